"""Sources and sinks: hit tables, JSON rows, CSV catalogs, parameter-keyed result tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("file_tag", T.StringType()), ("event_id", T.IntegerType()), ("hit_id", T.LongType()), ("x", T.FloatType()), ("y", T.FloatType()), ("z", T.FloatType()), ("energy", T.FloatType()),
        ("io_group", T.ShortType()), ("tpc", T.ShortType()), ("labels", T.IntegerType()), ("t0", T.FloatType()), ("t0_phase1", T.FloatType()), ("truth_t0", T.FloatType()),
    )]
)
FAILURES = "file string, event int, lab_a int, lab_b int, e_a double, e_b double, old_end_dist double, old_angle double, reason string"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits as doubles, with the cell derived from io_group where it is missing, and energy clipped."""
    h = spark.read.schema(HITS).parquet(path)
    cell = F.coalesce(F.col("tpc").cast("int"), F.floor((F.col("io_group") - 1) / 2).cast("int"))
    return h.withColumns({c: F.col(c).cast("double") for c in "xyz"} | {"tpc": cell, "e": F.greatest(F.col("energy").cast("double"), F.lit(0.0)), "label": F.col("labels").cast("long")})


def read_events(spark: SparkSession, path: str, per_file: int | None = None) -> DataFrame:
    """(file_tag, event_id) of a hit table, at most ``per_file`` of each file."""
    from cloudloom.operators.audit import events_up_to

    e = read_hits(spark, path).select("file_tag", "event_id").distinct()
    return events_up_to(e, per_file) if per_file else e


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as a struct of a given schema (null where it does not parse)."""
    return df.withColumn(column, F.from_json(column, schema))


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the file they came from."""
    return spark.read.schema(schema).json(path).withColumn("source_file", F.input_file_name())


def convert(rows: DataFrame, outside: DataFrame) -> DataFrame:
    """Converter rows (lab_rows and cluster_conf as JSON text) joined with outside rows on file and event."""
    labels = "array<struct<label:int,type:string,tpcs:array<int>,e_ok:double,e_wrong:double,reco_t0:double,truth:double>>"
    conf = "map<string,struct<z_min:double,z_own:double,chi2_loc:double,E:double,n_tpc:int>>"
    return parse_json(parse_json(rows, "lab_rows", labels), "cluster_conf", conf).join(outside, ["file_tag", "event_id"], "left")


def clusters(converted: DataFrame) -> DataFrame:
    """One row a cluster of converted rows."""
    c = converted.select("file_tag", "event_id", "split_index", "cluster_conf", F.explode("lab_rows").alias("r")).select("*", "r.*").drop("r")
    known = F.col("cluster_conf")[F.col("label").cast("string")]
    return c.withColumns({"backbone": F.col("label") < F.col("split_index"), "confidence": known}).drop("cluster_conf")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURES).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_parameters(path_or_dict) -> dict:
    """Parameters of a JSON file (driver side) or a dict."""
    if isinstance(path_or_dict, dict):
        return dict(path_or_dict)
    with open(path_or_dict) as f:
        return json.load(f)


def result_key(parameters: dict) -> str:
    return hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:10]


def cached(spark: SparkSession, root: str, parameters: dict, make) -> DataFrame:
    """The table of these parameters under ``root``: read where it is complete, else made and written."""
    path = f"{root.rstrip('/')}/params={result_key(parameters)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
