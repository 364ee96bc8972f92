"""Roles of the driver's tables: labelled hits, 3-D points and a large hit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Columns that tell the place of a row among the files of its table.
PLACE = ["file", "row"]


def event_hits(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """events as hits: ev is the hour modulo 4, label the user, g the event type's first letter, t seconds; ``placed``: with ``PLACE``."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.pmod(F.floor(micros / 3_600_000_000), F.lit(4)).cast("int").alias("ev"), F.col("event_id").alias("hit_id"),
        F.when(F.col("user_id") % 13 == 0, -1).otherwise(F.col("user_id")).alias("label"),
        F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.ascii("event_type")).cast("long").alias("g"),
        F.greatest(F.col("value"), F.lit(0.0)).alias("e"), (F.col("event_id") % 8).cast("int").alias("tpc"), micros.alias("t"),
        *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []),
    )


def point_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: three of their numbers, scaled to centimetres."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("ev"), F.col("vec_id").alias("hit_id"), *[(v[k].cast("double") * 100).alias(c) for k, c in enumerate("xyz")],
        (F.abs(v[3].cast("double")) * 10).alias("e"), F.col("label").cast("long").alias("g"), (F.col("vec_id") % 4).cast("int").alias("tpc"), (F.col("vec_id") % 7).alias("label"),
    )


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a large hit table: ev by order, label the part, cell the line number."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        (F.col("l_orderkey") % 8).cast("int").alias("ev"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("hit_id"), (F.col("l_partkey") % 200).alias("label"),
        (F.col("l_suppkey") % 10).cast("long").alias("g"), (F.col("l_extendedprice") / 1000).alias("e"), F.col("l_linenumber").cast("int").alias("tpc"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("t0"),
    )
