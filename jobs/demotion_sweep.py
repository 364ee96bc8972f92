"""Job: how purity, completeness and noise change when labels of few hits are demoted to noise.

Who tunes a clustering wants, for each event and each threshold, the scores and the labels that
remain, worst first.  The job reads a hit table, applies every threshold of the configuration, and
writes one row for each label with its event's scores, partitioned by threshold and event.

    spark-submit jobs/demotion_sweep.py --input DATA --output OUT [--config FILE]

``--input`` is a folder with the hit table, ``--output`` the folder to write.  Configuration:
``least_hits`` (thresholds: labels of fewer hits become noise), ``events`` (null: all, or a list),
``tracks_below`` (labels below it count as tracks) and ``files_per_partition``.

Rerunning replaces the partitions of the events and thresholds at hand and leaves others: the
same input and configuration give the same output, and a run that was cut off is just run again.  Each
threshold is counted from the same contingency table, so hits are read once whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators.graph import stored
from cloudloom.operators.incremental import event_scores, label_catalog, partial_contingency
from cloudloom.operators.metrics import swept
from cloudloom.sources.bindings import line_hits
from jobs.common import command_line, configuration, logger, run_folder

SCHEMA = """label long, n long, e double, e_truth double, dom long, purity double, e_foreign double, n_groups long, top_foreign string, kind string,
 ev_e double, ev_noise double, ev_purity double, ev_completeness double, ev_labels long, ev_groups long, least_hits int, ev int"""


def sweep(table: DataFrame, least_hits: list[int], tracks_below: int) -> DataFrame:
    """Rows (SCHEMA) of every label that remains at every threshold, with the scores of its event, from a contingency table."""
    sizes = table.where("label is not null").groupBy("ev", "label").agg(F.sum("n").alias("size"))
    variants = swept(table.join(sizes, ["ev", "label"], "left"), "least_hits", least_hits)
    cut = variants.withColumn("label", F.when(F.col("size") >= F.col("least_hits"), F.col("label"))).groupBy("least_hits", "ev", "label", "g").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    keys = ["least_hits", "ev"]
    scores = event_scores(cut, keys).select(*keys, F.col("e").alias("ev_e"), F.col("e_noise").alias("ev_noise"), F.col("purity").alias("ev_purity"), F.col("completeness").alias("ev_completeness"), F.col("n_labels").alias("ev_labels"), F.col("n_groups").alias("ev_groups"))
    labels = label_catalog(cut, keys).withColumn("kind", F.when(F.col("label") < tracks_below, "track").otherwise("blob"))
    return labels.join(scores, keys)


def run(spark: SparkSession, source: str, target: str, config: dict | None = None) -> DataFrame:
    """Read the hits of ``source``, write the sweep to ``target`` and return what stands there."""
    config, log = config or configuration(__file__), logger("demotion_sweep")
    hits = line_hits(spark, source).select("ev", "label", "g", "e")
    if config["events"] is not None:
        hits = hits.where(F.col("ev").isin(config["events"]))
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    table = stored(partial_contingency(hits.withColumns({"label": known("label"), "g": known("g")}), ["ev"]))
    log.info("read %d hits of %d events from %s", *table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("ev")).first(), source)
    columns = [c.split()[0] for c in SCHEMA.replace("\n", "").split(",")]
    rows = stored(sweep(table, config["least_hits"], config["tracks_below"]).select(*columns))
    # An event may hold most labels: its rows are dealt over as many files as configured.
    part = F.pmod(F.xxhash64("label"), F.lit(config["files_per_partition"]))
    rows.repartition("least_hits", "ev", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("least_hits", "ev").parquet(f"{target}/labels")
    log.info("wrote %d labels to %s/labels", rows.count(), target)
    return spark.read.schema(SCHEMA).parquet(f"{target}/labels")


def job1_demotion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice into one new folder, over all hits."""
    target = run_folder(spark, "demotion_sweep")
    run(spark, sf_dir, target)
    return _rounded(run(spark, sf_dir, target))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SQL = """WITH h AS (SELECT CAST(l_orderkey % 8 AS INTEGER) AS ev, l_partkey % 200 AS label, CAST(l_suppkey % 10 AS BIGINT) AS g, greatest(coalesce(l_extendedprice / 1000, 0), 0) AS e FROM lineitem),
z AS (SELECT ev, label, count(*) AS size FROM h GROUP BY ALL), v AS (SELECT unnest([1, 4, 40]) AS least_hits),
c AS (SELECT least_hits, ev, CASE WHEN size >= least_hits THEN label END AS label, g, sum(e) AS e, count(*) AS n FROM h JOIN z USING (ev, label), v GROUP BY ALL),
w AS (SELECT least_hits, ev, sum(e) AS ev_e, coalesce(sum(e) FILTER (label IS NULL), 0) AS ev_noise FROM c GROUP BY ALL),
l AS (SELECT least_hits, ev, label, CAST(sum(n) AS BIGINT) AS n, sum(e) AS e, arg_min(g, (-e, g)) AS dom, max(e) AS top, count(*) AS n_groups FROM c WHERE label IS NOT NULL GROUP BY ALL),
k AS (SELECT least_hits, ev, label, g, row_number() OVER (PARTITION BY least_hits, ev, label ORDER BY e DESC, g) AS k FROM c WHERE label IS NOT NULL),
t AS (SELECT least_hits, ev, label, coalesce(string_agg(CAST(g AS VARCHAR), ';' ORDER BY k) FILTER (k BETWEEN 2 AND 3), '') AS top_foreign FROM k GROUP BY ALL),
p AS (SELECT least_hits, ev, sum(top) / sum(e) AS ev_purity, count(*) AS ev_labels FROM l GROUP BY ALL),
q AS (SELECT least_hits, ev, sum(top) / sum(e) AS ev_completeness, count(*) AS ev_groups FROM (SELECT least_hits, ev, g, max(e) AS top, sum(e) AS e FROM c WHERE label IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT label, n, round(e, 6) AS e, round(e, 6) AS e_truth, dom, round(top / e, 6) AS purity, round(e - top, 6) AS e_foreign, n_groups, top_foreign, CASE WHEN label < 50 THEN 'track' ELSE 'blob' END AS kind,
 round(ev_e, 6) AS ev_e, round(ev_noise, 6) AS ev_noise, round(ev_purity, 6) AS ev_purity, round(ev_completeness, 6) AS ev_completeness, ev_labels, ev_groups, least_hits, ev
FROM l JOIN t USING (least_hits, ev, label) JOIN w USING (least_hits, ev) JOIN p USING (least_hits, ev) JOIN q USING (least_hits, ev)"""


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], run, __file__, "input", "output")
