"""Job: scores of a labelling of documents, kept up to date as files of documents arrive.

The clustering scores ask whether what shares a label shares its truth, weighted by size.  Here
documents are the hits, their characters the energy, one column is the label (``source``) and one the
truth (``lang``): which sources are of one language, what do the others mix, how much is without
either.  A file stream hands over only files that no earlier run has taken; each micro-batch becomes a
partial contingency table, and the catalog is made of the partials alone.

    spark-submit jobs/label_watch.py --input DOCS --output OUT --checkpoint CKPT [--config FILE]

``--input`` is a Parquet folder to which files are added, or a pattern of them, ``--output`` gets ``partials`` (one folder for
each batch), ``catalog`` (a row for each label, partitioned by shard) and ``scores`` (one row), and
``--checkpoint`` is the stream's.  Configuration: ``label``, ``group`` (columns), ``max_files`` (of a
micro-batch), ``shards`` (of the catalog).

Output and checkpoint belong together: start both anew or neither. Rerunning takes what is new and is safe at any point: a batch that is tried again replaces its own
partial, and the catalog and scores are made anew from all partials.  Null labels are noise, null
groups are without truth, null texts have no characters; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators.incremental import event_scores, label_catalog, merged, partial_contingency
from jobs.common import command_line, configuration, logger, run_folder

PARTIAL = "label string, g string, e decimal(38,9), n long, batch long"
CATALOG = "label string, n long, e double, e_truth double, dom string, e_dom double, purity double, e_foreign double, n_groups long, top_foreign string, shard int"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take the new files of ``source``, bring ``target`` up to date and return its catalog."""
    config, log = config or configuration(__file__), logger("label_watch")

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(config["label"]).cast("string").alias("label"), F.col(config["group"]).cast("string").alias("g"), F.length("text").alias("e"))
        path = f"{target}/partials/batch={number}"
        partial_contingency(rows, []).write.mode("overwrite").parquet(path)
        sums = batch.sparkSession.read.schema(PARTIAL).parquet(path)
        log.info("batch %d: read %d documents, wrote %d sums", number, *sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())

    schema = f"text string, `{config['label']}` string, `{config['group']}` string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files"]).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    # A first run without any file leaves no partials; the folder then has to exist to be read.
    spark.createDataFrame([], PARTIAL).write.mode("append").partitionBy("batch").parquet(f"{target}/partials")
    table = merged(spark.read.schema(PARTIAL).parquet(f"{target}/partials"), [])
    labels = label_catalog(table, []).withColumn("shard", F.pmod(F.crc32("label"), F.lit(config["shards"])).cast("int"))
    labels.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{target}/catalog")
    event_scores(table, []).write.mode("overwrite").parquet(f"{target}/scores")
    catalog = spark.read.schema(CATALOG).parquet(f"{target}/catalog")
    log.info("wrote %d labels to %s/catalog", catalog.count(), target)
    return catalog


def job2_label_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job, run twice with one new folder and checkpoint, over all documents."""
    folder = run_folder(spark, "label_watch")
    source = f"{sf_dir.rstrip('/')}/documents.parque[t]"  # a file stream takes a single file by a pattern only
    for _ in range(2):
        out = run(spark, source, folder, f"{folder}/checkpoint")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "shard"])


SQL = """WITH c AS (SELECT source AS label, lang AS g, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS e, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN g IS NULL THEN 1 ELSE 0 END, e DESC, g) AS k FROM c)
SELECT label, CAST(sum(n) AS BIGINT) AS n, sum(e) AS e, coalesce(sum(e) FILTER (g IS NOT NULL), 0) AS e_truth, max(g) FILTER (k = 1) AS dom, coalesce(max(e) FILTER (k = 1 AND g IS NOT NULL), 0) AS e_dom,
 round(CASE WHEN sum(e) FILTER (g IS NOT NULL) > 0 THEN max(e) FILTER (k = 1) / sum(e) FILTER (g IS NOT NULL) END, 6) AS purity,
 coalesce(sum(e) FILTER (g IS NOT NULL AND k > 1), 0) AS e_foreign, count(g) AS n_groups, coalesce(string_agg(g, ';' ORDER BY k) FILTER (k BETWEEN 2 AND 3 AND g IS NOT NULL), '') AS top_foreign
FROM k GROUP BY label"""


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], run, __file__, "input", "output", "checkpoint")
