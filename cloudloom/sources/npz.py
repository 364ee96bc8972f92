"""Event dumps as compressed array files (.npz), one event a file, read by Spark's binary file source.

Files may lie anywhere Spark can read; each is opened in a task, of its arrays only the wanted ones are unpacked, and a wish
for some file tags is a pattern on the names, so other files are not even listed into tasks.  The file tag and the event
number come from the name, ``<tag>_ev<event>.npz``.

Defined results: an array a file lacks gives nulls; arrays of unequal length in one file, and files that are no archives, are
errors that name the file; pickled objects are never loaded; an event without hits has a row of its own among
the events and none among the hits; a folder without files gives no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.sources.readers import clusters, convert

#: Names of arrays in a dump and of the hit columns made of them, with their types.
ARRAYS = {
    "x": ("x", "float"), "y": ("y", "float"), "z": ("z", "float"), "energy": ("e", "float"), "io_group": ("io_group", "smallint"), "tpc": ("tpc", "smallint"), "labels": ("labels", "int"),
    "t0": ("ts_final", "float"), "t0_phase1": ("ts_p1", "float"), "truth_t0": ("truth_t0", "float"),
}
#: Entries that hold one value an event.
SCALARS = {"lab_rows": "string", "cluster_conf": "string", "split_index": "int", "src_file": "string", "event": "int"}
_KINDS = {"float": "f4", "smallint": "i2", "int": "i4"}
NAME = r"([^/]+)_ev(\d+)\.npz$"


def npz_files(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(path, content, file_tag, event_id) of the dumps under ``path``, of all tags or the given ones."""
    pattern = "*_ev*.npz" if tags is None else "{" + ",".join(re.sub(r"([*?\[\]{},\\])", r"\\\1", t) for t in tags) + "}_ev*.npz"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", F.regexp_extract("path", NAME, 1).alias("file_tag"), F.regexp_extract("path", NAME, 2).cast("int").alias("event_id"))


def _archive(path: str, content: bytes):
    try:
        return np.load(io.BytesIO(content), allow_pickle=False)
    except Exception as e:
        raise ValueError(f"{path} is no array archive") from e


def read_npz_hits(spark: SparkSession, path: str, columns: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """(file_tag, event_id, hit_id, columns): a row for each hit; ``columns`` are names of ``ARRAYS``, all by default."""
    wanted = list(ARRAYS) if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, tag, event in zip(*[batch.column(k) for k in range(4)], strict=True):
                with _archive(name.as_py(), content.as_buffer()) as d:
                    held = {c: d[ARRAYS[c][0]] for c in wanted if ARRAYS[c][0] in d.files}
                    n = {len(v) for v in held.values()} or {len(d[f]) for f in d.files if d[f].ndim == 1}
                if len(n) > 1:
                    raise ValueError(f"{name.as_py()} has arrays of unequal length")
                n = n.pop() if n else 0
                cols = [pa.array([tag.as_py()] * n, pa.string()), pa.array(np.full(n, event.as_py(), np.int32)), pa.array(np.arange(n))]
                for c in wanted:
                    kind = _KINDS[ARRAYS[c][1]]
                    cols.append(pa.array(held[c].astype(kind)) if c in held else pa.nulls(n, pa.from_numpy_dtype(np.dtype(kind))))
                yield pa.RecordBatch.from_arrays(cols, names=["file_tag", "event_id", "hit_id", *wanted])

    schema = ["file_tag string", "event_id int", "hit_id long", *[f"{c} {ARRAYS[c][1]}" for c in wanted]]
    return npz_files(spark, path, tags).mapInArrow(run, ", ".join(schema))


def read_npz_events(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(file_tag, event_id, SCALARS): a row for each file; texts stay JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                with _archive(name.as_py(), content.as_buffer()) as d:
                    rows.append([d[s].item() if s in d.files else None for s in SCALARS])
            cols = [batch.column(2), batch.column(3)]
            for k, kind in enumerate(SCALARS.values()):
                cast = str if kind == "string" else int
                cols.append(pa.array([None if r[k] is None else cast(r[k]) for r in rows], pa.string() if kind == "string" else pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=["file_tag", "event_id", *SCALARS])

    return npz_files(spark, path, tags).mapInArrow(run, ", ".join(["file_tag string", "event_id int", *[f"{k} {v}" for k, v in SCALARS.items()]]))


def convert_dumps(spark: SparkSession, path: str, target: str, outside: DataFrame | None = None, tags: list[str] | None = None) -> DataFrame:
    """Write ``target``/hits and ``target``/clusters, one folder for each dump; returns the events that were converted.

    ``outside`` has (file_tag, event_id) and more columns of events, as from JSON lines.  Folders of dumps at hand are
    replaced, others stay, so a run over some tags or a repeated one leaves the rest as it is.
    """
    keys = ["file_tag", "event_id"]
    events = read_npz_events(spark, path, tags)
    bare = outside if outside is not None else events.select(*keys).limit(0)
    rows = convert(events, bare)
    for name, df in (("hits", read_npz_hits(spark, path, tags=tags)), ("clusters", clusters(rows))):
        df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{target}/{name}")
    return rows.drop("lab_rows", "cluster_conf")
