"""Benchmark decontamination by exact windows of words, in DataFrame operations only.

Every run of ``width`` consecutive words of a benchmark item is a window (a shorter item is one
window).  The windows become a hash set inside the scan of the documents: a position is a
candidate if a hash of three of its words is in the set, and a hit if the whole window is too.
While the set has at most ``SET_LIMIT`` windows it is part of the plan, as large as the benchmark
and not as the documents, and nothing is shuffled to find hits; a larger benchmark is joined on
the hash instead, window by window.  Spans or documents can then be removed.

Defined results: a null text has no words; an item without words has no window; repeated rows
are rows of their own; an item_id that is null marks hits but is not listed; an empty benchmark
hits nothing; very long texts are read whole; several items with one window are all listed; other
columns are ignored (or kept as they are, whatever their names, by ``remove_contaminated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import ascii_words, pinned, read_table

#: Windows up to which the set travels inside the plan.
SET_LIMIT = 100_000
#: A word of a text that has not been lower-cased: as WORD_PATTERN, and A-Z.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HIT = "array<struct<pos:int,w:int,window:string>>"


def _key(words: Column, pos: Column, w: Column | int) -> Column:
    w = F.lit(w) if isinstance(w, int) else w
    mid = F.floor(w / 2).cast("int")
    return F.xxhash64(words[pos], words[pos + mid], words[pos + w - 1], w)


def benchmark_windows(bench: DataFrame, width: int = 10) -> DataFrame:
    """(w, key, window, items) of each different window of the benchmark."""
    words = bench.select("item_id", ascii_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("w", F.least(F.lit(width), F.size("words")))
    at = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("pos"))
    rows = at.select("item_id", "w", _key(F.col("words"), F.col("pos"), F.col("w")).alias("key"), F.array_join(F.slice("words", F.col("pos") + 1, F.col("w")), " ").alias("window"))
    return rows.groupBy("w", "key", "window").agg(F.collect_set("item_id").alias("items"))


def _starts(words: Column, w: int) -> Column:
    n = F.size(words)
    return F.when(n >= w, F.sequence(F.lit(0), n - w)).otherwise(F.array().cast("array<int>"))


def with_hits(docs: DataFrame, windows: DataFrame, set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` with _words, and _hits: position, length and words of each window that occurs."""
    docs = pinned(docs, "_words", ascii_words(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # Counted before anything is collected: the branch below holds at most set_limit windows.
    if windows.count() > set_limit:
        return _joined_hits(docs, windows)
    found = windows.select("w", "key", "window").collect()
    hits = F.array().cast(HIT)
    for w in sorted({r["w"] for r in found}):
        own = [r for r in found if r["w"] == w]
        hits = F.concat(hits, _hits_of(F.col("_words"), w, sorted({r["key"] for r in own}), sorted({r["window"] for r in own})))
    return pinned(docs, "_hits", hits)


def _hits_of(words: Column, w: int, keys: list[int], texts: list[str]) -> Column:
    near = F.filter(_starts(words, w), lambda i: _key(words, i, w).isin(keys))
    full = F.transform(near, lambda i: _window(words, i, w))
    return F.filter(full, lambda x: x["window"].isin(texts))


def _window(words: Column, pos: Column, w: int) -> Column:
    return F.struct(pos.cast("int").alias("pos"), F.lit(w).alias("w"), F.array_join(F.slice(words, pos + 1, F.lit(w)), " ").alias("window"))


def _joined_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: windows are joined on their hash, not held in a set.

    ``docs`` must give the same rows in the same partitions when read again (a table does).
    """
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    widths = [r[0] for r in windows.select("w").distinct().collect()]  # at most ``width`` numbers
    words = F.col("_words")

    def of(w: int) -> Column:
        return F.transform(_starts(words, w), lambda i: F.struct(_key(words, i, w).alias("key"), _window(words, i, w).alias("x")))

    at = docs.select("_row", F.explode(F.flatten(F.array(*map(of, widths)))).alias("e"))
    at = at.select("_row", "e.key", "e.x.pos", "e.x.w", "e.x.window")
    hit = at.join(windows.select("w", "key", "window"), ["w", "key", "window"], "left_semi")
    hits = hit.groupBy("_row").agg(F.collect_list(F.struct("pos", "w", "window")).alias("_hits"))
    return docs.join(hits, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(HIT))).drop("_row")


def hit_words(hits: Column) -> Column:
    """Word positions inside any hit, ascending and distinct."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["w"] - 1)))))


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit and the sorted ids of the items that occur."""
    windows = benchmark_windows(bench, width)
    hit = with_hits(docs.select("doc_id", "text"), windows, set_limit)
    rows = hit.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.size(hit_words(F.col("_hits"))).cast("long").alias("n_hit"), F.array_distinct("_hits.window").alias("_windows"),
    )
    each = rows.select("_row", "doc_id", "n_words", "n_hit", F.explode_outer("_windows").alias("window"))
    named = each.join(windows.groupBy("window").agg(F.flatten(F.collect_list("items")).alias("items")), "window", "left")
    out = named.groupBy("_row", "doc_id", "n_words", "n_hit").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, width: int = 10, drop_share: float = 0.5, set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` without contaminated spans, and without documents that consist of them.

    A document of whose words at least ``drop_share`` are hit goes; from others the hit words go
    (what stood between them stays).  Documents without a hit keep their text as it is.
    """
    # The rows travel as one struct, so that no column of theirs meets one made here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_kept"), docs["text"].alias("text"))
    hit = pinned(with_hits(rows, benchmark_windows(bench, width), set_limit), "_at", hit_words(F.col("_hits")))
    hit = hit.where((F.size("_at") == 0) | (F.size("_at") < F.size("_words") * drop_share))
    words, gaps = F.regexp_extract_all("text", F.lit(CASED_WORD), F.lit(0)), F.split("text", CASED_WORD, -1)
    cut = pinned(pinned(hit, "_w", F.when(F.size("_at") > 0, words)), "_g", F.when(F.size("_at") > 0, gaps))
    # Spared words, each with the gap after it, from the first gap on.
    spared = F.array_except(F.sequence(F.lit(0), F.size("_w") - 1), "_at")
    kept = F.array_join(F.transform(spared, lambda i: F.concat(F.col("_w")[i], F.col("_g")[i + 1])), "")
    text = F.when(F.size("_at") > 0, F.concat(F.col("_g")[0], kept)).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col("_kept")[c].alias(c) for c in docs.columns])


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by the benchmark's windows of ten words."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS win
       FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS p
             FROM (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, p, k, array_to_string(w[p + 1 : p + k], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p
             FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
