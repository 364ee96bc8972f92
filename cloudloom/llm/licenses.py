"""License scans: ordered signature rules over words, in DataFrame operations only.

A document whose words contain none of the rules' keywords is done after one look.  In others
every keyword opens a window of words around it, with the keyword marked, and the window meets
only the rules of that keyword (a join with the rule table, whose size is fixed).  A match is an
interval of words; among matches of a document one that lies inside an interval of better rank is
suppressed.  Rules are made of license names and wordings, the more telling wording first.
Beside the rules stand a few base phrases whose every place counts.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.llm.common import ascii_words, read_table

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Score of a document with a base phrase.
BASE_SCORE = 0.95
#: Words looked at on either side of a keyword; no rule is longer.
REACH = 12

#: License names as patterns over words; '@' marks the keyword that gates the rule.
NAMES = [
    ("mit", "@mit license"), ("mit", "@mit expat license"), ("apache-2", "@apache(?: software)? license(?: version)? 2(?: 0)?"),
    ("apache-1.1", "@apache(?: software)? license(?: version)? 1 1"), ("bsd-2-clause", "(?:2|two) clause @bsd(?: license)?"),
    ("bsd-3-clause", "(?:3|three) clause @bsd(?: license)?"), ("bsd", "(?:modified |simplified |new )?@bsd(?: style)? license"),
    ("gpl-2", "(?:gnu )?@gpl(?: license)?(?: version)? v?2(?: 0)?"), ("gpl-3", "(?:gnu )?@gpl(?: license)?(?: version)? v?3(?: 0)?"),
    ("gpl-2", "gnu @general public license(?: version)? v?2"), ("gpl-3", "gnu @general public license(?: version)? v?3"),
    ("gpl", "gnu @general public license"), ("lgpl-2.1", "(?:gnu )?@lgpl(?: version)? v?2 1"), ("lgpl-3", "(?:gnu )?@lgpl(?: version)? v?3(?: 0)?"),
    ("lgpl", "gnu @lesser general public license"), ("agpl-3", "(?:gnu )?@agpl(?: version)? v?3(?: 0)?"), ("agpl", "gnu @affero general public license"),
    ("mpl-2", "@mozilla public license(?: version)? 2(?: 0)?"), ("mpl", "@mozilla public license"), ("epl-2", "@eclipse public license(?: version)? 2(?: 0)?"),
    ("epl-1", "@eclipse public license(?: version)? 1(?: 0)?"), ("isc", "@isc license"), ("zlib", "@zlib license"), ("boost-1", "@boost software license(?: version)? 1(?: 0)?"),
    ("cc-by-nc-nd", "@cc by nc nd(?: [1-4] [05])?"), ("cc-by-nc-sa", "@cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc", "@cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "@cc by nd(?: [1-4] [05])?"), ("cc-by-sa", "@cc by sa(?: [1-4] [05])?"), ("cc-by", "@cc by(?: [1-4] [05])?"), ("cc0", "@cc0(?: 1 0)?"),
    ("cc-by-sa", "@creative commons attribution share ?alike"), ("cc-by-nc", "@creative commons attribution non ?commercial"), ("cc-by", "@creative commons attribution"),
    ("unlicense", "(?:the )?@unlicense"), ("wtfpl", "@wtfpl"), ("artistic-2", "@artistic license(?: version)? 2(?: 0)?"), ("public-domain", "public @domain"),
    ("odbl", "@odbl(?: 1 0)?"), ("sil-ofl", "@sil open font license"),
]
#: Wordings around a name, from the most to the least telling, and their scores.
WORDINGS = [
    ("spdx license identifier {}", 0.99), ("licensed under (?:the )?(?:terms of (?:the )?)?{}", 0.97),
    ("(?:released|distributed|published|provided|available) under (?:the )?(?:terms of (?:the )?)?{}", 0.93),
    ("(?:subject|according) to (?:the )?(?:terms of (?:the )?)?{}", 0.9), ("under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}", 0.85),
    ("see (?:the )?{}(?: for details)?", 0.8), ("{} (?:text|notice|terms|header|applies)", 0.75), ("{}", 0.6),
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """(rank, keyword, pattern, label, score) of every rule, the best rank first."""
    made = [(wording, name, label, score) for wording, score in WORDINGS for label, name in NAMES]
    return [(k, name.split("@")[1].split(" ")[0].split("(")[0], f" {wording.format(name)} ", label, score) for k, (wording, name, label, score) in enumerate(made)]


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    n = F.size(words)
    at = F.when(n >= len(parts), F.sequence(F.lit(0), n - len(parts))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        same = words[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (words[i + k] == part)
        return same

    return F.filter(at, here)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def license_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: base places, and the windows around keywords."""
    words, line = F.col("_words"), F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", ascii_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_words"))
    rows = rows.withColumn("_line", F.when(F.arrays_overlap(words, F.array(*[F.lit(p.split()[0]) for p, _ in BASE])), line))
    none = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"_at{k}", F.when(F.contains(F.col("_line"), F.lit(f" {phrase} ")), _phrase_starts(words, phrase)).otherwise(none))
    keywords = sorted({r[1] for r in rules()})
    anchors = F.when(
        F.arrays_overlap(words, F.array(*map(F.lit, keywords))),
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i].isin(keywords)),
    ).otherwise(none)

    def window(i: Column) -> Column:
        first = F.greatest(i - REACH, F.lit(0))
        before, after = F.slice(words, first + 1, i - first), F.slice(words, i + 1, F.lit(REACH + 1))
        text = F.concat(F.lit(" "), F.array_join(before, " "), F.when(i > 0, " ").otherwise(""), F.lit("@"), F.array_join(after, " "), F.lit(" "))
        return F.struct(first.alias("first"), words[i].alias("keyword"), text.alias("text"))

    places = F.concat(*[f"_at{k}" for k in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    return rows.select(
        "_row", "doc_id", F.size("_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"), F.transform(anchors, window).alias("_windows"),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base places and, per row of ``docs``, the detections that no better one contains."""
    own = ["_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    names = ("rank", "keyword", "pattern", "label", "score")
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in rules()])
    table = docs.sparkSession.range(1).select(F.inline(table))  # a fixed number of rows
    each = license_rows(docs).select(*own, F.explode_outer("_windows").alias("w"))
    met = each.join(F.broadcast(table), (F.col("w.keyword") == F.col("keyword")) & F.expr("w.text rlike pattern"), "left")
    match = F.expr("regexp_extract(w.text, pattern, 0)")
    start = F.col("w.first") + _spaces(F.expr("substring(w.text, 1, locate(regexp_extract(w.text, pattern, 0), w.text) - 1)"))
    found = met.select(*own, "rank", "label", "score", start.alias("start"), (start + _spaces(match) - 1).alias("stop"))
    near = Window.partitionBy("_row").orderBy(F.coalesce("start", F.lit(0))).rangeBetween(-2 * REACH, 2 * REACH)
    around = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "start", "stop"))).over(near)
    beaten = F.exists("_near", lambda e: (e["start"] <= F.col("start")) & (e["stop"] >= F.col("stop")) & (e["rank"] < F.col("rank")))
    kept = F.col("rank").isNotNull() & ~F.col("_beaten")
    judged = found.withColumn("_near", around).withColumn("_beaten", beaten)
    hit = F.struct("start", "stop", "rank", "label", "score")
    return judged.groupBy(*own).agg(F.array_sort(F.collect_set(F.when(kept, hit))).alias("detections")).drop("_row")


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """Base places and license labels of all documents."""
    rows = scan_licenses(read_table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "detections.label")))
    score = F.greatest(F.coalesce(F.array_max("detections.score"), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {quoted(kw)}, {quoted(p)}, {quoted(label)}, CAST({s} AS DOUBLE))" for k, kw, p, label, s in rules())
    places = " UNION ALL ".join(
        f"SELECT doc_id, p, {quoted(label)} AS label FROM (SELECT doc_id, w, unnest(range(0, len(w) - {len(ph.split())} + 1)) AS p FROM d) WHERE array_to_string(w[p + 1 : p + {len(ph.split())}], ' ') = {quoted(ph)}"
        for ph, label in BASE
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r(rank, keyword, pattern, label, score) AS (VALUES {table}),
b AS ({places}),
ba AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
a AS (SELECT doc_id, w, p, greatest(p - {REACH}, 0) AS f, w[p + 1] AS keyword FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d) WHERE w[p + 1] IN (SELECT keyword FROM r)),
t AS (SELECT doc_id, f, keyword, ' ' || array_to_string(w[f + 1 : p], ' ') || CASE WHEN p > 0 THEN ' ' ELSE '' END || '@' || array_to_string(w[p + 1 : p + {REACH + 1}], ' ') || ' ' AS win FROM a),
m AS (SELECT doc_id, f, win, rank, label, score, regexp_extract(win, pattern) AS g FROM t JOIN r USING (keyword) WHERE regexp_matches(win, pattern)),
s AS (SELECT DISTINCT doc_id, rank, label, score, f + len(q) - len(replace(q, ' ', '')) AS x, f + len(q) - len(replace(q, ' ', '')) + len(g) - len(replace(g, ' ', '')) - 1 AS y
      FROM (SELECT *, substr(win, 1, strpos(win, g) - 1) AS q FROM m)),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s e WHERE e.doc_id = s.doc_id AND e.x <= s.x AND e.y >= s.y AND e.rank < s.rank)),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM (SELECT doc_id, label, score FROM k UNION ALL SELECT doc_id, label, {BASE_SCORE} FROM b) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(ba.n, 0) AS BIGINT) AS n_base, CAST(ba.lo AS BIGINT) AS first_word, CAST(ba.hi AS BIGINT) AS last_word,
       coalesce(ba.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CAST(coalesce(l.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP8_SQL = _sql()
