"""Personal data: exact patterns, and terms that give protected values away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Then comes
information-theoretic sanitisation: a found value is a protected entity, all words of the
documents that hold it are terms, and over the whole corpus the pointwise mutual information of a
term and an entity says how much of the entity's information (-log2 of its document frequency)
the term discloses.  A term that discloses at least ``threshold`` of it, seen in at least
``support`` different contexts, is a span of its own wherever it occurs, in any document; in texts
it is removed where it discloses all, else generalised.

Document frequencies are exact, of every term; counts are aggregated map-side; terms too frequent
to tell any value never meet one; a copied context counts once.

Defined results: a null or empty text has no spans; very long texts are read whole; spans of equal
start are in the order of kinds; repeated rows are rows of their own; an empty table gives no
rows; other columns are ignored (or kept, by ``sanitise``).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import checkpoint, fresh, read_table

#: Kinds in the order of ties, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
#: Words on either side of a term that make its context.
WORDS = 6
#: Terms that a task counts before it passes them on.
MOST_TERMS = 200_000
BROADCAST_ROWS = 200_000
SPAN = "struct<kind:string,start:int,end:int>"
TOLD = "array<struct<term:string,share:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from each '@' outwards (a scan from the left would be quadratic)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match that holds, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """Distinct values of the spans, as kind:value."""
    out = set()
    for s, k, e in spans:
        value = text[s:e].lower() if k == 0 else re.sub(r"[^0-9.]" if k == 1 else "[^0-9]", "", text[s:e])
        out.add(f"{KINDS[k]}:{value}")
    return sorted(out)


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of ``text`` that are in no span."""
    words = [(m[0].lower(), m.start(), m.end()) for m in TERM.finditer(text)]
    if not spans:
        return words
    starts = np.array([s for s, _, _ in spans])
    reach = np.maximum.accumulate(np.array([e for _, _, e in spans]))
    last = (np.searchsorted(starts, np.array([e for _, _, e in words], np.int64)) - 1).tolist()  # the last span that starts before the word ends
    return [w for w, j in zip(words, last, strict=True) if j < 0 or reach[j] <= w[1]]


def contexts(words: list[tuple[str, int, int]], common: frozenset[str], most: int) -> dict[str, list[int]]:
    """The ``most`` least different contexts, the words on either side, of each term but the common ones."""
    names = [w[0] for w in words]
    out: dict[str, set[int]] = {}
    for k, name in enumerate(names):
        if name not in common:
            near = " ".join(names[max(0, k - WORDS) : k + WORDS + 1])
            out.setdefault(name, set()).add(int.from_bytes(hashlib.blake2b(near.encode(), digest_size=8).digest(), "little", signed=True))
    return {name: sorted(c)[:most] for name, c in out.items()}


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col("text").cast("string").alias("text"))


def find_values(docs: DataFrame) -> DataFrame:
    """(_row, text, entities) of the rows of ``docs`` that hold base values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = [], []
            for k, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                spans = base_spans(text)
                if spans:
                    at.append(k)
                    held.append(entities(text, spans))
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(held, pa.list_(pa.string()))], names=["_row", "text", "entities"])

    return _numbered(docs).mapInArrow(run, "_row long, text string, entities array<string>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df): number of documents with each term, over all of ``docs``; added up in each partition first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update({w.lower() for w in set(TERM.findall(t.as_py() or ""))})
                if len(total) > MOST_TERMS:
                    yield out()
                    total.clear()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosures(docs: DataFrame, threshold: float = 0.95, support: int = 3) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``threshold`` of an entity.

    A term and an entity are together in a document wherever in it they stand.  A term that is too
    frequent for all entities (even if it were in all their documents) is left out beforehand.
    """
    found = checkpoint(find_values(docs))
    total = docs.count()
    values = checkpoint(found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_df")))
    most = values.agg(F.max("entity_df")).first()[0]
    if most is None:
        return values.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("share"))
    bound = lambda n: F.lit(total * (1 + 1e-9)) * F.pow(n / F.lit(total + 1.0), F.lit(threshold))
    counts = checkpoint(term_counts(docs))
    frequent = counts.where(F.col("df") > bound(F.lit(most))).orderBy(F.desc("df")).limit(BROADCAST_ROWS)
    common = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in frequent.select("term").collect()))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids, terms, marks = [], [], []
                for row, t in zip(batch.column(0).slice(k, 500).to_pylist(), batch.column(1).slice(k, 500), strict=True):
                    text = t.as_py()
                    own = contexts(outside(text, base_spans(text)), common.value, support)
                    ids += [row] * len(own)
                    terms += own
                    marks += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(marks, pa.list_(pa.int64()))], names=["_row", "term", "contexts"])

    terms = found.select("_row", "text").mapInArrow(around, "_row long, term string, contexts array<long>")
    rare = counts.where(F.col("df") <= bound(F.lit(most)))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    terms = terms.join(small(rare), "term").where((F.col("df") > 1) | (F.size("contexts") >= support))
    held = found.select("_row", F.explode("entities").alias("entity")).join(small(values), "entity")
    both = checkpoint(terms.join(held, "_row").where(F.col("df") <= bound(F.col("entity_df"))).select("entity", "term", "df", "entity_df", "_row", "contexts"))
    names = ["entity", "term"]
    met = both.groupBy(*names).agg(F.count(F.lit(1)).alias("together"), F.first("df").alias("df"), F.first("entity_df").alias("entity_df"))
    pmi = F.log2(F.col("together") * total / (F.col("df") * F.col("entity_df")))
    share = pmi / F.log2((F.lit(total) + 1) / F.col("entity_df"))
    telling = met.select(*names, share.alias("share")).where(F.col("share") >= threshold)
    different = both.select(*names, F.explode("contexts").alias("c")).distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    return telling.join(different, names, "left_semi")


def _with_telling(docs: DataFrame, threshold: float, support: int) -> tuple[DataFrame, Callable[[pa.Scalar], dict[str, float]]]:
    """``docs`` with one more, last column, and what reads the telling terms (term: share) of a row from it.

    They are broadcast up to ``BROADCAST_ROWS``; beyond, each row is joined with its own, for
    which ``docs`` must give the same rows in the same partitions when read again (a table does).
    """
    told = checkpoint(disclosures(docs, threshold, support).groupBy("term").agg(F.max("share").alias("share")))
    names, (telling, at) = docs.columns, fresh(docs, "_told", "_at")
    if told.count() <= BROADCAST_ROWS:
        shared = docs.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in told.collect()})
        return docs.select(*names, F.array().cast(TOLD).alias(telling)), lambda own: shared.value

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sorted({w.lower() for w in set(TERM.findall(t.as_py() or ""))})
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array(own, pa.string())], names=["_row", "term"])

    own = _numbered(docs).mapInArrow(words, "_row long, term string").join(told, "term").groupBy("_row").agg(F.collect_list(F.struct("term", "share")).alias("_told"))
    rows = docs.withColumn(at, F.monotonically_increasing_id()).join(own.select(F.col("_row").alias(at), F.col("_told").alias(telling)), at, "left")
    return rows.select(*names, telling), lambda own: {x["term"]: x["share"] for x in own.as_py() or []}


def find_personal_data(docs: DataFrame, threshold: float = 0.95, support: int = 3) -> DataFrame:
    """doc_id, base spans and the method's term spans for each row of ``docs``."""
    rows, known = _with_telling(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), threshold, support)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, terms = [], []
            for t, own in zip(batch.column(1), batch.column(2), strict=True):
                text, told = t.as_py() or "", known(own)
                spans = base_spans(text)
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                terms.append([{"kind": "term", "start": s, "end": e} for name, s, e in outside(text, spans) if name in told] if told else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(terms, span)], names=["doc_id", "base", "terms"])

    return rows.mapInArrow(run, f"doc_id long, base array<{SPAN}>, terms array<{SPAN}>")


def sanitise_text(text: str, told: dict[str, float], remove_at: float = 0.999) -> str:
    """``text`` with values and telling terms generalised to their kind, or terms removed."""
    spans = base_spans(text)
    edits = [(s, e, f"<{KINDS[k].upper()}>") for s, k, e in spans]
    if told:
        edits += [(s, e, "" if told[name] >= remove_at else "<TERM>") for name, s, e in outside(text, spans) if name in told]
    out, at = [], 0
    for s, e, put in sorted(set(edits)):
        if s >= at:
            out += [text[at:s], put]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, threshold: float = 0.95, support: int = 3) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; no row is dropped."""
    names = docs.columns
    rows, known = _with_telling(docs, threshold, support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            own = batch.column(batch.num_columns - 1)
            texts = [None if t.as_py() is None else sanitise_text(t.as_py(), known(o)) for t, o in zip(batch.column(k), own, strict=True)]
            cols = [pa.array(texts, pa.string()) if i == k else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, docs.schema)


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base counts and digest, and all spans."""
    rows = find_personal_data(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        place = lambda x: F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "term"]]), x["kind"])
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"))
