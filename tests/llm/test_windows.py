"""Concatenate and cut: exact round trips against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cloudloom.llm import packing, windows

from .conftest import EDGES
from .test_operators import texts

ODD = ["", " \n ", "It's 12,345.67% DON'T 'S", "a\x01b", "<|endoftext|> x<|startoftext|>", "naïve ÉCOLE ßtraße", "Привет 漢字 😀", "é x ́y", "İstanbul ΑΣ", "a\xa0b\x85c\x1cd", "x" * 3000, "!?!?' 's"]


def test_both_tokenizers_agree():
    both, rng = windows.tokenizer(), random.Random(5)
    low = [f"a{c}b {c}{c} 1{c}2 {c}'s it{c}s 'S{c}" for c in map(chr, range(0x130))]
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x130), 32])) for _ in range(60)) for _ in range(400)]
    for t in [*texts(40), *ODD, *low, *mixed]:
        assert both(t) == both.full.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("total", [0, 1, 15, 16, 17, 47, 64, 79])
def test_cuts_are_full_windows_and_powers_of_two(total):
    cuts = windows.Cuts(total, 16)
    at = np.arange(total)
    w = cuts.window(at)
    sizes = np.bincount(w) if total else np.array([], int)
    assert all(s == 16 for s in sizes[: total // 16]) and all(s & (s - 1) == 0 and s > 0 for s in sizes)
    assert (cuts.start(w) <= at).all() and (at < cuts.start(w + 1)).all()


@pytest.mark.parametrize("width", [16, 64])
def test_windows_hold_the_documents(spark, frame, width):
    docs = [(i, t) for i, t in enumerate(texts(70, 2, 1, 90) + ODD)] + [(99, None), (7, "a repeated id")]
    packed = windows.concatenate_and_cut(frame(docs), max_tokens=width, with_ids=True)
    rows, encode = packed.collect(), windows.tokenizer()
    want = sorted((i, tuple(encode(t or "")) + (2,)) for i, t in docs)
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        by.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    assert sorted(by) == list(range(len(by)))
    # All pieces in order of sequence and offset are the documents, one after another.
    got, now = [], []
    for s in sorted(by):
        at = 0
        for r in by[s]:
            assert r.offset == at and r.start == len(now) and r.piece == (0 if not now else piece + 1)
            at, piece, now = at + r.length, r.piece, now + r.ids
            assert r.last == (len(now) == r.doc_tokens)
            if r.last:
                got.append((r.doc_id, tuple(now)))
                now = []
        assert at == width or s >= sum(r.length for r in rows) // width and at & (at - 1) == 0
    assert not now and sorted(got) == want
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {s: sum(r.length for r in v) for s, v in by.items()} == {s: len(v) for s, v in whole.items()}
    for r in windows.boundaries(packed).collect():
        own = by[r.sequence_id]
        assert (r.tokens, r.pieces, r.first_doc, r.last_doc) == (sum(x.length for x in own), len(own), own[0].doc_id, own[-1].doc_id)
        assert (r.begins_inside, r.ends_inside) == (own[0].start > 0, not own[-1].last)


def test_prefix_sums_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id as part", "id % 9 + 1 as n")
    rows = rows.unionByName(rows.where("part % 3 = 0"))
    got = {r.part: r.base for r in windows.partition_starts(rows).collect()}
    n = np.array([(k % 9 + 1) * (2 if k % 3 == 0 else 1) for k in range(5000)])
    assert [got[k] for k in range(5000)] == (np.cumsum(n) - n).tolist()


def test_edges(spark, frame):
    out = windows.concatenate_and_cut(frame(EDGES), max_tokens=4096).collect()
    ends = [r for r in out if r.last]
    assert len(ends) == len(EDGES) and sorted(r.doc_id or 0 for r in ends) == sorted(d or 0 for d, _ in EDGES)
    assert all(r.doc_tokens == 1 for r in ends if r.doc_id in (1, 2, 3)) and sum(r.length for r in out) == sum(r.doc_tokens for r in ends)
    assert windows.concatenate_and_cut(frame([])).collect() == []


def test_joined_starts_give_the_same(spark, frame, monkeypatch):
    docs = frame(list(enumerate(texts(40, 3))))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(windows.concatenate_and_cut(docs, 32))
    monkeypatch.setattr(windows, "BROADCAST_PARTITIONS", 0)
    assert key(windows.concatenate_and_cut(docs, 32)) == want
