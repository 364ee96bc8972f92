"""The jobs: registered runs against SQL, reruns, growing input, configuration and command line."""

from __future__ import annotations

import json
import logging
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import jobs
from cloudloom.operators.incremental import event_scores, label_catalog, merged, partial_contingency
from jobs import common, demotion_sweep, label_watch

from .test_queries import DATA, duck  # noqa: F401

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_registered_run_equals_sql(spark, duck, name):  # noqa: F811
    df = jobs.QUERIES[name](spark, DATA)
    got = rows(df)
    want = sorted(map(tuple, duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(df.columns))} FROM ({jobs.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b, strict=True)), (a, b)


def documents(spark, path, values):
    spark.createDataFrame(values, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(path)


FIRST = [(1, "aaaa", "en", "s1"), (2, "bb", "de", "s1"), (3, None, "en", "s2"), (4, "cc", None, "s2"), (5, "d", "en", None), (6, "", None, None)]
THEN = [(7, "eeeeeeeee", "de", "s1"), (8, "ff", "fr", "s1"), (9, "gg", "en", "s3"), (9, "gg", "en", "s3")]


def test_label_watch_takes_only_what_is_new(spark, tmp_path, caplog):
    source, target, mark = (str(tmp_path / n) for n in ("docs", "out", "ckpt"))
    documents(spark, source, FIRST)
    with caplog.at_level(logging.INFO):
        one = {r.label: r for r in label_watch.run(spark, source, target, mark).collect()}
        again = {r.label: r for r in label_watch.run(spark, source, target, mark).collect()}
        assert one == again and caplog.text.count("read 6 documents") == 1
        assert (one["s1"].dom, one["s1"].e, one["s1"].purity, one["s1"].top_foreign) == ("en", 6, pytest.approx(4 / 6), "de")
        assert (one["s2"].n, one["s2"].e, one["s2"].e_truth, one["s2"].purity) == (2, 2, 0, None)
        documents(spark, source, THEN)
        two = {r.label: r for r in label_watch.run(spark, source, target, mark).collect()}
    assert "read 4 documents" in caplog.text and "read 10 documents" not in caplog.text
    assert (two["s1"].dom, two["s1"].e, two["s1"].top_foreign) == ("de", 17, "en;fr") and two["s2"] == one["s2"] and two["s3"].n == 2
    # What two intakes add up to is what one intake of everything gives.
    whole = label_watch.run(spark, source, str(tmp_path / "out2"), str(tmp_path / "ckpt2"))
    assert rows(whole) == rows(spark.read.schema(label_watch.CATALOG).parquet(f"{target}/catalog"))
    score = spark.read.parquet(f"{target}/scores").first()
    assert (score.n, score.e, score.e_noise, score.e_truthless, score.n_labels, score.n_groups) == (10, 24, 1, 2, 3, 3)
    assert score.purity == pytest.approx((11 + 0 + 4) / 21) and score.completeness == pytest.approx((11 + 4 + 2) / 21)


def test_label_watch_in_small_batches_gives_the_same(spark, tmp_path):
    source = str(tmp_path / "docs")
    for part in (FIRST[:2], FIRST[2:], THEN):
        documents(spark, source, part)
    config = common.configuration(label_watch.__file__, max_files=1, shards=3)
    small = label_watch.run(spark, source, str(tmp_path / "a"), str(tmp_path / "a_ckpt"), config)
    whole = label_watch.run(spark, source, str(tmp_path / "b"), str(tmp_path / "b_ckpt"), common.configuration(label_watch.__file__, shards=3))
    assert rows(small) == rows(whole) and len(small.collect()) == 3
    count = lambda out: len([x for x in os.listdir(tmp_path / out / "partials") if x.startswith("batch=")])
    assert (count("a"), count("b")) == (3, 1)
    swapped = common.configuration(label_watch.__file__, label="lang", group="source")
    other = {r.label: r.dom for r in label_watch.run(spark, source, str(tmp_path / "c"), str(tmp_path / "c_ckpt"), swapped).collect()}
    assert other == {"en": "s1", "de": "s1", "fr": "s1"}


def test_label_watch_repeats_a_batch_that_was_cut_off(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("docs", "out", "ckpt"))
    documents(spark, source, FIRST)
    want = rows(label_watch.run(spark, source, target, mark))
    # As after a crash between the partial and the commit: the partial is there, the commit is not.
    os.remove(f"{mark}/commits/0")
    shutil.rmtree(f"{target}/catalog")
    crc = f"{mark}/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert rows(label_watch.run(spark, source, target, mark)) == want
    assert sorted(x for x in os.listdir(f"{target}/partials") if x.startswith("batch")) == ["batch=0"]


def test_paths_may_be_uris(spark, tmp_path):
    source, out = f"file:{tmp_path}/docs", f"file:{tmp_path}/out"
    documents(spark, source, FIRST)
    assert label_watch.run(spark, source, out, f"{out}/checkpoint").count() == 2
    if os.path.isdir(DATA):
        assert demotion_sweep.run(spark, f"file:{DATA}", f"{out}/sweep", common.configuration(demotion_sweep.__file__, least_hits=[3])).count() > 0


def test_label_watch_without_files(spark, tmp_path):
    documents(spark, str(tmp_path / "docs"), [])
    assert label_watch.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ckpt")).collect() == []


@needs_tables
def test_demotion_sweep_replaces_only_its_partitions(spark, tmp_path):
    target = str(tmp_path / "out")
    whole = rows(demotion_sweep.run(spark, DATA, target))
    assert rows(demotion_sweep.run(spark, DATA, target)) == whole
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    part = common.configuration(demotion_sweep.__file__, least_hits=[4], events=[2, 3])
    assert rows(demotion_sweep.run(spark, DATA, target, part)) == whole
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    more = demotion_sweep.run(spark, DATA, target, common.configuration(demotion_sweep.__file__, least_hits=[2], events=[1]))
    assert rows(more.where("least_hits <> 2")) == whole and more.where("least_hits = 2 and ev = 1").count() > 0
    by = {r.least_hits: r for r in more.groupBy("least_hits").agg(F.max("ev_noise").alias("noise"), F.count(F.lit(1)).alias("n")).collect()}
    assert by[1].noise == 0 and by[4].noise > 0 and by[1].n > by[4].n > by[40].n if 40 in by else by[1].n > by[4].n


def test_partials_merge_in_any_cut(spark):
    hits = spark.createDataFrame([(k % 2, None if k % 7 == 0 else k % 5, None if k % 11 == 0 else f"g{k % 3}", None if k % 13 == 0 else float(k % 17 - 1)) for k in range(400)], "ev int, label int, g string, e double")
    whole = merged(partial_contingency(hits, ["ev"]), ["ev"])
    cut = partial_contingency(hits.where("e > 5"), ["ev"]).unionByName(partial_contingency(hits.where("not coalesce(e > 5, false)"), ["ev"]))
    cut = merged(cut, ["ev"])
    assert rows(whole) == rows(cut)
    for r in label_catalog(cut, ["ev"]).collect():
        own = [h for h in hits.collect() if h.ev == r.ev and h.label == r.label]
        by: dict = {}
        for h in own:
            if h.g is not None:
                by[h.g] = by.get(h.g, 0) + max(h.e or 0, 0)
        order = sorted(by, key=lambda g: (-by[g], g))
        assert (r.n, r.dom, r.top_foreign) == (len(own), order[0], ";".join(order[1:3])) and r.purity == pytest.approx(by[order[0]] / sum(by.values()))
    assert label_catalog(cut.limit(0), ["ev"]).collect() == [] and event_scores(cut.limit(0), ["ev"]).collect() == []


def test_configuration_refuses_unknown_names(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"least_hits": [9]}))
    assert common.configuration(demotion_sweep.__file__, str(tmp_path / "c.json"))["least_hits"] == [9]
    with pytest.raises(ValueError, match="lest_hits"):
        common.configuration(demotion_sweep.__file__, lest_hits=[9])


@needs_tables
def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir={tmp_path}/ckpt pyspark-shell"}
    done = subprocess.run([sys.executable, f"{root}/jobs/demotion_sweep.py", "--input", DATA, "--output", str(tmp_path / "out")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "hits of" in done.stderr and "wrote" in done.stderr and sorted(os.listdir(tmp_path / "out/labels"))[-1].startswith("least_hits=")


def test_jobs_need_nothing_of_the_training_data_part():
    for name in ("common", "demotion_sweep", "label_watch", "__init__"):
        text = open(os.path.join(os.path.dirname(common.__file__), f"{name}.py")).read()
        assert "cloudloom.llm" not in text and "corpus_pipeline" not in text
