"""Event dumps: arrays as written, pruned tags and columns, one output for each input, reruns."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest

from cloudloom.sources.npz import ARRAYS, convert_dumps, npz_files, read_npz_events, read_npz_hits


def dump(folder, tag, event, n, seed, **without):
    rng = np.random.default_rng(seed)
    d = {src: (rng.normal(size=n) * 50).astype("f8" if kind == "float" else "i8") for src, kind in ARRAYS.values()}
    d["truth_t0"][::3] = np.nan
    labels = [{"label": k, "type": "track" if k < 2 else "shower", "tpcs": [k], "e_ok": 1.5 * k, "e_wrong": 0.5, "reco_t0": None, "truth": 3.0} for k in range(3)]
    d |= {"lab_rows": np.array(json.dumps(labels)), "cluster_conf": np.array(json.dumps({"1": {"z_min": 0.5, "E": 2.0, "n_tpc": 1}})), "split_index": np.array(2), "src_file": np.array(f"/flow/{tag}.h5"), "event": np.array(event)}
    d = {k: v for k, v in d.items() if k not in without.get("lacks", ())}
    os.makedirs(folder, exist_ok=True)
    np.savez_compressed(f"{folder}/{tag}_ev{event}.npz", **d)
    return d


def test_hits_are_the_arrays(spark, tmp_path):
    made = {("flow1", 0): dump(tmp_path, "flow1", 0, 40, 1), ("flow1", 12): dump(tmp_path / "sub", "flow1", 12, 7, 2), ("flow2", 3): dump(tmp_path, "flow2", 3, 0, 3), ("flow2", 4): dump(tmp_path, "flow2", 4, 5, 4, lacks=("tpc", "cluster_conf", "split_index"))}
    (tmp_path / "notes.txt").write_text("x")
    rows = read_npz_hits(spark, str(tmp_path)).collect()
    assert len(rows) == 52
    for (tag, event), d in made.items():
        own = sorted((r for r in rows if (r.file_tag, r.event_id) == (tag, event)), key=lambda r: r.hit_id)
        assert [r.hit_id for r in own] == list(range(len(d["x"])))
        assert np.allclose([r.energy for r in own], d["e"].astype("f4")) and [r.labels for r in own] == d["labels"].tolist()
        assert np.allclose([r.truth_t0 for r in own], d["truth_t0"].astype("f4"), equal_nan=True)
        assert all((r.tpc is None) == ("tpc" not in d) for r in own)
    few = read_npz_hits(spark, str(tmp_path), ["x"], ["flow1"])
    assert few.columns == ["file_tag", "event_id", "hit_id", "x"] and few.count() == 47
    assert npz_files(spark, str(tmp_path), ["flow2"]).count() == 2
    events = {(r.file_tag, r.event_id): r for r in read_npz_events(spark, str(tmp_path)).collect()}
    assert set(events) == set(made) and events["flow2", 4].split_index is None and events["flow1", 12].src_file == "/flow/flow1.h5"


def test_one_output_for_each_input(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for tag, event in (("flow1", 0), ("flow1", 1), ("flow2", 0)):
        dump(source, tag, event, 10 + event, event)
    outside = spark.createDataFrame([("flow1", 0, 0.95)], "file_tag string, event_id int, ns_total_eff double")
    events = convert_dumps(spark, str(source), target, outside).collect()
    assert {(r.file_tag, r.event_id, r.ns_total_eff) for r in events} == {("flow1", 0, 0.95), ("flow1", 1, None), ("flow2", 0, None)}
    read = lambda name: sorted(map(str, spark.read.parquet(f"{target}/{name}").collect()))
    hits, found = read("hits"), spark.read.parquet(f"{target}/clusters")
    assert len(hits) == 31 and found.count() == 9
    one = found.where("file_tag = 'flow1' and event_id = 0 and label = 1").first()
    assert one.backbone and one.type == "track" and one.e_ok == 1.5 and one.confidence.z_min == 0.5
    folders = lambda: sorted(f"{t}/{e}" for t in os.listdir(f"{target}/hits") if "=" in t for e in os.listdir(f"{target}/hits/{t}"))
    assert folders() == ["file_tag=flow1/event_id=0", "file_tag=flow1/event_id=1", "file_tag=flow2/event_id=0"]
    convert_dumps(spark, str(source), target, outside, tags=["flow1"])
    assert read("hits") == hits and len(folders()) == 3


def test_broken_dumps_are_named(spark, tmp_path):
    (tmp_path / "bad_ev1.npz").write_bytes(b"not an archive")
    with pytest.raises(Exception, match="bad_ev1.npz is no array archive"):
        read_npz_hits(spark, str(tmp_path)).collect()
    np.savez(tmp_path / "odd_ev1.npz", x=np.zeros(3), y=np.zeros(4))
    with pytest.raises(Exception, match="odd_ev1.npz has arrays of unequal length"):
        read_npz_hits(spark, str(tmp_path), tags=["odd"]).collect()
    np.savez(tmp_path / "obj_ev1.npz", x=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="allow_pickle"):
        read_npz_hits(spark, str(tmp_path), ["x"], ["obj"]).collect()
