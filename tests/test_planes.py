"""Recordings, references, manifests and result tables from files made here."""

import datetime
import json
import os
import pickle

import numpy as np
import pytest

from longitrack.operators import bundles, tracks
from longitrack.sources import planes


def save(path, x):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.save(path, x, allow_pickle=True)


def objects(xs):
    out = np.empty(len(xs), object)
    out[:] = xs
    return out


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("recordings"))
    roi = lambda y, x, **more: {"ypix": np.array([y, y, y + 1]), "xpix": np.array([x, x + 1, x]), "lam": np.array([1.0, 2.0, 3.0]), **more}
    for s, (name, shift) in enumerate((("2024-01-02_a", 0), ("2024-01-05", 1))):
        p = f"{d}/mouse/{name}/suite2p/plane0"
        save(f"{p}/stat.npy", objects([roi(2, 2, radius=1.5, overlap=np.array([False, True, False])), roi(6, 6 + shift, radius=2.0, npix=3), roi(9, 1), roi(4, 4, overlap=np.ones(3, bool))]))
        save(f"{p}/iscell.npy", np.array([[1, 0.9], [1, 0.8], [1, 0.2], [1, 0.9]]))
        save(f"{p}/ops.npy", np.array({"meanImg": np.arange(12.0).reshape(3, 4), "Ly": 3}, object))
        if s == 0:
            save(f"{p}/F.npy", np.arange(20.0).reshape(4, 5))
    masks = np.zeros((2, 4, 4))
    masks[0, 1, 2], masks[1, 3, 3], masks[1, 0, 0] = 1, 2, np.nan
    save(f"{d}/mouse/other/data_npy/plane0/rois.npy", masks)
    save(f"{d}/rat/2024-02-01/suite2p/plane1/stat.npy", objects([roi(0, 0)]))
    save(f"{d}/mouse/track2p/track_ops.npy", np.array({"all_ds_path": np.array(["/x/2024-01-02_a", "/x/2024-01-05/"], object), "vector_curation_plane_0": np.array([1, 0])}, object))
    save(f"{d}/mouse/track2p/plane0_suite2p_indices.npy", np.array([[0, 1], [1, None]], object))
    save(f"{d}/mouse/track2p/plane0_match_mat.npy", np.array([[0.0, np.nan], [1.0, 1.0]]))
    return d


def test_sessions_and_rois(spark, root):
    assert planes.subjects(spark, root) == ["mouse", "rat"]
    got = [(r.session, r.session_date, r.session_index, r.kind) for r in planes.sessions(spark, root).orderBy("session_index").collect()]
    assert got == [("2024-01-02_a", datetime.date(2024, 1, 2), 0, "suite2p"), ("2024-01-05", datetime.date(2024, 1, 5), 1, "suite2p"), ("other", None, 2, "data_npy")]
    with pytest.raises(FileNotFoundError, match="rat"):
        planes.sessions(spark, root, strict=True)
    rows = planes.rois(spark, root).collect()
    assert sorted((r.session_index, r.roi, r.position, r.cell_probability, r.radius) for r in rows if r.session_index < 2) == [(0, 0, 0, 0.9, 1.5), (0, 1, 1, 0.8, 2.0), (1, 0, 0, 0.9, 1.5), (1, 1, 1, 0.8, 2.0)]
    assert sorted(r.roi for r in rows if r.session_index == 2) == [0, 1]
    assert sorted(r.roi for r in planes.rois(spark, root, include_non_cells=True, exclude_overlap=False, input_format="suite2p").where("session_index = 0").collect()) == [0, 1, 2, 3]


def test_pixels_traces_images(spark, root):
    px = planes.pixels(spark, root, weighted=True)
    assert sorted((r.x, r.y, r.w) for r in px.where("session_index = 0 AND roi = 0").collect()) == [(2, 2, 1.0), (2, 3, 3.0)]
    assert sorted((r.roi, r.x, r.y, r.w) for r in px.where("session_index = 2").collect()) == [(0, 2, 1, 1.0), (1, 3, 3, 2.0)]
    t = planes.traces(spark, root).collect()
    assert sorted((r.session_index, r.roi, r.source, r["values"][0]) for r in t) == [(0, 0, "fluorescence", 0.0), (0, 1, "fluorescence", 5.0)]
    image = planes.images(spark, root)
    assert sorted((r.session_index, r.height, r.width, len(r.pixels)) for r in image.collect()) == [(0, 3, 4, 12), (1, 3, 4, 12)]
    s = {r.session_index: (r.n_rois, r.n_frames, r.has_fov, r.has_traces) for r in planes.summary(planes.rois(spark, root), image, planes.traces(spark, root)).collect()}
    assert s == {0: (2, 5, True, True), 1: (2, None, True, False), 2: (2, None, False, False)}
    pairs = bundles.bundle(px.where("session_index < 2")).withColumn("cost", bundles.cost("roi_aware"))
    best = {(r.roi_a, r.roi_b): r.iou for r in pairs.collect()}
    assert best[0, 0] == 1.0 and abs(best[1, 1] - 1 / 5) < 1e-9 and best[0, 1] == 0.0


def test_references(spark, root):
    got = {(r.track_id, r.session_index, r.roi, r.session, r.curated) for r in planes.read_reference(spark, root).collect()}
    assert got == {(0, 0, 0, "2024-01-02_a", True), (0, 1, 1, "2024-01-05", True), (1, 0, 1, "2024-01-02_a", False)}
    other = {(r.track_id, r.session_index, r.roi) for r in planes.read_reference(spark, root, prefer_indices=False).collect()}
    assert other == {(0, 0, 0), (1, 0, 1), (1, 1, 1)}
    aligned = planes.aligned_reference(planes.rois(spark, root, input_format="suite2p"))
    assert tracks.links(aligned).count() == 2


def test_pickles_run_nothing(tmp_path):
    class Evil:
        def __reduce__(self):
            return (os.mkdir, (f"{tmp_path}/made",))

    bad = np.empty(1, object)
    bad[0] = Evil()
    np.save(f"{tmp_path}/bad.npy", bad, allow_pickle=True)
    with pytest.raises(pickle.UnpicklingError):
        planes.load_npy(open(f"{tmp_path}/bad.npy", "rb").read())
    assert not os.path.exists(f"{tmp_path}/made")


def test_results_and_manifests(spark, tmp_path):
    t = spark.createDataFrame([(4, 0, 7), (4, 1, 8), (9, 1, 3)], "track_id long, session_index int, roi long")
    planes.write_npz(t, ["a", "b"], f"{tmp_path}/t.npz")
    assert np.load(f"{tmp_path}/t.npz")["tracks"].tolist() == [[7, 8], [-1, 3]]
    for i in (1, 2):
        planes.append_results(spark.createDataFrame([(i, 0.5)], "setting long, f1 double"), f"{tmp_path}/sweep")
    (tmp_path / "b.csv").write_text("﻿setting,extra\n3,x\n", encoding="utf-8")
    rows = planes.read_labelled(spark, {"one": f"{tmp_path}/sweep", "two": f"{tmp_path}/b.csv"}).collect()
    assert sorted((r.approach, r.setting, r.f1, r.extra) for r in rows) == [("one", "1", "0.5", None), ("one", "2", "0.5", None), ("two", "3", None, "x")]
    manifest = {"defaults": {"data": "<DATA_ROOT>/m"}, "runs": [{"name": "a", "output": "out"}, {"name": "b"}], "comparisons": [{"name": "c"}]}
    path = f"{tmp_path}/m.json"
    json.dump(manifest, open(path, "w"))
    got = planes.load_manifest(path, {"DATA_ROOT": "/data"})
    assert got["runs"][0] == {"name": "a", "data": "/data/m", "output": f"{tmp_path}/out"}
    for bad in ({"runs": []}, {"runs": [{"name": "a"}, {"name": "a"}]}, {"runs": [{"name": "a", "colour": 1}]}, manifest):
        json.dump(bad, open(path, "w"))
        with pytest.raises(ValueError):
            planes.load_manifest(path)
