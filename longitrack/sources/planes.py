"""Recordings from folders of .npy files: one task a plane, read by Spark's own binary source, to long tables.

Folders are <subject>/<session>/suite2p/<plane>/ with stat.npy (a list of dictionaries), iscell.npy, ops.npy and traces, or
<subject>/<session>/data_npy/<plane>/ with rois.npy, F.npy and fov.npy. Where a session has both, the first is read. Lists of
dictionaries are pickles; only arrays, numbers, strings and containers are let out of them, and nothing in them is run.
"""

from __future__ import annotations

import io
import json
import os
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.session import ship
from longitrack.sources.tables import session_dates

#: Fixed names of the scalar features of an ROI, and of the trace files.
FEATURES = ("radius", "aspect_ratio", "compact", "footprint", "skew", "std", "npix", "npix_norm")
TRACES = {"F.npy": "fluorescence", "spks.npy": "spikes", "Fneu.npy": "neuropil"}
PLANE = r"/([^/]+)/([^/]+)/(suite2p|data_npy)/([^/]+)/([^/]+\.npy)$"
_SAFE = {("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{c}.multiarray", n) for c in ("core", "_core") for n in ("_reconstruct", "scalar")), *((f"numpy.{c}.numeric", "_frombuffer") for c in ("core", "_core"))}


class _Plain(pickle.Unpickler):
    """Arrays, numbers, strings and containers."""

    def find_class(self, module, name):
        if (module, name) in _SAFE:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not read from recordings")


def load_npy(content: bytes):
    """The array of a .npy file; those of objects are unpickled as plain data."""
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if not dtype.hasobject:
        return np.load(io.BytesIO(content), allow_pickle=False)
    return np.asarray(_Plain(f).load(), dtype=object).reshape(shape, order="F" if fortran else "C")


def plane_files(spark: SparkSession, root: str, plane: str = "plane0") -> DataFrame:
    """(subject, session, kind, file, path) of the planes' files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select("path")
    part = lambda i: F.regexp_extract("path", PLANE, i)
    found = files.select(part(1).alias("subject"), part(2).alias("session"), part(3).alias("kind"), part(4).alias("plane"), part(5).alias("file"), "path")
    return found.where((F.col("subject") != "") & (F.col("plane") == plane)).drop("plane")


def subjects(spark: SparkSession, root: str) -> list[str]:
    """The names of the subjects below root, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    name = F.regexp_extract("path", PLANE, 1)
    return sorted(r[0] for r in files.select(name).where(name != "").distinct().collect())


def sessions(spark: SparkSession, root: str, plane: str = "plane0", input_format: str = "auto", strict: bool = False) -> DataFrame:
    """(subject, session, session_date, session_index, kind): the sessions that hold the plane, by date and name; dateless ones last.

    Strict: a session of a subject with another plane but without this one is an error; otherwise it is left out.
    """
    if input_format not in ("auto", "suite2p", "npy"):
        raise ValueError("input_format is auto, suite2p or npy")
    holds = plane_files(spark, root, plane).where(F.col("file").isin("stat.npy", "rois.npy"))
    if input_format != "auto":
        holds = holds.where(F.col("kind") == ("suite2p" if input_format == "suite2p" else "data_npy"))
    one = holds.groupBy("subject", "session").agg(F.max("kind").alias("kind"))  # suite2p is the greater name
    if strict:
        every = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root).select(F.regexp_extract("path", PLANE, 1).alias("subject"), F.regexp_extract("path", PLANE, 2).alias("session")).where("subject <> ''").distinct()
        lost = [f"{r.subject}/{r.session}" for r in every.join(one, ["subject", "session"], "left_anti").limit(20).collect()]
        if lost:
            raise FileNotFoundError(f"sessions without {plane}: {', '.join(sorted(lost))}")
    dated = one.join(session_dates(one.select(F.col("session").alias("path"))), "session")
    order = Window.partitionBy("subject").orderBy(F.col("session_date").asc_nulls_last(), "session")
    return dated.withColumn("session_index", (F.row_number().over(order) - 1).cast("int")).select("subject", "session", "session_date", "session_index", "kind")


def _kept(files: dict[str, bytes], include_non_cells: bool, threshold: float, exclude_overlap: bool):
    """(row, probability, dictionary, x, y, w) of the ROIs that stay, and how many the plane has."""
    stat = load_npy(files["stat.npy"])
    if stat.ndim != 1:
        raise ValueError("stat.npy must be a list of ROIs")
    cells = load_npy(files["iscell.npy"]).astype(float) if "iscell.npy" in files else None
    if cells is not None and (cells.ndim not in (1, 2) or len(cells) != len(stat)):
        raise ValueError("iscell.npy must have a row for each ROI of stat.npy")
    out = []
    for i, roi in enumerate(stat):
        probability = None
        if cells is not None:
            row = np.atleast_1d(cells[i])
            probability = float(row[1] if len(row) > 1 else row[0])
            if not include_non_cells and not (row[0] and probability >= threshold):
                continue
        y, x = np.asarray(roi["ypix"], int), np.asarray(roi["xpix"], int)
        w = np.asarray(roi.get("lam", np.ones(len(y))), float)
        if exclude_overlap and "overlap" in roi and np.shape(roi["overlap"]) == y.shape:
            alone = ~np.asarray(roi["overlap"], bool)
            y, x, w = y[alone], x[alone], w[alone]
        if len(y):
            out.append((i, probability, roi, x, y, w))
    return out, len(stat)


def _planes(spark: SparkSession, root: str, parse, shape: str, wanted: tuple[str, ...], names: tuple[str, ...], plane: str, options: dict) -> DataFrame:
    """parse(kind, files) of every plane, as rows of `shape` behind (subject, session, session_index)."""
    ship(spark)
    known = sessions(spark, root, plane, **options)
    # by name, so that traces are read only where they are wanted
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(wanted) + "}").load(root)
    part = lambda i: F.regexp_extract("path", PLANE, i)
    of_plane = files.where((part(4) == plane) & part(5).isin(*wanted)).select(part(1).alias("subject"), part(2).alias("session"), part(3).alias("kind"), part(5).alias("file"), "content")

    def read(t: pd.DataFrame) -> pd.DataFrame:
        rows = parse(t["kind"].iloc[0], dict(zip(t["file"], t["content"], strict=True)))
        out = pd.DataFrame(rows, columns=list(names))
        for i, c in enumerate(("subject", "session", "session_index")):
            out.insert(i, c, t[c].iloc[0])
        return out

    joined = of_plane.join(known.select("subject", "session", "kind", "session_index"), ["subject", "session", "kind"])
    return joined.groupBy("subject", "session").applyInPandas(read, f"subject string, session string, session_index int, {shape}")


def rois(spark: SparkSession, root: str, plane: str = "plane0", include_non_cells: bool = False, threshold: float = 0.5, exclude_overlap: bool = True, **options) -> DataFrame:
    """(subject, session, session_index, roi, position, cell_probability, features): roi is the row in the plane, position that among those kept."""

    def parse(kind, files):
        if kind == "data_npy":
            return [(i, i, None, *[None] * len(FEATURES)) for i in range(len(load_npy(files["rois.npy"])))]
        kept, _ = _kept(files, include_non_cells, threshold, exclude_overlap)
        value = lambda r, n: float(r[n]) if n in r else None
        return [(i, k, p, *(value(r, n) for n in FEATURES)) for k, (i, p, r, *_) in enumerate(kept)]

    shape = "roi long, position long, cell_probability double, " + ", ".join(f"{n} double" for n in FEATURES)
    return _planes(spark, root, parse, shape, ("stat.npy", "iscell.npy", "rois.npy"), ("roi", "position", "cell_probability", *FEATURES), plane, options)


def pixels(spark: SparkSession, root: str, plane: str = "plane0", weighted: bool = False, include_non_cells: bool = False, threshold: float = 0.5, exclude_overlap: bool = True, **options) -> DataFrame:
    """(subject, session, session_index, roi, x, y, w) of the ROIs that rois() gives; weights are 1 unless weighted, of a repeated pixel the last counts."""

    def parse(kind, files):
        if kind == "data_npy":
            masks = load_npy(files["rois.npy"])
            if masks.ndim != 3:
                raise ValueError("rois.npy must be (ROIs, height, width)")
            roi, y, x = np.nonzero(np.isfinite(masks) & (masks > 0))
            return list(zip(roi.tolist(), x.tolist(), y.tolist(), masks[roi, y, x].astype(float).tolist(), strict=True))
        kept, _ = _kept(files, include_non_cells, threshold, exclude_overlap)
        out: dict[tuple[int, int, int], float] = {}
        for i, _, _, x, y, w in kept:
            out |= zip(((i, a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)), w.tolist() if weighted else [1.0] * len(w), strict=True)
        return [(*k, w) for k, w in out.items()]

    return _planes(spark, root, parse, "roi long, x int, y int, w double", ("stat.npy", "iscell.npy", "rois.npy"), ("roi", "x", "y", "w"), plane, options)


def traces(spark: SparkSession, root: str, plane: str = "plane0", include_non_cells: bool = False, threshold: float = 0.5, exclude_overlap: bool = True, **options) -> DataFrame:
    """(subject, session, session_index, roi, source, values) of the traces that are there; files with another number of rows than ROIs are an error."""

    def parse(kind, files):
        if kind == "data_npy":
            keep, n = None, len(load_npy(files["rois.npy"]))
        else:
            kept, n = _kept(files, include_non_cells, threshold, exclude_overlap)
            keep = [i for i, *_ in kept]
        out = []
        for name, source in TRACES.items():
            if name in files:
                values = load_npy(files[name])
                if values.ndim != 2 or len(values) != n:
                    raise ValueError(f"{name} must have a row for each of {n} ROIs")
                out += [(i, source, values[i].astype(float).tolist()) for i in (range(n) if keep is None else keep)]
        return out

    return _planes(spark, root, parse, "roi long, source string, values array<double>", ("stat.npy", "iscell.npy", "rois.npy", *TRACES), ("roi", "source", "values"), plane, options)


def images(spark: SparkSession, root: str, plane: str = "plane0", **options) -> DataFrame:
    """(subject, session, session_index, height, width, pixels) of the mean pictures that are there, by rows."""

    def parse(kind, files):
        if kind == "data_npy":
            image = load_npy(files["fov.npy"]) if "fov.npy" in files else None
        else:
            image = load_npy(files["ops.npy"]).item().get("meanImg") if "ops.npy" in files else None
        return [] if image is None else [(*np.shape(image), np.asarray(image, float).ravel().tolist())]

    return _planes(spark, root, parse, "height int, width int, pixels array<double>", ("stat.npy", "ops.npy", "rois.npy", "fov.npy"), ("height", "width", "pixels"), plane, options)


def aligned_reference(of: DataFrame) -> DataFrame:
    """(subject, track_id, session_index, roi) where the k-th ROI of every session is the same cell; of: what rois() gives."""
    return of.select("subject", F.col("position").alias("track_id"), "session_index", "roi")


def read_reference(spark: SparkSession, root: str, plane: str = "plane0", prefer_indices: bool = True) -> DataFrame:
    """(subject, track_id, session_index, roi, session, curated) of the tracks in <subject>/track2p/; missing observations have no row.

    Tracks are read from <plane>_suite2p_indices.npy or <plane>_match_mat.npy, sessions and curation from track_ops.npy.
    """
    ship(spark)
    names = (f"{plane}_suite2p_indices.npy", f"{plane}_match_mat.npy")
    # by name: the other arrays of a folder are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{track_ops.npy," + ",".join(names) + "}").load(root)
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/track2p/([^/]+\.npy)$", i)
    held = files.where(part(2).isin("track_ops.npy", *names)).select(part(1).alias("subject"), part(2).alias("file"), "content")
    number = "".join(c for c in plane if c.isdigit()) or "0"

    def read(t: pd.DataFrame) -> pd.DataFrame:
        of, subject = dict(zip(t["file"], t["content"], strict=True)), t["subject"].iloc[0]
        found = [n for n in (names if prefer_indices else names[::-1]) if n in of]
        if "track_ops.npy" not in of or not found:
            raise FileNotFoundError(f"{subject}: track_ops.npy and one of {', '.join(names)} are needed")
        ops, matrix = load_npy(of["track_ops.npy"]).item(), load_npy(of[found[0]])
        days = [str(p).rstrip("/").rpartition("/")[2] for p in np.asarray(ops["all_ds_path"], object).reshape(-1).tolist()]
        if matrix.ndim != 2 or matrix.shape[1] != len(days):
            raise ValueError(f"{subject}: {found[0]} must have a column for each of {len(days)} sessions")
        curated = next((np.asarray(ops[k]).reshape(-1) for k in (f"vector_curation_plane_{number}", "vector_curation") if k in ops), None)
        rows = []
        for i, row in enumerate(matrix.tolist()):
            for s, v in enumerate(row):
                if v is not None and v == v and v >= 0:
                    if int(v) != v:
                        raise ValueError(f"{subject}: {v} is no ROI")
                    rows.append((subject, i, s, int(v), days[s], None if curated is None else bool(curated[i])))
        return pd.DataFrame(rows, columns=["subject", "track_id", "session_index", "roi", "session", "curated"])

    return held.groupBy("subject").applyInPandas(read, "subject string, track_id long, session_index int, roi long, session string, curated boolean")


def summary(of: DataFrame, image: DataFrame, trace: DataFrame) -> DataFrame:
    """Per session: ROIs, the picture's size, frames and whether there are traces; of, image and trace are what rois(), images() and traces() give."""
    key = ["subject", "session", "session_index"]
    n = of.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rois"))
    frames = trace.groupBy(*key).agg(F.max(F.size("values")).alias("n_frames"))
    out = n.join(image.select(*key, "height", "width"), key, "left").join(frames, key, "left")
    return out.withColumns({"has_fov": F.col("height").isNotNull(), "has_traces": F.col("n_frames").isNotNull()})


def write_npz(tracks: DataFrame, names: list[str], path: str) -> None:
    """One subject's tracks as a .npz file on the driver: `tracks`, -1 where missing, and `session_names`. A subject's tracks are few."""
    rows = tracks.select("track_id", "session_index", "roi").toPandas()
    ids = sorted(rows["track_id"].unique())
    matrix = np.full((len(ids), len(names)), -1, np.int64)
    matrix[np.searchsorted(ids, rows["track_id"]), rows["session_index"]] = rows["roi"]
    np.savez(path, tracks=matrix, track_ids=np.array(ids), session_names=np.array(names))


def read_labelled(spark: SparkSession, inputs: dict[str, str]) -> DataFrame:
    """The result tables (CSV) of several approaches with a column `approach`; columns that one lacks are null, no rows at all an error."""
    out = None
    for label, path in inputs.items():
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        one = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns)).select(F.lit(label).alias("approach"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None or out.isEmpty():
        raise ValueError("there are no result rows")
    return out


def append_results(df: DataFrame, path: str) -> None:
    """Add a setting's rows to a table as it finishes."""
    df.write.mode("append").option("header", True).csv(path)


def load_manifest(path: str, roots: dict[str, str] | None = None, run_keys: tuple[str, ...] = ("name", "data", "reference", "method", "query", "output", "options")) -> dict:
    """A JSON manifest of runs and comparisons: defaults filled in, <ROOT> placeholders replaced, paths relative to the manifest made absolute.

    Unknown keys, names that repeat, a list without runs and placeholders without a root are errors.
    """

    def replaced(x):
        if isinstance(x, str):
            for name, root in (roots or {}).items():
                x = x.replace(f"<{name}>", root)
            if "<" in x and ">" in x:
                raise ValueError(f"no root is given for {x}")
            return x
        if isinstance(x, dict):
            return {k: replaced(v) for k, v in x.items()}
        return [replaced(v) for v in x] if isinstance(x, list) else x

    with open(path, encoding="utf-8") as f:
        raw = replaced(json.load(f))
    base, defaults = os.path.dirname(os.path.abspath(path)), raw.get("defaults", {})
    runs = raw.get("runs")
    if not isinstance(runs, list) or not runs:
        raise ValueError("a manifest needs a list of runs")
    out = []
    for run in runs:
        whole = defaults | run
        if unknown := set(whole) - set(run_keys):
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        out.append(whole | {k: os.path.normpath(os.path.join(base, whole[k])) for k in ("data", "reference", "output") if k in whole and "://" not in whole[k]})
    comparisons = raw.get("comparisons", [])
    for what in (out, comparisons):
        names = [x.get("name") for x in what]
        if None in names or len(set(names)) < len(names):
            raise ValueError("runs and comparisons need names of their own")
    return {"runs": out, "comparisons": comparisons}
