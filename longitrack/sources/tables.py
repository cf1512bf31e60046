"""Track tables, session folders and planes as DataFrames."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longitrack.operators.tracks import from_wide, observed
from longitrack.session import ship


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """A track table in wide (track_id and a column a session) or long form (track_id, session, roi), by its header.

    Sessions of the long form are numbered in order of their names. A byte-order mark is skipped.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    names = {c.lower(): c for c in raw.columns}
    session = next((names[c] for c in ("session", "session_name", "session_index") if c in names), None)
    roi = next((names[c] for c in ("roi", "roi_index", "roi_id") if c in names), None)
    track = next((names[c] for c in ("track_id", "track") if c in names), None)
    if session and roi and track:
        order = raw.select(F.col(session).alias("s")).distinct().groupBy().agg(F.sort_array(F.collect_set("s")).alias("all"))
        long = raw.crossJoin(F.broadcast(order))  # one row: the sorted names
        return observed(long.select(F.col(track).alias("track_id"), (F.array_position("all", F.col(session)) - 1).cast("int").alias("session_index"), F.col(roi).alias("roi"))).distinct()
    if track is None:
        raw = raw.withColumn("track_id", F.monotonically_increasing_id())
        track = "track_id"
    return from_wide(raw, track, [c for c in raw.columns if c != track])


def session_dates(paths: DataFrame, column: str = "path") -> DataFrame:
    """Session names and dates from folder names `YYYY-MM-DD` or `YYYY-MM-DD_...`, in order of date and name."""
    name = F.regexp_extract(column, r"([^/]+)/?$", 1)
    date = F.to_date(F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})(?:_.+)?$", 1), F.lit("")))
    return paths.select(name.alias("session"), date.alias("session_date")).distinct().orderBy(F.col("session_date").asc_nulls_last(), "session")


def read_masks(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, roi, x, y, w) of dense mask stacks (n, height, width) in .npy files; one file a task, read by Spark itself."""
    ship(spark)

    def pixels(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                masks = np.load(io.BytesIO(content), allow_pickle=False)
                roi, y, x = np.nonzero(np.isfinite(masks) & (masks > 0))
                yield pd.DataFrame({"path": path, "roi": roi, "x": x, "y": y, "w": masks[roi, y, x].astype(float)})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(pixels, "path string, roi long, x int, y int, w double")


def write_results(df: DataFrame, path: str, form: str) -> None:
    """Rows as parquet, CSV or JSON; reports, which are small, in one file."""
    df.coalesce(1).write.format(form).option("header", True).save(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report as a Markdown table, of at most so many rows."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])
