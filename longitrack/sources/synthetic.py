"""Synthetic subjects: disks that drift from session to session, some of them missing, with their true tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the example subject.
CENTRES = ((8, 8), (8, 22), (22, 8), (22, 22))
DRIFT, RADIUS, SIZE = (0.5, 1.0), 2.0, 32


def synthetic_subjects(spark: SparkSession, n_subjects: int = 1, n_sessions: int = 3, missing: tuple[tuple[int, int], ...] = (), centres=CENTRES, drift=DRIFT, radius: float = RADIUS, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(pixels, tracks): supports (subject, session_index, roi, x, y, w) and (subject, track_id, session_index, roi).

    Centres and drift are (y, x). missing holds (session, track) without a detection; a session's ROIs are numbered
    over its detections. Everything follows from the row number, so any number of subjects is made in parallel.
    """
    places = F.array(*(F.struct(F.lit(i).cast("long").alias("track_id"), F.lit(float(y)).alias("cy"), F.lit(float(x)).alias("cx")) for i, (y, x) in enumerate(centres)))
    each = spark.range(n_subjects).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(n_sessions - 1))).alias("session_index"))
    each = each.select("subject", "session_index", F.explode(places).alias("_c")).select("subject", "session_index", "_c.*")
    for s, t in missing:
        each = each.where(~((F.col("session_index") == s) & (F.col("track_id") == t)))
    roi = F.row_number().over(Window.partitionBy("subject", "session_index").orderBy("track_id")) - 1
    found = each.withColumn("roi", roi.cast("long")).withColumns({"cy": F.col("cy") + drift[0] * F.col("session_index"), "cx": F.col("cx") + drift[1] * F.col("session_index")})
    axis = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = found.withColumn("y", axis).where(F.abs(F.col("y") - F.col("cy")) <= radius).withColumn("x", axis)
    inside = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) <= radius * radius
    return grid.where(inside).select("subject", "session_index", "roi", "x", "y", F.lit(1.0).alias("w")), found.select("subject", "track_id", "session_index", "roi")
