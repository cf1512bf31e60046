"""A benchmark suite: the tracks that several ways of reading the same recordings give, scored against a reference.

A config file lists the runs. Each run makes an identity for every user and day from that day's events (the hour of the
first, the last or their mean, optionally of events before some hour alone) and may split its tracks at links that few runs agree on. Links
and complete tracks of all runs are scored as multisets against the reference, by subject (the nation of a user), then runs are
compared by micro F1 and their mean over subjects.

    python -m jobs.benchmark_suite --events PATH --customers PATH --out DIR [--config FILE] [--runs NAME ...]

Writes `observations` and `tracks` by run, `scores` by run and kind and `standings` by metric. Only partitions of the config's runs
are replaced, and of tracks and scores those asked for, so a repeated run gives the same tables and one run of many can be made anew.
Votes count all runs of the config, within a subject, where runs of one estimate have one vote.

Events without a user or time take no part; users without a customer belong to subject -1; a user is taken for a customer of the
same key, of which the least nation counts if there are several. A run that finds no event has no tracks, and so no recall.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longitrack.operators import evaluation, tracks

LOG = logging.getLogger("jobs.benchmark_suite")
HERE = os.path.dirname(os.path.abspath(__file__))
REFERENCE = "reference"


def settings() -> dict:
    """The config file beside this one."""
    with open(os.path.join(HERE, "benchmark_suite.json"), encoding="utf-8") as f:
        return json.load(f)


def _estimate(run: dict) -> Column:
    hour = F.hour("ts")
    if run.get("before_hour") is not None:
        hour = F.when(hour < run["before_hour"], hour)
    return {"first": F.min, "last": F.max, "mean": lambda h: F.floor(F.avg(h))}[run["estimate"]](hour).cast("long")


def observations(events: DataFrame, customers: DataFrame, runs: list[dict], origin: str) -> DataFrame:
    """(run, subject, user_id, session_index, roi) of all runs from one pass over the events."""
    known = events.where("user_id IS NOT NULL AND ts IS NOT NULL")
    day = F.datediff("ts", F.lit(origin).cast("date")).alias("session_index")
    per_day = known.groupBy("user_id", day).agg(*(_estimate(r).alias(f"r{i}") for i, r in enumerate(runs)))
    each = F.explode(F.array(*(F.struct(F.lit(r["name"]).alias("run"), F.col(f"r{i}").alias("roi")) for i, r in enumerate(runs))))
    nations = customers.groupBy(F.col("c_custkey").alias("user_id")).agg(F.min("c_nationkey").cast("long").alias("subject"))
    placed = per_day.withColumn("x", each).select("x.run", "user_id", "session_index", "x.roi").where("roi IS NOT NULL")
    return placed.join(nations, "user_id", "left").select("run", F.coalesce("subject", F.lit(-1).cast("long")).alias("subject"), "user_id", "session_index", "roi")


def split(rows: DataFrame, runs: list[dict]) -> DataFrame:
    """rows with `piece`: tracks of the runs that say so are split at links with fewer votes than they ask for."""
    named = rows.withColumn("track_id", F.struct("run", "subject", "user_id"))
    asked = [r for r in runs if r.get("split_below_votes")]
    mine = named.where(F.col("run").isin([r["name"] for r in asked])) if asked else None
    rest = named.where(~F.col("run").isin([r["name"] for r in asked])).withColumn("piece", F.lit(0).cast("long"))
    if mine is not None:
        # a run that only splits another's tracks has no view of its own: one vote for each estimate
        views = {json.dumps([r["estimate"], r.get("before_hour")]): r["name"] for r in reversed(runs)}
        of_subject = lambda df: tracks.links(df).withColumn("subject", F.col("track_id.subject"))
        voted = of_subject(named.where(F.col("run").isin(list(views.values())))).withColumn("run", F.col("track_id.run"))
        votes = voted.select("run", "subject", *tracks.LINK).distinct().groupBy("subject", *tracks.LINK).agg(F.count(F.lit(1)).alias("votes"))
        for r in asked:
            own = mine.where(F.col("run") == r["name"])
            weak = of_subject(own).join(votes, ["subject", *tracks.LINK]).where(F.col("votes") < r["split_below_votes"])
            rest = rest.unionByName(tracks.split_at(own, weak, r.get("min_side", 1)).select(*(F.col(f"track_id.{c}").alias(c) for c in ("run", "subject", "user_id")), "session_index", "roi", "track_id", F.col("piece").cast("long")))
    return rest.drop("track_id")


def scores(found: DataFrame, reference: DataFrame, names: list[str], horizon: int) -> DataFrame:
    """(run, kind, subject, tp, fp, fn, precision, recall, f1) of links and of tracks complete over the first sessions."""
    run = F.explode(F.array(*(F.lit(n) for n in names)))
    name = lambda df: df.withColumn("track_id", F.struct("run", "subject", "user_id", "piece"))
    truth = reference.withColumn("run", run)
    out = None
    for kind, keys, rows in (("link", tracks.LINK, tracks.links), ("complete", ["identity"], lambda df: tracks.complete(df, horizon))):
        side = lambda df: rows(name(df)).withColumn("run", F.col("track_id.run")).withColumn("subject", F.col("track_id.subject"))  # noqa: B023, E731
        got = tracks.scored(tracks.ledger(side(found), side(truth), ["run", "subject", *keys]), ["run", "subject"]).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


def _replaced(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """df's partitions written in place of those that the folder has; all that it holds then."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    whole = df.sparkSession.read.schema(df.schema).parquet(path)
    LOG.info("%s: %d rows", path, whole.count())
    return whole


def run(spark: SparkSession, events: str, customers: str, out: str, config: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """Make the runs of the config, or those of the names in `only`; the scores of all runs in the folder."""
    config = config or settings()
    runs = config["runs"]
    names = [r["name"] for r in runs if only is None or r["name"] in only]
    if REFERENCE in names or len({r["name"] for r in runs}) < len(runs):
        raise ValueError(f"runs need different names other than {REFERENCE}")
    source = spark.read.parquet(events).select("user_id", "ts")
    LOG.info("read %d rows of %s", source.count(), events)
    everything = [*runs, {"name": REFERENCE, "estimate": config["reference"]}]
    rows = _replaced(observations(source, spark.read.parquet(customers), everything, config["origin"]), f"{out}/observations", ["run"])
    made = split(rows.where(F.col("run").isin([r["name"] for r in runs])), runs).where(F.col("run").isin(names))
    kept = _replaced(made.unionByName(rows.where(F.col("run") == REFERENCE).withColumn("piece", F.lit(0).cast("long"))), f"{out}/tracks", ["run"])
    scored = _replaced(scores(kept.where(F.col("run").isin(names)), kept.where(F.col("run") == REFERENCE), names, config["horizon"]), f"{out}/scores", ["run", "kind"])
    # one row for each run and subject
    wide = scored.groupBy("run", "subject").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("link", "complete") for c in ("tp", "fp", "fn", "f1")))
    agg = evaluation.comparison(wide, "run", ["link_f1", "complete_f1"], {k: tuple(f"{k}_{c}" for c in ("tp", "fp", "fn")) for k in ("link", "complete")})
    _replaced(evaluation.standings(agg, "run", ["link_f1_macro", "complete_f1_macro", "link_micro_f1", "complete_micro_f1"], config["compare_with"]), f"{out}/standings", ["metric"])
    return scored


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("events", "customers", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=os.path.join(HERE, "benchmark_suite.json"))
    p.add_argument("--runs", nargs="*", help="make only these runs anew")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("benchmark_suite").getOrCreate()
    try:
        run(spark, args.events, args.customers, args.out, config, args.runs)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
