"""Which item of a reference each arriving text matches: association of new recordings with a reference, as they come.

Texts are detections, their distinct words the pixels of their supports; the items of a reference table are the plane
that they are associated with. A run takes the files that came since the last one (a file stream with a checkpoint that
ends when it has seen all there is), finds for each text the items whose words it holds by a given share at least, costs them
like pairs of supports, and writes one row for each text with its best item and the margin over the next.

    python -m jobs.reference_links --documents DIR --items PATH --out DIR --checkpoint DIR [--config FILE]

Rows go to partitions of the batch and the texts' language. Spark gives a batch that was cut short the same number and the same
files again, and it overwrites the partitions it left, so a repeated run changes nothing. `current` is what holds: of a text id that
came in several batches the rows of the last. `summary`, partitioned by whether an item was found at all, is made anew from that.

Null texts hold no word and match nothing, like empty ones; null ids are an id like others; of rows that repeat id and
text within a batch one counts. Columns are those of the files: folders that name partitions add none. Items without words are never found, nor are those of an empty table.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import ratio
from longitrack.operators import pairs

LOG = logging.getLogger("jobs.reference_links")
SETTINGS = {"containment": 0.5, "min_margin": 0.05, "files_per_batch": 64}


def _words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))


def reference_plane(items: DataFrame, containment: float) -> DataFrame:
    """(item_id, item_words, word) of items with words; word: those of which a text must hold one to hold enough.

    A text that holds `need` of n words holds one of any n - need + 1, so the words that fewest items have are looked up.
    """
    own = items.select("item_id", _words("text").alias("item_words")).where(F.size("item_words") > 0).distinct()
    each = own.select("item_id", "item_words", F.explode("item_words").alias("word"))
    rare = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_items"))
    order = Window.partitionBy("item_id", "item_words").orderBy("n_items", "word")
    n = F.size("item_words")
    kept = n - F.ceil(n * F.lit(containment) - F.lit(1e-9)) + 1
    return each.join(rare, "word").withColumn("k", F.row_number().over(order)).where(F.col("k") <= kept).select("item_id", "item_words", "word")


def linked(docs: DataFrame, items: DataFrame, settings: dict) -> DataFrame:
    """One row for each distinct (doc_id, text): its best item by cost (ties by the lesser item_id) and how clear that is."""
    texts = docs.select("doc_id", "lang", "source", F.xxhash64("doc_id", "text").alias("key"), _words("text").alias("words")).dropDuplicates(["key"])
    plane = reference_plane(items, settings["containment"])
    met = texts.select("key", F.explode("words").alias("word")).join(plane.select("item_id", "item_words", "word"), "word").select("key", "item_id", "item_words").distinct()
    both = met.join(texts.select("key", "words"), "key")
    inter = F.size(F.array_intersect("words", "item_words"))
    n, m = F.size("words"), F.size("item_words")
    sized = both.select("key", "item_id", inter.alias("inter"), n.alias("area"), m.alias("item_area")).where(F.col("inter") >= F.ceil(F.col("item_area") * F.lit(settings["containment"]) - F.lit(1e-9)))
    i, a, b = F.col("inter"), F.col("area"), F.col("item_area")
    scored = sized.withColumn("iou", ratio(i * 1.0, a + b - i, 0.0)).withColumn("containment", i / b)
    cost = pairs.total_cost(None, 1.0, F.col("iou"), i / F.sqrt(a * b), F.abs(F.log(a / b)))
    order = Window.partitionBy("key").orderBy("cost", "item_id")
    ranked = scored.withColumn("cost", cost).withColumn("k", F.row_number().over(order)).withColumn("margin", F.lead("cost").over(order) - F.col("cost")).withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy("key")))
    best = ranked.where("k = 1").select("key", "item_id", "inter", "iou", "containment", "cost", "margin", "n_candidates")
    status = F.when(F.col("item_id").isNull(), "unlinked").when(F.col("margin") < settings["min_margin"], "ambiguous").otherwise("linked")
    out = texts.withColumn("area", F.size("words").cast("long")).drop("words").join(best, "key", "left")
    return out.withColumn("status", status).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long")).withColumn("inter", F.coalesce("inter", F.lit(0)).cast("long")).drop("key")


def current(links: DataFrame) -> DataFrame:
    """What holds of all batches: for each text id the rows of the last batch that had it."""
    return links.withColumn("last", F.max("batch").over(Window.partitionBy("doc_id"))).where("batch = last").drop("last", "part")


def summarised(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many texts have it as their best, how many of them clearly, and the one of least cost (ties by id)."""
    found = rows.where("item_id IS NOT NULL").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("status") == "linked").alias("n_clear"), F.min(F.struct("cost", "doc_id"))["doc_id"].alias("best_doc_id"))
    all_items = items.select("item_id").distinct().join(found, "item_id", "left").na.fill(0, ["n_texts", "n_clear"])
    return all_items.withColumn("found", F.col("n_texts") > 0)


def run(spark: SparkSession, documents: str, items: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take the files of `documents` that no earlier run took; what holds after that."""
    settings = SETTINGS | (config or {})
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema

    taken = []

    def placed(rows: DataFrame, number: int) -> DataFrame:
        # the language as it is stays a column: null and empty ones share a folder
        part = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang"))
        found = linked(rows, rows.sparkSession.read.parquet(items), settings)
        return found.withColumn("batch", F.lit(number).cast("long")).withColumn("part", part)

    def take(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            LOG.info("batch %d: no rows", number)
            return
        read, wrote = Observation(), Observation()
        found = placed(batch.observe(read, F.count(F.lit(1)).alias("n")), number).observe(wrote, F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "linked").alias("linked"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(f"{out}/links")
        taken.append(read.get["n"])
        LOG.info("batch %d: read %d rows of %s, wrote %d rows to %s/links, %d of them linked", number, read.get["n"], documents, wrote.get["n"], out, wrote.get["linked"])

    # Spark streams a single file only if a pattern matches it; a folder's files come by one too
    pattern = documents if any(c in documents for c in "*?[{") else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("took %d new rows of %s", sum(taken), documents)
    none = placed(spark.createDataFrame([], schema), -1)
    none.write.mode("append").partitionBy("batch", "part").parquet(f"{out}/links")  # makes the folder where no file came yet
    links = spark.read.schema(none.schema).parquet(f"{out}/links")
    report = summarised(current(links), spark.read.parquet(items))
    report.write.mode("overwrite").partitionBy("found").parquet(f"{out}/summary")
    made = spark.read.schema(report.schema).parquet(f"{out}/summary")
    LOG.info("wrote %d items to %s/summary, %d of them found", made.count(), out, made.where("found").count())
    return current(links)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "items", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "reference_links.json"))
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("reference_links").getOrCreate()
    try:
        run(spark, args.documents, args.items, args.out, args.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
