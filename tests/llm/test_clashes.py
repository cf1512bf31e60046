"""Extra columns whose names the operators use themselves, repeated rows, long texts and frequent keys."""

from collections import Counter

from pyspark.sql import functions as F

from longitrack.llm import common, decontaminate, pii, secrets, simhash, substrings, urls, warc

NAMES = ["_id", "_same", "_doc", "_cuts", "_bad", "_secrets", "_ledger", "_SAME_", "fp", "id", "same", "component", "t", "spans", "key", "rank"]


def crowded(spark, rows):
    """rows of (doc_id, text) with a column for each of the names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_one_of_each_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, "other words " * 9), (3, "other words " * 9), (4, None), (5, ""), (None, text), (6, "more " * 200_000)]
    got = simhash.one_of_each(crowded(spark, rows))
    assert got.columns == ["doc_id", "text", *NAMES]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 6]
    assert simhash.near_duplicates(crowded(spark, rows)).count() == len(rows)


def test_decontaminated_and_sanitised_with_clashing_names(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"before {item} after"), (2, "clean text of me@corp.org and more"), (None, None)]
    items = spark.createDataFrame([(7, item, "x")], "item_id long, text string, _bad string")
    got = decontaminate.decontaminated(crowded(spark, rows), items)
    assert got.columns == ["doc_id", "text", *NAMES] and [r.doc_id for r in got.orderBy("doc_id").collect()] == [None, 2]
    clean = pii.sanitised(crowded(spark, rows))
    assert clean.columns == ["doc_id", "text", *NAMES] and "[EMAIL]" in clean.where("doc_id = 2").collect()[0].text
    assert secrets.without_secrets(crowded(spark, rows)).columns == ["doc_id", "text", *NAMES]


def test_substrings_with_clashing_names(spark):
    part = "".join(chr(97 + i * i % 23) for i in range(450))
    rows = [(1, part + "A" * 10), (2, "B" * 10 + part), (3, None)]
    extra = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(i).alias(n) for i, n in enumerate([*NAMES, "doc", "start", "end", "kept", "marked", "n_bytes"])))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.deduplicated(extra).collect()}
    want = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got[1][1] >= 450 and got[3] == (0, 0)


def test_pages_with_clashing_names_and_repeats(spark, tmp_path):
    long = "<p>" + "é\r\n" * 300_000
    rows = [(1, "http://a.net/es/1", long), (1, "http://a.net/es/1", long), (2, "http://b.org/", None), (None, None, "x")]
    extra = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(i).alias(n) for i, n in enumerate(["id", "n", "uri", "payload", "digest", "first", "host", "path", "rule", "verdict", "trust", "record_id"])))
    warc.archive_pages(extra, f"file://{tmp_path}/w")
    got = Counter((r.record_id.split(":")[2], r.record_type, r.payload_bytes) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect())
    assert got == {("1", "response", len(long.encode())): 2, ("2", "response", 0): 1, ("null", "response", 1): 1}
    verdicts = Counter((r.page_id, r.verdict) for r in urls.judge(extra).collect())
    assert verdicts == {(1, "block"): 2, (2, "allow"): 1, (None, "allow"): 1}


def test_spread_join_is_a_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(0, "hot"), (1, "one"), (9999, "none")], "k long, w string")
    for how in ("inner", "left"):
        want = Counter(rows.join(lookup, "k", how).collect())
        assert Counter(common.spread_join(rows, lookup, "k", how, least=100).select("k", "v", "w").collect()) == want
