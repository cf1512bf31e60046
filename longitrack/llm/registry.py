"""The queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longitrack.llm import decontaminate, hyperminhash, mixing, negatives, passages, pii, quality, secrets, simhash, substrings, urls, warc
from longitrack.llm.common import new_path, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = F.col(quality.LEDGER)
    return judged.select(
        "doc_id",
        *(got[m].alias(m) for m in quality.MEASURES[:5]),
        (~quality.passes("base", got["failures"])).alias("base_failed"),
        quality.passes("v1", got["failures"]).alias("kept"),
        got["failures"].alias("failures"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:([^:]*):", 1).try_cast("long")
    return warc.read_archives(spark, path, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = F.col("secrets")
    return found.select("doc_id", *(got[n].alias(n) for n in ("n_assign", "n_access", "n_hex")), F.sha2(got["base"], 256).alias("base_sha256"), got["spans"].alias("spans"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.usable(rows.withColumn("label", noisy)), F.col("id") % 50 == 0)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_passages": op5_passages,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_substrings": op8_substrings,
    "op9_urls": op9_urls,
    "op10_pii": op10_pii,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_negatives": op12_negatives,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM b, unnest(range(1, len(w) - k + 2)) AS r(i)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM b) AS ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
""",
    "op3_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM d, unnest(range(1, len(w) - 1)) AS r(i)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, unnest([0, 1, 2]) AS r(k) WHERE c > 1 GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n - lines.u, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), j AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 30 * word_chars THEN 64 ELSE 0 END)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM j
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
""",
    "op11_hyperminhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s AS x JOIN s AS y USING (g) JOIN n AS nx ON nx.doc_id = x.doc_id JOIN n AS ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))),
c AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY 1) AS m USING (doc_id)
""",
    "op12_negatives": """
WITH r AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM r AS a JOIN r AS b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
QUALIFY row_number() OVER w <= 3
""",
}
