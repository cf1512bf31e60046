"""Personal data: fixed patterns, and the terms that would still disclose what they match.

Masking an address does not protect it if a word next to it appears with no other. Over the corpus, how
strongly a term reveals a protected entity is the share of the entity's information content, -log p(e),
that their pointwise mutual information PMI(t; e) makes up; terms of the texts with protected spans
whose share reaches the threshold are removed along with the spans, which are generalised to their kind.

All is built from DataFrame functions. Positions come from splitting a text by a pattern: what stands
between matches has the lengths that their starts add up from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.llm.common import small, unused, written

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that a failed match is not tried again from inside it (possessive
#: repeats; a match starts where its first run does or where the last match ended): what they match is the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MIN_TOGETHER = 1
DISCLOSURE = 0.75
#: Numbers stand with anything by chance: of a term without a letter at most this many rows are expected with the entity.
BY_CHANCE = 0.01
TERM = r"[\p{L}\p{N}]+"
_GAP = r"[^\p{L}\p{N}]+"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(F.split(digits, ""))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(back, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, s: Column) -> Column:
    """Whether a match of a kind is one: parts of at most 255, numbers of digits, Luhn."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(s, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", parts).when(kind == "card", n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(9, 15))


def _matches(text: Column, kind: str) -> Column:
    """Every match as a struct: kind, its number, characters since the last match, itself."""
    p = PATTERNS[kind]
    # zipped, so that a text is split once: what a lambda refers to is worked out for each element
    both = F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))

    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["s"].alias("s"))

    held = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    need = held if kind == "email" else held & F.regexp_like(text, F.lit("[0-9]"))
    return F.when(need, F.transform(F.filter(both, lambda x: x["s"].isNotNull()), one))


def _found() -> Column:
    """All matches in a text t, valid or not."""
    return F.flatten(F.filter(F.array(*(_matches(F.col("t"), k) for k in KINDS)), lambda a: a.isNotNull()))


def _base(texts: DataFrame) -> DataFrame:
    """(doc, same, kind, start, end, s) of the spans in (doc, same, t)."""
    found = _found()
    # rows that repeat id and text give the same matches once
    rows = texts.select("doc", "same", F.explode(found).alias("m")).select("doc", "same", "m.*").distinct()
    upto = Window.partitionBy("doc", "same", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("s")).over(upto)).withColumn("start", F.col("end") - F.length("s"))
    return placed.where(_valid(F.col("kind"), F.col("s"))).select("doc", "same", "kind", "start", "end", "s")


def _own(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts (doc, same, t) of some rows (doc, same) with spans, once each; texts without any match aren't shuffled."""
    texts = texts.where(F.size(_found()) > 0)
    rows = rows.select(F.col("doc").alias("_doc"), F.col("same").alias("_same")).distinct()
    return texts.join(rows, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")), "left_semi").dropDuplicates(["doc", "same"])


def _places(texts: DataFrame) -> DataFrame:
    """(doc, same, term, start, end) of every term of the texts."""
    both = F.zip_with(F.split("t", TERM, -1), F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), lambda gap, s: F.struct(F.length(gap).alias("gap"), F.length(s).alias("n"), F.lower(s).alias("term")))
    rows = texts.select("doc", "same", F.posexplode(F.filter(both, lambda x: x["term"].isNotNull())).alias("i", "x")).select("doc", "same", "i", "x.*")
    upto = Window.partitionBy("doc", "same").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).select("doc", "same", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def disclosing(texts: DataFrame, base: DataFrame, min_together: int = MIN_TOGETHER, threshold: float = DISCLOSURE) -> DataFrame:
    """(doc, same, start, end) of every place of a term that discloses a protected span, in the texts that have the span.

    A term counts with an entity in each row whose text has both, at least min_together of them. Its frequency
    is counted over all rows of the corpus.
    """
    entity = F.concat_ws(":", "kind", F.lower("s"))
    holds = written(base.select("doc", "same", entity.alias("entity")).distinct(), "entities")
    distinct = F.array_distinct(F.transform(F.split("t", _GAP), F.lower))
    terms = written(_own(texts, holds).select("doc", "same", F.explode(distinct).alias("term")).where("term <> ''"), "terms")
    # counted before the join: a task's repeats of a term are one row, where every term of every text was shuffled
    counts = texts.select(F.explode(distinct).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    often = counts.join(small(terms.select("term").distinct()), "term", "left_semi")
    often = written(often, "often")
    # rows with their repeats: how many of the corpus have the entity, and the term with it
    entities = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n = F.lit(float(max(1, texts.count())))
    left = holds.join(entities, "entity").withColumnsRenamed({"doc": "_doc", "same": "_same"})
    both = left.join(terms.join(often, "term"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")))
    # a term more frequent than this has too small a share even if all rows of the entity have it
    both = both.where(F.col("n_t") <= F.col("n_e") * F.pow(n / F.col("n_e"), 1 - threshold) * (1 + 1e-9))
    both = both.where(F.regexp_like("term", F.lit(r"\p{L}")) | (F.col("n_t") * F.col("n_e") <= BY_CHANCE * n))
    both = written(both.select("doc", "same", "entity", "term", "n_e", "n_t"), "together")
    asked = both.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= min_together)
    # PMI(t; e) / -log p(e), both in nats; repeated rows can make n_t larger than the rows counted, never smaller
    pmi = F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(n > F.col("n_e"), pmi / F.log(n / F.col("n_e"))).otherwise(F.lit(0.0))
    flagged = asked.where(share >= threshold).select("entity", "term")
    marked = written(both.join(flagged, ["entity", "term"], "left_semi").select("doc", "same", "term").distinct(), "disclosing")
    places = _places(_own(texts, marked)).withColumnsRenamed({"doc": "_doc", "same": "_same", "term": "_term"})
    on = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")) & (F.col("term") == F.col("_term"))
    return places.join(marked, on).select("doc", "same", "start", "end")


def spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts as (doc, same, t), and (doc, same, kind, start, end, base) of all spans.

    same tells apart texts under one id. Spans of the method have kind term and never overlap the fixed ones.
    """
    texts = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("same"), F.coalesce(text, F.lit("")).alias("t"))
    base = written(_base(texts), "personal")
    terms = disclosing(texts, base).select("doc", "same", F.lit("term").alias("kind"), "start", "end", F.lit(False).alias("base"))
    every = base.select("doc", "same", "kind", "start", "end", F.lit(True).alias("base")).unionByName(terms)
    by_start = Window.partitionBy("doc", "same").orderBy("start")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    return texts, every.withColumn("clear", clear).where("base OR clear").drop("clear")


def _listed(kinds) -> Column:
    no = F.create_map(*(x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))))
    shown = F.sort_array(F.collect_list(F.when(kinds, F.struct(no[F.col("kind")].alias("no"), "start", "end", "kind"))))
    return F.array_join(F.transform(shown, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def found(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) of every row, spans as kind:start:end in code points.

    Null and empty texts have none. Repeated rows are reported each; a null id is an id like others. Other
    columns are not read. An empty table gives an empty one.
    """
    texts, all_spans = spans(docs, id_column, text)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    each = all_spans.groupBy("doc", "same").agg(*counts, _listed(F.col("base")).alias("base"), _listed(F.lit(True)).alias("spans"))
    each = each.withColumnsRenamed({"doc": "_doc", "same": "_same"})
    out = texts.select("doc", "same").join(each, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")), "left")
    return out.select(F.col("doc").alias(id_column), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS), *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")))


def sanitised(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span in its text generalised to its kind in brackets; terms are removed as [TERM].

    Of overlapping spans the one that starts first counts, then the longer.
    """
    _, all_spans = spans(docs, id_column, text)
    order = Window.partitionBy("doc", "same").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    apart = all_spans.withColumn("ended", F.max("end").over(order)).where("ended IS NULL OR ended <= start")
    doc, same, held = (unused(docs, x) for x in ("_doc", "_same", "_cuts"))
    cuts = apart.groupBy("doc", "same").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(held)).withColumnsRenamed({"doc": doc, "same": same})
    joined = docs.join(cuts, docs[id_column].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text]) == F.col(same)), "left")
    c, t = F.col(held), docs[text]
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)["end"]).cast("int")
    pieces = F.transform(c, lambda x, i: F.concat(F.substring(t, since(i) + 1, x["start"].cast("int") - since(i)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.substring(t, F.element_at(c, -1)["end"].cast("int") + 1, F.length(t))
    clean = F.when(c.isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*(clean.alias(text) if x == text else docs[x] for x in docs.columns))
