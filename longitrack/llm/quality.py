"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
failed rule; policies (versioned sets of rules) and ablations are then bit operations on it and never
look at a text again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitrack.llm.common import unused
from longitrack.session import ship

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
LEDGER = "ledger"

_SPACES = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _repeat_words(ws: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    windows = list(zip(ws, ws[1:], ws[2:], strict=False))
    if len(seen := set(windows)) == len(windows):
        return 0
    del seen
    first: dict[tuple, int] = {}
    marked = bytearray(len(ws))
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            marked[i : i + 3] = b"\1\1\1"
            marked[j : j + 3] = b"\1\1\1"
    return sum(marked)


def measure_text(raw: bytes | None) -> tuple[int, ...]:
    """The measurements of one text (UTF-8), in the order of MEASURES."""
    raw = raw or b""
    ws = raw.split()  # on ASCII white space, as bytes do
    lines = [x for x in raw.split(b"\n") if x.strip()]
    points = len(re.sub(rb"[\x80-\xbf]+", b"", raw)) if not raw.isascii() else len(raw)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (len(ws), points - without(_SPACES), without(_SYMBOLS), len(lines) - len(set(lines)), _repeat_words(ws), len(lines), without(_UPPER))


_TYPE = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.arrow_udf(_TYPE)
def _measures(texts: pa.Array) -> pa.Array:
    columns = zip(*(measure_text(x.as_py()) for x in texts.cast(pa.binary())), strict=True) if len(texts) else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


#: Rules by bit: a name and the condition under which a document fails. m gives a measurement's column.
RULES: list[tuple[str, object]] = [
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    ("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    ("long_words", lambda m: m("word_chars") > 12 * m("n_words")),
    ("shouting", lambda m: 100 * m("n_upper") > 30 * m("word_chars")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def ledger(docs: DataFrame, text: str = "text", column: str = LEDGER) -> DataFrame:
    """docs with a struct column: the measurements and `failures`, a bit for each failed rule.

    Null and blank texts measure zero and fail few_words alone; the other rules need a word or line.
    Repeated rows are measured each by itself; other columns pass unread. A column of the ledger's own
    name is replaced.
    """
    ship(docs.sparkSession)
    m = lambda name: F.col(column)[name]
    bits = [F.when(fails(m), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES]
    failures: Column = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return docs.withColumn(column, _measures(F.col(text))).withColumn(column, F.struct(*(m(x).alias(x) for x in MEASURES), failures.cast("long").alias("failures")))


def passes(policy: str, failures: Column) -> Column:
    """Whether a document with these failure bits is kept under a policy."""
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(judged: DataFrame, policy: str, column: str = LEDGER) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects.

    Documents are first summed by their failure bits, at most 2^rules rows, so no text and no
    document moves.
    """
    mask = POLICIES[policy]
    counts = judged.groupBy(F.col(column)["failures"].bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask)))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counts.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(total(hit).alias("n_failed"), total(F.col("bits") == F.col("r.bit")).alias("n_only"))


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    held = unused(docs, "_ledger")
    return ledger(docs, text, held).where(passes(policy, F.col(held)["failures"])).select(*(F.col(f"`{c}`") for c in docs.columns))
