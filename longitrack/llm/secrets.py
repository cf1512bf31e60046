"""Secrets in texts: fixed patterns, and random strings found by their poor compression into tokens.

A BPE vocabulary packs ordinary words into few tokens; a random string falls into many short ones, so
its characters per token are few. Candidates are long unbroken strings; known digests and identifiers
(MD5 to SHA-512, UUIDs, numbers) are excluded first.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitrack.llm.common import unused
from longitrack.session import ship

#: Fixed patterns. Letters of the first in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Digests by length in hex digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and UUIDs.
DIGESTS = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")

VOCABULARY = os.environ.get("TIKTOKEN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern by which that vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MIN_CHARS = 12
#: Shorter strings in the form of a word (letters in lower case, upper case or capitalised) are taken for words, which rare languages cut as short.
WORD_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.0

#: Printable ASCII but quotes and angle brackets. Keys are ASCII; words of other letters take several tokens each and are no sign of one.
_CANDIDATE = re.compile(r"[!#-&(-;=?-_a-~]{%d,}" % MIN_CHARS)
_PART = re.compile(r"[^/=:,;&?|()\[\]{}\\]{%d,}" % MIN_CHARS)
#: A digest or identifier within a longer string.
_KNOWN = re.compile(r"(?<![A-Za-z0-9])" + DIGESTS.pattern + r"(?![A-Za-z0-9])")
_encoders: dict[str, object] = {}


def _encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's bytes, built once in each process."""
    key = hashlib.md5(ranks).hexdigest()
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of these characters are maximal, so asking for 24 at once finds what a later test would leave
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def random_spans(text: str, covered: list[tuple[int, int, str]], encoder, max_ratio: float) -> list[tuple[int, int, str]]:
    """Strings of MIN_CHARS or more with at most max_ratio characters per token, outside covered spans.

    Strings end at white space, quotes, letters that are not ASCII, covered spans and digests. One that is not random as a whole is tried part by
    part between delimiters. Those without a letter are numbers or rules.
    """
    out = []

    def random(s: str) -> bool:
        inner = "".join(filter(str.isalnum, s))
        if len(s) < WORD_CHARS and inner.isalpha() and (inner.islower() or inner.isupper() or inner.istitle()):
            return False
        return any(c.isalpha() for c in s) and len(s) <= max_ratio * len(encoder.encode_ordinary(s))

    for m in _CANDIDATE.finditer(text):
        cuts = [(max(a, m.start()), min(b, m.end())) for a, b, _ in covered if a < m.end() and m.start() < b]
        cuts += [(m.start() + x.start(), m.start() + x.end()) for x in _KNOWN.finditer(m[0])]
        at = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a - at >= MIN_CHARS:
                if random(text[at:a]):
                    out.append((at, a, "random"))
                else:
                    out += [(x.start(), x.end(), "random") for x in _PART.finditer(text, at, a) if x.end() - x.start() < a - at and random(x[0])]
            at = max(at, b)
    return out


_TYPE = T.StructType(
    [T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("n_random", T.LongType()), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
)


def scan(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, max_ratio: float = MAX_CHARS_PER_TOKEN) -> Column:
    """A struct of counts by kind and of spans as kind:start:end (code points), comma-joined.

    Null and empty texts have no spans. The vocabulary is a file of fixed size (about 1 MB) that the
    driver reads and sends along with the function; executors need no copy of it.
    """
    ship(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def one(s: str | None) -> tuple:
        base = base_spans(s or "")
        more = random_spans(s or "", base, _encoder(ranks.value), max_ratio)
        show = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
        counts = [sum(k == kind for _, _, k in base + more) for kind in KINDS]
        return (*counts, show(base), show(sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))))

    @F.arrow_udf(_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        columns = zip(*(one(x.as_py()) for x in texts), strict=True) if len(texts) else [[] for _ in _TYPE.fields]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if f.name[:2] == "n_" else pa.string()) for f, c in zip(_TYPE.fields, columns, strict=True)], names=_TYPE.names)

    return found(text)


def find_secrets(docs: DataFrame, text: str = "text", column: str = "secrets", **options) -> DataFrame:
    """docs with the struct of scan() as `column`, which replaces a column of that name."""
    return docs.withColumn(column, scan(docs.sparkSession, F.col(text), **options))


def without_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which nothing was found, with their own columns."""
    held = unused(docs, "_secrets")
    return find_secrets(docs, text, held, **options).where(F.col(held)["spans"] == "").select(*(F.col(f"`{c}`") for c in docs.columns))
