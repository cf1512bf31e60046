"""WARC archives: writing, and reading with reassembly of segmented records.

Records longer than a segment are written as a first segment and continuation records that name their
origin (WARC-Segment-Origin-ID) and number; the last carries the total length. Payloads travel under
chunked transfer framing. Reading groups continuations by origin, orders them by number, verifies the
total length and decodes the chunks; digests are verified on the decoded payload.

Archives are written by Spark's own text writer and read by its text reader, so any store that Spark
reaches will do. The reader splits files at version lines, and the writer ends a chunk inside every
version string of a payload, so that none occurs in a block.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longitrack.llm.common import short_batches, small, written
from longitrack.session import ship

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: No proper beginning of it is also its end, so a reader may stop and resume anywhere in it.
BREAK = VERSION + CRLF
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT = 32 * 1024
CHUNK = 8 * 1024


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; a chunk also ends inside each version string."""
    ends = {*range(size, len(payload), size), len(payload)} | {m.start() + 4 for m in re.finditer(re.escape(VERSION), payload)}
    out, at = [], 0
    for end in sorted(ends):
        if end > at:
            out += [b"%x" % (end - at), CRLF, payload[at:end], CRLF]
            at = end
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n or body[end + 2 + n : end + 4 + n] != CRLF:
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last CRLF, which the writer's line end adds."""
    # a space keeps a value that ends like a version line from being one
    lines = [VERSION, *(f"{k}: {v}".encode() + b" " * str(v).endswith(VERSION.decode()) for k, v in headers if v is not None), b"Content-Length: %d" % len(block)]
    return CRLF.join([*lines, b"", block, b""])


def records(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The record or records of a payload: a response, in segments if its block is long, or a revisit."""
    clean = lambda s: None if s is None else re.sub(r"[\x00-\x1f\x7f]", " ", s)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], block)]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *head], block)]
    cuts = [0]
    while cuts[-1] + segment < len(block):
        cuts.append(cuts[-1] + segment)
    parts = [block[a:b] for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True)]
    out = [_record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        total = len(block) if i == len(parts) else None
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:segment:{i}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)]
        out.append(_record(own, part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write (record_id, uri, payload, refers_to) rows, payload binary, as gzip-compressed archives below path."""
    ship(pages.sparkSession)

    def build(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r for i, u, p, t in rows for r in records(i, u, p or b"", base32_sha1(p or b""), t, segment)], pa.binary())], names=["value"])

    ready = pages.select("record_id", "uri", "payload", "refers_to").mapInArrow(build, "value binary")
    with short_batches(pages.sparkSession):
        ready.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


_PARSED = "record_id string, type string, uri string, digest string, refers_to string, segment int, total long, block binary"


def _parse(raw: bytes) -> tuple | None:
    """A record's fields from what stands between two breaks; None for what is left after the last."""
    head, sep, rest = raw.partition(CRLF + CRLF)
    if not sep:
        if raw.strip():
            raise ValueError("a record has no end of headers")
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n"))}
    n = int(fields["content-length"])
    if len(rest) < n or rest[n:].strip(CRLF):
        raise ValueError(f"{fields.get('warc-record-id')}: {len(rest)} bytes where {n} are declared")
    ids = lambda k: fields[k].strip("<>") if k in fields else None
    number = lambda k: int(fields[k]) if k in fields else None
    origin = ids("warc-segment-origin-id") or ids("warc-record-id")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (origin, fields["warc-type"], fields.get("warc-target-uri"), digest, ids("warc-refers-to"), number("warc-segment-number"), number("warc-segment-total-length"), rest[:n])


def _decoded(kind: str, digest: str | None, block: bytes) -> tuple[int, str, bytes | None]:
    """Payload length and digest of a whole block, and the payload (none in a revisit)."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        return int(fields["content-length"]), digest, None
    payload = dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    got = base32_sha1(payload)
    if digest is not None and got != digest:
        raise ValueError(f"the payload's digest is {got}, not {digest}")
    return len(payload), got, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload) of the responses and revisits below path.

    Only segmented records are shuffled, by origin; a group is one record. Missing segments, lengths that do not
    add up, cut chunks and wrong digests stop the read; equal records under one id are read as often as they are there. Without payloads the column is left null.
    """
    ship(spark)

    def parse(batches):
        for b in batches:
            found = [p for x in b.column(0).to_pylist() if (p := _parse(x)) and p[1] in ("response", "revisit", "continuation")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 8, (pa.string(),) * 5 + (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=[f.split()[0] for f in _PARSED.split(", ")])

    def decode(batches):
        for b in batches:
            rows = b.to_pylist()
            got = [_decoded(r["type"], r["digest"], r["block"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.string()) for k in ("record_id", "uri", "type")), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([r["refers_to"] for r in rows], pa.string()), pa.array([g[2] if payloads else None for g in got], pa.binary())],
                names=["record_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"],
            )

    shape = "record_id string, uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    raw = spark.read.option("lineSep", BREAK.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    parsed = raw.mapInArrow(parse, _PARSED)
    whole = parsed.where("segment IS NULL").drop("segment", "total").mapInArrow(decode, shape)
    parts = parsed.where("segment IS NOT NULL").groupBy("record_id").agg(
        F.max("type").alias("type"), F.max("uri").alias("uri"), F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"), F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.max("segment").alias("last"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s")
    )
    # a record that is there several times, with one id, has each segment as often
    same = lambda x, i: (i > 0) & (F.get("s", i - 1)["segment"] == x["segment"])
    parts = parts.withColumn("differ", F.exists(F.transform("s", lambda x, i: same(x, i) & (F.get("s", i - 1)["block"] != x["block"])), lambda x: x))
    parts = parts.withColumn("s", F.filter("s", lambda x, i: ~same(x, i))).withColumn("times", F.expr("n DIV last"))
    block = F.aggregate("s", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["block"]))
    sound = ~F.col("differ") & (F.size("s") == F.col("last")) & (F.col("n") == F.col("times") * F.col("last")) & (F.length("block") == F.col("total"))
    joined = parts.withColumn("block", block).withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing or do not add up: "), "record_id")).cast("binary")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("times", F.lit(1).cast("long")))))
    again = joined.select("record_id", "type", "uri", "digest", "refers_to", "block").mapInArrow(decode, shape)
    return whole.unionByName(again)


def archive_pages(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write a record for each row: of equal payloads of least_bytes or more, the largest id is a response, others revisit it.

    Null html is an empty payload. Rows that repeat both id and payload are alike: all are responses if
    theirs is the largest id. A null id is smaller than any other. Only digests are compared and shuffled.
    """
    own = pages.select(F.col(id_column).cast("string").alias("id"), F.col(id_column).alias("n"), F.col(url).alias("uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    repeated = own.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("n").cast("string").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    found = own.join(small(written(repeated, "repeated")), "digest", "left")
    name = lambda i: F.concat(F.lit("urn:page:"), F.coalesce(i, F.lit("null")), F.lit(":"), F.col("digest"))
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    write_archives(found.select(name(F.col("id")).alias("record_id"), "uri", "payload", F.when(revisits, name(F.col("first"))).alias("refers_to")), path, segment)
