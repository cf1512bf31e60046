"""Substring removal against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from longitrack.llm import substrings


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((str(i), len(r), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, alphabet, base):
    rnd = random.Random(seed)
    some = [("".join(rnd.choice(alphabet) for _ in range(base + rnd.randrange(3 * base)))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(2 * base)))
        for _ in range(rnd.randrange(4)):
            s = rnd.choice(some)
            a = rnd.randrange(len(s))
            t += s[a : a + base + rnd.randrange(base)] + rnd.choice(["", "é", "xy"])
        rows.append((i, t))
    return rows + [(100, None), (101, ""), (102, "ab" * base), (103, "q" * (3 * base)), (7, rows[7][1]), (7, "other " + some[0]), (None, some[1])]


@pytest.mark.parametrize(("alphabet", "length", "gram", "group"), [("abcdefghij é", 60, 12, 20000), ("ab", 40, 8, 20000), ("abcdefgh ", 60, 12, 2)])
def test_all_windows(spark, alphabet, length, gram, group):
    rows = corpus(len(alphabet) + group, alphabet, length)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, same string")
    got = substrings.deduplicated(docs, length=length, gram=gram, group=group, bodies=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("group", [2, 1000])
def test_what_is_noticed_but_stays(spark, group):
    rows = corpus(5 + group, "abcdefgh ", 60)
    docs = spark.createDataFrame([(i, t, [1], "x", b"") for i, t in rows], "doc_id long, text string, spans array<int>, same string, t binary")
    got = substrings.deduplicated(docs, length=60, noticed=35, gram=12, group=group).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 60)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_repeated) for r in got) == sorted(x[:3] for x in brute(rows, 35))
    assert any(r.n_repeated > r.n_removed > 0 for r in got)


def test_long_texts_are_cut_without_loss(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8))
    whole = substrings.anchors(raw, 60, 12)
    monkeypatch.setattr(substrings, "_PIECE", 700)
    cut = substrings.anchors(raw, 60, 12)
    spread = lambda x: {(int(p), s) for _, _, p, lo, hi in zip(*x, strict=True) for s in range(lo, hi + 1)}
    assert spread(whole) == spread(cut)


def test_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
