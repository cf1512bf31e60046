"""Personal data against a plain reading of the patterns."""

import math
import random
import re

from longitrack.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def by_hand(t):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= n(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= n(s) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_base_spans(spark):
    rnd = random.Random(3)
    bits = ["a.b%", "@", "x-1", ".", "com", " ", "12", "255", "256", "0007", "+", "(555)", "-", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "é😀", "_", "\n", "+1 (555) 555-1234", "3"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "7" * 60000), (903, "a" * 60000 + "@"), (904, "1-" * 30000), (905, "1.2.3.4 " * 3000), (None, "me@x.org"), (7, "9.9.9.9 twice"), (7, "9.9.9.9 twice"), (7, "other 8.8.8.8")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = pii.found(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), ",".join(by_hand(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert sum(r[f"n_{k}"] for k in pii.KINDS) == len(list(filter(None, r.base.split(","))))


def test_terms_that_disclose(spark):
    near = [(i, f"Write to Zorblax of the office at boss@corp.org the day {i} and more words") for i in range(5)]
    rest = [(100 + i, f"the office of day {i} has words and at times more to write of the same") for i in range(200)]
    docs = spark.createDataFrame(near + rest, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.found(docs).collect()}
    # what the share should be, by hand, for a term seen with the entity alone and one seen everywhere
    assert math.isclose(math.log(205 * 5 / (5 * 5)) / math.log(205 / 5), 1.0)
    for i, t in near:
        terms = {t[int(a) : int(b)] for k, a, b in (x.split(":") for x in rows[i].spans.split(",")) if k == "term"}
        assert terms == {"Zorblax"}
    assert all(rows[i].spans == "" for i, _ in rest)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "Write to [TERM] of the office at [EMAIL] the day 0 and more words" and clean[100] == rest[0][1]


def terms_of(row, text):
    return {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in row.spans.split(",")) if k == "term"}


def test_entities_of_one_document_have_terms(spark):
    rows = [(0, "Write to Quuxley of the office at me@corp.org the day and more words")]
    rows += [(100 + i, "the office of day has words and at times more to write of the same") for i in range(200)]
    got = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert terms_of(got[0], rows[0][1]) == {"Quuxley"} and all(got[i].spans == "" for i, _ in rows[1:])


def test_terms_of_the_whole_text_are_found_and_removed_everywhere(spark):
    far = "many words of the same office and more to write " * 5
    rows = [(i, f"Zorblax {far} case 77001234 at boss@corp.org the day {far} ZORBLAX and more") for i in range(2)]
    rows += [(100 + i, f"the office of day has words and at times case {i} {far}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for i, t in rows[:2]:
        assert terms_of(got[i], t) == {"Zorblax", "ZORBLAX", "77001234"}
    assert all(got[i].spans == "" for i, _ in rows[2:])
    assert "zorblax" not in pii.sanitised(docs).where("doc_id = 0").collect()[0].text.lower()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.found(docs).count() == 0 and pii.sanitised(docs).count() == 0


def test_texts_without_matches_are_not_shuffled(spark):
    """A text is joined for its terms only if it has a match; before, all texts of the corpus were."""
    texts = spark.createDataFrame([(1, 7, "no match here"), (2, 8, "write to a@b.org"), (3, 9, "call 1.2.3.4")], "doc long, same long, t string")
    assert sorted(r.doc for r in pii._own(texts, texts.select("doc", "same")).collect()) == [2, 3]
