"""Decontamination against exact containment of all pairs."""

import random
import re

from longitrack.llm import decontaminate


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(docs, items, t=0.8):
    out = {}
    for j, b in items:
        n = shingles(b, 1)[1]
        if not n:
            continue
        own = shingles(b, min(5, n))[0]
        for i, d in docs:
            got = len(own & shingles(d, min(5, n))[0])
            if got >= t * len(own) - 1e-9:
                out[(i, j)] = max(out.get((i, j), 0), got / len(own))
    return out


def test_all_pairs(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(50)] + ["É", "The"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 6, 20, 60, 200])))) for i in range(60)] + [(60, ""), (61, None), (5, "only here and so on to the end"), (62, "a a a a a a a a a")]
    docs = []
    for i in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 2, 30, 400]))]
        for _ in range(rnd.choice([0, 1, 3])):
            b = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.randrange(3)):
                if b:
                    b[rnd.randrange(len(b))] = "changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = b
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(w).upper() if i % 3 else " ".join(w)))
    docs += [(900, None), (901, ""), (3, docs[3][1]), (3, items[0][1]), (902, "A " * 50000)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, item_id int")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id): round(r.containment, 9) for r in got} == {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = decontaminate.decontaminated(d, b)
    bad = {i for i, _ in brute(docs, items)}
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, none).count() == 0
    assert decontaminate.decontaminated(d, none).count() == 1
    assert decontaminate.contaminated(d.where("false"), d.withColumnRenamed("doc_id", "item_id")).count() == 0
