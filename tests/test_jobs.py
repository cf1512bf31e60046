"""The jobs: two runs over growing input, cut-short batches, single runs made anew, odd rows, the command line."""

import logging
import math
import os
import random
import re
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import benchmark_suite, reference_links

DOCS = "doc_id long, text string, lang string, source string, extra int, word string, key string, batch int"
VOCABULARY = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]


def texts(seed, n, start=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ws = rnd.choices(VOCABULARY, k=rnd.choice([3, 20, 60]))
        rows.append((start + i, " ".join(ws).title() + "!", rnd.choice(["en", "fr", None, ""]), "s", 1, "x", "y", 7))
    return rows


def items():
    rnd = random.Random(1)
    return [(k, " ".join(rnd.sample(VOCABULARY, rnd.choice([2, 5, 12])))) for k in range(25)] + [(90, None), (91, " 1 2 "), (3, "")]


def words(t):
    return set(re.findall(r"[^\W\d_]+", (t or "").lower()))


def brute(docs, items, share=0.5, clear=0.05):
    """{(doc_id, text): (area, item_id, inter, status)}"""
    out = {}
    for d in docs:
        w, found = words(d[1]), []
        for k, t in items:
            v = words(t)
            inter = len(w & v)
            if v and inter >= math.ceil(share * len(v) - 1e-9):
                n, m = len(w), len(v)
                cost = -6 * math.log(max(inter / (n + m - inter), 1e-6)) + 2 * (1 - inter / math.sqrt(n * m)) + 0.5 * abs(math.log(n / m))
                found.append((max(cost, 0), k, inter))
        found.sort()
        best = found[0] if found else (None, None, 0)
        out[d[0], d[1]] = (len(w), best[1], best[2], "unlinked" if not found else "ambiguous" if len(found) > 1 and found[1][0] - found[0][0] < clear else "linked")
    return out


def put(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def held(df):
    return {(r.doc_id, r.lang, r.area, r.item_id, r.inter, r.status) for r in df.collect()}


def wanted(docs, found):
    return {(d[0], d[2], *found[d[0], d[1]]) for d in docs}


@pytest.fixture()
def place(spark, tmp_path):
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/items")
    return str(tmp_path)


def run(spark, place, **config):
    return reference_links.run(spark, f"{place}/docs", f"{place}/items", f"{place}/out", f"{place}/checkpoint", config)


def test_growing_input_takes_only_what_is_new(spark, place, caplog):
    caplog.set_level(logging.INFO, "jobs.reference_links")
    first, second = texts(1, 60), texts(2, 40, 60)
    put(spark, first, f"{place}/docs")
    assert held(run(spark, place)) == wanted(first, brute(first, items()))
    put(spark, second, f"{place}/docs")
    out = run(spark, place)
    assert held(out) == wanted(first + second, brute(first + second, items()))
    taken = [int(m[1]) for m in re.finditer(r"took (\d+) new rows", caplog.text)]
    assert taken == [60, 40]
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{place}/out/links") for f in fs if f.startswith("part-")}
    assert held(run(spark, place)) == held(out)
    assert before == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{place}/out/links") for f in fs if f.startswith("part-")}
    report = {r.item_id: r.n_texts for r in spark.read.parquet(f"{place}/out/summary").collect()}
    assert report == {k: Counter(x[1] for x in brute(first + second, items()).values())[k] for k, _ in items()}


def test_a_batch_cut_short_is_made_again(spark, place):
    docs = texts(3, 30)
    put(spark, docs, f"{place}/docs")
    run(spark, place)
    # as if it had ended after the write and before the commit
    for name in os.listdir(f"{place}/checkpoint/commits"):
        os.remove(f"{place}/checkpoint/commits/{name}")
    out = run(spark, place)
    assert out.count() == 30 and held(out) == wanted(docs, brute(docs, items()))
    assert [b for b in os.listdir(f"{place}/out/links") if b.startswith("batch=")] == ["batch=0"]


def test_odd_rows_and_later_versions(spark, place):
    odd = [(1, None, "en", "s", 1, "x", "y", 7), (2, "", None, None, 1, "x", "y", 7), (None, items()[1][1], "", "s", 1, "x", "y", 7), (4, "long " * 50_000 + items()[2][1], "de", "s", 1, "x", "y", 7)]
    odd += [odd[-1]]  # a repeated row
    put(spark, odd, f"{place}/docs")
    out = run(spark, place)
    assert out.count() == 4 and held(out) == wanted(odd, brute(odd, items()))
    later = [(4, "nothing", "de", "s", 1, "x", "y", 7)]
    put(spark, later, f"{place}/docs")
    now = run(spark, place)
    assert held(now) == wanted(odd[:3] + later, brute(odd[:3] + later, items()))


def test_many_small_batches_give_the_same(spark, place):
    docs = texts(4, 45)
    for i in range(0, 45, 15):
        put(spark, docs[i : i + 15], f"{place}/docs")
    assert held(run(spark, place, files_per_batch=1)) == wanted(docs, brute(docs, items()))
    assert len([b for b in os.listdir(f"{place}/out/links") if b.startswith("batch=")]) == 3


def test_empty_tables(spark, place, tmp_path):
    put(spark, [], f"{place}/docs")
    assert run(spark, place).count() == 0
    docs = texts(5, 5)
    put(spark, docs, f"{place}/docs")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{place}/none")
    out = reference_links.run(spark, f"{place}/docs", f"{place}/none", f"{place}/out2", f"{place}/checkpoint2")
    assert {r.status for r in out.collect()} == {"unlinked"} and out.count() == 5


def events(seed, users=40, days=8):
    rnd = random.Random(seed)
    return [(u, f"2024-01-{d + 1:02d} {rnd.choice([3, 3, 4, 9, 22, 23]):02d}:{rnd.randrange(60):02d}:00") for u in range(users) for d in range(days) for _ in range(rnd.choice([0, 1, 1, 3]))]


CUSTOMERS = [(u, u % 3) for u in range(30)] + [(5, 9)]
CONFIG = benchmark_suite.settings()


def plain(rows, runs):
    """Counts by (run, kind, subject) in plain Python, without splits."""
    nation = {}
    for u, n in CUSTOMERS:
        nation[u] = min(n, nation.get(u, n))
    tracks = {}
    for r in [*runs, {"name": "reference", "estimate": CONFIG["reference"]}]:
        hours = {}
        for u, ts in rows:
            h = int(ts[11:13])
            if r.get("before_hour") is None or h < r["before_hour"]:
                hours.setdefault((u, int(ts[8:10]) - 1), []).append(h)
        pick = {"first": min, "last": max, "mean": lambda hs: sum(hs) // len(hs)}[r["estimate"]]
        for (u, d), hs in hours.items():
            tracks.setdefault(r["name"], {}).setdefault(u, {})[d] = pick(hs)
    out = {}

    def bags(name, kind):
        bag = Counter()
        for u, t in tracks.get(name, {}).items():
            s = nation.get(u, -1)
            if kind == "link":
                bag.update((s, d, t[d], t[d + 1]) for d in t if d + 1 in t)
            elif all(d in t for d in range(3)):
                bag[s, t[0], t[1], t[2]] += 1
        return bag

    for r in runs:
        for kind in ("link", "complete"):
            x, y = bags(r["name"], kind), bags("reference", kind)
            for s in {k[0] for k in x | y}:
                mine, theirs = (Counter({k: v for k, v in b.items() if k[0] == s}) for b in (x, y))
                out[r["name"], kind, s] = (sum((mine & theirs).values()), sum((mine - theirs).values()), sum((theirs - mine).values()))
    return out


def suite(spark, rows, where, **kw):
    e = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("run", F.lit("x")).withColumn("subject", F.lit(1))
    e.write.mode("overwrite").parquet(f"{where}/events")
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_nationkey int").write.mode("overwrite").parquet(f"{where}/customers")
    return benchmark_suite.run(spark, f"{where}/events", f"{where}/customers", f"{where}/out", **kw)


def counts(df):
    return {(r.run, r.kind, r.subject): (r.tp, r.fp, r.fn) for r in df.collect()}


def test_suite_against_plain_python_and_one_run_made_anew(spark, tmp_path):
    rows = events(1)
    got = counts(suite(spark, rows, str(tmp_path)))
    want = plain(rows, [r for r in CONFIG["runs"] if "split_below_votes" not in r])
    assert {k: v for k, v in got.items() if k[0] != "first_stable"} == want
    # a split only takes links away
    for s in {k[2] for k in got}:
        a, b = got["first", "link", s], got["first_stable", "link", s]
        assert a[0] >= b[0] and a[1] >= b[1]
    assert counts(suite(spark, rows, str(tmp_path))) == got
    fewer = events(2, users=10)
    again = counts(suite(spark, fewer, str(tmp_path), only=["mean"]))
    assert {k: v for k, v in again.items() if k[0] != "mean" and k[2] in (0, 1, 2)} == {k: v for k, v in got.items() if k[0] != "mean" and k[2] in (0, 1, 2)}
    assert {k: v for k, v in again.items() if k[0] == "mean"} == plain(fewer, [r for r in CONFIG["runs"] if r["name"] == "mean"])
    standings = spark.read.parquet(f"{tmp_path}/out/standings").collect()
    assert {r.metric for r in standings} == {"link_f1_macro", "complete_f1_macro", "link_micro_f1", "complete_micro_f1"} and all(r.gap == 0 for r in standings if r.run == CONFIG["compare_with"])


def test_suite_on_odd_and_no_events(spark, tmp_path):
    odd = [(None, "2024-01-01 01:00:00"), (1, None), (77, "2024-01-01 01:00:00"), (77, "2024-01-02 02:00:00"), (77, "2024-01-02 02:00:00")]
    got = counts(suite(spark, odd, f"{tmp_path}/a"))
    assert got["first", "link", -1] == (1, 0, 0) and {k[2] for k in got} == {-1}
    assert counts(suite(spark, [], f"{tmp_path}/b")) == {}
    with pytest.raises(ValueError):
        suite(spark, odd, f"{tmp_path}/c", config=CONFIG | {"runs": [{"name": "reference", "estimate": "first"}]})


def test_command_line(tmp_path):
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = [sys.executable, "-m", "jobs.benchmark_suite", "--events", f"{tmp_path}/events.parquet", "--customers", "/root/testdata/sf0.001/customer.parquet", "--out", f"{tmp_path}/out"]
    done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1000 rows" in done.stderr and os.path.isdir(f"{tmp_path}/out/scores/run=mean/kind=link")
