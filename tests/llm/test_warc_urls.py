"""WARC round trips and URL filters."""

import random

import pytest

from longitrack.llm import urls, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_round_trip_with_segments_and_traps(spark, tmp_path):
    rnd = random.Random(1)
    trap = "\r\n\r\nWARC/1.1\r\n"
    texts = ["", None, "x", trap, trap * 50, "a" + trap, "é😀" * 9000, "".join(rnd.choice("ab\r\n") for _ in range(50_000)) + trap, "same", "same", "WARC/1.1\r\n" * 5000, "\r" * 40_000, "b" * 8188 + "WARC/1.1", "WARC/1.1"]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: WARC/1.1", t) for i, t in enumerate(texts)] + [(8, "http://h/8", "same")]
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages(spark, rows), path, segment=1000)
    got = warc.read_archives(spark, path).collect()
    by = {}
    for r in got:
        by.setdefault(int(r.record_id.split(":")[2]), []).append(r)
    assert len(got) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.base32_sha1(raw))
            assert r.payload == raw if r.record_type == "response" else r.payload is None
    assert {r.record_type for r in by[9]} == {"response"} and {(r.record_type, r.refers_to.split(":")[2]) for r in by[8]} == {("revisit", "9")} and len(by[8]) == 2
    assert by[0][0].record_type == "revisit" and by[1][0].record_type == "response"


def test_least_bytes_and_empty(spark, tmp_path):
    warc.archive_pages(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), f"file://{tmp_path}/a", least_bytes=3)
    assert sorted(r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()) == ["response"] * 3 + ["revisit"]
    warc.archive_pages(pages(spark, []), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_lost_segments_and_bad_chunks_stop_the_read(spark, tmp_path):
    parts = warc.records("urn:page:1:x", "u", b"y" * 5000, warc.base32_sha1(b"y" * 5000), None, segment=1000)
    assert len(parts) > 4
    for k in (1, len(parts) - 1):
        path = tmp_path / f"lost{k}"
        path.mkdir()
        (path / "f.warc").write_bytes(b"\r\n".join([*parts[:k], *parts[k + 1 :], b""]))
        with pytest.raises(Exception, match="segments are missing"):
            warc.read_archives(spark, f"file://{path}").collect()
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_rules_and_hosts(spark):
    rows = [(1, "https://Www.Example.com/en/1?q", ""), (2, "http://a.example.com/en/1", ""), (3, "http://example.com/enx", ""), (4, "http://x.net/es/1", ""), (5, "http://x.net/de/1", ""), (6, "http://notcom/en/", ""), (7, None, None), (8, "no host", ""), (9, "http://x.com#f", ""), (10, "http://b.org", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, rows)).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow") and got[4][2:] == ("net/es/", "block")
    assert got[5][:3] == ("x.net", "/de/1", None) and got[5][3] == "block"  # half of its pages are blocked
    assert got[6] == ("notcom", "/en/", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("x.com", "", None, "allow") and got[10] == ("b.org", "", None, "allow")
    assert urls.judge(pages(spark, [])).count() == 0


def plain_rank(seeds, edges, key):
    hosts = set(seeds) | {x for e in edges for x in e[:2]}
    flow = [(a, b, n) if key == 0 else (b, a, n) for a, b, n in edges]
    out = {h: sum(n for a, _, n in flow if a == h) for h in hosts}
    now = {h: 0.15 * seeds.get(h, (0, 0))[key] for h in hosts}
    for _ in range(200):
        now = {h: 0.15 * seeds.get(h, (0, 0))[key] + 0.85 * sum(now[a] * n / out[a] for a, b, n in flow if b == h) for h in hosts}
    return now


def test_long_ways_are_followed_to_the_end(spark):
    # a ring in which a score comes back undiminished but for the damping needs over 60 rounds
    edges = [(f"h{i}", f"h{(i + 1) % 3}", 1) for i in range(3)]
    got = urls.propagate(spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()
    want = plain_rank({"h0": (1.0, 0.0)}, edges, 0)
    assert all(abs(r.trust - want[r.host]) < 1e-5 for r in got) and abs(sum(want.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        urls.propagate(spark.createDataFrame([], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long"), damping=1.0)


def test_propagation(spark):
    seeds = {"good": (1.0, 0.0), "bad": (0.0, 1.0), "shop": (0.0, 0.0)}
    edges = [("good", "shop", 3), ("shop", "news", 1), ("farm", "bad", 5), ("hub", "farm", 1), ("hub", "news", 9), ("bad", "bad2", 1), ("news", "good", 1)]
    got = urls.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()
    for key, name in enumerate(("trust", "distrust")):
        want = plain_rank(seeds, edges, key)
        assert {r.host for r in got} == set(want)
        for r in got:
            assert abs(r[name] - want[r.host]) < 1e-5
    html = {"http://farm.org/a": '<a href="http://x.net/es/1">', "http://x.net/es/1": "", "http://ok.org/": "<a HREF='//x.com/'>"}
    verdicts = {r.host: r.verdict for r in urls.judge(pages(spark, [(i, u, h) for i, (u, h) in enumerate(html.items())])).collect()}
    assert verdicts == {"farm.org": "block", "x.net": "block", "ok.org": "allow"}
