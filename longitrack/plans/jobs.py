"""The jobs as queries: each runs twice into one new folder and gives what stands there after the second run."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import benchmark_suite, reference_links
from longitrack.plans.catalog import _round, query
from longitrack.session import new_folder


@query(
    r"""
WITH d AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS h, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS ws FROM documents),
i AS (SELECT DISTINCT item_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS iws FROM benchmark),
c AS (SELECT doc_id, h, item_id, len(list_intersect(ws, iws)) AS inter, len(ws) AS n, len(iws) AS m FROM d, i WHERE len(iws) > 0),
s AS (SELECT *, inter / (n + m - inter) AS iou, 6 * -ln(least(greatest(inter / (n + m - inter), 1e-6), 1)) + 2 * (1 - inter / sqrt(n * m)) + 0.5 * abs(ln(n / m)) AS cost FROM c WHERE inter >= ceil(0.5 * m - 1e-9)),
k AS (SELECT *, row_number() OVER w AS k, lead(cost) OVER w - cost AS margin, count(*) OVER (PARTITION BY doc_id, h) AS n_candidates FROM s WINDOW w AS (PARTITION BY doc_id, h ORDER BY cost, item_id))
SELECT d.doc_id, lang, source, len(ws)::BIGINT AS area, item_id, coalesce(inter, 0)::BIGINT AS inter, round(iou, 6) AS iou, round(inter / m, 6) AS containment, round(cost, 6) AS cost, round(margin, 6) AS margin,
  coalesce(n_candidates, 0)::BIGINT AS n_candidates, CASE WHEN item_id IS NULL THEN 'unlinked' WHEN margin < 0.05 THEN 'ambiguous' ELSE 'linked' END AS status
FROM d LEFT JOIN k ON k.k = 1 AND k.doc_id = d.doc_id AND k.h = d.h
"""
)
def job1_reference_links(spark, d):
    """Texts associated with the benchmark's items as their files come; the second run finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = reference_links.run(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return _round(out.drop("batch"), "iou", "containment", "cost", "margin")


def _links_sql(x: str) -> str:
    return f"SELECT a.run, a.subject, a.session_index AS session_a, b.session_index AS session_b, a.roi AS roi_a, b.roi AS roi_b, a.user_id, a.piece FROM {x} a JOIN {x} b ON a.run = b.run AND a.user_id = b.user_id AND a.piece = b.piece AND b.session_index = a.session_index + 1"


def _ledger_sql(kind: str, keys: str, found: str, truth: str) -> str:
    return f"""SELECT run, subject, '{kind}' AS kind, sum(least(p, r)) AS tp, sum(greatest(p - r, 0)) AS fp, sum(greatest(r - p, 0)) AS fn FROM (
  SELECT run, subject, coalesce(x.n, 0) AS p, coalesce(y.n, 0) AS r FROM (SELECT run, subject, {keys}, count(*) AS n FROM ({found}) GROUP BY ALL) x
  FULL JOIN (SELECT q.run, subject, {keys}, count(*) AS n FROM ({truth}) t, runs q GROUP BY ALL) y USING (run, subject, {keys})) GROUP BY ALL"""


def _complete_sql(x: str) -> str:
    return f"SELECT run, subject, user_id, piece, string_agg(roi::VARCHAR, ',' ORDER BY session_index) AS identity FROM {x} WHERE session_index < 3 GROUP BY ALL HAVING count(*) = 3"


@query(
    f"""
WITH runs AS (SELECT unnest(['first', 'mean', 'last_but_gated', 'first_stable']) AS run),
e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS session_index, min(hour(ts)) AS first, max(hour(ts)) AS last, floor(avg(hour(ts)))::BIGINT AS mean, max(hour(ts)) FILTER (hour(ts) < 22) AS gated FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT e.*, coalesce(n.subject, -1) AS subject FROM e LEFT JOIN (SELECT c_custkey AS user_id, min(c_nationkey)::BIGINT AS subject FROM customer GROUP BY 1) n USING (user_id)),
o AS (SELECT 'first' AS run, subject, user_id, session_index, first AS roi, 0::BIGINT AS piece FROM s UNION ALL SELECT 'mean', subject, user_id, session_index, mean, 0 FROM s
  UNION ALL SELECT 'last_but_gated', subject, user_id, session_index, gated, 0 FROM s WHERE gated IS NOT NULL UNION ALL SELECT 'first_stable', subject, user_id, session_index, first, 0 FROM s),
truth AS (SELECT 'reference' AS run, subject, user_id, session_index, last AS roi, 0::BIGINT AS piece FROM s),
ol AS ({_links_sql("o")}), v AS (SELECT subject, session_a, session_b, roi_a, roi_b, count(*) AS votes FROM (SELECT DISTINCT run, subject, session_a, session_b, roi_a, roi_b FROM ol WHERE run <> 'first_stable') GROUP BY ALL),
cuts AS (SELECT DISTINCT user_id, session_b FROM ol JOIN v USING (subject, session_a, session_b, roi_a, roi_b) WHERE run = 'first_stable' AND votes < 2),
w AS (SELECT o.*, row_number() OVER x - 1 AS before, count(*) OVER (PARTITION BY o.user_id) AS n, c.session_b FROM o LEFT JOIN cuts c ON c.user_id = o.user_id AND c.session_b = o.session_index WHERE run = 'first_stable' WINDOW x AS (PARTITION BY o.user_id ORDER BY session_index)),
p AS (FROM o WHERE run <> 'first_stable' UNION ALL SELECT run, subject, user_id, session_index, roi, sum(CASE WHEN session_b IS NOT NULL AND before >= 2 AND n - before >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY session_index)::BIGINT FROM w),
l AS ({_ledger_sql("link", "session_a, session_b, roi_a, roi_b", _links_sql("p"), _links_sql("truth"))} UNION ALL {_ledger_sql("complete", "identity", _complete_sql("p"), _complete_sql("truth"))})
SELECT run, kind, subject, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM l
"""
)
def job2_benchmark_suite(spark, d):
    """Four ways of reading the events scored by nation; the second run replaces the first one's partitions."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        out = benchmark_suite.run(spark, f"{d}/events.parquet", f"{d}/customer.parquet", folder)
    return _round(out, "precision", "recall", "f1")
