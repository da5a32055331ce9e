"""Micro-batches of documents by count and by tokens (words)."""

from __future__ import annotations

from cadenza.operators import batches as B
from cadenza.plans import examples as X

SIZE, BUDGET, PREFIX = 16, 4096, 2


def batch_assignment(spark, sf_dir):
    """Every document's micro-batch of 16 and its place there."""
    return B.by_count(X.lengths(spark, sf_dir), "doc_id", SIZE).select("doc_id", "n", "batch", "place")


def token_budget_packing(spark, sf_dir):
    """Every document's batch of at most 4,096 words, unless it alone has more, and where it begins there."""
    return B.by_budget(X.lengths(spark, sf_dir), "doc_id", "n", BUDGET, prefix=PREFIX)


QUERIES = {f.__name__: f for f in (batch_assignment, token_budget_packing)}
SQL = {
    "batch_assignment": f"""WITH {X.LENGTHS}, r AS (SELECT doc_id, n, row_number() OVER (ORDER BY sha256(doc_id || ':42'), doc_id) - 1 AS rank FROM t)
SELECT doc_id, n, rank // {SIZE} AS batch, (rank % {SIZE})::INT AS place FROM r""",
    "token_budget_packing": f"""WITH RECURSIVE {X.LENGTHS},
r AS (SELECT doc_id, n, left(h, {PREFIX}) AS r, row_number() OVER (PARTITION BY left(h, {PREFIX}) ORDER BY h, doc_id) AS k FROM (SELECT doc_id, n, sha256(doc_id || ':42') AS h FROM t WHERE n > 0)),
packed AS (
  SELECT doc_id, n, r, k, 0 AS b, n AS used, 0::BIGINT AS place, 0::BIGINT AS start FROM r WHERE k = 1
  UNION ALL
  SELECT r.doc_id, r.n, r.r, r.k, CASE WHEN p.used + r.n > {BUDGET} THEN p.b + 1 ELSE p.b END, CASE WHEN p.used + r.n > {BUDGET} THEN r.n ELSE p.used + r.n END,
         CASE WHEN p.used + r.n > {BUDGET} THEN 0 ELSE p.place + 1 END, CASE WHEN p.used + r.n > {BUDGET} THEN 0 ELSE p.used END
  FROM packed p JOIN r ON r.r = p.r AND r.k = p.k + 1),
firsts AS (SELECT r, coalesce(sum(max(b) + 1) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM packed GROUP BY r)
SELECT doc_id, n, (first + b)::BIGINT AS batch, place::INT AS place, start FROM packed JOIN firsts USING (r)""",
}
