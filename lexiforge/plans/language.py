"""Queries of the back-off model: shares of all trigrams, losses, keystrokes, plausible next words, objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backoff as K
from ..operators import evals as E
from .base import docs, q, table
from .evaluations import HIT, TOKENS, TURN


def _discount(rows: str, c: str) -> str:
    n1, n2 = (f"count(*) FILTER (WHERE {c} = {x})" for x in (1, 2))
    return f"(SELECT CASE WHEN {n1} > 0 AND {n2} > 0 THEN {n1}::DOUBLE / ({n1} + 2.0::DOUBLE * {n2}) ELSE {K.HALF}::DOUBLE END FROM {rows})"


#: Counts of three orders, sums of contexts, and one row of discounts.
COUNTS = f"""t AS (SELECT list_concat(['{K.START}', '{K.START}'], {TOKENS}) AS t FROM documents),
e AS (SELECT unnest(t[1:len(t) - 2]) AS w1, unnest(t[2:len(t) - 1]) AS w2, unnest(t[3:]) AS w3 FROM t WHERE len(t) > 2),
tri AS MATERIALIZED (SELECT w1, w2, w3, count(*) AS cnt FROM e GROUP BY w1, w2, w3),
pairs AS MATERIALIZED (SELECT w1, w2, sum(cnt)::DOUBLE AS n, count(*) AS kinds FROM tri GROUP BY w1, w2),
bi AS MATERIALIZED (SELECT w2, w3, CAST(CASE WHEN w2 = '{K.START}' THEN sum(cnt) ELSE count(*) END AS BIGINT) AS c FROM tri GROUP BY w2, w3),
heads AS MATERIALIZED (SELECT w2, sum(c)::DOUBLE AS n, count(*) AS kinds FROM bi GROUP BY w2),
uni AS MATERIALIZED (SELECT w3, count(*) AS c FROM bi GROUP BY w3),
d AS MATERIALIZED (SELECT {_discount('tri', 'cnt')} AS d3, {_discount('bi', 'c')} AS d2, {_discount('uni', 'c')} AS d1, (SELECT sum(c)::DOUBLE FROM uni) AS total, (SELECT count(*)::DOUBLE FROM uni) AS kinds),
k AS MATERIALIZED (SELECT *, d1 * kinds / total / (kinds + 1) AS p0 FROM d)"""


def shares(name: str, asked: str) -> str:
    """CTEs that end in `name`: w1, w2, w3 and p of all that is asked for, once."""
    return f"""{name} AS MATERIALIZED (SELECT a.w1, a.w2, a.w3, coalesce((x.cnt - k.d3) / c.n, 0.0::DOUBLE) + coalesce((k.d3 * c.kinds) / c.n, 1.0::DOUBLE) *
 (coalesce((b.c - k.d2) / h.n, 0.0::DOUBLE) + coalesce((k.d2 * h.kinds) / h.n, 1.0::DOUBLE) * coalesce((u.c - k.d1) / k.total + k.p0, k.p0)) AS p
 FROM (SELECT DISTINCT w1, w2, w3 FROM {asked}) a LEFT JOIN tri x ON x.w1 = a.w1 AND x.w2 = a.w2 AND x.w3 = a.w3 LEFT JOIN pairs c ON c.w1 = a.w1 AND c.w2 = a.w2
 LEFT JOIN bi b ON b.w2 = a.w2 AND b.w3 = a.w3 LEFT JOIN heads h ON h.w2 = a.w2 LEFT JOIN uni u ON u.w3 = a.w3, k)"""


TALK = f"talk AS MATERIALIZED (SELECT conv_id, turn, {TOKENS} AS w FROM conversations)"
START = f"['{K.START}', '{K.START}']"
#: A row for each word of each turn, with the two before it.
STEPS = f"s AS (SELECT conv_id, turn, list_concat({START}, w) AS p, w FROM talk WHERE len(w) > 0), steps AS MATERIALIZED (SELECT conv_id, turn, unnest(p[1:len(w)]) AS w1, unnest(p[2:len(w) + 1]) AS w2, unnest(w) AS w3 FROM s)"
q(
    "backoff_model", lambda s, d: K.all_shares(K.model(docs(s, d))).select("w1", "w2", "w3", F.round("p", 9).alias("p")),
    f"WITH {COUNTS}, {shares('v', 'tri')} SELECT w1, w2, w3, round(p, 9) AS p FROM v",
)
q(
    "backoff_losses", lambda s, d: E.turn_losses(table(s, d, "conversations"), TURN, lambda steps: K.with_loss(steps, K.model(docs(s, d)))),
    f"WITH {COUNTS}, {TALK}, {STEPS}, {shares('v', 'steps')} SELECT conv_id, turn, round(-avg(ln(p)), 6) AS loss, count(*) AS n FROM steps JOIN v USING (w1, w2, w3) GROUP BY conv_id, turn",
)


def _best(s, d):
    return lambda contexts: K.best_words(contexts, K.model(docs(s, d)))


#: prev2, prev and topk of the contexts in `ask` (w1, w2): candidates are all words seen after w2, and the five best words of all.
BEST = f"""heap AS (SELECT w3 FROM uni, k ORDER BY (c - d1) / total + p0 DESC, w3 LIMIT 5),
cand AS MATERIALIZED (SELECT w1, w2, w3 FROM ask JOIN bi USING (w2) UNION SELECT w1, w2, w3 FROM ask, heap), {shares('v', 'cand')},
top AS MATERIALIZED (SELECT w1 AS prev2, w2 AS prev, list(w3 ORDER BY p DESC, w3) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY p DESC, w3) AS r FROM v) y WHERE r <= 5 GROUP BY w1, w2)"""
q(
    "keystrokes_backoff", lambda s, d: E.keystrokes(table(s, d, "conversations"), docs(s, d), TURN, _best(s, d)),
    f"""WITH {COUNTS}, {TALK}, {STEPS}, late AS MATERIALIZED (SELECT w1 AS prev2, w2 AS prev, w3 AS target FROM steps WHERE w2 <> '{K.START}'), ask AS (SELECT DISTINCT prev2 AS w1, prev AS w2 FROM late), {BEST},
j AS (SELECT target, coalesce({HIT.format('topk[1]')}, false) AS h1, coalesce(len(list_filter(topk, lambda y: {HIT.format('y')})) > 0, false) AS hk FROM late LEFT JOIN top USING (prev2, prev)),
a AS (SELECT CAST(sum(length(target)) AS BIGINT) AS chars, CAST(sum(CASE WHEN h1 THEN length(target) ELSE 0 END) AS BIGINT) AS saved_top1, CAST(sum(CASE WHEN hk THEN length(target) ELSE 0 END) AS BIGINT) AS saved_topk, count(*) AS n FROM j)
SELECT *, round(saved_topk * 100.0 / chars, 6) AS pct_topk FROM a""",
)
q(
    "nextword_plausible", lambda s, d: E.next_word_plausible(table(s, d, "conversations"), _best(s, d)),
    f"""WITH {COUNTS}, {TALK}, {STEPS}, late AS MATERIALIZED (SELECT w1 AS prev2, w2 AS prev, list(DISTINCT w3) AS right_ones FROM steps WHERE w2 <> '{K.START}' GROUP BY w1, w2),
cases AS MATERIALIZED (SELECT w[i - 1] AS prev2, w[i] AS prev FROM (SELECT w, greatest(2, CAST(floor(len(w) * 0.6) AS INT)) AS i FROM talk WHERE len(w) >= 4) y), ask AS (SELECT DISTINCT prev2 AS w1, prev AS w2 FROM cases), {BEST}
SELECT count(*) FILTER (WHERE list_contains(right_ones, topk[1])) AS top1, count(*) FILTER (WHERE list_has_any(right_ones, topk)) AS topk, count(*) AS n FROM cases JOIN late USING (prev2, prev) LEFT JOIN top USING (prev2, prev)""",
)
q(
    "objective_backoff", lambda s, d: E.objective_losses(table(s, d, "conversations"), TURN, docs(s, d), lambda steps: K.with_loss(steps, K.model(docs(s, d)))),
    f"""WITH {COUNTS}, {TALK}, p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM talk WHERE len(w) >= 3),
steps AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN i = 1 THEN '{K.START}' ELSE w[i - 1] END AS w1, w[i] AS w2, d, w[i + d] AS w3 FROM p, (VALUES (1), (2)) u(d) WHERE i + d <= len(w)), {shares('v', 'steps')},
z AS (SELECT conv_id, turn, round(-avg(ln(p)) FILTER (WHERE d = 1), 6) AS next_loss, round(-avg(ln(p)) FILTER (WHERE d = 2), 6) AS skip_loss FROM steps JOIN v USING (w1, w2, w3) GROUP BY conv_id, turn)
SELECT *, next_loss < skip_loss AS ok FROM z""",
)
