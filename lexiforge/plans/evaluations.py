"""Queries that evaluate: keystrokes, next words, autocorrection, re-ranking, objectives, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lang
from ..functions import text as T
from ..operators import backoff as K
from ..operators import channel as N
from ..operators import evals as E
from ..operators import order as O
from ..operators import pieces as P
from ..operators import sequences as S
from ..operators import vocab as V
from . import sqltext as Q
from .base import docs, kept, q, table
from .sequences import real_pairs
from .typos import words
from .vocabulary import BIGRAMS

B = Q.B
TURN = ["conv_id", "turn"]
TOKENS = f"list_transform(regexp_extract_all(text, '{B}'), lambda x: lower(x))"
q(
    "prefix_expand", lambda s, d: E.prefixes(table(s, d, "conversations"), TURN),
    f"WITH x AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(1, len(w))) AS pos FROM x) SELECT conv_id, turn, pos, w[pos] AS prev, w[pos + 1] AS target, array_to_string(w[1:pos], ' ') AS prefix FROM e",
)
TOP = f"big AS ({BIGRAMS}), pred AS (SELECT w1 AS prev, list(w2 ORDER BY cnt DESC, w2) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY cnt DESC, w2) AS r FROM big) t WHERE r <= 5 GROUP BY w1)"
HIT = "(target = {0} OR (length({0}) >= 2 AND starts_with(target, {0})))"
q(
    "keystrokes", lambda s, d: E.keystrokes(table(s, d, "conversations"), docs(s, d), TURN),
    f"""WITH {TOP}, x AS (SELECT {TOKENS} AS w FROM conversations), e AS (SELECT w, unnest(range(1, len(w))) AS pos FROM x), p AS (SELECT w[pos] AS prev, w[pos + 1] AS target FROM e),
j AS (SELECT target, coalesce({HIT.format('topk[1]')}, false) AS h1, coalesce(len(list_filter(topk, lambda y: {HIT.format('y')})) > 0, false) AS hk FROM p LEFT JOIN pred USING (prev)),
a AS (SELECT CAST(sum(length(target)) AS BIGINT) AS chars, CAST(sum(CASE WHEN h1 THEN length(target) ELSE 0 END) AS BIGINT) AS saved_top1, CAST(sum(CASE WHEN hk THEN length(target) ELSE 0 END) AS BIGINT) AS saved_topk, count(*) AS n FROM j)
SELECT *, round(saved_topk * 100.0 / chars, 6) AS pct_topk FROM a""",
)
q(
    "nextword_acc", lambda s, d: E.next_word(table(s, d, "conversations"), docs(s, d)),
    f"""WITH {TOP}, x AS (SELECT {TOKENS} AS w FROM conversations), p AS (SELECT w[i] AS prev, w[i + 1] AS gold FROM (SELECT w, greatest(2, CAST(floor(len(w) * 0.6) AS INT)) AS i FROM x WHERE len(w) >= 4) y)
SELECT count(*) FILTER (WHERE topk[1] = gold) AS top1, count(*) FILTER (WHERE list_contains(topk, gold)) AS topk, count(*) AS n FROM p LEFT JOIN pred USING (prev)""",
)
PMI = f"""big AS MATERIALIZED ({BIGRAMS}), l AS (SELECT w1, sum(cnt) AS n1 FROM big GROUP BY w1), r AS (SELECT w2, sum(cnt) AS n2 FROM big GROUP BY w2),
pmi AS (SELECT w1, w2, cnt, round(ln(cnt / n1) - ln(n2 / (SELECT sum(cnt) FROM big)), 6) AS pmi FROM big JOIN l USING (w1) JOIN r USING (w2))"""
q("surprisal", lambda s, d: E.mutual_information(docs(s, d)), f"WITH {PMI} SELECT w1, w2, cnt, pmi FROM pmi")
q("surprisal_rerank", lambda s, d: E.reranked(docs(s, d)), f"WITH {PMI} SELECT w1, min(struct_pack(p := -pmi, w := w2)).w AS best FROM pmi GROUP BY w1")

# --- autocorrection: typos of all words, and the aliases, against the words of the corpus


def typo_cases(s, d, numbered=None):
    rows = S.typos(words(s, d) if numbered is None else numbered, "word", "i").select("typed", F.col("word").alias("committed"))
    return rows.unionByName(real_pairs(s, d).select("typed", "committed"))


def cases_and_words(s, d):
    """The cases and the words they are corrected by, from one count of the texts."""
    counts = kept(V.word_counts(docs(s, d), least=3))
    return typo_cases(s, d, O.numbered(counts)), counts


NEAR = "list_distinct(list_prepend({0}, list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: {0}[1:i - 1] || {0}[i + 1:])))"
CASES = f"""{Q.WORDS}, {Q.with_typos('t', 'w', 'word', 'i')},
cases AS (SELECT typed, word AS committed FROM t UNION ALL SELECT DISTINCT * FROM (VALUES {Q.values((a, w) for w, forms in lang.SHORTCUTS.items() for a in forms if a != w)}) v(typed, committed)),
a AS (SELECT typed, unnest({NEAR.format('lower(typed)')}) AS k FROM (SELECT DISTINCT typed FROM cases) x),
b AS (SELECT word, cnt, unnest({NEAR.format('word')}) AS k FROM w),
m AS (SELECT DISTINCT typed, word, cnt FROM a JOIN b USING (k)),
top AS (SELECT typed, list(word ORDER BY cnt DESC, word) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY cnt DESC, word) AS r FROM m) y WHERE r <= 5 GROUP BY typed),
j AS (SELECT typed, committed, topk FROM cases LEFT JOIN top USING (typed))"""
q(
    "autocorrect_topk", lambda s, d: E.corrections(typo_cases(s, d), words(s, d)).select("typed", F.array_join("topk", " ").alias("topk")),
    f"WITH {CASES} SELECT typed, array_to_string(topk, ' ') AS topk FROM top",
)


def _autocorrect(s, d):
    cases = kept(typo_cases(s, d))
    return E.accuracy(E.corrected_hits(cases, E.corrections(cases, words(s, d))))


q("autocorrect_acc", _autocorrect, f"WITH {CASES} SELECT count(*) FILTER (WHERE lower(topk[1]) = lower(committed)) AS top1, count(*) FILTER (WHERE list_contains(topk, lower(committed))) AS topk, count(*) AS n FROM j")

# --- correction by a noisy channel: the same cases, all words within two edits

#: DuckDB counts edits of bytes: small letters from ß to ÿ become capitals and signs, which the words do not have.
ONE_BYTE = f"translate({{}}, '{''.join(map(chr, range(0xDF, 0x100)))}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()')"
q(
    "channel_candidates", lambda s, d: N.candidates(*cases_and_words(s, d), costs=None).select("typed", "word", "edits"),
    f"""WITH {CASES}, c AS (SELECT DISTINCT typed, {ONE_BYTE.format('lower(typed)')} AS low FROM cases WHERE length(typed) <= {N.WIDTH}), v AS (SELECT word, {ONE_BYTE.format('word')} AS code FROM w WHERE length(word) <= {V.LONGEST})
SELECT typed, word, damerau_levenshtein(low, code) AS edits FROM c JOIN v ON length(low) BETWEEN length(word) - 2 AND length(word) + 2 WHERE damerau_levenshtein(low, code) <= 2""",
)


def _channel(s, d):
    cases, counts = cases_and_words(s, d)
    cases = kept(cases)
    return E.accuracy(E.corrected_hits(cases, N.corrections(cases, counts)))


q("channel_acc", _channel)


def _channel_in_text(s, d):
    """Every word of the conversations, mistyped where a typo can be drawn, is corrected after the two words before it."""
    steps = E.contexts(table(s, d, "conversations"), TURN).withColumn("i", F.concat_ws(".", *TURN, "pos"))
    cases = kept(S.typos(steps, "target", "i").select("prev2", "prev", "typed", F.col("target").alias("committed")))
    top = N.corrections_in_text(cases, words(s, d), K.model(docs(s, d)))
    j = cases.join(K.merged(top), ["prev2", "prev", "typed"], "left").select("typed", "committed", "topk")
    hit = lambda c: F.coalesce(c, F.lit(False))
    return E.accuracy(j.select(hit(T.same_word(F.get("topk", F.lit(0)), F.col("committed"), False)).alias("top1_hit"), hit(F.exists("topk", lambda w: T.same_word(w, F.col("committed"), False))).alias("topk_hit")))


q("channel_in_text", _channel_in_text)

# --- re-ranking and objectives

MODEL = f"""big AS MATERIALIZED ({BIGRAMS}), l AS MATERIALIZED (SELECT w1, sum(cnt) AS n1 FROM big GROUP BY w1), r AS MATERIALIZED (SELECT w2, sum(cnt) AS n2 FROM big GROUP BY w2),
s AS MATERIALIZED (SELECT sum(n2) AS n, count(*) AS kinds FROM r)"""
LP = "ln((coalesce(big.cnt, 0) + 1) / (coalesce(l.n1, 0) + s.kinds)) AS lp, ln((coalesce(r.n2, 0) + 1) / (s.n + s.kinds)) AS base"
JOINS = "LEFT JOIN big ON big.w1 = t.prev AND big.w2 = t.word LEFT JOIN l ON l.w1 = t.prev LEFT JOIN r ON r.w2 = t.word, s"
SCORED = f"""{MODEL}, x AS (SELECT conv_id, turn, w, CAST(floor(len(w) * 0.6) AS INT) AS i FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) y WHERE len(w) >= 6),
o AS (SELECT conv_id, turn, w[i] AS context, unnest([w[i + 1:i + 2], w[1:2], w[len(w) - 1:]]) AS words, unnest([0, 1, 2]) AS nth FROM x),
t AS MATERIALIZED (SELECT conv_id, turn, nth, words[place + 1] AS word, CASE WHEN place = 0 THEN context ELSE words[place] END AS prev, place FROM (SELECT *, unnest(range(len(words))) AS place FROM o) z),
v AS (SELECT t.*, {LP} FROM t {JOINS}),
g AS (SELECT conv_id, turn, nth, count(*) AS n, sum(lp) AS c, sum(CASE WHEN place = 0 THEN base ELSE lp END) AS b FROM v GROUP BY conv_id, turn, nth),
h AS (SELECT conv_id, turn, nth, unnest(['sum_logprob', 'per_token', 'surprisal_sum', 'surprisal_ptok', 'surprisal_ratio']) AS method, round(unnest([c, c / n, c - b, (c - b) / n, c / n - b / n]), 9) AS score FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, method ORDER BY score DESC, nth) AS rk FROM h)"""


def _rerank(s, d):
    rows = table(s, d, "conversations")
    return E.reranking(E.phrase_scores(E.phrase_cases(rows, TURN), TURN, docs(s, d)), TURN)


q("rerank_methods", _rerank, f"WITH {SCORED} SELECT method, count(*) FILTER (WHERE nth = 0) AS hits, count(*) AS n FROM k WHERE rk = 1 GROUP BY method")
LOSSES = f"""{MODEL}, x AS (SELECT conv_id, turn, w FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) y WHERE len(w) >= 3),
p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM x),
t AS MATERIALIZED (SELECT conv_id, turn, w[i] AS prev, d, w[i + d] AS word FROM p, (VALUES (1), (2)) u(d) WHERE i + d <= len(w)),
v AS (SELECT t.*, {LP} FROM t {JOINS}),
z AS (SELECT conv_id, turn, round(-avg(lp) FILTER (WHERE d = 1), 6) AS next_loss, round(-avg(lp) FILTER (WHERE d = 2), 6) AS skip_loss FROM v GROUP BY conv_id, turn)"""
q("objective_losses", lambda s, d: E.objective_losses(table(s, d, "conversations"), TURN, docs(s, d)), f"WITH {LOSSES} SELECT *, next_loss < skip_loss AS ok FROM z")
q(
    "objective_verdict", lambda s, d: E.verdict(E.objective_losses(table(s, d, "conversations"), TURN, docs(s, d)), F.col("ok")),
    f"WITH {LOSSES}, f AS (SELECT count(*) FILTER (WHERE next_loss < skip_loss) AS hits, count(*) AS n FROM z) SELECT hits, n, CASE WHEN hits = n THEN 'healthy' WHEN hits = 0 THEN 'broken' ELSE 'mixed' END AS verdict FROM f",
)


def _carried(s, d):
    """The words that follow a word, and those that the first two letters of the next word leave."""
    top = E.prefixes(table(s, d, "conversations"), TURN).select(*TURN, "pos", "prev", "target")
    rows = top.join(E.predictor(docs(s, d), first=top).withColumnRenamed("w1", "prev"), "prev").select(*TURN, "pos", F.substring("target", 1, 2).alias("typed"), F.posexplode("topk").alias("nth", "word"))
    rows = rows.withColumn("p", F.lit(1.0) / (F.col("nth") + 2))
    return E.carried_forward(rows, rows.filter("nth < 3"), [*TURN, "pos"]).select(*TURN, "pos", "word", F.round("p", 6).alias("p"), F.col("rank").cast("bigint").alias("rank"))


q(
    "carried_forward", _carried,
    f"""WITH {TOP}, x AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(1, len(w))) AS pos FROM x),
c AS (SELECT conv_id, turn, pos, w[pos + 1][1:2] AS typed, unnest(topk) AS word, unnest(range(len(topk))) AS nth FROM e JOIN pred ON pred.prev = w[pos]),
p AS (SELECT conv_id, turn, pos, word, 1.0::DOUBLE / (nth + 2) + 0.1::DOUBLE AS p FROM c WHERE starts_with(word, typed) UNION ALL SELECT conv_id, turn, pos, word, 1.0::DOUBLE / (nth + 2) FROM c WHERE nth < 3),
b AS (SELECT conv_id, turn, pos, word, max(p) AS p FROM p GROUP BY ALL)
SELECT conv_id, turn, pos, word, round(p, 6) AS p, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY p DESC, word) AS rank FROM b QUALIFY rank <= 3""",
)


def _progress(s, d):
    step, took = F.col("event_id"), F.col("event_id") % 997
    return table(s, d, "events").select("event_id", *[v.alias(k) for k, v in E.progress(step, F.lit(8000), took, F.lit(512)).items()], T.utc_stamp(F.col("ts")).alias("stamp"))


q(
    "progress", _progress,
    """SELECT event_id, floor(10000.0::DOUBLE * event_id / 8000 + 0.5) / 100 AS pct, CAST(CASE WHEN e > 0 AND event_id > 0 THEN floor(greatest(0, 8000 - event_id) / (event_id::DOUBLE / e)) ELSE 0 END AS BIGINT) AS eta,
CAST(CASE WHEN e > 0 THEN floor(event_id * 512 / e) ELSE 0 END AS BIGINT) AS tps, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT *, event_id % 997 AS e FROM events) t""",
)
q(
    "normal_words", lambda s, d: docs(s, d).select(F.explode(F.split("text", " ")).alias("w")).select(T.normal_word(F.concat(F.lit("▁ "), "w")).alias("word"), T.first_word(F.col("w")).alias("first")).groupBy("word", "first").agg(F.count("*").alias("n")),
    r"""SELECT word, first, count(*) AS n FROM (SELECT trim(lower(trim(w)), '.,!?;:"''()«»[]{}') AS word, regexp_extract(trim(w), '^[^\s.,!?;:"''()«»\[\]{}]+') AS first FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t) x GROUP BY word, first""",
)
