"""Queries on vocabularies and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lang
from ..operators import vocab as V
from .base import c, docs, kept, q, table

A, B = lang.WORD_A.replace("'", "''"), lang.WORD_B.replace("'", "''")
CAP, ART = V.LETTERS, lang.ARTIFACT.replace("'", "''")
LOWER = f"SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(text, '{B}'))) AS word FROM documents) t GROUP BY word"
CAPS = f"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{B}')) AS word FROM documents) t WHERE regexp_matches(word, '{CAP}') GROUP BY word"
BIGRAMS = f"SELECT w1, w2, count(*) AS cnt FROM (SELECT unnest(list_zip(t[1:len(t) - 1], t[2:])) AS z, z[1] AS w1, z[2] AS w2 FROM (SELECT list_transform(regexp_extract_all(text, '{B}'), lambda x: lower(x)) AS t FROM documents) a WHERE len(t) > 1) b GROUP BY w1, w2"
PROPER = f"proper AS MATERIALIZED (SELECT low, cnt, display FROM (SELECT lower(word) AS low, CAST(sum(cnt) AS BIGINT) AS cnt, min(struct_pack(c := -cnt, w := word)).w AS display FROM caps WHERE length(word) BETWEEN 2 AND 30 AND NOT regexp_matches(word, '{ART}') GROUP BY lower(word)) g LEFT JOIN (SELECT word, cnt AS n FROM low) l ON l.word = g.low WHERE cnt >= 3 AND cnt / greatest(1, coalesce(n, 0)) >= 0.5)"
COMMON = f"common AS MATERIALIZED (SELECT word, cnt FROM low WHERE length(word) BETWEEN 2 AND 30 AND cnt >= 3 AND NOT regexp_matches(word, '{ART}') AND NOT EXISTS (SELECT 1 FROM proper WHERE proper.low = low.word))"


def scale(cnt: str, top: str) -> str:
    return f"CAST(greatest(1, least(255, round_even(255 - ln({top} / {cnt}) / ln(1.15), 0))) AS BIGINT)"


BASE = f"WITH low AS MATERIALIZED ({LOWER}), caps AS MATERIALIZED ({CAPS}), {PROPER}, {COMMON}, merged AS (SELECT word, max(cnt) AS cnt FROM (SELECT word, cnt FROM common UNION ALL SELECT display, cnt FROM proper) u GROUP BY word), dict AS (SELECT word, cnt, {scale('cnt', '(SELECT max(cnt) FROM merged)')} AS f FROM merged)"
BI = f"{BASE}, big AS ({BIGRAMS}), top AS (SELECT * FROM big WHERE w1 IN (SELECT word FROM dict) AND w2 IN (SELECT word FROM dict) ORDER BY cnt DESC, w1, w2 LIMIT 5000), bi AS (SELECT w1, w2, cnt, {scale('cnt', '(SELECT max(cnt) FROM top)')} AS f FROM top)"
LINES = f"{BI}, lines AS (SELECT word, CAST(0 AS BIGINT) AS n, ' word=' || word || ',f=' || f AS line FROM dict WHERE word <> '' AND NOT contains(word, ',') UNION ALL SELECT w1, row_number() OVER (PARTITION BY w1 ORDER BY f DESC, w2), '  bigram=' || w2 || ',f=' || f FROM bi)"


def parts(s, d):
    cased = V.cased_counts(docs(s, d))
    lower = V.lower_counts(cased)
    return lower, V.proper_nouns(lower, V.capitalised_counts(cased))


def lines(s, d):
    words = kept(V.dictionary(docs(s, d)))
    return V.dictionary_lines(words, V.dictionary_bigrams(docs(s, d), words))


q(
    "wordfreq",
    lambda s, d: V.word_counts(docs(s, d), least=3).orderBy(F.desc("cnt"), "word").limit(200_000),
    f"SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(text, '{A}'))) AS word FROM documents) t GROUP BY word HAVING count(*) >= 3 ORDER BY cnt DESC, word LIMIT 200000",
)
q(
    "top_words",
    lambda s, d: V.word_counts(docs(s, d)).orderBy(F.desc("cnt"), "word").limit(20),
    f"SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(text, '{A}'))) AS word FROM documents) t GROUP BY word ORDER BY cnt DESC, word LIMIT 20",
)
q("lower_counts", lambda s, d: V.word_counts(docs(s, d), lang.WORD_B), LOWER)
q("cap_counts", lambda s, d: V.capitalised_counts(V.cased_counts(docs(s, d))), CAPS)
q("bigrams", lambda s, d: V.bigram_counts(docs(s, d)), BIGRAMS)
q(
    "proper_nouns",
    lambda s, d: parts(s, d)[1],
    f"WITH low AS MATERIALIZED ({LOWER}), caps AS MATERIALIZED ({CAPS}), {PROPER} SELECT low, display, cnt FROM proper",
)
q(
    "common_words",
    lambda s, d: V.common_words(*parts(s, d)),
    f"WITH low AS MATERIALIZED ({LOWER}), caps AS MATERIALIZED ({CAPS}), {PROPER}, {COMMON} SELECT word, cnt FROM common",
)
q(
    "validated_words",
    lambda s, d: V.without_rejected(V.common_words(*parts(s, d)), V.word_counts(table(s, d, "benchmark"), lang.WORD_B).select("word")),
    f"WITH low AS MATERIALIZED ({LOWER}), caps AS MATERIALIZED ({CAPS}), {PROPER}, {COMMON} SELECT word, cnt FROM common ANTI JOIN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{B}'))) AS bad FROM benchmark) x ON x.bad = lower(common.word)",
)
q("dictionary", lambda s, d: V.dictionary(docs(s, d)), f"{BASE} SELECT word, cnt, f FROM dict")
q("dict_bigrams", lambda s, d: V.dictionary_bigrams(docs(s, d), kept(V.dictionary(docs(s, d)))), f"{BI} SELECT w1, w2, cnt, f FROM bi")
q("dict_lines", lambda s, d: lines(s, d).select("word", "n", "line"), f"{LINES} SELECT word, n, line FROM lines")
q(
    "dict_roundtrip",
    lambda s, d: V.parsed_lines(kept(V.numbered_lines(kept(lines(s, d))))),
    f"{LINES} SELECT word, nullif(regexp_extract(line, '^  bigram=(.*),f=(\\d+)$', 1), '') AS bigram, CAST(regexp_extract(line, ',f=(\\d+)$', 1) AS BIGINT) AS f FROM lines",
)
q(
    "dict_compare",
    lambda s, d: V.compared(V.scaled(V.word_counts(docs(s, d), lang.WORD_B, False)), V.scaled(V.word_counts(table(s, d, "conversations"), lang.WORD_B, False))),
    f"WITH a AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{B}')) AS word FROM documents) t GROUP BY word), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{B}')) AS word FROM conversations), f AS (SELECT word, {scale('cnt', '(SELECT max(cnt) FROM a)')} AS f FROM a) SELECT count(*) FILTER (WHERE f.word IS NOT NULL AND b.word IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.word IS NULL) AS only_a, count(*) FILTER (WHERE f.word IS NULL) AS only_b, min(f) AS min_a, max(f) AS max_a, count(*) FILTER (WHERE f = 255) AS at_top_a, count(*) FILTER (WHERE regexp_matches(f.word, '{CAP}')) AS capitalised_a FROM f FULL JOIN b ON f.word = b.word",
)
q(
    "word_rank",
    lambda s, d: V.rank_of(V.dictionary(docs(s, d)), "on"),
    f"{BASE}, k AS (SELECT coalesce(max(f) FILTER (WHERE word = 'on'), 0) AS f FROM dict) SELECT any_value(k.f) AS f, count(*) FILTER (WHERE dict.f > k.f) AS above, count(*) AS n FROM dict, k",
)
MUST = f"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{A}'))) AS word FROM conversations"
LACKS = f"missing AS (SELECT word FROM ({MUST}) m WHERE length(word) BETWEEN 2 AND 30 AND NOT EXISTS (SELECT 1 FROM common WHERE common.word = m.word) AND NOT EXISTS (SELECT 1 FROM proper WHERE proper.display = m.word))"


def must(s, d):
    return V.word_counts(table(s, d, "conversations")).select("word")


def _missing(s, d):
    lower, proper = parts(s, d)
    return V.missing_words(must(s, d), V.common_words(lower, proper), proper)


q("missing_words", _missing, f"WITH low AS MATERIALIZED ({LOWER}), caps AS MATERIALIZED ({CAPS}), {PROPER}, {COMMON}, {LACKS} SELECT word FROM missing")
q(
    "dictionary_must",
    lambda s, d: V.dictionary(docs(s, d), must=must(s, d)),
    f"{BASE}, {LACKS}, again AS (SELECT word, max(cnt) AS cnt FROM (SELECT word, cnt FROM merged UNION ALL SELECT word, 1 FROM missing) u GROUP BY word) SELECT word, cnt, {scale('cnt', '(SELECT max(cnt) FROM again)')} AS f FROM again",
)
q(
    "target_coverage",
    lambda s, d: table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("t")).withColumn("t", F.lower("t")).join(V.dictionary(docs(s, d)).select(F.col("word").alias("t")), "t", "left_semi").agg(c(F.count("*"), "covered")),
    f"{BASE} SELECT count(*) AS covered FROM (SELECT lower(unnest(string_split(text, ' '))) AS t FROM benchmark) b WHERE t IN (SELECT word FROM dict)",
)
q(
    "set_operations",
    lambda s, d: _sets(s, d),
    f"WITH a AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{B}'))) AS word FROM benchmark), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{B}'))) AS word FROM conversations) SELECT word, 'both' AS kind FROM (SELECT word FROM a INTERSECT SELECT word FROM b) x UNION ALL SELECT word, 'first' FROM (SELECT word FROM a EXCEPT SELECT word FROM b) y UNION ALL SELECT word, 'any' FROM (SELECT word FROM a UNION SELECT word FROM b) z",
)


def _sets(s, d):
    a, b = (V.word_counts(table(s, d, t), lang.WORD_B).select("word") for t in ("benchmark", "conversations"))
    kinds = {"both": a.intersect(b), "first": a.exceptAll(b), "any": a.union(b).distinct()}
    out = None
    for k, df in kinds.items():
        df = df.withColumn("kind", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out
