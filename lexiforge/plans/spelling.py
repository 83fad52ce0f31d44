"""Spelling of the corpus by a small affix grammar over its most frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lang
from ..operators import affixes as A
from ..operators import vocab as V
from . import sqltext as Q
from .base import docs, kept, q

#: Stems are words seen so often; their class is vowel or consonant, by their last letter, and X for those that take prefixes.
LEAST = 40
#: kind, flag, strip, gain, cond, cross: a grammar for these queries.
RULES = [
    ("S", "V", "", "k", "[^a]", True),
    ("S", "V", "", "ren", "", True),
    ("S", "V", "a", "ak", "a", True),
    ("S", "V", "a", "iko", "[^e]a", False),
    ("S", "C", "", "a", "", True),
    ("S", "C", "", "ak", "[^s]", True),
    ("S", "C", "", "eko", "", False),
    ("S", "C", "n", "ra", "[aeiou]n", True),
    ("P", "X", "", "ber", "[aeiou]", True),
    ("P", "X", "", "des", "[^aeiou]", True),
    ("P", "X", "e", "i", "e", False),
]
SCHEMA = "kind string, flag string, strip string, gain string, cond string, cross boolean"
CLASSES = ("(?i)[aeiou]$", "V"), ("(?i)[^aeiou]$", "C"), ("^[a-m]", "X")


def grammar(s, d):
    """stems, rules and all words of the documents, with their counts."""
    words = kept(V.word_counts(docs(s, d), lang.WORD_B))
    flags = F.array_compact(F.array(*[F.when(F.col("word").rlike(p), f) for p, f in CLASSES]))
    stems = words.filter(F.col("cnt") >= LEAST).select(F.col("word").alias("stem"), F.explode_outer(flags).alias("flag"))
    return kept(stems), s.createDataFrame(RULES, SCHEMA), words


def _rejected(s, d):
    stems, rules, words = grammar(s, d)
    return A.rejected(words, stems, rules).join(words, "word")


def _expanded(s, d):
    return A.expanded(*grammar(s, d)[:2])


#: SQL expands every stem; the query over words does not.
FORMS = f"""words AS MATERIALIZED (SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(text, '{Q.B}'))) AS word FROM documents) x GROUP BY word),
flags AS MATERIALIZED ({' UNION ALL '.join(f"SELECT word AS stem, '{f}' AS flag FROM words WHERE cnt >= {LEAST} AND regexp_matches(word, '{p}')" for p, f in CLASSES)}),
stems AS (SELECT word AS stem FROM words WHERE cnt >= {LEAST}),
rules AS MATERIALIZED (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', '{e}', '{f}', {g})" for a, b, c, e, f, g in RULES)}) r(kind, flag, strip, gain, cond, crossed)),
suf AS MATERIALIZED (SELECT stem, stem[1:length(stem) - length(strip)] || gain AS form, crossed FROM flags JOIN rules USING (flag) WHERE kind = 'S' AND ends_with(stem, strip) AND regexp_matches(stem, '(?:' || cond || ')$')),
base AS (SELECT stem, stem AS form, false AS done FROM stems UNION ALL SELECT stem, form, true FROM suf WHERE crossed),
pre AS (SELECT stem, gain || form[length(strip) + 1:] AS form FROM base JOIN flags USING (stem) JOIN rules USING (flag) WHERE kind = 'P' AND (crossed OR NOT done) AND starts_with(form, strip) AND regexp_matches(form, '^(?:' || cond || ')')),
forms AS MATERIALIZED (SELECT stem, form FROM base UNION SELECT stem, form FROM suf UNION SELECT stem, form FROM pre)"""
q("affix_rejected", _rejected, f"WITH {FORMS} SELECT word, cnt FROM words WHERE word <> '' AND word NOT IN (SELECT form FROM forms)")
q("affix_expansion", _expanded, f"WITH {FORMS} SELECT stem, form FROM forms")
