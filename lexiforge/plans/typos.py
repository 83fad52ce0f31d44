"""Queries on typos, keys and typo pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lang
from ..functions import text as T
from ..operators import order as O
from ..operators import pieces as P
from ..operators import sequences as S
from ..operators import vocab as V
from . import sqltext as Q
from .base import c, docs, kept, q

PAIRS = 2000


def words(s, d):
    """word, cnt and i of all words seen three times."""
    return O.numbered(kept(V.word_counts(docs(s, d), least=3)))


def on_words(name: str, column: str, f, sql: str, keep: str = "") -> None:
    """A query of one expression over all words."""

    def query(s, d):
        rows = words(s, d).select("word", f(F.col("word"), F.col("i")).alias(column))
        return rows.filter(keep) if keep else rows

    q(name, query, f"WITH {Q.WORDS} SELECT * FROM (SELECT word, {sql} AS {column} FROM w) t" + (f" WHERE {keep}" if keep else ""))


on_words("keypress", "keys", lambda w, i: F.array_join(T.keypresses(w), ""), Q.keys("word"))
on_words("triples", "triple", lambda w, i: T.triple(T.double(w, F.lit(1)), w), Q.triple(f"({Q.double('word', '1')})", "word"))
on_words("typo_transpose", "typo", lambda w, i: T.transpose(w, F.lit(1)), Q.transpose("word", "1"))
on_words("typo_delete", "typo", lambda w, i: T.delete(w, F.lit(1)), Q.delete("word", "1"))
on_words("typo_double", "typo", lambda w, i: T.double(w, F.lit(0)), Q.double("word", "0"))
on_words("typo_insert", "typo", lambda w, i: T.insert(w, F.lit(1), F.lit("q")), Q.insert("word", "1", "'q'"))
on_words("typo_adjacent", "typo", lambda w, i: T.adjacent(w, F.lit(0), i), Q.adjacent("word", "0", "i"))
on_words("accent_drop", "plain", lambda w, i: T.strip_marks(w), "strip_accents(word)", keep="word <> plain")
on_words("rule_draws", "r", lambda w, i: T.draw(i, "typo1", 0, 100), f"CAST({Q.draw('i', 'typo1', 0, 100)} AS BIGINT)")
on_words(
    "char_ids", "ids", lambda w, i: F.array_join(F.transform(T.char_ids(w), lambda x: x.cast("string")), " "),
    f"array_to_string(list_transform(regexp_extract_all({Q.keys('word')}, '[A-Z]>'), lambda x: CAST({lang.CHAR_A} + ascii(x) - 65 AS VARCHAR)), ' ')",
)
on_words(
    "affix_split", "parts", lambda w, i: F.concat_ws("|", *T.affixes(F.concat(F.lit("«"), w, F.lit("!»")))),
    r"""CASE WHEN regexp_matches(word, '^[\p{L}'']+$') THEN '«|' || word || '|!»' ELSE '||' END""",
)

q("synthetic_typos", lambda s, d: S.typos(words(s, d), "word", "i").select("word", "typed"), f"WITH {Q.WORDS}, {Q.with_typos('t', 'w', 'word', 'i')} SELECT word, typed FROM t")
q("cdf_sample", lambda s, d: S.cdf_sample(words(s, d), 997), f"WITH {Q.WORDS}, {Q.sampled('x', 997, '(range + 0.5) / 997')} SELECT i, word FROM x")
GOLDEN = f"((range + 0.5) * CAST({S.GOLDEN} AS DOUBLE)) % 1.0"
SYNTHETIC = f"""{Q.WORDS}, {Q.sampled('x', S.TRIES * PAIRS, GOLDEN)}, {Q.with_typos('t', 'x', 'word', 'i')},
pairs AS MATERIALIZED (SELECT i, typed, word AS committed FROM t ORDER BY i LIMIT {PAIRS})"""
q("typo_pairs", lambda s, d: S.synthetic_pairs(words(s, d), PAIRS), f"WITH {SYNTHETIC} SELECT i, typed, committed FROM pairs")
SHORTCUTS = [(a, w) for w, forms in lang.SHORTCUTS.items() for a in forms if a != w]
q("shortcut_pairs", lambda s, d: S.shortcut_pairs(s), f"SELECT * FROM (VALUES {Q.values(SHORTCUTS)}) t(typed, committed)")


def _shortcut_words(s, d):
    """The alias that each word tries first, in its case: words of the lists in three cases, each with many numbers."""
    names = s.createDataFrame([(k, x) for k, w in enumerate(lang.SHORTCUTS) for x in (w, w.capitalize(), w.upper())], "k long, word string")
    rows = s.range(200).withColumnRenamed("id", "n").join(F.broadcast(names)).withColumn("seq", F.col("n") * 97 + F.col("k"))
    return T.once(rows, "alias", S.shortcut(F.col("word"), F.col("seq"))).filter("alias is not null").select("seq", "word", "alias")


CASED = [(k, x) for k, w in enumerate(lang.SHORTCUTS) for x in (w, w.capitalize(), w.upper())]
q(
    "shortcut_aliases", _shortcut_words,
    f"WITH names AS (SELECT CAST(k AS BIGINT) AS k, word FROM (VALUES {Q.values(CASED)}) t(k, word)), r AS (SELECT range * 97 + k AS seq, word FROM range(200), names) SELECT * FROM (SELECT seq, word, {Q.shortcut('word', 'seq')} AS alias FROM r) t WHERE alias IS NOT NULL",
)

SECTIONS = [(4, 27, "filler"), (28, 173, "words"), (174, 207, "control"), (208, 303, "rest")]
BOUNDS = ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), '{n}')" for a, b, n in SECTIONS)


def sections(s):
    return s.createDataFrame(SECTIONS, "lo long, hi long, section string")


q(
    "slot_sections", lambda s, d: S.slot_layout(s).join(F.broadcast(sections(s)), F.expr("id between lo and hi")).groupBy("section").agg(F.count("*").alias("n"), F.min("id").alias("first")),
    f"SELECT section, hi - lo + 1 AS n, lo AS first FROM (VALUES {BOUNDS}) t(lo, hi, section)",
)


def _other_slots(s):
    """The layout with two keys of the control range swapped and one missing."""
    rows = S.slot_layout(s).select("id", "piece").filter("id <> 180")
    return rows.withColumn("piece", F.when(F.col("id") == 190, "<CHAR_J>").when(F.col("id") == 191, "<CHAR_I>").otherwise(F.col("piece")))


q("slot_compare", lambda s, d: P.slot_verdict(P.compared_slots(S.slot_layout(s), _other_slots(s))), "SELECT CAST(34 AS BIGINT) AS slots, CAST(3 AS BIGINT) AS mismatches, 'differ' AS verdict")
KEYS = f"SELECT section, list(id ORDER BY id) AS ids FROM (SELECT range AS id FROM range(4, 304)) i JOIN (VALUES {BOUNDS}) t(lo, hi, section) ON id BETWEEN lo AND hi AND id <> 180 GROUP BY section"
q(
    "sequential_ids", lambda s, d: _other_slots(s).join(F.broadcast(sections(s)), F.expr("id between lo and hi")).groupBy("section").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("section", c(F.size("ids"), "n"), P.are_sequential(F.col("ids")).alias("sequential")),
    f"SELECT section, len(ids) AS n, ids[len(ids)] - ids[1] + 1 = len(ids) AS sequential FROM ({KEYS}) t",
)
