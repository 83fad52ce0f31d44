"""Spelling by an affix grammar: stems with classes, and rules that say what a class takes off and puts on.

Tables: stems (stem and flag, a row for each class; a null flag for none) and rules (kind "P" or "S", flag, strip, gain, cond, cross). A suffix rule turns a stem that ends in strip, and whose end fits cond (a regular expression), into one with gain in place of strip; a prefix rule does so at the beginning. Where both rules have cross, a prefix joins what a suffix made, and looks at that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a frequent ending: the rules are repeated as often.
SALTS = 16


def _kind(rules: DataFrame, kind: str) -> DataFrame:
    """The rules of a kind, with cond tied to the end of the word that they look at."""
    cond = F.concat(F.lit("(?:"), "cond", F.lit(")$")) if kind == "S" else F.concat(F.lit("^(?:"), "cond", F.lit(")"))
    return rules.filter(F.col("kind") == kind).select("flag", "strip", "gain", cond.alias("cond"), "cross").distinct()


def _joined(word: Column, strip: str, gain: str, kind: str) -> Column:
    """The word with `gain` in place of `strip` at its end (S) or its beginning (P)."""
    n = F.length(word) - F.length(strip)
    return F.concat(F.substring(word, F.lit(1), n), gain) if kind == "S" else F.concat(gain, F.substring(word, F.length(strip) + 1, n))


def _at(word: Column, part: Column, kind: str) -> Column:
    return F.endswith(word, part) if kind == "S" else F.startswith(word, part)


def _applied(rows: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """stem, form, flag and cross: what the rules of a kind make of rows (stem, form, flag), whose flag is that of the rule."""
    r = _kind(rules, kind)
    j = rows.join(r, "flag").filter(_at(F.col("form"), F.col("strip"), kind) & F.expr("form rlike cond"))
    return j.select("stem", _joined(F.col("form"), "strip", "gain", kind).alias("form"), "flag", "cross")


def expanded(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """stem and form, once each: all that the grammar makes of each stem, the stem among it."""
    stems = stems.select("stem", "flag").distinct()
    bare = stems.select("stem", F.col("stem").alias("form"), "flag")
    suffixed = _applied(bare, rules, "S")
    both = suffixed.filter("cross").select("stem", "form").distinct().join(stems, "stem")
    both = _applied(both, rules.filter("cross"), "P")
    parts = [bare, suffixed, _applied(bare, rules, "P"), both]
    out = parts[0].select("stem", "form")
    for p in parts[1:]:
        out = out.unionByName(p.select("stem", "form"))
    return out.distinct()


def _reversed(rows: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """rows with what each word may come from by one rule of a kind (base), the rule's flag and cross. A word meets the rules by its ends, up to the longest gain; a frequent end is dealt over SALTS parts by the word."""
    r = _kind(rules, kind)
    longest = r.agg(F.coalesce(F.max(F.length("gain")), F.lit(-1))).first()[0]
    if longest < 0:
        return rows.select("*", F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("_flag"), F.lit(None).cast("boolean").alias("_cross")).limit(0)
    n = F.length("form")
    sizes = F.sequence(F.lit(0), F.least(n, F.lit(longest)))
    ends = F.transform(sizes, lambda k: F.substring("form", n - k + 1, k) if kind == "S" else F.substring("form", F.lit(1), k))
    salted = r.select(F.col("flag").alias("_flag"), "strip", "gain", "cond", F.col("cross").alias("_cross"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    at = rows.select("*", F.explode(ends).alias("gain"), F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int").alias("_salt"))
    j = at.join(salted, ["gain", "_salt"]).withColumn("base", _joined(F.col("form"), "gain", "strip", kind))
    return j.filter((F.col("base") != "") & F.expr("base rlike cond")).select(*rows.columns, "base", "_flag", "_cross")


def case_forms(word: Column) -> Column:
    """What a word may be written for: itself, all in small letters if it begins with a capital and goes on in small ones, and if it is all in capitals, that and with one capital."""
    low = F.lower(word)
    first = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))
    more = F.when(word == low, F.array(word)).when(word == first, F.array(word, low)).when(word == F.upper(word), F.array(word, first, low)).otherwise(F.array(word))
    return F.array_distinct(more)


def accepted(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """word, once each: those of words (word) that the grammar makes, in one of their case forms. Rules are reversed at the words; nothing is expanded, and a word costs as many rows as rules fit its ends. Null and empty words are not accepted."""
    rows = words.select("word").distinct().filter("word <> ''").select("word", F.explode(case_forms(F.col("word"))).alias("form"))
    stems = stems.select("stem", "flag").distinct()
    flags = stems.filter("flag is not null")
    known = stems.select(F.col("stem").alias("form")).distinct()
    cross = rules.filter("cross")
    one = lambda r, kind: _reversed(r, rules, kind).select("word", F.col("base").alias("stem"), F.col("_flag").alias("flag"))
    single = one(rows, "S").unionByName(one(rows, "P")).distinct().join(flags, ["stem", "flag"], "left_semi")
    inner = _reversed(rows, cross, "P").select("word", F.col("base").alias("form"), F.col("_flag").alias("_pre")).distinct()
    both = _reversed(inner, cross, "S").select("word", F.col("base").alias("stem"), F.col("_flag").alias("flag"), "_pre").distinct()
    both = both.join(flags, ["stem", "flag"], "left_semi").select("word", "stem", F.col("_pre").alias("flag")).join(flags, ["stem", "flag"], "left_semi")
    return rows.join(known, "form", "left_semi").select("word").unionByName(single.select("word")).unionByName(both.select("word")).distinct()


def rejected(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """word, once each: what a validator rejects, as operators/vocab.without_rejected takes it, but in the letters of the text."""
    return words.select("word").distinct().filter("word <> ''").join(accepted(words, stems, rules), "word", "left_anti")
