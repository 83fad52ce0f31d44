"""Vocabularies: word, capitalised-form and bigram counts, proper nouns, scaled dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lang
from ..functions import text as T
from . import order as O
from .backoff import word_blocks

#: Letters of a dictionary word at most.
LONGEST = 30
LETTERS = r"^[A-ZÑÜÇÀ-ÖØ-Þ]"


def word_counts(docs: DataFrame, pattern: str = lang.WORD_A, lower: bool = True, least: int = 1) -> DataFrame:
    w = F.explode(T.matches(F.col("text"), pattern)).alias("word")
    rows = docs.select(w).select(F.lower("word").alias("word") if lower else "word")
    counts = rows.groupBy("word").agg(F.count("*").alias("cnt"))
    return counts.filter(F.col("cnt") >= least) if least > 1 else counts


def cased_counts(docs: DataFrame) -> DataFrame:
    """word and cnt of the words as they are written: the texts are read once, and both kinds of counts follow."""
    return word_counts(docs, lang.WORD_B, lower=False)


def lower_counts(cased: DataFrame) -> DataFrame:
    return cased.groupBy(F.lower("word").alias("word")).agg(F.sum("cnt").alias("cnt"))


def capitalised_counts(cased: DataFrame) -> DataFrame:
    return cased.filter(F.col("word").rlike(LETTERS))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of a block once with its count, in order: like texts stand together in the shuffle, which makes them small."""
    for words, codes, starts in word_blocks(batches):
        order = np.asarray(pc.sort_indices(words))
        words, rank = words.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        later = np.ones(len(codes), bool)
        later[starts] = False
        at, code = np.flatnonzero(later), rank[codes]
        keys, counts = np.unique(code[at - 1] * len(words) + code[at], return_counts=True)
        for begin in range(0, len(keys), 65536):
            first, second = (words.take(pa.array(x)) for x in np.divmod(keys[begin : begin + 65536], len(words)))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, "\t"), pa.array(counts[begin : begin + 65536], pa.int64())], ["_k", "cnt"])


def bigram_counts(docs: DataFrame) -> DataFrame:
    # One text a row is less to shuffle than two.
    counts = docs.select("text").mapInArrow(_pairs, "_k string, cnt bigint").groupBy("_k").agg(F.sum("cnt").alias("cnt"))
    return counts.select(F.substring_index("_k", "\t", 1).alias("w1"), F.substring_index("_k", "\t", -1).alias("w2"), "cnt")


def proper_nouns(lower: DataFrame, caps: DataFrame, least: int = 3, ratio: float = 0.5, shortest: int = 2, longest: int = LONGEST) -> DataFrame:
    """low, display and cnt of words that are mostly written with a capital, of variants of fitting length. Ties of variants go to the first in order."""
    ok = caps.filter((F.length("word") >= shortest) & (F.length("word") <= longest) & ~F.col("word").rlike(lang.ARTIFACT))
    grouped = ok.groupBy(F.lower("word").alias("low")).agg(F.sum("cnt").alias("cnt"), F.min(F.struct((-F.col("cnt")).alias("c"), "word"))["word"].alias("display"))
    both = grouped.join(lower.select(F.col("word").alias("_w"), F.col("cnt").alias("_n")), F.col("low") == F.col("_w"), "left")
    share = F.col("cnt") / F.greatest(F.lit(1), F.coalesce("_n", F.lit(0)))
    return both.filter((F.col("cnt") >= least) & (share >= ratio)).select("low", "display", "cnt")


def common_words(lower: DataFrame, proper: DataFrame, least: int = 3, shortest: int = 2, longest: int = LONGEST) -> DataFrame:
    ok = lower.filter((F.length("word") >= shortest) & (F.length("word") <= longest) & (F.col("cnt") >= least) & ~F.col("word").rlike(lang.ARTIFACT))
    return ok.join(proper.select(F.col("low").alias("word")), "word", "left_anti")


def without_rejected(words: DataFrame, rejected: DataFrame) -> DataFrame:
    """Words that a validator did not reject; it gives lower-cased words."""
    return words.join(rejected.select(F.col("word").alias("_r")), F.lower("word") == F.col("_r"), "left_anti")


def missing_words(must: DataFrame, valid: DataFrame, proper: DataFrame, shortest: int = 2, longest: int = LONGEST) -> DataFrame:
    """word: words that a dictionary must have, of fitting length, that are neither valid nor a proper noun's display form."""
    fits = must.filter((F.length("word") >= shortest) & (F.length("word") <= longest)).select("word").distinct()
    return fits.join(valid.select("word"), "word", "left_anti").join(proper.select(F.col("display").alias("word")), "word", "left_anti")


def merged_words(common: DataFrame, proper: DataFrame, must: DataFrame | None = None) -> DataFrame:
    rows = common.select("word", "cnt").unionByName(proper.select(F.col("display").alias("word"), "cnt"))
    if must is not None:
        rows = rows.unionByName(must.select("word", F.lit(1).cast("bigint").alias("cnt")))
    return rows.groupBy("word").agg(F.max("cnt").alias("cnt"))


def scaled(words: DataFrame, cnt: str = "cnt", out: str = "f") -> DataFrame:
    top = words.agg(F.max(cnt).alias("_top"))
    return words.join(F.broadcast(top)).withColumn(out, T.scale_count(F.col(cnt), F.col("_top"))).drop("_top")


def dictionary(docs: DataFrame, most: int = 0, must: DataFrame | None = None) -> DataFrame:
    """word, cnt and f, most frequent first by f and then word; most caps it unless 0. Words of `must` that the corpus lacks come in with the least count."""
    cased = cased_counts(docs)
    lower = lower_counts(cased)
    proper = proper_nouns(lower, capitalised_counts(cased))
    common = common_words(lower, proper)
    words = scaled(merged_words(common, proper, None if must is None else missing_words(must, common, proper))).orderBy(F.desc("f"), "word")
    return words.limit(most) if most else words


def rank_of(words: DataFrame, key: str) -> DataFrame:
    """f, above and n: a word's f (0 if it is missing), how many words have more, and how many words there are."""
    f = words.agg(F.coalesce(F.max(F.when(F.col("word") == key, F.col("f"))), F.lit(0)).alias("_f"))
    return words.join(F.broadcast(f)).agg(F.max("_f").alias("f"), F.count_if(F.col("f") > F.col("_f")).cast("bigint").alias("above"), F.count("*").alias("n"))


def dictionary_bigrams(docs: DataFrame, words: DataFrame, most: int = 5000) -> DataFrame:
    """w1, w2, cnt and f of the most frequent pairs of dictionary words."""
    b = bigram_counts(docs)
    for side in ("w1", "w2"):
        b = b.join(words.select(F.col("word").alias(side)), side, "left_semi")
    return scaled(b.orderBy(F.desc("cnt"), "w1", "w2").limit(most))


def dictionary_lines(words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """word, n, f (the word's own) and line: a unigram's line (n = 0) and its bigrams' by their f; what cannot be written is left out. In a file, lines stand by f of the word, the word, and n."""
    ok = lambda w: (F.col(w) != "") & ~F.col(w).contains(",") & (F.col("f") > 0)
    kept = words.filter(ok("word"))
    line = lambda mark, w: F.concat(F.lit(mark), w, F.lit(",f="), F.col("f").cast("string")).alias("line")
    uni = kept.select("word", F.lit(0).cast("bigint").alias("n"), "f", line(" word=", "word"))
    nth = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("f"), "w2")).cast("bigint")
    bi = bigrams.filter(ok("w2")).select("w1", nth.alias("n"), line("  bigram=", "w2"))
    return uni.unionByName(bi.join(kept.select(F.col("word").alias("w1"), "f"), "w1").select(F.col("w1").alias("word"), "n", "f", "line"))


def line_order() -> list[Column]:
    """The order of a dictionary's lines."""
    return [F.desc("f"), F.asc("word"), F.asc("n")]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """seq and line of dictionary_lines: each line's number in its file."""
    rows = lines.withColumn("_key", F.struct((-F.col("f")).alias("f"), "word", "n")).withColumn("_head", F.struct((-F.col("f")).alias("f"), F.substring("word", 1, 3).alias("w")))
    return O.running_sum(rows, "_key", F.lit(1).cast("bigint"), "seq", bucket=F.col("_head")).select("seq", "line")


def parsed_lines(lines: DataFrame, bucket: Column | None = None) -> DataFrame:
    """word, bigram and f from a dictionary's lines (seq, line) in order of seq: a bigram belongs to the word above it. Words are numbered by a running count, and a bigram finds its word by that number; other lines, the header among them, are passed over."""
    p = r"^ word=(.*),f=(\d+)$", r"^  bigram=(.*),f=(\d+)$"
    rows = lines.select("seq", *([bucket.alias("_bucket")] if bucket is not None else []), F.nullif(F.regexp_extract("line", p[0], 1), F.lit("")).alias("w"), F.nullif(F.regexp_extract("line", p[1], 1), F.lit("")).alias("bigram"), F.regexp_extract("line", r",f=(\d+)$", 1).try_cast("bigint").alias("f"))
    rows = O.running_sum(rows, "seq", F.col("w").isNotNull().cast("bigint"), "_g", bucket=F.col("_bucket") if bucket is not None else None)
    words = rows.filter("w is not null").select(F.col("_g").alias("_h"), F.col("w").alias("word"))
    return rows.filter("w is not null or bigram is not null").join(words, F.col("_g") == F.col("_h")).select("word", "bigram", "f")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row of how two dictionaries (word, f) overlap."""
    x, y = a.select("word", F.col("f").alias("fa")), b.select("word", F.col("f").alias("fb"))
    c = lambda e: F.count_if(e).cast("bigint")
    return x.join(y, "word", "full_outer").agg(
        c(F.col("fa").isNotNull() & F.col("fb").isNotNull()).alias("in_both"), c(F.col("fb").isNull()).alias("only_a"), c(F.col("fa").isNull()).alias("only_b"),
        F.min("fa").alias("min_a"), F.max("fa").alias("max_a"), c(F.col("fa") == lang.SCALE_TOP).alias("at_top_a"), c(F.col("word").rlike(LETTERS) & F.col("fa").isNotNull()).alias("capitalised_a"),
    )
