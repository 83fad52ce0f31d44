"""Evaluations: keystrokes saved, next word, autocorrection, re-ranking by five scores, objective checks. Predictions come from a bigram predictor of the corpus, or from a back-off model that is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lang
from ..functions import text as T
from . import backoff as K
from . import vocab as V
from .store import tabled

#: Rows of prev2 and prev to rows of these and topk.
Predict = Callable[[DataFrame], DataFrame]


def predictor(docs: DataFrame, k: int = 5, first: DataFrame | None = None) -> DataFrame:
    """w1 and topk: the k most frequent next words, ties in order. Only first words that are asked for (column prev) are ranked, if given."""
    counts = V.bigram_counts(docs)
    if first is not None:
        counts = counts.join(first.select(F.col("prev").alias("w1")).distinct(), "w1", "left_semi")
    r = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("cnt"), "w2"))
    top = counts.withColumn("r", r).filter(F.col("r") <= k)
    return top.groupBy("w1").agg(F.array_sort(F.collect_list(F.struct("r", "w2")))["w2"].alias("topk"))


def prefixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos, prev, target and prefix for each word after the first of each text."""
    w = rows.select(*keys, F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w"))
    at = w.select(*keys, "w", F.posexplode("w").alias("pos", "target")).filter("pos > 0")
    return at.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.get("w", F.col("pos") - 1).alias("prev"), "target", F.array_join(F.slice("w", F.lit(1), F.col("pos")), " ").alias("prefix"))


def contexts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos, prev2, prev and target for each word after the first of each text, with the mark of a text's start before its first word."""
    w = rows.select(*keys, F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w"))
    at = w.select(*keys, "w", F.posexplode("w").alias("pos", "target")).filter("pos > 0")
    return at.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.get("w", F.col("pos") - 2), F.lit(K.START)).alias("prev2"), F.get("w", F.col("pos") - 1).alias("prev"), "target")


def keystrokes(rows: DataFrame, docs: DataFrame, keys: list[str], predict: Predict | None = None) -> DataFrame:
    """A row of counts: predictable characters, and those saved if the first or any of the top words is the target (or, from two letters, begins it). The top words are those of `predict`, or the bigram predictor's."""
    p = contexts(rows, keys).select("prev2", "prev", "target")
    if predict is None:
        p = p.join(predictor(docs, first=p).withColumnRenamed("w1", "prev"), "prev", "left")
    else:
        p = p.join(K.merged(predict(p)), ["prev2", "prev"], "left")
    fits = lambda w: (F.col("target") == w) | ((F.length(w) >= 2) & F.startswith(F.col("target"), w))
    first = F.coalesce(fits(F.get("topk", F.lit(0))), F.lit(False))
    any_ = F.coalesce(F.exists("topk", fits), F.lit(False))
    n = F.length("target")
    out = p.agg(F.sum(n).cast("bigint").alias("chars"), F.sum(F.when(first, n).otherwise(0)).cast("bigint").alias("saved_top1"), F.sum(F.when(any_, n).otherwise(0)).cast("bigint").alias("saved_topk"), F.count("*").alias("n"))
    return out.withColumn("pct_topk", F.round(F.coalesce(F.try_divide(F.col("saved_topk") * 100.0, F.col("chars")), F.lit(0.0)), 6))


def next_word(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """hits and n of the word at 60 per cent of each text, among the top words after the one before it."""
    w = rows.select(F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w")).filter(F.size("w") >= 4)
    i = F.greatest(F.lit(2), F.floor(F.size("w") * 0.6)).cast("int")
    cases = w.select(F.get("w", i - 1).alias("prev"), F.get("w", i).alias("gold"))
    j = cases.join(predictor(docs, first=cases).withColumnRenamed("w1", "prev"), "prev", "left")
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    return j.agg(hit(F.get("topk", F.lit(0)) == F.col("gold")).alias("top1"), hit(F.array_contains("topk", F.col("gold"))).alias("topk"), F.count("*").alias("n"))


def next_word_plausible(rows: DataFrame, predict: Predict) -> DataFrame:
    """hits and n of the word at 60 per cent of each text where any word is right that follows the same two words somewhere in rows. Contexts are judged once each and weighed by how often they are asked."""
    w = rows.select(F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w")).filter(F.size("w") >= 4)
    i = F.greatest(F.lit(2), F.floor(F.size("w") * 0.6)).cast("int")
    cases = w.select(F.get("w", i - 2).alias("prev2"), F.get("w", i - 1).alias("prev")).groupBy("prev2", "prev").agg(F.count("*").alias("n"))
    plausible = contexts(rows, []).select("prev2", "prev", F.col("target").alias("word"), F.lit(True).alias("ok")).distinct()
    guesses = predict(cases).select("prev2", "prev", F.posexplode("topk").alias("nth", "word")).join(K.merged(plausible), ["prev2", "prev", "word"])
    hits = guesses.groupBy("prev2", "prev").agg(F.min("nth").alias("first"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return cases.join(K.merged(hits), ["prev2", "prev"], "left").agg(total(F.col("first") == 0).alias("top1"), total(F.col("first").isNotNull()).alias("topk"), total(F.lit(True)).alias("n"))


def mutual_information(docs: DataFrame, least: int = 1, last: str = "w2") -> DataFrame:
    """w1, w2, cnt and pmi: ln P(w2 | w1) - ln P(w2), of pairs seen at least so many times. Rows end up dealt by the word `last`, so that what groups them by it need not deal them again."""
    b = tabled(V.bigram_counts(docs))
    left = b.groupBy("w1").agg(F.sum("cnt").alias("n1"))
    right = b.groupBy("w2").agg(F.sum("cnt").alias("n2"))
    total = b.agg(F.sum("cnt").alias("n"))
    sides = {"w1": left, "w2": right}
    first = next(w for w in sides if w != last)
    j = b.filter(F.col("cnt") >= least).join(sides[first], first).join(sides[last], last).join(F.broadcast(total))
    return j.select("w1", "w2", "cnt", F.round(F.log(F.col("cnt") / F.col("n1")) - F.log(F.col("n2") / F.col("n")), 6).alias("pmi"))


def reranked(docs: DataFrame) -> DataFrame:
    """The best next word of each first word by mutual information, ties in order."""
    return mutual_information(docs, last="w1").groupBy("w1").agg(F.min(F.struct((-F.col("pmi")).alias("p"), "w2"))["w2"].alias("best"))


# --- autocorrection ---------------------------------------------------------------------------------------------------


def one_deletion(word: Column) -> Column:
    """A word and what is left of it without any one of its letters, each once."""
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), shorter))


def corrections(typed: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """typed and topk: of the words that share a one-deletion form with what was typed, the k most frequent, ties in order."""
    left = typed.select("typed").distinct().select("typed", F.explode(one_deletion(F.lower("typed"))).alias("_key"))
    right = words.select("word", "cnt", F.explode(one_deletion(F.col("word"))).alias("_key"))
    found = left.join(right, "_key").groupBy("typed", "word").agg(F.max("cnt").alias("cnt"))
    r = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("cnt"), "word"))
    return found.withColumn("r", r).filter(F.col("r") <= k).groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("r", "word")))["word"].alias("topk"))


def corrected_hits(pairs: DataFrame, topk: DataFrame, case: bool = False) -> DataFrame:
    """The pairs with topk and whether the first, or any, of its words is the one meant; without regard to case unless `case`."""
    j = pairs.join(topk, "typed", "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumn("top1_hit", hit(T.same_word(F.get("topk", F.lit(0)), F.col("committed"), case))).withColumn("topk_hit", hit(F.exists("topk", lambda w: T.same_word(w, F.col("committed"), case))))


def accuracy(hits: DataFrame) -> DataFrame:
    """top1, topk and n."""
    return hits.agg(F.count_if("top1_hit").cast("bigint").alias("top1"), F.count_if("topk_hit").cast("bigint").alias("topk"), F.count("*").alias("n"))


# --- re-ranking and objectives ----------------------------------------------------------------------------------------


def with_logprobs(steps: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds lp, ln P(word | prev), and base, ln P(word), of a smoothed bigram model (each count one more) to rows of prev and word. Only pairs that are asked for leave the counts."""
    b = tabled(V.bigram_counts(docs))
    first = b.groupBy("w1").agg(F.sum("cnt").alias("_n1")).withColumnRenamed("w1", "_p")
    second = b.groupBy("w2").agg(F.sum("cnt").alias("_n2"))
    total = second.agg(F.sum("_n2").alias("_n"), F.count("*").alias("_kinds"))
    j = steps.join(b.select(F.col("w1").alias("_a"), F.col("w2").alias("_b"), F.col("cnt").alias("_c")), (F.col("prev") == F.col("_a")) & (F.col("word") == F.col("_b")), "left")
    j = j.join(first, F.col("prev") == F.col("_p"), "left").join(second.withColumnRenamed("w2", "_s"), F.col("word") == F.col("_s"), "left").join(F.broadcast(total))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    lp, base = F.log((more("_c") + 1) / (more("_n1") + F.col("_kinds"))), F.log((more("_n2") + 1) / (F.col("_n") + F.col("_kinds")))
    return j.select(*steps.columns, lp.alias("lp"), base.alias("base"))


METHODS = ("sum_logprob", "per_token", "surprisal_sum", "surprisal_ptok", "surprisal_ratio")


def candidate_scores(lps: Column, base: Column) -> dict[str, Column]:
    """Five scores of a candidate, from its tokens' log probabilities with and without context; values that are not finite do not count."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    x, y = T.finite(lps), T.finite(base)
    c, b, cn, bn = total(x), total(y), F.size(x), F.size(y)
    over = lambda v, n, none: F.when(n > 0, v / n).otherwise(F.lit(float(none)))
    return dict(zip(METHODS, (c, over(c, cn, -999), c - b, over(c - b, cn, -999), over(c, cn, 0) - over(b, bn, 0)), strict=True))


def reranking(candidates: DataFrame, case: list[str]) -> DataFrame:
    """method, hits and n: in how many cases the candidate of the best score is the right one (nth 0). Candidates have nth, lps and base; ties go to the smaller nth."""
    scores = candidate_scores(F.col("lps"), F.col("base"))
    rows = candidates.select(*case, "nth", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("score")) for m, s in scores.items()])).alias("s"))
    best = rows.groupBy(*case, "s.method").agg(F.max_by("nth", F.struct("s.score", -F.col("nth"))).alias("best"))
    return best.groupBy("method").agg(F.count_if(F.col("best") == 0).cast("bigint").alias("hits"), F.count("*").alias("n"))


def phrase_cases(rows: DataFrame, keys: list[str], size: int = 2) -> DataFrame:
    """keys, nth, context and words: at 60 per cent of each text, the `size` words that follow (nth 0), and as wrong ones the text's first and last words."""
    w = rows.select(*keys, F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w")).filter(F.size("w") >= 2 * size + 2)
    i = F.floor(F.size("w") * 0.6).cast("int")
    options = [F.slice("w", i + 1, F.lit(size)), F.slice("w", 1, size), F.slice("w", -size, size)]
    return w.select(*keys, F.get("w", i - 1).alias("context"), F.posexplode(F.array(*options)).alias("nth", "words"))


def phrase_scores(cases: DataFrame, keys: list[str], docs: DataFrame) -> DataFrame:
    """The cases' candidates with lps and base, a value for each word: the first word's base knows no word before it."""
    steps = cases.select(*keys, "nth", "context", "words", F.posexplode("words").alias("at", "word"))
    steps = steps.select(*keys, "nth", "at", "word", F.when(F.col("at") == 0, F.col("context")).otherwise(F.get("words", F.col("at") - 1)).alias("prev"))
    t = F.struct("at", "lp", F.when(F.col("at") == 0, F.col("base")).otherwise(F.col("lp")).alias("b"))
    grouped = with_logprobs(steps, docs).groupBy(*keys, "nth").agg(F.array_sort(F.collect_list(t)).alias("t"))
    return grouped.select(*keys, "nth", F.col("t.lp").alias("lps"), F.col("t.b").alias("base"))


def objective_losses(rows: DataFrame, keys: list[str], docs: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys, next_loss, skip_loss and ok: the mean loss of each next word, and of each word after that one, given the same words; ok if the first is less. `score` adds lp to rows of prev2, prev and word, in place of the bigram model of docs."""
    w = rows.select(*keys, F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w")).filter(F.size("w") >= 3)
    at = w.select(*keys, "w", F.posexplode("w").alias("i", "prev"))
    at = at.withColumn("prev2", F.coalesce(F.get("w", F.col("i") - 1), F.lit(K.START)))
    steps = at.select(*keys, "prev2", "prev", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.get("w", F.col("i") + d).alias("word")) for d in (1, 2)])).alias("z"))
    steps = steps.select(*keys, "prev2", "prev", "z.d", "z.word").filter("word is not null")
    mean = lambda d: F.round(-F.avg(F.when(F.col("d") == d, F.col("lp"))), 6)
    out = (with_logprobs(steps, docs) if score is None else score(steps)).groupBy(*keys).agg(mean(1).alias("next_loss"), mean(2).alias("skip_loss"))
    return out.withColumn("ok", F.col("next_loss") < F.col("skip_loss"))


def turn_losses(rows: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, loss and n: the mean loss of each text's words by `score`, which adds lp to rows of prev2, prev and word. A text without words has no row."""
    w = rows.select(*keys, F.transform(T.matches(F.col("text"), lang.WORD_B), F.lower).alias("w"))
    at = w.select(*keys, "w", F.posexplode("w").alias("i", "word"))
    before = lambda d: F.coalesce(F.get("w", F.col("i") - d), F.lit(K.START))
    return score(at.select(*keys, before(2).alias("prev2"), before(1).alias("prev"), "word")).groupBy(*keys).agg(F.round(-F.avg("lp"), 6).alias("loss"), F.count("*").alias("n"))


def verdict(rows: DataFrame, ok: Column) -> DataFrame:
    """hits, n and verdict: healthy if all are ok (or there is none), broken if none is, mixed otherwise."""
    hits, n = F.count_if(ok).cast("bigint"), F.count("*")
    return rows.agg(hits.alias("hits"), n.alias("n"), F.when(hits == n, "healthy").when(hits == 0, "broken").otherwise("mixed").alias("verdict"))


def carried_forward(pool: DataFrame, fresh: DataFrame, keys: list[str], bonus: float = 0.1, most: int = 3) -> DataFrame:
    """keys, word, p and rank: fresh candidates and those of the pool that begin with what is typed by now (column typed), which gain a bonus; each word once by its best p, the best `most` of them."""
    kept = pool.filter(F.startswith(F.col("word"), F.col("typed"))).select(*keys, "word", (F.col("p") + bonus).alias("p"))
    best = kept.unionByName(fresh.select(*keys, "word", "p")).groupBy(*keys, "word").agg(F.max("p").alias("p"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "word"))).filter(F.col("rank") <= most)


def progress(step: Column, steps: Column, elapsed: Column, tokens: Column) -> dict[str, Column]:
    """pct, eta in seconds and tokens a second of a run, from its steps, its seconds so far and the tokens of a step."""
    rate = F.coalesce(F.try_divide(step, F.when(elapsed > 0, elapsed)), F.lit(0.0))
    left = F.greatest(F.lit(0), steps - step)
    return {
        "pct": F.floor(F.lit(10000.0) * step / F.greatest(F.lit(1), steps) + 0.5) / 100,
        "eta": F.coalesce(F.floor(F.try_divide(left, F.when(rate > 0, rate))), F.lit(0)).cast("bigint"),
        "tps": F.coalesce(F.floor(F.try_divide(step * tokens, F.when(elapsed > 0, elapsed))), F.lit(0)).cast("bigint"),
    }
