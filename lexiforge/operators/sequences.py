"""Typo pairs, token sequences, masks, weights and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lang
from ..functions import text as T
from . import order as O

#: Draws for each pair wanted, and their step.
TRIES, GOLDEN = 5, 0.6180339887498949
#: A quarter of words tries an alias first.
SHORTCUT_SHARE = 25


def cdf_sample(words: DataFrame, n: int, at: Column | None = None) -> DataFrame:
    """i and word: n draws at the quantiles (i + 0.5) / n, or `at` of i (called id), of words weighted by ln(cnt + 1), in word order.

    The running weights are sums of ranges of words. Draws and words meet on cells of the unit interval, as many as there are words, so the range join is an equi-join: a word is in every cell that its interval touches.
    """
    w = words.select("word", F.log1p(F.col("cnt").cast("double")).alias("_w"))
    hi = O.running_sum(w, "word", F.col("_w"), "_hi", bucket=O.word_range("word"))
    total = w.agg(F.sum("_w").alias("_total"), F.count("*").alias("_cells"))
    b = hi.join(F.broadcast(total)).select("word", ((F.col("_hi") - F.col("_w")) / F.col("_total")).alias("_lo"), (F.col("_hi") / F.col("_total")).alias("_hi"), "_cells")
    b = b.select("word", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * F.col("_cells")), F.floor(F.col("_hi") * F.col("_cells")))).alias("_cell"))
    u = words.sparkSession.range(n).select(F.col("id").alias("i"), ((F.col("id") + 0.5) / n if at is None else at).alias("_u"))
    u = u.join(F.broadcast(total)).withColumn("_cell", F.floor(F.col("_u") * F.col("_cells"))).drop("_total", "_cells")
    return u.join(b, "_cell").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("i", "word")


def shortcut_pairs(spark, p: lang.Profile = lang.DEFAULT) -> DataFrame:
    """typed and committed from the alias lists; repeats stay, aliases equal to the word go."""
    rows = spark.createDataFrame([(w, list(a)) for w, a in p.shortcuts], "committed string, forms array<string>")
    return rows.select(F.explode("forms").alias("typed"), "committed").filter(F.col("typed") != F.col("committed"))


def synthetic_pairs(words: DataFrame, n: int) -> DataFrame:
    """i, typed and committed: the first n typos of up to 5n draws. The draws step round the unit interval by the golden ratio, so that any first part of them covers all words."""
    tries = cdf_sample(words, TRIES * n, at=F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0)))
    return O.within_budget(typos(tries, "word", "i").select("i", "typed", F.col("word").alias("committed")), "i", F.lit(1), n)


def shortcut(word: Column, seq: Column, p: lang.Profile = lang.DEFAULT) -> Column:
    """An alias of the word, in its case; null for three quarters of rows, where there is no alias, and where the alias is the word."""
    forms = F.create_map(*[x for w, a in p.shortcuts for x in (F.lit(w), F.array(*map(F.lit, a)))])
    of = F.try_element_at(forms, F.lower(word))
    form = F.get(of, F.pmod(T.draw(seq, "alias", 1, T.ANY), F.size(of)).cast("int"))
    first = F.substring(word, 1, 1)
    cased = lambda x: F.when(first != F.lower(first), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
    # Few words have an alias, so that is looked up before a draw is made.
    return F.when(of.isNotNull() & (T.draw(seq, "alias", 0, 100) < SHORTCUT_SHARE), T.let(form, lambda x: F.nullif(cased(x), word)))


def typed_of(word: Column, seq: Column) -> Column:
    """What is typed for a word, null where it has no typo. An alias comes first, and each try is made only where what came before gave none."""
    ok = (F.length(word) >= 2) & word.rlike(lang.ELIGIBLE)
    tries = [T.let(T.typo_try(word, seq, t), lambda x: F.nullif(x, word)) for t in (1, 2)]
    return F.when(ok, F.coalesce(shortcut(word, seq), *tries))


def typos(df: DataFrame, word: str, seq: str) -> DataFrame:
    """Adds `typed`; rows without a typo go."""
    return T.once(df, "typed", typed_of(F.col(word), F.col(seq))).filter("typed is not null")


def span_mask(ids: Column, start: int, stop: int, low: float) -> Column:
    """1.0 from each start through the stop after it, low elsewhere; an open span runs to the end. The array is cut after each stop, so the cost is linear in its length."""
    stops = F.filter(F.transform(ids, lambda x, i: F.when(x == stop, i + 1)), lambda i: i.isNotNull())
    ends = F.concat(stops, F.array(F.size(ids)))
    pieces = F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), stops).alias("lo"), ends.alias("hi")), lambda z: F.slice(ids, z["lo"] + 1, z["hi"] - z["lo"]))

    def weights(piece: Column) -> Column:
        before = F.coalesce(F.nullif(F.array_position(piece, F.lit(start)), F.lit(0)) - 1, F.size(piece)).cast("int")
        return F.concat(F.array_repeat(F.lit(low), before), F.array_repeat(F.lit(1.0), F.size(piece) - before))

    return F.flatten(F.transform(pieces, weights))


def correction_mask(ids: Column, start: int, stop: int, low: float) -> Column:
    """1.0 from the first start through the first stop after it, low elsewhere; an open span runs to the end. Three runs of equal weights, so the cost is linear in the length."""
    n = F.size(ids)
    a = F.coalesce(F.nullif(F.array_position(ids, F.lit(start)), F.lit(0)) - 1, n).cast("int")
    rest = F.slice(ids, a + 1, F.greatest(n - a, F.lit(0)))
    inside = F.coalesce(F.nullif(F.array_position(rest, F.lit(stop)), F.lit(0)), F.size(rest)).cast("int")
    return F.concat(F.array_repeat(F.lit(low), a), F.array_repeat(F.lit(1.0), inside), F.array_repeat(F.lit(low), n - a - inside))


def padded(ids: Column, length: int) -> tuple[Column, Column, Column]:
    """input_ids padded with 0, labels padded with -100, and the attention mask."""
    n = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    fill = lambda v: F.array_repeat(F.lit(v), n)
    return F.concat(ids, fill(0)), F.concat(ids, fill(-100)), F.concat(F.transform(ids, lambda x: F.lit(1)), fill(0))


def weighted_loss(ce: Column, weight: Column, valid: Column) -> Column:
    return F.sum(ce * weight * valid) / F.greatest(F.sum(weight * valid), F.lit(1e-8))


def slot_layout(spark, first: tuple[str, ...] = (), second: tuple[str, ...] = (), emoji: tuple[str, ...] = ()) -> DataFrame:
    """id, piece and kind of the 300 reserved pieces: 24 fillers, 146 words, the control pieces and keys, 56 more words, 40 emoji. Words get the space mark; lists that are too long are cut, and too short ones filled up with fillers numbered on from the first slot of the range."""

    def filled(words: tuple[str, ...], n: int, start: int) -> list[str]:
        return [*words, *(f"<FUTO{start + i}>" for i in range(n - len(words)))][:n]

    spaced = lambda words: [f"{w}{lang.SPACE_MARK}" for w in words]
    groups = [
        ("filler", [f"<FUTO{i}>" for i in range(24)]),
        ("word", spaced(filled(first, 146, 28))),
        ("control", ["<XBU>", "<XBC>", "<XEC>"]),
        ("extra", [f"<XC{i}>" for i in range(5)]),
        ("char", [f"<CHAR_{chr(65 + i)}>" for i in range(26)]),
        ("word2", spaced(filled(second, 56, 208))),
        ("emoji", [*emoji, *(f"<EMOJI{i}>" for i in range(40 - len(emoji)))][:40]),
    ]
    rows = [(p, k) for k, ps in groups for p in ps]
    return spark.createDataFrame([(lang.FIRST_SLOT + i, p, k) for i, (p, k) in enumerate(rows)], "id long, piece string, kind string")
