"""Training examples: inline corrections, correction triples, packed text, and mixes of them.

Ids come from an encoder, a function that adds a column `ids` to a table: operators.pieces.symbols, or operators.pieces.encoder of a model file. Sources of examples have a number without gaps (`chunk` or `i`, from 0), so that a draw picks an example by an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lang
from ..functions import batches as B
from ..functions import text as T
from . import order as O
from . import sequences as S

Encoder = Callable[[DataFrame, str], DataFrame]
#: Shares are compared with draws below this.
DRAWS = 1_000_000


def inline_corrected(docs: DataFrame, seq: str, text: str = "text", rate: float = lang.TYPO_RATE) -> DataFrame:
    """Adds `corrupted`: of the words of a text, about `rate` are written as what was typed and what was meant. Words without letters alone in their middle and words without a typo stay. Draws follow from seq (unique) and the word's place; a row is rewritten where it is."""

    def corrected(texts: list[str], part: pa.RecordBatch) -> pa.Array:
        keys = part.column(part.num_columns - 1).to_pylist()
        return pa.array([B.inline_corrected(t, k, int(rate * DRAWS), DRAWS, S.SHORTCUT_SHARE) for t, k in zip(texts, keys, strict=True)], pa.string())

    keyed = docs.drop("corrupted").withColumn("_seq", F.col(seq).cast("string"))
    return B.added(keyed, text, "corrupted", StringType(), corrected).drop("_seq")


def bounded(df: DataFrame) -> DataFrame:
    """ids between the marks of begin and end."""
    return df.withColumn("ids", F.concat(F.array(F.lit(lang.BOS)), "ids", F.array(F.lit(lang.EOS))))


def inline_examples(docs: DataFrame, seq: str, encode: Encoder, length: int, low: float = 1.0, rate: float = lang.TYPO_RATE, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """chunk, input_ids, labels and loss_weights: texts with inline corrections on end, in chunks of `length`; tokens of corrections weigh 1, others `low`. Packing reads the corrected texts twice; `kept` may make a table of them."""
    texts = kept(inline_corrected(docs, seq, rate=rate).select(seq, "corrupted"))
    chunks = O.packed(texts, seq, "ids", length, made=lambda df: bounded(encode(df, "corrupted")))
    return chunks.select("chunk", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"), S.span_mask(F.col("ids"), lang.XBU, lang.XEC, low).alias("loss_weights"))


def plain_examples(docs: DataFrame, seq: str, encode: Encoder, length: int) -> DataFrame:
    """chunk, input_ids, labels, loss_weights (all 1) and attention_mask of packed text."""
    chunks = O.packed(docs.select(seq, "text"), seq, "ids", length, made=lambda df: bounded(encode(df, "text")))
    ones = lambda v: F.transform("ids", lambda x: F.lit(v))
    return chunks.select("chunk", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"), ones(1.0).alias("loss_weights"), ones(1).alias("attention_mask"))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides, which differ."""
    return pairs.filter((F.col("typed") != "") & (F.col("committed") != "") & (F.col("typed") != F.col("committed")))


def triple_examples(pairs: DataFrame, encode: Encoder, length: int, low: float = 0.0) -> DataFrame:
    """The pairs' other columns, with input_ids, labels, loss_weights and attention_mask: each pair as one triple between the marks, filled up to `length`; longer ones go. The correction weighs 1, the rest `low`."""
    rows = valid_pairs(pairs).withColumn("_text", T.triple(F.col("typed"), F.col("committed")))
    rows = T.once(bounded(encode(rows, "_text")).drop("_text"), "_ids", F.col("ids")).filter(F.size("_ids") <= length).drop("ids")
    inputs, labels, mask = S.padded(F.col("_ids"), length)
    weights = S.correction_mask(inputs, lang.XBC, lang.XEC, low)
    return rows.select("*", inputs.alias("input_ids"), labels.alias("labels"), weights.alias("loss_weights"), mask.alias("attention_mask")).drop("_ids")


def mix_plan(spark, n: int, plain: int, synthetic: int, real: int, plain_share: float = 0.60, real_share: float = 0.25) -> DataFrame:
    """i, origin and pick for n draws over sources of so many examples: the next plain one with plain_share until none is left, otherwise any pair, a real one with real_share if there are any. Without any pair, only plain ones come."""
    rows = spark.range(n).withColumnRenamed("id", "i")
    wants = (T.draw(F.col("i"), "mix", 0, DRAWS) < int(plain_share * DRAWS)).cast("bigint")
    rows = O.running_sum(rows, "i", wants, "_nth").withColumn("_plain", (wants == 1) & (F.col("_nth") <= plain))
    is_real = F.lit(real > 0) & ((T.draw(F.col("i"), "mix", 1, DRAWS) < int(real_share * DRAWS)) | F.lit(synthetic == 0))
    pick = T.draw(F.col("i"), "mix", 2, T.ANY)
    rows = rows.withColumn("origin", F.when(F.col("_plain"), "plain").when(is_real, "real").otherwise("synthetic"))
    count = F.when(F.col("origin") == "real", real).otherwise(synthetic)
    rows = rows.withColumn("pick", F.when(F.col("_plain"), F.col("_nth") - 1).when(count > 0, F.pmod(pick, count)))
    return rows.filter("pick is not null").select("i", "origin", "pick")


def mixed_examples(n: int, plain: DataFrame, synthetic: DataFrame, real: DataFrame, plain_share: float = 0.60, real_share: float = 0.25) -> DataFrame:
    """i, origin and an example's columns: n draws from packed text (numbered by chunk) and triples (numbered by i). A recovery mix is one of plain_share 0.75."""
    spark, sources = plain.sparkSession, {"plain": plain.withColumnRenamed("chunk", "_n"), "synthetic": synthetic.withColumnRenamed("i", "_n"), "real": real.withColumnRenamed("i", "_n")}
    plan = mix_plan(spark, n, plain.count(), synthetic.count(), real.count(), plain_share, real_share)
    columns = ["input_ids", "labels", "loss_weights", "attention_mask"]
    every = None
    for origin, rows in sources.items():
        rows = rows.select(F.lit(origin).alias("_origin"), F.col("_n").cast("bigint").alias("_n"), *columns)
        every = rows if every is None else every.unionByName(rows)
    # A source's most wanted example is drawn n times at most, and picks are spread evenly.
    return plan.join(every, (F.col("origin") == F.col("_origin")) & (F.col("pick") == F.col("_n"))).select("i", "origin", *columns)


def loss_report(examples: DataFrame, key: str, ce: Column) -> DataFrame:
    """For each example and, with a null key, for all: kind (plain if no token weighs 0.5 or less), valid tokens, the weight of valid tokens, and the mean loss with and without weights.

    ce is an array: the loss of each label after the first. Labels of -100 do not count.
    """
    at = F.sequence(F.lit(0), F.size("labels") - 2)
    rows = examples.select(key, F.when(F.array_min("loss_weights") > 0.5, "plain").otherwise("triple").alias("kind"), "labels", "loss_weights", ce.alias("_ce")).filter(F.size("labels") > 1)
    rows = rows.select(key, "kind", F.explode(F.transform(at, lambda j: F.struct(F.get("_ce", j).alias("ce"), F.get("loss_weights", j + 1).cast("double").alias("w"), (F.get("labels", j + 1) != lang.IGNORED).cast("double").alias("v")))).alias("t"))
    t = {k: F.col(f"t.{k}") for k in ("ce", "w", "v")}
    sums = rows.groupBy(key, "kind").agg(F.sum(t["v"]).alias("valid"), F.sum(t["w"] * t["v"]).alias("weight"), F.sum(t["ce"] * t["v"]).alias("_u"), F.sum(t["ce"] * t["w"] * t["v"]).alias("_w"))
    whole = sums.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("valid", "weight", "_u", "_w"))).select(F.lit(None).cast(sums.schema[key].dataType).alias(key), F.lit("batch").alias("kind"), "valid", "weight", "_u", "_w")
    mean = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return sums.unionByName(whole).select(key, "kind", F.col("valid").cast("bigint").alias("valid"), F.round("weight", 6).alias("weight"), mean("_u", "valid").alias("loss"), mean("_w", "weight").alias("weighted_loss"))
