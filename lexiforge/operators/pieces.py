"""Pieces and ids: reserved slots, character symbols, and a trained SentencePiece model of any file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import lang
from ..functions import batches as B
from ..functions import text as T
from . import order as O

_models: dict[str, object] = {}


def symbols(df: DataFrame, text: str) -> DataFrame:
    """df with `ids` by symbols (functions.text.symbol_ids), reversible."""
    return B.added(df.drop("ids"), text, "ids", ArrayType(IntegerType()), lambda texts, _: B.symbol_ids(texts))


def model(path: str):
    """The model of a file that every worker can read, loaded once a worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _added(df: DataFrame, column: str, out: str, kind, one: Callable[[list], list]) -> DataFrame:
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                values = part.column(at)
                made = pa.array(one(pc.fill_null(values, "").to_pylist() if pa.types.is_string(values.type) else [x or [] for x in values.to_pylist()]), target)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    target = pa.list_(pa.int32()) if isinstance(kind, ArrayType) and isinstance(kind.elementType, IntegerType) else pa.list_(pa.string()) if isinstance(kind, ArrayType) else pa.string()
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, kind)]))


def encoder(path: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds `ids` to a table: the text's ids by a SentencePiece model. A null text has none."""
    return lambda df, text: _added(df, text, "ids", ArrayType(IntegerType()), lambda texts: model(path).encode(texts, out_type=int, num_threads=1))


def encode_pieces(df: DataFrame, text: str, path: str) -> DataFrame:
    """df with `pieces`."""
    return _added(df, text, "pieces", ArrayType(StringType()), lambda texts: model(path).encode(texts, out_type=str, num_threads=1))


def decode(df: DataFrame, ids: str, path: str) -> DataFrame:
    """df with `decoded`, the text of a column of ids."""
    return _added(df, ids, "decoded", StringType(), lambda rows: [model(path).decode(x) for x in rows])


def vocabulary(spark, path: str) -> DataFrame:
    """id, piece and score of a model."""
    m = model(path)
    return spark.createDataFrame([(i, m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size())], "id long, piece string, score double")


def compared_slots(ours: DataFrame, theirs: DataFrame, lo: int = lang.XBU, hi: int = lang.CHAR_A + 25) -> DataFrame:
    """id, ours, theirs and same for each slot from lo to hi, of two tables of id and piece; a slot that is missing on one side differs."""
    x, y = ours.select("id", F.col("piece").alias("ours")), theirs.select("id", F.col("piece").alias("theirs"))
    return x.join(y, "id", "full_outer").filter(F.col("id").between(lo, hi)).withColumn("same", F.coalesce(F.col("ours") == F.col("theirs"), F.lit(False)))


def slot_verdict(compared: DataFrame) -> DataFrame:
    """slots, mismatches and verdict."""
    wrong = F.count_if(~F.col("same")).cast("bigint")
    return compared.agg(F.count("*").alias("slots"), wrong.alias("mismatches"), F.when(wrong == 0, "match").otherwise("differ").alias("verdict"))


def are_sequential(ids: Column) -> Column:
    """Whether an array of ids rises by one from each to the next."""
    n = F.size(ids)
    return F.when(n < 2, True).otherwise(F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(ids, i) == F.get(ids, i - 1) + 1))


def splits_morphemes(pieces: Column, root: Column, suffix: Column) -> Column:
    """Whether a word's first piece is its root (with or without the space mark) and its suffix is among the rest."""
    first = F.get(pieces, F.lit(0))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    return F.coalesce(((first == root) | (first == F.concat(F.lit(lang.SPACE_MARK), root))) & F.array_contains(rest, suffix), F.lit(False))


def morpheme_accuracy(cases: DataFrame) -> DataFrame:
    """hits, n and whether 60 per cent are hit, of cases with pieces, root and suffix."""
    hits = F.count_if(splits_morphemes(F.col("pieces"), F.col("root"), F.col("suffix"))).cast("bigint")
    return cases.agg(hits.alias("hits"), F.count("*").alias("n"), (hits >= F.count("*") * 0.6).alias("enough"))


def trainer_sample(texts: DataFrame, most: int = 10_000_000, longest: int = 4192, seed: int = 1337) -> DataFrame:
    """Sentences for a tokenizer's trainer: of those with no more than `longest` bytes, the `most` with the least hashes. A threshold of hashes is counted out first, so no task sorts or holds the sample."""
    kept = texts.filter((F.col("text") != "") & (F.octet_length("text") <= longest))
    return O.least_k(kept.withColumn("_u", F.xxhash64("text", F.lit(seed))), "_u", ["text"], most).drop("_u")
