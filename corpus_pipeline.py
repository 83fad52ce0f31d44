"""From raw documents to packed training sequences: quality, lines, near duplicates, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet in the shared folder and reads it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiforge.llm import decontamination, jaccard, linededup, packing, quality, tokens
from lexiforge.llm.shared import Tables, column_without_clash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled rows of this stage's documents.

    Null and empty texts get the constant's score, repeated rows equal ones; without labels every score is 0.5 and all stay. A null id is scored and never learned from. Other columns pass unread. An empty table gives an empty one.
    """
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.remainder(3, 1))
    score = column_without_clash(docs, "score")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                s = quality.score_texts(weights, text.slice(at, 256))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, score])

    # A table of its own, as put() bounds the batches that workers get.
    scored = Tables(spark).put(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())])).filter(F.col(score) >= 0.5), "scored")
    return scored.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents that lose lines and have no text left.

    Null and empty texts stay as they are. Rows of one id and text keep or lose the same lines; lines of a null id are never first. n_chars follows the text; other columns pass. An empty table gives an empty one.
    """
    out = linededup.dedup_lines(docs, Tables(spark))
    return out.filter(~((F.col(linededup.count_columns(docs)[1]) > 0) & (F.col("text") == ""))).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id.

    Null and empty texts are linked with nothing and stay. Rows that repeat that id stay together, and so do rows of a null id. Other columns pass. An empty table gives an empty one.
    """
    return jaccard.keep_one(docs, Tables(spark))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text, whatever its id.

    Null and empty texts hold nothing and stay, unless they are all that an item has (an empty item is held by none). Other columns pass. An empty table gives an empty one.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Tables(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed: a row for each piece.

    A null text is an empty one, which is one piece of the end id alone. Rows of one id are packed each by itself; a null id keeps its place as null. Other columns play no part. An empty table gives no piece.
    """
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"), Tables(spark))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: Two stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = tables.put(stage(spark, docs, sf_dir), f"stage{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
