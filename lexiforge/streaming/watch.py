"""A log folder watched by Structured Streaming, and running dedup of a stream of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import lang
from ..sources.files import events


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """kind and kv of each event as files appear; the checkpoint stands for marker files."""
    return events(spark.readStream.text(folder).withColumnRenamed("value", "line"))


def spikes(stream: DataFrame, key: str = "loss", scale: float = 8.0, limit: float = 3.0) -> DataFrame:
    return stream.filter(F.try_divide(F.col("kv")[key].try_cast("double"), F.lit(scale)) > limit)


def watch(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="120 seconds")).start()


def dedup_stream(lines: DataFrame) -> DataFrame:
    """Lines whose first 200 characters have not come before; the state grows with the distinct lines."""
    return lines.withColumn("_key", F.substring("text", 1, lang.PREFIX)).dropDuplicates(["_key"]).drop("_key")


def dedup_stream_within(lines: DataFrame, seq: str, time: str, length: str, late: str) -> DataFrame:
    """Of the lines with the same first 200 characters in each window of `length`, the one of the least seq (unique), whichever came first; a line comes out when its window is closed.

    Rows may come up to `late` behind the newest, twice, and in any order: what comes out is what a batch over all rows gives. Later ones are dropped. The state holds a row for each different line of the windows that are open, so it does not grow with the stream. Null texts are one line; a null time has no window and is dropped.
    """
    first = F.min_by(F.struct(*[F.col(c) for c in lines.columns]), F.col(seq)).alias("_row")
    rows = lines.withWatermark(time, late) if lines.isStreaming else lines.filter(F.col(time).isNotNull())
    return rows.groupBy(F.window(time, length), F.substring("text", 1, lang.PREFIX).alias("_key")).agg(first).select("_row.*")
