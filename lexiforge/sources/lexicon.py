"""Lexicons with affix grammars from their two text files: stems with classes, and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How flags are written: a character each, two characters each, or numbers with commas.
FLAGS = {"char": "(?s).", "long": "(?s)..", "num": "[0-9]+"}


def _flags(written: Column, kind: str) -> Column:
    return F.regexp_extract_all(written, F.lit(FLAGS[kind]), F.lit(0))


def read_stems(spark: SparkSession, path: str, flags: str = "char") -> DataFrame:
    """stem and flag, a row for each class of a stem (null for none), from lines `stem/FLAGS`. The count in the first line, what follows a blank, and empty lines are passed over."""
    line = F.regexp_replace("value", r"\s.*$", "")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\d*\s*$")).select(F.regexp_extract(line, r"^([^/]+)", 1).alias("stem"), F.regexp_extract(line, r"/(.*)$", 1).alias("f"))
    return rows.filter("stem <> ''").select("stem", F.explode_outer(_flags(F.col("f"), flags)).alias("flag"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """kind, flag, strip, gain, cond and cross from lines `SFX flag strip gain cond` (PFX for prefixes) and the headers `SFX flag Y count` above them. A 0 is nothing, a dot any beginning or end. Classes of a gain (after a slash) are not followed."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^[PS]FX\s")).select(F.substring("value", 1, 1).alias("kind"), f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    head = (F.size("f") == 4) & at(2).isin("Y", "N") & at(3).rlike(r"^\d+$")
    heads = rows.filter(head).select("kind", at(1).alias("flag"), (at(2) == "Y").alias("cross"))
    none = lambda c: F.when(c == "0", "").otherwise(c)
    gain = none(F.regexp_replace(at(3), "/.*$", ""))
    cond = F.coalesce(F.nullif(at(4), F.lit(".")), F.lit(""))
    body = rows.filter(~head).select("kind", at(1).alias("flag"), none(at(2)).alias("strip"), gain.alias("gain"), cond.alias("cond"))
    return body.join(heads, ["kind", "flag"])
