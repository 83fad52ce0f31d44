"""Files in and out: text shards, frequency maps, pairs, dictionaries, logs, key-value metadata."""

from __future__ import annotations

import json
import logging
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import order as O
from ..operators import vocab as V
from . import tokens

log = logging.getLogger(__name__)


def read_shards(spark: SparkSession, *dirs: str, pattern: str = "shard_*.txt") -> DataFrame:
    """text and file of each line of the shards in the folders; an error if there is none."""
    try:
        rows = spark.read.option("pathGlobFilter", pattern).text(list(dirs))
    except Exception as e:
        raise FileNotFoundError(f"no {pattern} in {dirs}") from e
    if not rows.inputFiles():
        raise FileNotFoundError(f"no {pattern} in {dirs}")
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """source (the file's name) and text of each non-empty line."""
    rows = read_shards(spark, folder, pattern="*.txt").filter("text <> ''")
    return rows.select(F.regexp_replace("file", r"\.txt$", "").alias("source"), "text")


def write_shards(df: DataFrame, path: str, group: str, seq: str, target: int) -> None:
    """Lines in shards of about `target` UTF-8 bytes with the line end, in order of seq in each group."""
    sized = df.withColumn("_b", F.octet_length("text") + 1)
    ids = O.greedy_shards(sized, group, seq, "_b", target).withColumnRenamed(group, "_g")
    rows = df.join(ids, (F.col(seq) == F.col("seq")) & (F.col(group) == F.col("_g")))
    rows = rows.repartition(group, "shard").sortWithinPartitions(group, "shard", seq)
    rows.select(group, "shard", "text").write.partitionBy(group, "shard").text(path)


def scan_sources(spark: SparkSession, sources: dict[str, tuple[str, str]], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """source and text of tables given by format and path, and why those that cannot be read were skipped. A null text counts as empty; other columns are not read."""
    out, skipped = None, {}
    for name, (kind, path) in sources.items():
        try:
            rows = spark.read.format(kind).load(path).select(F.lit(name).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        except Exception as e:
            skipped[name] = str(e).splitlines()[0]
            log.warning("source %s is skipped: %s", name, skipped[name])
            continue
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "source string, text string") if out is None else out, skipped


# --- JSON documents, written as lines so that no task holds one ------------------------------------------------------


def _document(parts: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """line, part and n of a document: each part opens with a text and holds the rows (key, value) of a table, if any, as one entry a line."""
    out = None
    spark = next(df for _, df in parts if df is not None).sparkSession
    for i, (head, df) in enumerate(parts):
        rows = spark.createDataFrame([(i, "", head)], "part int, key string, value string").select("part", F.lit(None).cast("string").alias("key"), "value")
        if df is not None:
            rows = rows.unionByName(df.select(F.lit(i).alias("part"), F.col("key"), F.col("value")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _write_document(parts: list[tuple[str, DataFrame | None]], path: str, one: bool = False) -> None:
    """The document as text files in the folder, ranges of its lines in order of their names: on end, they are the document. The first entry of a part has no comma before it. `one` is for what is read back whole."""
    rows = _document(parts)
    firsts = rows.filter("key is not null").groupBy("part").agg(F.min("key").alias("_first"))
    rows = rows.join(F.broadcast(firsts), "part", "left")
    comma = F.when(F.col("key").isNotNull() & (F.col("key") != F.col("_first")), ",").otherwise("")
    rows = rows.orderBy("part", F.asc_nulls_first("key")).select(F.concat(comma, "value").alias("value"))
    (rows.coalesce(1) if one else rows).write.text(path)


def _quoted(word: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(word.alias("a")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _entries(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.alias("key"), F.concat(_quoted(key), F.lit(":"), F.col("cnt").cast("string")).alias("value"))


def write_counts(words: DataFrame, path: str) -> None:
    """A frequency map: one JSON object of words (unique) and counts, one a line."""
    _write_document([("{", _entries(words, F.col("word"))), ("}", None)], path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """word and cnt from frequency maps, written in one line or more, an entry in one line."""
    line = F.regexp_replace(F.trim("value"), r"^[{,]+\s*|\s*[},]+$", "")
    entries = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string,bigint>")
    return spark.read.text(path).filter(F.contains("value", F.lit(":"))).select(F.explode(entries).alias("word", "cnt"))


def write_blob(unigrams: DataFrame, proper: DataFrame, bigrams: DataFrame, path: str) -> None:
    """A composite map of three: words, capitalised forms, and pairs (w1, w2) joined by a tab."""
    pairs = _entries(bigrams, T.pair_key(F.col("w1"), F.col("w2")))
    _write_document([('{"unigrams": {', _entries(unigrams, F.col("word"))), ('}, "proper": {', _entries(proper, F.col("word"))), ('}, "bigrams": {', pairs), ("}}", None)], path, one=True)


def read_blob(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """unigrams, proper and bigrams of a composite map; a flat map is unigrams alone, and pair keys without a tab go. What other tools write in one line is one row here."""
    raw = spark.read.text(path, wholetext=True)
    m = "map<string,bigint>"
    blob = raw.select(F.from_json("value", f"unigrams {m}, proper {m}, bigrams {m}").alias("b"), F.from_json("value", m).alias("flat"))
    word = lambda c: blob.select(F.explode(c).alias("word", "cnt"))
    pairs = blob.select(F.explode("b.bigrams").alias("k", "cnt")).filter(F.contains("k", F.lit("\t")))
    w1, w2 = T.unpaired(F.col("k"))
    return {"unigrams": word(F.coalesce("b.unigrams", "flat")).filter("cnt is not null"), "proper": word("b.proper"), "bigrams": pairs.select(w1.alias("w1"), w2.alias("w2"), "cnt")}


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A JSON array of pairs, one a line, in order of what was meant and typed; repeats stay."""
    row = F.to_json(F.struct("typed", "committed"))
    rows = pairs.select(F.concat_ws("\x00", "committed", "typed", F.lpad(F.row_number().over(Window.partitionBy("committed", "typed").orderBy(F.lit(1))).cast("string"), 10, "0")).alias("key"), row.alias("value"))
    _write_document([("[", rows), ("]", None)], path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """typed and committed from a JSON array or JSON lines, an object in one line or all in one; typo and correct are taken for them where these are missing."""
    line = F.regexp_replace(F.trim("value"), r"^[\[,]+\s*|\s*[\],]+$", "")
    rows = spark.read.text(path).filter(F.contains("value", F.lit("{"))).select(F.explode(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<struct<typed:string,committed:string,typo:string,correct:string>>")).alias("p"))
    return rows.select(F.coalesce("p.typed", "p.typo").alias("typed"), F.coalesce("p.committed", "p.correct").alias("committed"))


def write_report(aggregate: DataFrame, rows: DataFrame, order: str, name: str, path: str) -> None:
    """A nested report: a name, the one row of totals, and all rows (each one JSON object), in order of a column that is unique."""
    total = aggregate.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).limit(1).select(F.lit("a").alias("key"), "value")
    each = rows.select(F.lpad(F.col(order).cast("string"), 20, "0").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    _write_document([('{"name": ' + json.dumps(name) + ', "aggregate":', total), (', "rows": [', each), ("]}", None)], path)


# --- dictionaries -----------------------------------------------------------------------------------------------------


def dictionary_header(locale: str, description: str, date: int) -> str:
    """The first line of a dictionary; date is a Unix time."""
    return f"dictionary=main:{locale},locale={locale},description={description},date={date},version=1"


def write_dictionary(lines: DataFrame, header: str, path: str) -> None:
    """The header and dictionary_lines as gzipped texts, ranges of lines in order of their names. A gzip file may have several members, so the files on end are the dictionary as one file, and no task has it whole."""
    rows = lines.select("f", "word", "n", "line")
    head = lines.sparkSession.createDataFrame([(header,)], "line string").select(F.lit(1 << 30).cast(rows.schema["f"].dataType).alias("f"), F.lit("").alias("word"), F.lit(-1).cast("bigint").alias("n"), "line")
    head.unionByName(rows).orderBy(*V.line_order()).select("line").write.option("compression", "gzip").text(path)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """block, seq (a struct) and line of a text file's lines: seq rises with the line's place, also where a file is read in several blocks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select(F.struct("file", "start").alias("block"), F.struct("file", "start", F.monotonically_increasing_id().alias("at")).alias("seq"), F.col("value").alias("line"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, bigram (null for the word itself) and f of a dictionary file, gzipped or not."""
    return V.parsed_lines(ordered_lines(spark, path), bucket=F.col("block"))


# --- token ids --------------------------------------------------------------------------------------------------------


def write_ids(rows: DataFrame, path: str) -> None:
    """Token ids as a list column; ids of 16 bits are dictionary-encoded by the writer."""
    rows.write.parquet(path)


def write_token_bin(rows: DataFrame, seq: str, ids: str | Column, path: str, parts: int = 8, width: int = 2) -> int:
    """All ids on end as flat files of little-endian numbers of `width` bytes, in ascending ranges of seq, in a folder that all executors share; returns how many there are. A folder that is complete already is left as it is. ids may be an expression: it is evaluated behind the shuffle, which then has what it is made of, such as texts. Ids that need more bytes are an error. The files appear when all are whole, so a repeated task does no harm and a failed job leaves none."""
    if not tokens.complete(path):
        ordered = rows.repartitionByRange(parts, seq).sortWithinPartitions(seq).select(ids)
        ordered.write.format(tokens.register(rows.sparkSession)).option("width", width).mode("append").save(path)
    return sum(n for _, n in tokens.parts(path, width))


def read_token_bin(spark: SparkSession, path: str, width: int = 2, length: int = 1 << 18, **options) -> DataFrame:
    """file, worker, nth, start and ids of the flat files, in rows of `length` ids; tasks read ranges of bytes. See tokens.TokenFiles for the options, start and end among them."""
    return spark.read.format(tokens.register(spark)).options(width=width, length=length, **options).load(path)


def token_slices(spark: SparkSession, path: str, length: int, workers: int, width: int = 2) -> DataFrame:
    """worker, nth, input_ids and labels: slices of `length` ids and the same moved on by one, in consecutive ranges of ids, one for each worker, of which the last has what is left over. What is too short for a slice is dropped at the end of each range."""
    rows = read_token_bin(spark, path, width, length + 1, overlap=1, workers=workers, tail=False)
    return rows.select("worker", "nth", F.slice("ids", 1, length).alias("input_ids"), F.slice("ids", 2, length).alias("labels"))


# --- metrics and logs -------------------------------------------------------------------------------------------------


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV; only the first file of a folder has a header."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    first = not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows.coalesce(1).write.mode("append").option("header", first).csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of appended metrics, without headers."""
    names = [c.split()[0] for c in schema.split(",")]
    lines = spark.read.text(path).filter(F.col("value") != ",".join(names))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def event_lines(rows: DataFrame, kind: Column, at: Column, pairs: dict[str, Column]) -> DataFrame:
    """line: events as [kind] t=... key=value ..."""
    body = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items()]
    return rows.select(F.concat_ws(" ", F.concat(F.lit("["), kind, F.lit("]")), F.concat(F.lit("t="), T.utc_stamp(at)), *body).alias("line"))


def append_events(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


def events(lines: DataFrame) -> DataFrame:
    """kind and kv of log lines of the form [kind] key=value ...; of a key that comes again, the last value counts, and words without = are passed over."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace("line", r"^\[[^\]]*\]", "")), r"\s+"), lambda x: F.contains(x, F.lit("=")))
    key = lambda x: F.substring_index(x, "=", 1)
    rows = lines.select(*[c for c in lines.columns if c != "line"], F.nullif(F.regexp_extract("line", r"^\[([^\]]*)\]", 1), F.lit("")).alias("kind"), tokens.alias("_t")).filter("kind is not null")
    last = F.filter("_t", lambda x, i: ~F.exists(F.slice("_t", i + 2, F.size("_t")), lambda y: key(y) == key(x)))
    kv = F.map_from_entries(F.transform(last, lambda x: F.struct(key(x).alias("key"), F.substring(x, F.length(key(x)) + 2, F.length(x)).alias("value"))))
    return rows.withColumn("kv", kv).drop("_t")


def latest(lines: DataFrame, order: str) -> DataFrame:
    """The last event of each kind."""
    return events(lines).groupBy("kind").agg(F.max_by("kv", order).alias("kv"))


def errors(lines: DataFrame) -> DataFrame:
    """All events of kind error."""
    return events(lines).filter("kind = 'error'")


# --- key-value headers of model files ---------------------------------------------------------------------------------


_KINDS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


class _Reader:
    """A cursor over a model file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, fmt: str):
        (v,) = struct.unpack_from("<" + fmt, self.data, self.at)
        self.at += struct.calcsize("<" + fmt)
        return v

    def text(self) -> str:
        n = self.number("Q")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            sub, n = self.number("I"), self.number("Q")
            return [self.value(sub) for _ in range(n)]
        return self.number(_KINDS[kind])


def _header(data: bytes) -> tuple[int, int, list[tuple[str, int, int | None, object, bytes]], _Reader]:
    """Version, number of tensors, and key, type, element type, value and bytes of each field; the cursor stands behind the fields."""
    if data[:4] != b"GGUF":
        raise ValueError("not a model file")
    r = _Reader(data)
    r.at = 4
    version, tensors, count = r.number("I"), r.number("Q"), r.number("Q")
    fields = []
    for _ in range(count):
        begin = r.at
        key, kind = r.text(), r.number("I")
        sub = struct.unpack_from("<I", data, r.at)[0] if kind == 9 else None
        fields.append((key, kind, sub, r.value(kind), data[begin : r.at]))
    return version, tensors, fields, r


def parse_metadata(data: bytes) -> list[tuple[str, int, int | None, str]]:
    """key, type, element type and value (as text) of a model file's key-value header."""
    return [(key, kind, sub, str(value)) for key, kind, sub, value, _ in _header(data)[2]]


def _field(key: str, value) -> bytes:
    """A field from a Python value: text, truth, whole number (32 bits, or 64 if it needs them), number, or bytes (an array of 8-bit numbers)."""
    text = lambda x: struct.pack("<Q", len(x.encode())) + x.encode()
    head = text(key)
    if isinstance(value, str):
        return head + struct.pack("<I", 8) + text(value)
    if isinstance(value, bool):
        return head + struct.pack("<I?", 7, value)
    if isinstance(value, int):
        return head + (struct.pack("<II", 4, value) if 0 <= value < 1 << 32 else struct.pack("<Iq", 11, value))
    if isinstance(value, float):
        return head + struct.pack("<If", 6, value)
    return head + struct.pack("<IIQ", 9, 0, len(value)) + bytes(value)


def rewritten(data: bytes, strip: tuple[str, ...] = (), override: dict | None = None, version: int | None = None) -> bytes:
    """A model file whose other fields are copied as they are: without the fields in strip, with those in override new or in place of old ones, and of another version. Tensors are copied byte by byte behind the new header."""
    old, tensors, fields, r = _header(data)
    override = override or {}
    align = int(next((v for k, _, _, v, _ in fields if k == "general.alignment"), 32))
    kept = [raw for k, _, _, _, raw in fields if k not in strip and k not in override]
    made = [_field(k, v) for k, v in override.items() if k not in strip]
    begin = r.at
    for _ in range(tensors):
        r.text()
        for _ in range(r.number("I")):
            r.number("Q")
        r.number("I")
        r.number("Q")
    head = struct.pack("<4sIQQ", b"GGUF", old if version is None else version, tensors, len(kept) + len(made)) + b"".join(kept + made) + data[begin : r.at]
    if not tensors:
        return head
    return head + bytes(-len(head) % align) + data[r.at + (-r.at % align) :]


def rewrite_metadata(spark: SparkSession, path: str, strip: tuple[str, ...] = (), override: dict | None = None, version: int | None = None) -> DataFrame:
    """path and content of each model file as rewritten() makes it; a model is one row, and Spark has no writer of plain binary files, so the caller stores it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [rewritten(bytes(c), strip, override, version) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content binary")


def stripped(kv: Column, *keys: str) -> Column:
    """A map without some keys."""
    return F.map_filter(kv, lambda k, v: ~k.isin(*keys))


def overridden(kv: Column, new: dict[str, str]) -> Column:
    """A map with some keys set."""
    return F.map_concat(stripped(kv, *new), F.create_map(*[F.lit(x) for pair in new.items() for x in pair]))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, key, type, sub_type and value of each file's header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in parse_metadata(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "key", "type", "sub_type", "value"]).astype({"sub_type": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, type int, sub_type int, value string")


def slot_report(slots: DataFrame, sections: DataFrame) -> DataFrame:
    """place and line of a report on slots (id, piece): a heading for each section (lo, hi, section) and a line for each of its ids, in order."""
    heads = sections.select(F.struct("lo", F.lit(-1).cast("bigint").alias("id")).alias("place"), F.concat(F.lit("## "), "section", F.lit(" ("), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit(")")).alias("line"))
    rows = slots.join(F.broadcast(sections), F.col("id").between(F.col("lo"), F.col("hi")))
    return heads.unionByName(rows.select(F.struct("lo", "id").alias("place"), F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(": "), "piece").alias("line")))


def write_lines(rows: DataFrame, order: str, path: str) -> None:
    """The column line as text files, in order of their names and in them."""
    rows.orderBy(order).select("line").write.text(path)
