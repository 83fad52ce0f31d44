"""Conversation structure repair: the cheapest edits that give a conversation the role order `(s?(ua)+)?`.

Window functions flag each turn's faults (blank, repeated, truncated, a role that cannot follow). A conversation's turns are collected as sorted structs, and aggregate() folds them: it carries four structs of (cost, audit), the cheapest edits that end with nothing, a system turn, a user turn or an assistant turn, and takes native least() of what can lead to each. Audits of one cost and one end never begin one another (the longer one would have more inserts), so the least prefix always gives the least whole.

Conversations up to LONG turns and BYTES of text, which is all of an ordinary corpus, need one shuffle. Longer ones are sorted over all tasks and cut into chunks. A chunk folds from each of the four states, so it is a table of 4 x 4 structs, and a fold over a conversation's chunks joins these. Of a conversation, only its chunks' tables and its audit, a letter for each turn, meet in one row; its text is hashed as a stream of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Tables, release, small_batches

#: Turns and text bytes of a conversation that is repaired in one row; turns and text bytes of a chunk of a longer one.
LONG, BYTES, CHUNK, CHUNK_BYTES = 1000, 8 << 20, 256, 4 << 20
#: Costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The cost of what cannot be: more than any conversation's edits.
NEVER = 1 << 40
STATES = ("none", "s", "u", "a")
STATS = ("blank", "duplicate", "truncated", "illegal")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _best(cost, audit) -> Column:
    return F.struct((F.lit(cost) if isinstance(cost, int) else cost).cast("long").alias("cost"), (F.lit(audit) if isinstance(audit, str) else audit).alias("audit"))


def _plus(x: Column, cost, letter) -> Column:
    return _best(x["cost"] + cost, F.concat(x["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _state(*values: Column) -> Column:
    return F.struct(*(v.alias(name) for name, v in zip(STATES, values, strict=True)))


def _inserted(x: Column) -> Column:
    """State x with what inserts reach: a user turn from any other end, an assistant turn from a user turn."""
    with_user = lambda x: _state(x["none"], x["s"], F.least(x["u"], _plus(F.least(x["none"], x["s"], x["a"]), INSERT, "I")), x["a"])
    with_both = lambda x: _state(x["none"], x["s"], x["u"], F.least(x["a"], _plus(x["u"], INSERT, "I")))
    return _let(_let(x, with_user), with_both)


def _after(x: Column, turn: Column) -> Column:
    """State x after a turn: deleted, kept where its role fits, or given the role that fits."""
    may = turn["forced"] == 0
    weak = F.when(turn["weak"], TRUNCATED).otherwise(0)
    gone = lambda name: _plus(x[name], DELETE, "D")

    def role(value: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return _let(value, lambda v: F.when(may, _plus(v, weak + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R"))).otherwise(_best(NEVER, "")))

    system = F.when(may & (turn["initial"] == "s"), _plus(x["none"], weak, "K")).otherwise(_best(NEVER, ""))
    return _inserted(
        _state(
            gone("none"),
            F.least(gone("s"), system),
            F.least(gone("u"), role(F.least(x["none"], x["s"], x["a"]), "u")),
            F.least(gone("a"), role(x["u"], "a")),
        )
    )


def _start(name: str) -> Column:
    return _state(*(_best(0 if name == s else NEVER, "") for s in STATES))


def fold(turns: Column, start: Column) -> Column:
    """The state after an array of turns (initial, forced, weak)."""
    return F.aggregate(turns, start, _after)


def _joined(x: Column, chunk: Column) -> Column:
    """The state after a chunk, from state x before and the chunk's table."""
    to = lambda end: F.least(*(_best(x[s]["cost"] + chunk[s][end]["cost"], F.concat(x[s]["audit"], chunk[s][end]["audit"])) for s in STATES))
    return _state(*(to(end) for end in STATES))


def _end(state: Column) -> Column:
    """The cheapest of a state that a conversation may end with."""
    return F.least(state["none"], state["a"])


def pieces(audit: Column) -> Column:
    """An audit by turns: inserts go to the turn after them, those at the end to the last one."""
    return F.regexp_extract_all(audit, F.lit("I*[KRD](?:I+$)?"), F.lit(0))


def emitted(audit: Column) -> Column:
    """How many turns an audit leaves."""
    return F.length(F.replace(audit, F.lit("D"), F.lit("")))


def repaired(turns: Column, edits: Column, before: Column, total: Column) -> Column:
    """The repaired turns as structs of role and text. `before` of `total` turns of the conversation stand before these.

    The last turn of all is an assistant's, and roles that are not kept alternate, so a place tells its role.
    """
    role = lambda m: F.when((total - m) % 2 == 1, "assistant").otherwise("user")  # noqa: E731  m turns stand before
    empty = lambda m: F.struct(role(m).alias("role"), F.lit("").alias("text"))
    none = F.array().cast("array<struct<role:string,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["edit"], "^I*", 0))
        tail = F.length(x["edit"]) - lead - 1
        letter = F.substring(x["edit"], lead + 1, F.lit(1))
        m = acc["m"]
        inserts = lambda n, m: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: empty(m + i - 1))).otherwise(none)
        stays = F.when(letter == "D", 0).otherwise(1)
        own = F.when(letter == "D", none).otherwise(F.array(F.struct(F.when(letter == "K", x["turn"]["role"]).otherwise(role(m + lead)).alias("role"), x["turn"]["text"].alias("text"))))
        return F.struct((m + F.length(x["edit"]) - 1 + stays).cast("long").alias("m"), F.concat(acc["out"], inserts(lead, m), own, inserts(tail, m + lead + stays)).alias("out"))

    zipped = F.arrays_zip(turns.alias("turn"), edits.alias("edit"))
    return F.aggregate(zipped, F.struct(before.cast("long").alias("m"), none.alias("out")), step)["out"]


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def keyed(turns: DataFrame) -> DataFrame:
    """_c (the id as text, one space for a null), conv_id, turn, role and text (one space for a null); _gone is false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_c"), "conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(False).alias("_gone"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of keyed() with damage by a checksum of `conv_id:turn`: of 20 rows one is dropped (_gone), one emptied, one loses its sentence ends, one is there twice, and one becomes the user's."""
    draw = F.pmod(F.crc32(F.concat("_c", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    rows = turns.withColumn("_h", draw)
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("_c", "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_h") == 0).alias("_gone"), F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _flags(rows: DataFrame, repeats: Column, role_before: Column, turn_before: Column) -> DataFrame:
    """rows with initial, fault (1 blank, 2 repeated, 3 truncated, 0 none), _illegal and _new (a turn number not seen before)."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    rows = rows.select("*", F.substring("role", 1, 1).alias("initial"), F.substring(role_before, 1, 1).alias("_before"), turn_before.alias("_turn_before"), repeats.alias("_repeats"), last.alias("_last"))
    fault = F.when(F.col("_last") == "", 1).when(F.col("_repeats"), 2).when(~F.col("_last").isin(".", "!", "?"), 3).otherwise(0)
    illegal = F.col("_before").isNotNull() & ~F.concat("_before", "initial").isin("su", "ua", "au")
    new = F.col("turn").isNotNull() & (F.col("_turn_before").isNull() | (F.col("_turn_before") != F.col("turn")))
    return rows.select("*", fault.alias("fault"), illegal.alias("_illegal"), new.alias("_new"))


def _turn(with_text: bool = True) -> Column:
    own = [F.col("_at"), F.col("initial"), F.when(F.col("fault").isin(1, 2), 1).otherwise(0).alias("forced"), (F.col("fault") == 3).alias("weak")]
    return F.struct(*own, *(["role", "text"] if with_text else []))


def _sums(there: Column) -> list[Column]:
    count = lambda when: F.count_if(there & when).cast("long")
    faults = [count(F.col("fault") == i + 1).alias(name) for i, name in enumerate(STATS[:3])]
    own = F.when(there, F.col("turn"))
    return [*faults, count(F.col("_illegal")).alias("illegal"), F.min(own).alias("_lo"), F.max(own).alias("_hi"), count(F.col("_new")).alias("_turns")]


def _gaps() -> Column:
    return F.coalesce(F.try_subtract(F.try_add(F.try_subtract("_hi", "_lo"), F.lit(1).cast("long")), F.col("_turns")), F.lit(0)).cast("long").alias("gaps")


def _short(rows: DataFrame) -> DataFrame:
    """A row for each conversation that fits a row: `turns` repaired."""
    order = Window.partitionBy("_c", "_gone").orderBy("turn", "role", "text")
    again = Window.partitionBy("_c", "_gone", "role", "text").orderBy("_at")
    # Dealt by the conversation alone, for the windows and the collection.
    rows = rows.repartition("_c").withColumn("_at", F.row_number().over(order))
    rows = _flags(rows, F.row_number().over(again) > 1, F.lag("role").over(order), F.lag("turn").over(order))
    there = ~F.col("_gone")
    whole = rows.groupBy("_c").agg(F.min("conv_id").alias("conv_id"), *_sums(there), F.sort_array(F.collect_list(F.when(there, _turn()))).alias("_t"))
    # The start has its inserts; explode() of one value keeps the fold from being written out again at each use.
    whole = whole.select("*", F.explode(F.array(_end(fold(F.col("_t"), _inserted(_start("none")))))).alias("_x"))
    audit = F.col("_x.audit")
    out = repaired(F.col("_t"), pieces(audit), F.lit(0), emitted(audit))
    return whole.select("conv_id", _gaps(), *STATS, F.col("_x.cost").alias("cost"), audit.alias("audit"), out.alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's chunks, which arrive in order; one chunk is held at a time."""
    name, state, lines = None, None, False
    done: tuple[list, list] = ([], [])
    for batch in batches:
        for c, text, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if c != name:
                if name is not None:
                    done[0].append(name)
                    done[1].append(state.hexdigest())
                name, state, lines = c, hashlib.sha256(), False
            if n:
                if lines:
                    state.update(b"\n")
                state.update(text.as_buffer() if len(text.as_buffer() or b"") else b"")
                lines = True
        release()
    if name is not None:
        done[0].append(name)
        done[1].append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], ["_c", "sha"])


class _Long:
    """Conversations that are cut into chunks."""

    def __init__(self, rows: DataFrame, tables: Tables, chunk: int, chunk_bytes: int):
        spark = tables.spark
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("_key")
        alive = rows.filter(~F.col("_gone")).repartitionByRange(parts, "_c", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("_c", "turn", "role", "text")
        # Numbers of sorted rows rise over the parts, too.
        rows = tables.put(alive.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), key), "long_rows")
        first = rows.groupBy("_c", "_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("_c").alias("_d"), F.col("_key").alias("_k"), "_first")
        rows = rows.join(first, (F.col("_c") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
        inside = Window.partitionBy("_c", "_part").orderBy("_at")
        size = F.sum(F.octet_length("text").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        cut = F.struct(F.floor((F.row_number().over(inside) - 1) / chunk).alias("a"), F.floor(F.coalesce(size, F.lit(0)) / chunk_bytes).alias("b"))
        rows = _flags(rows, F.coalesce(F.col("_at") > F.col("_first"), F.lit(False)), F.lag("role").over(inside), F.lag("turn").over(inside)).select("*", cut.alias("_chunk"))
        ends = lambda f: [f(c, "_at").alias(f"_{c}_{f.__name__}") for c in ("initial", "turn", "_part")]
        turns = F.sort_array(F.collect_list(_turn())).alias("_t")
        chunks = rows.groupBy("_c", "_part", "_chunk").agg(F.min("_at").alias("_at"), F.count("*").alias("_n"), turns, *_sums(F.lit(True)), *ends(F.min_by), *ends(F.max_by))
        self.tables, self.chunks = tables, tables.put(chunks, "long_chunks")
        state = F.col("_t").cast("array<struct<_at:bigint,initial:string,forced:int,weak:boolean,role:string,text:string>>")
        tabled = self.chunks.drop("_t", "_part", "_chunk").join(self.chunks.select(F.col("_at").alias("_id"), _state(*(fold(state, _start(s)) for s in STATES)).alias("_m")), F.col("_at") == F.col("_id")).drop("_id")
        self.whole = tables.put(self._joined(tabled), "long_whole")

    def _joined(self, chunks: DataFrame) -> DataFrame:
        """_c, the sums, cost, audit and `_parts` (_at and n of the chunks, in order) of each conversation."""
        columns = [c for c in chunks.columns if c not in ("_c", "_at")]
        rows = chunks.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_at", *columns))).alias("_k"))
        n = F.size("_k")
        # What windows cannot see lies between parts of the range sort.
        between = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.get("_k", i - 1).alias("x"), F.get("_k", i).alias("y")))).otherwise(F.array())
        between = F.filter(between, lambda p: p["x"]["__part_max_by"] != p["y"]["__part_min_by"])
        illegal = F.size(F.filter(between, lambda p: ~F.concat(p["x"]["_initial_max_by"], p["y"]["_initial_min_by"]).isin("su", "ua", "au")))
        same = F.size(F.filter(between, lambda p: p["x"]["_turn_max_by"] == p["y"]["_turn_min_by"]))
        total = lambda c: F.aggregate("_k", F.lit(0).cast("long"), lambda s, k: s + k[c])
        last = _end(F.aggregate("_k", _inserted(_start("none")), lambda x, k: _joined(x, k["_m"])))
        rows = rows.select("_c", "_k", *(total(c).alias(c) for c in STATS[:3]), (total("illegal") + illegal).alias("illegal"), (total("_turns") - same).alias("_turns"), F.array_min(F.col("_k._lo")).alias("_lo"), F.array_max(F.col("_k._hi")).alias("_hi"), F.explode(F.array(last)).alias("_x"))
        return rows.select("_c", *STATS, "_turns", "_lo", "_hi", "_x", F.transform("_k", lambda k: F.struct(k["_at"].alias("_at"), k["_n"].cast("int").alias("_n"))).alias("_parts"))

    def turns(self) -> DataFrame:
        """_c, _at and `turns` (repaired) of each chunk."""
        places = self.whole.select("_c", pieces(F.col("_x.audit")).alias("_e"), emitted(F.col("_x.audit")).alias("_total"), "_parts")
        upto = F.aggregate("_parts", F.array(F.lit(0)), lambda s, p: F.array_append(s, F.element_at(s, -1) + p["_n"]))
        places = places.select("_c", "_e", "_total", "_parts", F.explode(F.array(upto)).alias("_upto"))
        cut = F.transform("_parts", lambda p, i: F.struct(p["_at"].alias("_p"), F.slice("_e", F.get("_upto", i) + 1, p["_n"]).alias("_edits")))
        parts = places.select("_c", "_total", F.inline(cut)).withColumn("_left", emitted(F.array_join("_edits", "")))
        before = F.sum("_left").over(Window.partitionBy("_c").orderBy("_p")) - F.col("_left")
        parts = parts.select("_p", "_edits", "_total", before.alias("_before"))
        both = self.chunks.select("_c", "_at", "_t").join(parts, F.col("_at") == F.col("_p"))
        return both.select("_c", "_at", repaired(F.col("_t"), F.col("_edits"), F.col("_before"), F.col("_total")).alias("turns"))

    def rows(self) -> DataFrame:
        """_c, the sums, cost, audit and repaired_sha256."""
        with small_batches(self.tables.spark):
            text = self.turns().select("_c", "_at", text_of(F.col("turns")).alias("_s"), F.size("turns").alias("_n"))
            text = self.tables.put(text, "long_texts").repartition("_c").sortWithinPartitions("_c", "_at").select("_c", "_s", "_n")
            shas = self.tables.put(text.mapInArrow(_streamed, "_c string, sha string"), "long_hashes").select(F.col("_c").alias("_d"), "sha")
        both = self.whole.join(shas, F.col("_c") == F.col("_d"))
        return both.select("_c", _gaps(), *STATS, F.col("_x.cost").alias("cost"), F.col("_x.audit").alias("audit"), F.col("sha").alias("repaired_sha256"))


@dataclass
class Repair:
    """The repaired conversations of a table of keyed() rows.

    Nulls are one space in role and text and an id of their own in conv_id; null turns come first. Rows of one turn stand by role, then text; rows that are equal are repeats of the first. Very long texts and conversations are cut into chunks. A conversation without rows (all _gone) has zeros, an empty audit and no turns. An empty table gives no rows. Extra columns play no part.
    """

    rows: DataFrame
    tables: Tables
    long: int = LONG
    long_bytes: int = BYTES
    chunk: int = CHUNK
    chunk_bytes: int = CHUNK_BYTES

    def __post_init__(self) -> None:
        sizes = self.rows.groupBy("_c").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text").cast("long")).alias("_b"), F.min("conv_id").alias("_conv"))
        self.sizes = self.tables.put(sizes.filter((F.col("_n") > self.long) | (F.col("_b") > self.long_bytes)).select("_c", "_conv"), "long_ids")
        self.any_long = bool(self.sizes.limit(1).count())
        self.short = _short(self.rows.join(self.sizes, "_c", "left_anti") if self.any_long else self.rows)
        self.cut = _Long(self.rows.join(self.sizes.select("_c"), "_c", "left_semi"), self.tables, self.chunk, self.chunk_bytes) if self.any_long else None

    def conversations(self) -> DataFrame:
        """conv_id, gaps, the counts of faults, cost, audit and repaired_sha256 of each conversation."""
        short = self.short.select("conv_id", "gaps", *STATS, "cost", "audit", F.sha2(text_of(F.col("turns")), 256).alias("repaired_sha256"))
        if self.cut is None:
            return short
        names = self.sizes.select(F.col("_c").alias("_d"), F.col("_conv").alias("conv_id"))
        long = names.join(self.cut.rows(), F.col("_d") == F.col("_c"), "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *STATS, "cost")]
        return short.unionByName(long.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))

    def turns(self) -> DataFrame:
        """conv_id, part, place, role and text: the repaired turns in order of part and place."""
        rows = self.short.select("conv_id", F.lit(0).cast("long").alias("part"), "turns")
        if self.cut is not None:
            names = self.sizes.select(F.col("_c").alias("_d"), F.col("_conv").alias("conv_id"))
            rows = rows.unionByName(self.cut.turns().join(names, F.col("_c") == F.col("_d")).select("conv_id", F.col("_at").alias("part"), "turns"))
        return rows.select("conv_id", "part", F.posexplode("turns").alias("place", "_x")).select("conv_id", "part", "place", "_x.role", "_x.text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Repair(damaged(keyed(turns)), Tables(spark)).conversations()


OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tbl
), k AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
), h AS MATERIALIZED (
  SELECT k.c, conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM k CROSS JOIN c
), d AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE h <> 0
), o AS MATERIALIZED (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), t AS MATERIALIZED (
  SELECT c, turn, role, text, left(role, 1) AS r, i, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
    right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) AS last, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again
  FROM o
), e AS MATERIALIZED (
  SELECT *, last = '' AS blank, last <> '' AND again AS dup, last NOT IN ('', '.', '!', '?') AND NOT again AS weak, CASE WHEN last NOT IN ('', '.', '!', '?') AND NOT again THEN 1 ELSE 0 END AS extra, last = '' OR again AS forced FROM t
), f AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM e
  UNION ALL
  SELECT c, i, n, s, u, least(a, concat(lpad(CAST(CAST(left(u, 9) AS BIGINT) + 2 AS VARCHAR), 9, '0'), u[10:], 'I')) FROM (
    SELECT c, i, n, s, a, least(u, concat(lpad(CAST(CAST(left(least(n, s, a), 9) AS BIGINT) + 2 AS VARCHAR), 9, '0'), least(n, s, a)[10:], 'I')) AS u FROM (
      SELECT c, i,
        concat(lpad(CAST(CAST(left(n, 9) AS BIGINT) + 3 AS VARCHAR), 9, '0'), n[10:], 'D') AS n,
        least(CASE WHEN s IS NOT NULL THEN concat(lpad(CAST(CAST(left(s, 9) AS BIGINT) + 3 AS VARCHAR), 9, '0'), s[10:], 'D') END,
          CASE WHEN NOT forced AND r = 's' THEN concat(lpad(CAST(CAST(left(n, 9) AS BIGINT) + extra AS VARCHAR), 9, '0'), n[10:], 'K') END) AS s,
        least(concat(lpad(CAST(CAST(left(u, 9) AS BIGINT) + 3 AS VARCHAR), 9, '0'), u[10:], 'D'),
          CASE WHEN NOT forced THEN concat(lpad(CAST(CAST(left(m, 9) AS BIGINT) + extra + CASE WHEN r = 'u' THEN 0 ELSE 2 END AS VARCHAR), 9, '0'), m[10:], CASE WHEN r = 'u' THEN 'K' ELSE 'R' END) END) AS u,
        least(concat(lpad(CAST(CAST(left(a, 9) AS BIGINT) + 3 AS VARCHAR), 9, '0'), a[10:], 'D'),
          CASE WHEN NOT forced THEN concat(lpad(CAST(CAST(left(u, 9) AS BIGINT) + extra + CASE WHEN r = 'a' THEN 0 ELSE 2 END AS VARCHAR), 9, '0'), u[10:], CASE WHEN r = 'a' THEN 'K' ELSE 'R' END) END) AS a
      FROM (SELECT f.c, e.i, f.n, f.s, f.u, f.a, least(f.n, f.s, f.a) AS m, e.r, e.forced, e.extra FROM f JOIN e ON e.c = f.c AND e.i = f.i + 1)
    )
  )
), best AS MATERIALIZED (SELECT c, least(n, a) AS b FROM (SELECT c, n, a, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS last FROM f) WHERE last = 1),
letters AS (SELECT c, b[10:] AS audit, unnest(string_split(b[10:], '')) AS l, generate_subscripts(string_split(b[10:], ''), 1) AS p FROM best WHERE length(b) > 9),
placed AS (
  SELECT c, l, p, count(*) FILTER (WHERE l <> 'I') OVER w AS i, count(*) FILTER (WHERE l <> 'D') OVER w AS m, count(*) FILTER (WHERE l <> 'D') OVER (PARTITION BY c) AS total
  FROM letters WINDOW w AS (PARTITION BY c ORDER BY p)
), text AS (
  SELECT placed.c, string_agg(concat(CASE WHEN l = 'K' THEN e.role WHEN (total - m) % 2 = 0 THEN 'assistant' ELSE 'user' END, ':', CASE WHEN l = 'I' THEN '' ELSE e.text END), chr(10) ORDER BY p) AS s
  FROM placed LEFT JOIN e ON e.c = placed.c AND e.i = placed.i WHERE l <> 'D' GROUP BY placed.c
), stats AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE weak) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND concat(before, r) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY c
)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(b, 9), '0') AS BIGINT) AS cost, coalesce(b[10:], '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM h) z LEFT JOIN stats ON stats.c = z.c LEFT JOIN best ON best.c = z.c LEFT JOIN text ON text.c = z.c
"""
