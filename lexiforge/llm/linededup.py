"""Line dedup by a log-template tree.

A line descends a tree of fixed depth: its token count, then its first tokens, in which a token with a digit is a wildcard. Its own template at the leaf has wildcards for all such tokens. Templates of a leaf that share a whole segment of their other tokens form a group; a leaf has as many groups as its lines have such segments. There is one segment more than tokens may differ, so two templates that are similar enough share one; lines of 27 tokens and more have eight segments, so that a line of any length costs in proportion to it, and similar ones of these are missed if they differ in all eight. A group votes on each position, by documents (one with several of its lines is one document): the token of more than half of them is a constant, any other a wildcard. A line whose tokens agree with enough of a group's constants belongs to the group's template. A template in enough documents recurs, be it a line's own or a group's; its lines are dropped everywhere but in the first document that has it, so one copy of any content stays.

All steps are associative aggregations and joins; no task gathers a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, column_without_clash

#: Leading tokens in the tree; documents in which a template recurs; tokens of a line that can be generalised; per cent of a line's tokens that must agree with a group's constants.
DEPTH, MIN_DOCS, MIN_TOKENS, CONSTANT = 3, 3, 4, 70
#: Segments of a line at most.
SEGMENTS = 8
#: Dropped lines, recurring templates, leaves or lines to read up to which that side is broadcast (100 bytes each at most); beyond, the same join shuffles.
BROADCAST_ROWS = 400_000
WILD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens joined by one space, those with a digit as wildcards. Most lines need neither, and a search is cheaper than a replacement."""
    loose = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\x0b\x0c\r":
        loose = loose | F.contains(line, F.lit(c))
    tight = F.when(loose, F.regexp_replace(F.regexp_replace(line, r"[ \t-\r]+", " "), r"^ | $", "")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(tight, r"[^ ]*[0-9][^ ]*", WILD)).otherwise(tight)


def _lines(docs: DataFrame) -> DataFrame:
    """_doc, _row (a hash of the text, for rows that share an id), _no, _k (tokens of the template), _leaf (a hash of count and leading tokens), _a and _b (the template as two hashes, 128 bits), for lines with enough tokens or a letter."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_row"), F.posexplode(F.split("text", "\n")).alias("_no", "_line"))
    # explode() of one value: a filter on the template is then not pushed below the patterns, which would run again.
    rows = rows.select("_doc", "_row", "_no", F.explode(F.array(masked(F.col("_line")))).alias("_t"))
    rows = rows.withColumn("_k", F.length("_t") - F.length(F.replace("_t", F.lit(" "), F.lit(""))) + 1)
    rows = rows.filter((F.col("_k") >= MIN_TOKENS) | F.col("_t").rlike(r"\p{L}"))
    return rows.select("_doc", "_row", "_no", "_k", F.xxhash64("_k", F.substring_index("_t", " ", DEPTH)).alias("_leaf"), F.xxhash64("_t").alias("_a"), F.xxhash64(F.lit(1), "_t").alias("_b"))


def _side(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows, or few entries in all of its arrays."""
    n = df.agg(F.sum(F.lit(1) if entries is None else entries).alias("n")).first()["n"]
    return F.broadcast(df) if (n or 0) <= BROADCAST_ROWS else df


def _segments(words: Column, k: Column) -> Column:
    """A line's segments behind its leading tokens: one more than tokens may differ, or a single empty one if all of these may."""
    m, differ = k - DEPTH, F.least(F.floor(k * (100 - CONSTANT) / 100), F.lit(SEGMENTS - 1)).cast("int")
    start = lambda s: F.floor((s * m + differ) / (differ + 1)).cast("int")  # noqa: E731  s * m / (differ + 1), rounded up
    cut = F.transform(F.sequence(F.lit(0), differ), lambda s: F.concat_ws(" ", s.cast("string"), F.slice(words, start(s) + DEPTH + 1, start(s + 1) - start(s))))
    return F.when(m > differ, cut).otherwise(F.array(F.lit("")))


def _texts(docs: DataFrame, templates: DataFrame, tables: Tables) -> DataFrame:
    """The templates with _w, their tokens, read from one line of each."""
    at = templates.groupBy(F.col("_at._doc").alias("_d"), F.col("_at._row").alias("_r")).agg(F.collect_list(F.struct(F.col("_at._no").alias("_no"), "_k", "_leaf", "_a", "_b", "_docs", "_first")).alias("_want"))
    at = tables.put(at, "wanted")
    rows = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_row"), F.col("text").alias("_text"))
    # Rows that repeat an id and text give a template's tokens once each.
    rows = rows.join(_side(at, F.size("_want")), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))).select(F.split("_text", "\n").alias("_all"), F.explode("_want").alias("_x"))
    rows = rows.select("_x.*", F.explode(F.array(F.get("_all", F.col("_x._no")))).alias("_line"))
    return rows.select("_k", "_leaf", "_a", "_b", "_docs", "_first", F.split(masked(F.col("_line")), " ").alias("_w")).dropDuplicates(["_a", "_b"])


def recurring(docs: DataFrame, lines: DataFrame, tables: Tables) -> DataFrame:
    """_a, _b and _first of each template whose lines are dropped: those that recur as they are, and those that a group's template takes."""
    by_doc = lines.groupBy("_k", "_leaf", "_a", "_b", "_doc").agg(F.min(F.struct("_row", "_no")).alias("_in"))
    at = F.struct("_doc", F.col("_in._row").alias("_row"), F.col("_in._no").alias("_no"))
    templates = tables.put(by_doc.groupBy("_k", "_leaf", "_a", "_b").agg(F.count("*").alias("_docs"), F.min("_doc").alias("_first"), F.min(at).alias("_at")), "templates")
    own = templates.filter(F.col("_docs") >= MIN_DOCS).select("_a", "_b", "_first")
    long = templates.filter(F.col("_k") >= MIN_TOKENS)
    # Only leaves with several templates, in enough documents, can have a group whose template recurs.
    leaves = tables.put(long.groupBy("_k", "_leaf").agg(F.sum("_docs").alias("_n"), F.count("*").alias("_kinds")).filter((F.col("_n") >= MIN_DOCS) & (F.col("_kinds") > 1)).select("_k", "_leaf"), "leaves")
    texts = _texts(docs, long.join(_side(leaves), ["_k", "_leaf"], "left_semi"), tables)
    keyed = texts.select("*", F.explode(_segments(F.col("_w"), F.col("_k"))).alias("_s")).select("_k", "_a", "_b", "_docs", "_first", "_w", F.xxhash64("_leaf", "_s").alias("_key"))
    keyed = tables.put(keyed, "keyed")
    # A group of few documents at most is none; sums count a document once for each of its templates, so they are bounds.
    groups = keyed.groupBy("_key").agg(F.sum("_docs").alias("_most"), F.count("*").alias("_kinds")).filter((F.col("_most") >= MIN_DOCS) & (F.col("_kinds") > 1)).select("_key", "_most")
    members = tables.put(keyed.join(groups, "_key"), "members")
    twice = _several(lines, members, tables)
    more = twice.groupBy(F.col("_key").alias("_k2")).agg(F.sum(F.size("_ts") - 1).alias("_more"))
    votes = _votes(members, twice)
    sizes = members.select("_key", "_most").distinct().join(more, F.col("_key") == F.col("_k2"), "left").select("_key", (F.col("_most") - F.coalesce("_more", F.lit(0))).alias("_n"))
    sizes = sizes.filter(F.col("_n") >= MIN_DOCS).select(F.col("_key").alias("_k2"), "_n")
    # Documents with several templates may give two tokens of one place more than half of them: the more frequent one counts, or the greater.
    most = votes.join(sizes, F.col("_key") == F.col("_k2")).filter((F.col("_v") * 2 > F.col("_n")) & (F.col("_word") != WILD)).groupBy("_key", "_p").agg(F.max(F.struct("_v", "_word"))["_word"].alias("_c"))
    shapes = most.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_c"))).alias("_shape"))
    agree = F.size(F.filter(F.transform("_w", lambda w, i: w == F.try_element_at("_shape", i)), lambda same: same))
    taken = members.join(shapes, "_key").filter(agree * 100 >= F.col("_k") * CONSTANT).select("_key", "_a", "_b", "_docs", "_first")
    taken = tables.put(taken, "taken")
    again = twice.select("_key", "_doc", F.explode("_ts").alias("_x")).select("_key", "_doc", "_x._a", "_x._b").join(taken.select("_key", "_a", "_b"), ["_key", "_a", "_b"], "left_semi")
    again = again.groupBy("_key", "_doc").agg((F.count("*") - 1).alias("_again")).groupBy(F.col("_key").alias("_k2")).agg(F.sum("_again").alias("_again"))
    enough = taken.groupBy("_key").agg(F.sum("_docs").alias("_all"), F.min("_first").alias("_group_first")).join(again, F.col("_key") == F.col("_k2"), "left")
    enough = enough.filter(F.col("_all") - F.coalesce("_again", F.lit(0)) >= MIN_DOCS).select("_key", "_group_first")
    wide = taken.join(enough, "_key").select("_a", "_b", F.col("_group_first").alias("_first"))
    # A template that recurs as it is keeps the line of its own first document; of several groups, the earliest counts.
    return tables.put(wide.groupBy("_a", "_b").agg(F.min("_first").alias("_first")).join(own, ["_a", "_b"], "left_anti").unionByName(own), "recurring")


def _several(lines: DataFrame, members: DataFrame, tables: Tables) -> DataFrame:
    """_key, _doc and _ts (_a and _b of its templates) of each document that has several templates of a group; its own length bounds them. A null id is a document."""
    wanted = tables.put(members.select("_a", "_b").distinct(), "member_templates")
    holders = lines.select("_a", "_b", "_doc").join(_side(wanted), ["_a", "_b"], "left_semi").distinct()
    pairs = members.select("_key", "_a", "_b").join(tables.put(holders, "holders"), ["_a", "_b"])
    # Most have one template: they are counted before any are collected.
    counts = pairs.groupBy("_key", "_doc").agg(F.count("*").alias("_n"), F.collect_list(F.struct("_a", "_b")).alias("_ts"))
    return tables.put(counts.filter("_n > 1").select("_key", "_doc", "_ts"), "twice")


def _votes(members: DataFrame, twice: DataFrame) -> DataFrame:
    """_key, _p, _word and _v: how many documents of a group have that token at that place. Documents with one template of the group are counted by template, the others by themselves."""
    each = twice.select("_key", "_doc", F.explode("_ts").alias("_x")).select("_key", "_doc", "_x._a", "_x._b")
    less = each.groupBy("_key", "_a", "_b").agg(F.count("*").alias("_less"))
    single = members.join(less, ["_key", "_a", "_b"], "left").select("_key", "_w", (F.col("_docs") - F.coalesce("_less", F.lit(0))).alias("_v")).filter("_v > 0")
    words = each.join(members.select("_key", "_a", "_b", "_w"), ["_key", "_a", "_b"]).select("_key", "_doc", F.posexplode("_w").alias("_p", "_word")).distinct()
    both = single.select("_key", F.posexplode("_w").alias("_p", "_word"), "_v").unionByName(words.select("_key", "_p", "_word", F.lit(1).cast("long").alias("_v")))
    return both.groupBy("_key", "_p", "_word").agg(F.sum("_v").alias("_v"))


def dropped_lines(docs: DataFrame, tables: Tables) -> DataFrame:
    """_doc, _row and _drop, the sorted numbers (from 0) of lines to drop, for each document with any."""
    lines = tables.put(_lines(docs), "lines")
    found = _side(recurring(docs, lines, tables))
    hits = lines.select("_doc", "_row", "_no", "_a", "_b").join(found, ["_a", "_b"]).filter(~F.col("_doc").eqNullSafe(F.col("_first")))
    return hits.groupBy("_doc", "_row").agg(F.array_sort(F.collect_set("_no")).alias("_drop"))


def count_columns(docs: DataFrame) -> tuple[str, str]:
    """The names that the numbers of lines and of dropped lines have: n_lines and n_dropped, with underscores before where docs has such columns."""
    return column_without_clash(docs, "n_lines"), column_without_clash(docs, "n_dropped")


def dedup_lines(docs: DataFrame, tables: Tables) -> DataFrame:
    """The documents with recurring lines dropped: all columns, then the numbers of lines and of dropped lines (see count_columns); n_chars follows the text if there is such a column.

    A null text stays null with 0 lines; an empty text is one empty line. Lines of fewer than MIN_TOKENS tokens take part with their own template only, and only if it has a letter. Rows of one id and text are one document; a null id is an id of its own, which is never first. A document that loses every line has an empty text. An empty table gives no rows.
    """
    drops = tables.put(dropped_lines(docs.select("doc_id", "text"), tables), "dropped")
    rows = docs.select(F.struct("*").alias("_in"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    rows = rows.join(_side(drops, F.size("_drop")), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left")
    before, lines = F.col("_in.text"), F.split("_in.text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drop"), i))
    text = F.when(F.col("_drop").isNull(), before).otherwise(F.array_join(kept, "\n"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    out = [new.get(c, F.col("_in").getField(c)).alias(c) for c in docs.columns]
    n_lines, n_dropped = count_columns(docs)
    return rows.select(*out, F.when(before.isNull(), 0).otherwise(F.size(lines)).alias(n_lines), F.greatest(F.coalesce(F.size("_drop"), F.lit(0)), F.lit(0)).alias(n_dropped))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), m AS (
  SELECT doc_id, no, line, regexp_replace(regexp_replace(regexp_replace(line, '[ \t-\r]+', ' ', 'g'), '^ | $', '', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS t FROM l
), x AS (
  SELECT doc_id, no, line, t, len(string_split(t, ' ')) AS k, array_to_string(string_split(t, ' ')[1:3], ' ') AS lead FROM m
), tpl AS MATERIALIZED (
  SELECT k, lead, t, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM x WHERE k >= 4 OR regexp_matches(t, '\p{L}') GROUP BY k, lead, t
), leaf AS (
  SELECT k, lead FROM tpl WHERE k >= 4 GROUP BY k, lead HAVING sum(docs) >= 3 AND count(*) > 1
), cand AS (
  SELECT k, lead, t, docs, first, string_split(t, ' ') AS w, k - 3 AS m, least(k * 30 // 100, 7) AS d FROM tpl JOIN leaf USING (k, lead)
), seg AS (
  SELECT k, lead, t, docs, first, w, m, d, unnest(range(0, CASE WHEN m > d THEN d + 1 ELSE 1 END)) AS s FROM cand
), keyed AS MATERIALIZED (
  SELECT k, lead, t, docs, first, w, s, CASE WHEN m > d THEN array_to_string(w[4 + (s * m + d) // (d + 1):3 + ((s + 1) * m + d) // (d + 1)], ' ') ELSE '' END AS part FROM seg
), many AS (SELECT k, lead, s, part FROM keyed GROUP BY k, lead, s, part HAVING sum(docs) >= 3 AND count(*) > 1),
held AS MATERIALIZED (
  SELECT DISTINCT keyed.k, keyed.lead, s, part, keyed.t, w, first, doc_id FROM keyed JOIN many USING (k, lead, s, part) JOIN (SELECT DISTINCT t, doc_id FROM x) h ON h.t = keyed.t
), grp AS (
  SELECT k, lead, s, part, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS n FROM held GROUP BY k, lead, s, part HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3
), word AS MATERIALIZED (
  SELECT k, lead, s, part, n, t, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM held JOIN grp USING (k, lead, s, part)
), vote AS (
  SELECT k, lead, s, part, p, word, n, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS v FROM word WHERE word <> '<*>' GROUP BY k, lead, s, part, p, word, n
), const AS (
  SELECT k, lead, s, part, p, max({'v': v, 'word': word}).word AS word FROM vote WHERE 2 * v > n GROUP BY k, lead, s, part, p
), fits AS MATERIALIZED (
  SELECT k, lead, s, part, t FROM (SELECT DISTINCT k, lead, s, part, t, p, word FROM word) JOIN const USING (k, lead, s, part, p, word) GROUP BY k, lead, s, part, t HAVING count(*) * 100 >= k * 70
), taken AS MATERIALIZED (SELECT held.* FROM held JOIN fits USING (k, lead, s, part, t)),
enough AS (SELECT k, lead, s, part, min(first) AS group_first FROM taken GROUP BY k, lead, s, part HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
wide AS (SELECT t, min(group_first) AS first FROM taken JOIN enough USING (k, lead, s, part) GROUP BY t),
rec AS (
  SELECT t, first FROM tpl WHERE docs >= 3
  UNION ALL SELECT wide.t, wide.first FROM wide WHERE t NOT IN (SELECT t FROM tpl WHERE docs >= 3)
), y AS (SELECT x.*, rec.t IS NOT NULL AND x.doc_id <> rec.first AS gone FROM x LEFT JOIN rec USING (t))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped,
  md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM y GROUP BY doc_id
"""
