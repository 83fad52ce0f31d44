"""Queries on documents and pages: gates, cleaning, dedup, budgets, shards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import lang
from ..functions import text as T
from ..operators import order as O
from ..sources.pull import pulled
from . import sqltext as Q
from .base import c, docs, q, quoted, table

RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
ES = f"CAST(len(list_filter({RUNS}, lambda x: x IN ({quoted(lang.FOREIGN_MARKERS)}))) AS BIGINT)"
OWN = f"CAST(len(list_filter({RUNS}, lambda x: lower(x) IN ({quoted(lang.OWN_MARKERS)}))) AS BIGINT)"
LIKELY = f"NOT ({ES} > 5 AND {OWN} = 0)"
STRICT = f"({LIKELY} AND coalesce({ES} / nullif(len({RUNS}), 0), 0.0) <= 0.15)"
JUNK = r"NOT regexp_matches(text, '[\p{L}\p{N}]')"
NWORDS = r"CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT)"
TOKENS = "greatest(1, CAST(floor(length(text) / 4) AS BIGINT))"
TIDY = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"



def runs(s, d):
    """The documents with the word runs of each text, which all gates look at."""
    return T.once(docs(s, d), "runs", T.word_runs(F.col("text")))


q(
    "token_stats",
    lambda s, d: docs(s, d).groupBy("source").agg(c(F.count("*"), "n_rows"), c(F.sum(T.estimate_tokens(F.col("text"))), "tokens"), F.count_if(F.length("text") < lang.MIN_CHARS).alias("short")),
    f"SELECT source, count(*) AS n_rows, CAST(sum({TOKENS}) AS BIGINT) AS tokens, count(*) FILTER (WHERE length(text) < 100) AS short FROM documents GROUP BY source",
)
q(
    "source_subset",
    lambda s, d: docs(s, d).filter(F.exists(F.array(F.lit("src1"), F.lit("src7")), lambda w: F.col("source").contains(w)) & ~F.col("source").isin("src12", "src13")).select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE (contains(source, 'src1') OR contains(source, 'src7')) AND source NOT IN ('src12', 'src13')",
)
q(
    "missing_sources",
    lambda s, d: s.createDataFrame([("src0",), ("src99",), ("none",)], "source string").join(docs(s, d).select("source").distinct(), "source", "left_anti"),
    "SELECT * FROM (VALUES ('src0'), ('src99'), ('none')) t(source) WHERE source NOT IN (SELECT source FROM documents)",
)
q(
    "union_sources",
    lambda s, d: docs(s, d).select("text", F.lit("documents").alias("kind")).unionByName(table(s, d, "conversations").select("text", F.lit("conversations").alias("kind"))).groupBy("kind").agg(c(F.count("*"), "n_rows"), c(F.sum(F.length("text")), "chars")),
    "SELECT kind, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, 'documents' AS kind FROM documents UNION ALL SELECT text, 'conversations' FROM conversations) t GROUP BY kind",
)
q(
    "min_len",
    lambda s, d: docs(s, d).select("doc_id", T.tidy(F.col("text")).alias("t")).filter(F.length("t") >= lang.MIN_CHARS).select("doc_id", c(F.length("t"), "n")),
    f"SELECT doc_id, length({TIDY.format('text')}) AS n FROM documents WHERE length({TIDY.format('text')}) >= 100",
)
q(
    "non_empty_lines",
    lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "").groupBy("doc_id").agg(c(F.count("*"), "lines"), c(F.max("line_no"), "last")),
    "SELECT doc_id, count(*) AS lines, CAST(max(n) - 1 AS BIGINT) AS last FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) t WHERE trim(line) <> '' GROUP BY doc_id",
)
q(
    "lang_soft",
    lambda s, d: runs(s, d).filter(T.likely_own(F.col("text"), runs=F.col("runs"))).select("doc_id", T.foreign_hits(F.col("text"), runs=F.col("runs")).alias("foreign_hits"), T.own_hits(F.col("text"), runs=F.col("runs")).alias("own_hits")),
    f"SELECT doc_id, {ES} AS foreign_hits, {OWN} AS own_hits FROM documents WHERE {LIKELY}",
)
q(
    "lang_strict",
    lambda s, d: runs(s, d).filter(T.strictly_own(F.col("text"), runs=F.col("runs"))).select("doc_id"),
    f"SELECT doc_id FROM documents WHERE {STRICT}",
)
q(
    "foreign_ratio",
    lambda s, d: runs(s, d).select("doc_id", F.round(T.foreign_ratio(F.col("text"), runs=F.col("runs")), 6).alias("ratio")),
    f"SELECT doc_id, round(coalesce({ES} / nullif(len({RUNS}), 0), 0.0), 6) AS ratio FROM documents",
)
q(
    "junk_lines",
    lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.split("html", "<[^>]+>")).alias("text")).groupBy("page_id").agg(c(F.count_if(T.is_junk(F.col("text"))), "junk"), c(F.count("*"), "n")),
    f"SELECT page_id, count(*) FILTER (WHERE {JUNK}) AS junk, count(*) AS n FROM (SELECT page_id, unnest(regexp_split_to_array(html, '<[^>]+>')) AS text FROM pages) t GROUP BY page_id",
)
q(
    "min_words",
    lambda s, d: docs(s, d).filter(T.n_words(F.col("text")) >= lang.MIN_WORDS).select("doc_id", T.n_words(F.col("text")).alias("n_words")),
    f"SELECT doc_id, {NWORDS} AS n_words FROM documents WHERE {NWORDS} >= 3",
)
q(
    "keepable",
    lambda s, d: runs(s, d).filter(T.keepable(F.col("text"), runs=F.col("runs"))).select("doc_id", "source"),
    f"SELECT doc_id, source FROM documents WHERE NOT ({JUNK}) AND {NWORDS} >= 3 AND {STRICT}",
)
q(
    "sampling_pool",
    lambda s, d: docs(s, d).filter((F.length("text") > 40) & (T.n_words(F.col("text")) >= 6)).select("doc_id"),
    f"SELECT doc_id FROM documents WHERE length(text) > 40 AND {NWORDS} >= 6",
)
q(
    "dedup_source",
    lambda s, d: O.keep_first(docs(s, d), [F.col("source"), F.substring("text", 1, lang.PREFIX)], "doc_id").select("doc_id", "source"),
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, substring(text, 1, 200) ORDER BY doc_id) = 1",
)
q(
    "dedup_global",
    lambda s, d: O.keep_first(docs(s, d), [F.substring("text", 1, lang.PREFIX)], "doc_id").select("doc_id"),
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substring(text, 1, 200) ORDER BY doc_id) = 1",
)
q(
    "token_budget",
    lambda s, d: pulled(s, f"{d}/documents.parquet", "doc_id", "text", lambda df: df.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens")), "tokens", 100_000),
    f"SELECT doc_id, tokens FROM (SELECT doc_id, {TOKENS} AS tokens, sum({TOKENS}) OVER (ORDER BY doc_id) AS upto FROM documents) t WHERE upto - tokens < 100000",
)


def staged(docs):
    """What may be staged: tidy texts that are long enough, in the language, the first of a source with its beginning."""
    rows = docs.select("doc_id", "source", T.tidy(F.col("text")).alias("text")).filter(F.length("text") >= lang.MIN_CHARS)
    rows = T.once(rows, "runs", T.word_runs(F.col("text"))).filter(T.likely_own(F.col("text"), runs=F.col("runs"))).drop("runs")
    rows = O.keep_first(rows, [F.col("source"), F.substring("text", 1, lang.PREFIX)], "doc_id")
    return rows.select("doc_id", "source", T.estimate_tokens(F.col("text")).alias("tokens"))


q(
    "staged_corpus",
    lambda s, d: pulled(s, f"{d}/documents.parquet", "doc_id", "text", staged, "tokens", 200_000),
    f"WITH a AS (SELECT doc_id, source, {TIDY.format('text')} AS text FROM documents), b AS (SELECT * FROM a WHERE length(text) >= 100 AND {LIKELY} QUALIFY row_number() OVER (PARTITION BY source, substring(text, 1, 200) ORDER BY doc_id) = 1), t AS (SELECT doc_id, source, {TOKENS} AS tokens, sum({TOKENS}) OVER (ORDER BY doc_id) AS upto FROM b) SELECT doc_id, source, tokens FROM t WHERE upto - tokens < 200000",
)
q(
    "line_cap",
    lambda s, d: docs(s, d).filter(F.col("text") != "").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint")).filter("rn <= 10").select("doc_id", "source", "rn"),
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE text <> '' QUALIFY rn <= 10",
)
q("shard_stats", lambda s, d: O.greedy_shards(docs(s, d).select("source", "doc_id", (F.octet_length("text") + 1).alias("bytes")), "source", "doc_id", "bytes", 20_000).groupBy("source", "shard").agg(c(F.count("*"), "n_rows"), c(F.min("seq"), "first_doc")), """WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text) + 1 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
 f AS (SELECT source, doc_id, rn, b AS filled, 0 AS shard FROM r WHERE rn = 1 UNION ALL SELECT r.source, r.doc_id, r.rn, CASE WHEN f.filled >= 20000 THEN r.b ELSE f.filled + r.b END, CASE WHEN f.filled >= 20000 THEN f.shard + 1 ELSE f.shard END FROM f JOIN r ON r.source = f.source AND r.rn = f.rn + 1)
 SELECT source, CAST(shard AS BIGINT) AS shard, count(*) AS n_rows, min(doc_id) AS first_doc FROM f GROUP BY source, shard""")
q(
    "quality_join",
    lambda s, d: docs(s, d).join(table(s, d, "labels").filter("quality is not null"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), c(F.count("*"), "n")),
    "SELECT source, round(avg(quality), 6) AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source",
)
q(
    "html_strip",
    lambda s, d: table(s, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text")),
    rf"SELECT page_id, {TIDY.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages",
)
EDGE = r"[\p{L}\p{N}_]"
# RE2 has no lookaround. Each forwarding word with its optional name and colon is therefore taken with the one character (or text end) on either side, after every run of letters has been set apart by two marks, so that neighbours never share a character.
APART = rf"regexp_replace(TEXT, '({EDGE}+)', chr(1) || '\1' || chr(2), 'g')"
GONE = rf"regexp_replace(TEXT, '(?i)' || chr(1) || '(?:rt|via)' || chr(2) || '\s*(?:@' || chr(1) || '{EDGE}+' || chr(2) || '\s*)?:?\s*', ' ', 'g')"
FORWARD = f"replace(replace({GONE.replace('TEXT', APART)}, chr(1), ''), chr(2), '')".replace("TEXT", r"regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g')")
STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({FORWARD}, '@{EDGE}+', ' ', 'g'), '#({EDGE}+)', '\1', 'g'), '[{lang.EMOJI_RANGES}]+', ' ', 'g'), '{lang.ENTITY}', ' ', 'g')"
q(
    "noise_strip",
    lambda s, d: docs(s, d).select("doc_id", T.strip_noise(F.col("text")).alias("text")),
    f"SELECT doc_id, {TIDY.format(STRIPPED)} AS text FROM documents",
)
BLOCK = 128
q(
    "block_shuffle_drop",
    lambda s, d: O.shuffled_blocks(docs(s, d).select("doc_id"), "doc_id", BLOCK),
    f"SELECT doc_id, block, row_number() OVER (PARTITION BY block ORDER BY {Q.draw('doc_id', 'block', 0, T.ANY)}, doc_id) AS place FROM (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BLOCK} AS BIGINT) AS block FROM documents) t QUALIFY count(*) OVER (PARTITION BY block) = {BLOCK}",
)
q(
    "stripe",
    lambda s, d: docs(s, d).join(F.broadcast(docs(s, d).select("source").distinct().withColumn("rk", F.row_number().over(Window.orderBy("source")))), "source").select("doc_id", F.pmod(F.col("rk") - 1, F.lit(4)).cast("bigint").alias("worker")),
    "SELECT doc_id, CAST((dense_rank() OVER (ORDER BY source) - 1) % 4 AS BIGINT) AS worker FROM documents",
)
q(
    "range_split",
    lambda s, d: O.range_split(docs(s, d).select("doc_id"), "doc_id", 6),
    "SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, (SELECT count(*) FROM documents) // 6), 5) AS BIGINT) AS worker FROM documents",
)
q(
    "seeded_sample",
    lambda s, d: docs(s, d).select("doc_id", T.draw(F.col("doc_id"), "sample", 0, T.ANY).alias("u")).orderBy("u", "doc_id").limit(100),
    f"SELECT doc_id, {Q.draw('doc_id', 'sample', 0, T.ANY)} AS u FROM documents ORDER BY u, doc_id LIMIT 100",
)
q(
    "latest_event",
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), c(F.count("*"), "n")),
    "SELECT event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, count(*) AS n FROM events GROUP BY event_type",
)
q(
    "spikes",
    lambda s, d: table(s, d, "events").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") / 8 > 3.0)).select("event_id"),
    "SELECT event_id FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value / 8 > 3.0",
)
q(
    "distinct_types",
    lambda s, d: table(s, d, "events").agg(F.countDistinct("event_type").alias("types"), F.countDistinct("user_id").alias("users")),
    "SELECT count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS users FROM events",
)
