"""Queries on token ids: packing, masks, examples, mixes and losses. Ids are those of symbols (functions.text.symbol_ids), which SQL can repeat; a model file's ids go through the same operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import lang
from ..functions import text as T
from ..operators import datasets as D
from ..operators import order as O
from ..operators import pieces as P
from ..operators import sequences as S
from ..operators.store import shared, tabled
from ..sources import files
from . import sqltext as Q
from .base import c, docs, kept, q, table
from .typos import PAIRS, SYNTHETIC, words

#: Tokens of a chunk, of a triple's example, and of a slice of a token file; workers that read one.
CHUNK, TRIPLE, SLICE, READERS = 512, 64, 128, 5
LOW = 0.1
IDS = f"ids AS MATERIALIZED (SELECT doc_id, {Q.symbol_ids('text')} AS ids FROM documents)"
INLINE = f"{Q.CORRUPTED}, ids AS MATERIALIZED (SELECT doc_id, {Q.symbol_ids('corrupted')} AS ids FROM corrupted)"


def ids(s, d):
    """doc_id and ids of each document's text, between the marks."""
    return D.bounded(P.symbols(docs(s, d).select("doc_id", "text"), "text")).select("doc_id", "ids")


def corrupted_ids(s, d):
    """The same of the texts with inline corrections."""
    return D.bounded(P.symbols(D.inline_corrected(docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id", "corrupted"), "corrupted")).select("doc_id", "ids")


def total(values):
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def weights(values):
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6)


def _chunked(rows):
    """Each document's ids in parts of CHUNK; the last one is shorter."""
    last = F.floor((F.size("ids") - 1) / CHUNK)
    parts = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.slice("ids", i * CHUNK + 1, F.lit(CHUNK)))
    return rows.select("doc_id", F.posexplode(parts).alias("part", "ids")).withColumn("part", F.col("part").cast("bigint"))


def joined(values):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


q("symbol_ids", lambda s, d: ids(s, d).select("doc_id", c(F.size("ids"), "n"), F.md5(joined("ids").cast("binary")).alias("digest")), f"WITH {IDS} SELECT doc_id, len(ids) AS n, md5(array_to_string(ids, ' ')) AS digest FROM ids")
q("inline_corrected", lambda s, d: D.inline_corrected(docs(s, d), "doc_id").select("doc_id", "corrupted"), f"WITH {Q.CORRUPTED} SELECT doc_id, corrupted FROM corrupted")
q(
    "pack", lambda s, d: O.packed(ids(s, d), "doc_id", "ids", CHUNK).select("chunk", joined("ids").alias("ids")),
    f"WITH {IDS}, {Q.chunks('x', 'ids', CHUNK)} SELECT chunk, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS ids FROM x GROUP BY chunk",
)
q(
    "span_mask", lambda s, d: corrupted_ids(s, d).select("doc_id", weights(S.span_mask(F.col("ids"), lang.XBU, lang.XEC, LOW)).alias("total")),
    f"WITH {INLINE}, e AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM ids), {Q.span_weights('x', 'e', 'doc_id', LOW)} SELECT doc_id, round(CAST(sum(w) AS DOUBLE), 6) AS total FROM x GROUP BY doc_id",
)
FIRST = f"WITH {INLINE}, e AS (SELECT doc_id, ids, list_position(ids, {lang.XBC}) AS a FROM ids), f AS (SELECT doc_id, len(ids) AS n, a, list_position(ids[a:], {lang.XEC}) AS z FROM e)"
q(
    "correction_mask", lambda s, d: corrupted_ids(s, d).select("doc_id", c(F.size(F.filter(S.correction_mask(F.col("ids"), lang.XBC, lang.XEC, LOW), lambda v: v == 1.0)), "ones")),
    f"{FIRST} SELECT doc_id, CAST(CASE WHEN a IS NULL OR a = 0 THEN 0 WHEN z IS NULL OR z = 0 THEN n - a + 1 ELSE z END AS BIGINT) AS ones FROM f",
)
q(
    "inline_examples", lambda s, d: D.inline_examples(docs(s, d).select("doc_id", "text"), "doc_id", P.symbols, CHUNK, LOW, kept=tabled).select("chunk", total("input_ids").alias("inputs"), weights("loss_weights").alias("weight")),
    f"WITH {INLINE}, {Q.chunks('x', 'ids', CHUNK)}, {Q.span_weights('y', 'x', 'chunk', LOW)} SELECT chunk, CAST(sum(id) AS BIGINT) AS inputs, round(CAST(sum(w) AS DOUBLE), 6) AS weight FROM y GROUP BY chunk",
)
q(
    "padded", lambda s, d: _chunked(ids(s, d)).select("doc_id", "part", *[total(x).alias(n) for x, n in zip(S.padded(F.col("ids"), CHUNK), ("inputs", "labels", "mask"), strict=True)]),
    f"""WITH {IDS}, parts AS (SELECT doc_id, unnest(range((len(ids) + {CHUNK - 1}) // {CHUNK})) AS part, ids FROM ids),
cut AS (SELECT doc_id, CAST(part AS BIGINT) AS part, ids[part * {CHUNK} + 1:(part + 1) * {CHUNK}] AS ids FROM parts)
SELECT doc_id, part, CAST(list_sum(ids) AS BIGINT) AS inputs, CAST(list_sum(ids) - 100 * ({CHUNK} - len(ids)) AS BIGINT) AS labels, CAST(len(ids) AS BIGINT) AS mask FROM cut""",
)
q(
    "shifted_pairs", lambda s, d: ids(s, d).select(F.explode(F.arrays_zip(F.slice(F.col("ids"), F.lit(1), F.size("ids") - 1).alias("a"), F.slice(F.col("ids"), F.lit(2), F.size("ids") - 1).alias("b"))).alias("z")).groupBy(c(F.col("z.a"), "a"), c(F.col("z.b"), "b")).agg(F.count("*").alias("n")),
    f"WITH {IDS} SELECT CAST(z[1] AS BIGINT) AS a, CAST(z[2] AS BIGINT) AS b, count(*) AS n FROM (SELECT unnest(list_zip(ids[1:len(ids) - 1], ids[2:])) AS z FROM ids) t GROUP BY 1, 2",
)


def _token_slices(s, d):
    path = f"{shared(s)}/tokens-{uuid.uuid4().hex}"
    # Texts are shuffled, not ids. Symbols' ids need more than 16 bits.
    marked = F.concat(F.array(F.lit(lang.BOS)), T.symbol_ids(F.col("text")), F.array(F.lit(lang.EOS))).alias("ids")
    files.write_token_bin(docs(s, d).select("doc_id", "text"), "doc_id", marked, path, parts=int(s.conf.get("spark.sql.shuffle.partitions")), width=4)
    rows = files.token_slices(s, path, SLICE, READERS, width=4)
    return rows.select(c(F.col("worker"), "worker"), "nth", total("input_ids").alias("inputs"), total("labels").alias("labels"), F.md5(joined("input_ids").cast("binary")).alias("digest"))


q(
    "token_slices", _token_slices,
    f"""WITH {IDS}, e AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM ids),
flat AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY doc_id, place) - 1 AS n, lead(id) OVER (ORDER BY doc_id, place) AS following FROM e),
share AS (SELECT count(*) AS n, count(*) // {READERS} AS m FROM flat),
w AS (SELECT range AS worker, range * m AS a, CASE WHEN range = {READERS - 1} THEN n ELSE (range + 1) * m END AS b FROM share, range({READERS})),
x AS (SELECT worker, n - a AS p, (n - a) // {SLICE} AS nth, id, following FROM flat JOIN w ON n >= a AND n < b WHERE (n - a) // {SLICE} < (b - a - 1) // {SLICE})
SELECT worker, nth, CAST(sum(id) AS BIGINT) AS inputs, CAST(sum(following) AS BIGINT) AS labels, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p)) AS digest FROM x GROUP BY worker, nth""",
)


def pairs(s, d):
    """i (from 0, without gaps), typed and committed of the synthetic pairs."""
    rows = O.running_sum(kept(S.synthetic_pairs(words(s, d), PAIRS)), "i", F.lit(1).cast("bigint"), "_n")
    return rows.select((F.col("_n") - 1).alias("i"), "typed", "committed")


def real_pairs(s, d):
    rows = S.shortcut_pairs(s).withColumn("_key", F.concat_ws(" ", "committed", "typed")).distinct()
    return O.numbered(rows, "_key").select((F.col("i") - 1).alias("i"), "typed", "committed")


def triples(s, d):
    return D.triple_examples(pairs(s, d), P.symbols, TRIPLE)


TRIPLES = f"""{SYNTHETIC}, texts AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, {Q.triple('typed', 'committed')} AS text FROM pairs),
examples AS MATERIALIZED (SELECT i, {Q.symbol_ids('text')} AS ids FROM texts)"""
q(
    "triple_examples", lambda s, d: triples(s, d).select("i", total("input_ids").alias("inputs"), total("labels").alias("labels"), weights("loss_weights").alias("weight"), total("attention_mask").alias("mask")),
    f"WITH {TRIPLES} SELECT i, CAST(list_sum(ids) AS BIGINT) AS inputs, CAST(list_sum(ids) - 100 * ({TRIPLE} - len(ids)) AS BIGINT) AS labels, CAST(list_position(ids, {lang.XEC}) - list_position(ids, {lang.XBC}) + 1 AS DOUBLE) AS weight, CAST(len(ids) AS BIGINT) AS mask FROM examples WHERE len(ids) <= {TRIPLE}",
)


def mix_sql(n: int, plain: int, synthetic: int, real: int, plain_share: float, real_share: float = 0.25) -> str:
    draw = lambda part, m: Q.draw("i", "mix", part, m)
    return f"""WITH a AS (SELECT range AS i, {draw(0, D.DRAWS)} < {int(plain_share * D.DRAWS)} AS wants FROM range({n})),
b AS (SELECT *, count(*) FILTER (WHERE wants) OVER (ORDER BY i) AS nth FROM a),
o AS (SELECT *, CASE WHEN wants AND nth <= {plain} THEN 'plain' WHEN {draw(1, D.DRAWS)} < {int(real_share * D.DRAWS)} THEN 'real' ELSE 'synthetic' END AS origin FROM b)
SELECT i, origin, CAST(CASE origin WHEN 'plain' THEN nth - 1 ELSE ({draw(2, T.ANY)}) % CASE origin WHEN 'real' THEN {real} ELSE {synthetic} END END AS BIGINT) AS pick FROM o"""


q("mix_plan", lambda s, d: D.mix_plan(s, 40_000, 21_000, 9_000, 33), mix_sql(40_000, 21_000, 9_000, 33, 0.60))
q("recovery_mix", lambda s, d: D.mix_plan(s, 40_000, 50_000, 9_000, 33, plain_share=0.75), mix_sql(40_000, 50_000, 9_000, 33, 0.75))


def _mixed(s, d):
    plain = kept(D.plain_examples(docs(s, d).select("doc_id", "text"), "doc_id", P.symbols, CHUNK))
    rows = D.mixed_examples(3_000, plain, kept(triples(s, d)), kept(D.triple_examples(real_pairs(s, d), P.symbols, TRIPLE)))
    return rows.select("i", "origin", total("input_ids").alias("inputs"), weights("loss_weights").alias("weight"), c(F.size("labels"), "n"))


# Its plan, its plain chunks and its triples have SQL of their own.
q("mixed_examples", _mixed)

#: A stand-in for a model's loss of each label after the first: ln(label + 2), 0 for labels that do not count.
def loss():
    return F.transform(F.slice("labels", F.lit(2), F.size("labels") - 1), lambda x: F.when(x >= 0, F.log(x + 2.0)).otherwise(0.0))


LOSS_SQL = f"""WITH {TRIPLES}, e AS (SELECT i, unnest(ids) AS id, generate_subscripts(ids, 1) AS p, list_position(ids, {lang.XBC}) AS a, list_position(ids, {lang.XEC}) AS z FROM examples WHERE len(ids) <= {TRIPLE}),
l AS (SELECT i, ln(id + 2.0) AS ce, CASE WHEN p BETWEEN a AND z THEN 1.0 ELSE 0.0 END AS w FROM e WHERE p > 1),
g AS (SELECT i, count(*) AS n, sum(w) AS w, sum(ce) AS u, sum(ce * w) AS x FROM l GROUP BY i)
SELECT i, 'triple' AS kind, n AS valid, CAST(w AS DOUBLE) AS weight, round(u / n, 6) AS loss, round(x / w, 6) AS weighted_loss FROM g
UNION ALL SELECT NULL, 'batch', CAST(sum(n) AS BIGINT), CAST(sum(w) AS DOUBLE), round(sum(u) / sum(n), 6), round(sum(x) / sum(w), 6) FROM g"""
q("loss_report", lambda s, d: D.loss_report(triples(s, d), "i", loss()), LOSS_SQL)


def _weighted_loss(s, d):
    weight, valid = F.lit(1.0) / (1 + F.pmod("event_id", F.lit(3))), F.when(F.col("event_id") % 5 == 0, 0).otherwise(1)
    return table(s, d, "events").groupBy("event_type").agg(F.round(S.weighted_loss(F.abs("value"), weight, valid), 6).alias("loss"))


q(
    "weighted_loss", _weighted_loss,
    "SELECT event_type, round(sum(abs(value) * (1.0 / (1 + event_id % 3)) * v) / greatest(sum((1.0 / (1 + event_id % 3)) * v), 1e-8), 6) AS loss FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS v FROM events) t GROUP BY event_type",
)
q(
    "trainer_sample", lambda s, d: P.trainer_sample(docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))).groupBy("doc_id").agg(F.count("*").alias("n")),
    "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t WHERE line <> '' AND strlen(line) <= 4192 GROUP BY doc_id",
)
MORPHS = [(["etxe", "tik"], "etxe", "tik"), (["▁etxe", "r", "a"], "etxe", "ra"), (["etxea"], "etxe", "a"), (["▁mendi", "ra"], "mendi", "ra"), (["gi", "zon", "a"], "gizon", "a"), ([], "x", "y")]
MORPH_SQL = ", ".join(f"({list(p) if p else '[]::VARCHAR[]'}, '{r}', '{x}')" for p, r, x in MORPHS)
q(
    "morpheme_accuracy", lambda s, d: P.morpheme_accuracy(s.createDataFrame(MORPHS, "pieces array<string>, root string, suffix string")),
    f"SELECT count(*) FILTER (WHERE ok) AS hits, count(*) AS n, count(*) FILTER (WHERE ok) >= count(*) * 0.6 AS enough FROM (SELECT coalesce(pieces[1] IN (root, '▁' || root) AND list_contains(pieces[2:], suffix), false) AS ok FROM (VALUES {MORPH_SQL}) t(pieces, root, suffix)) x",
)
