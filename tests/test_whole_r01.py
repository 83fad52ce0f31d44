
import re

import duckdb

from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.plans import registry


def written(spark, tmp_path, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_masks_reach_the_end(spark, tmp_path):
    texts = ["kaixo mendia " * 600, "x1 y2 " * 200 + "mendia", "", "b"]
    d = written(spark, tmp_path, texts)
    corrupted = {r.doc_id: r.corrupted for r in registry.QUERIES["inline_corrected"](spark, d).collect()}
    span, ones = {}, {}
    for n, text in corrupted.items():
        pieces = ["^", *re.findall(lang.SYMBOL, text), "$"]
        on, total = False, 0.0
        for x in pieces:
            on = on or x == "<XBU>"
            total += 1.0 if on else 0.1
            on = on and x != "<XEC>"
        span[n] = round(total, 6)
        ones[n] = pieces.index("<XEC>") - pieces.index("<XBC>") + 1 if "<XBC>" in pieces else 0
    assert max(len(t) for t in corrupted.values()) > 10_000 and corrupted[2] == ""
    assert {r.doc_id: r.total for r in registry.QUERIES["span_mask"](spark, d).collect()} == span
    assert {r.doc_id: r.ones for r in registry.QUERIES["correction_mask"](spark, d).collect()} == ones


def test_noise_strip_keeps_forwarded_documents(spark, tmp_path):
    texts = ["RT @user: kaixo", "bai via @a_b: agur http://a.b/c", "via", "artea bidvia", "rt : a RT b Via:c", "ez #eguna &amp; @x", ""]
    want = {}
    for n, text in enumerate(texts):
        for pattern, to in ((r"https?://\S+|www\.\S+", " "), (r"(?i)(?:\bRT\b|\bvia\b)\s*(?:@\w+\s*)?:?\s*", " "), (r"@\w+", " "), (r"#(\w+)", r"\1"), (lang.ENTITY, " "), (r"\s+", " ")):
            text = re.sub(pattern, to, text)
        want[n] = text.strip()
    d = written(spark, tmp_path, texts)
    assert {r.doc_id: r.text for r in registry.QUERIES["noise_strip"](spark, d).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert dict(con.execute(registry.ORACLES["noise_strip"]).fetchall()) == want


def test_typos_of_rare_and_short_words_and_of_shortcuts(spark, tmp_path):
    texts = ["mendia mendia mendia et et et xa xa", *["kaixo"] * 40, *["zu"] * 9, *["a"] * 9]
    d = written(spark, tmp_path, texts)
    got = {r.word for r in registry.QUERIES["synthetic_typos"](spark, d).collect()}
    assert got <= {"mendia", "et", "kaixo", "zu"} and {"mendia", "et"} & got
    pairs = registry.QUERIES["typo_pairs"](spark, d).collect()
    assert len(pairs) == 2000 == len({r.i for r in pairs}) and all(r.typed != r.committed for r in pairs)
    assert {r.committed for r in pairs} == {"mendia", "et", "kaixo", "zu"}
    of = [r.typed for r in pairs if r.committed == "kaixo"]
    assert 0.12 < sum(x in lang.SHORTCUTS["kaixo"] for x in of) / len(of) < 0.35


def test_blocks_are_of_consecutive_rows_and_shuffled(spark, tmp_path):
    ids = [i * 700 + i % 3 for i in range(300)]
    rows = registry.QUERIES["block_shuffle_drop"](spark, written(spark, tmp_path, ["x"] * 300, ids)).orderBy("block", "place").collect()
    assert [r.place for r in rows] == [*range(1, 129)] * 2
    got = [(r.doc_id, r.block) for r in rows]
    assert [b for _, b in got] == [0] * 128 + [1] * 128
    for b in (0, 1):
        block = [i for i, x in got if x == b]
        assert sorted(block) == ids[b * 128 : b * 128 + 128] and block != sorted(block)
