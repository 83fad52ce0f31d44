import gzip
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import sequences as S
from lexiforge.operators import vocab as V
from lexiforge.sources import config, files


def one_text(folder):
    return "\n".join(p.read_text() for p in sorted(folder.iterdir()) if p.name.startswith("part-"))


def test_maps_and_blobs(spark, tmp_path):
    words = [("kaixo", 3), ('a"b', 9), ("ñ,x", 1)]
    df = spark.createDataFrame(words, "word string, cnt long").repartition(3)
    files.write_counts(df, f"{tmp_path}/w")
    assert json.loads(one_text(tmp_path / "w")) == dict(words)
    assert sorted(map(tuple, files.read_counts(spark, f"{tmp_path}/w").collect())) == sorted(words)
    for name, text in (("one", json.dumps(dict(words))), ("indented", json.dumps(dict(words), indent=2, ensure_ascii=False)), ("lines", "\n".join(json.dumps({w: c}) for w, c in words))):
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, files.read_counts(spark, f"{tmp_path}/{name}").collect())) == sorted(words)
    pairs = spark.createDataFrame([("a", "b", 2), ("ñ", "a", 5)], "w1 string, w2 string, cnt long")
    files.write_blob(df, df.limit(0), pairs, f"{tmp_path}/b")
    assert json.loads(one_text(tmp_path / "b")) == {"unigrams": dict(words), "proper": {}, "bigrams": {"a\tb": 2, "ñ\ta": 5}}
    back = files.read_blob(spark, f"{tmp_path}/b")
    assert sorted(map(tuple, back["unigrams"].collect())) == sorted(words) and back["proper"].count() == 0
    assert sorted(map(tuple, back["bigrams"].collect())) == [("a", "b", 2), ("ñ", "a", 5)]
    (tmp_path / "flat").write_text(json.dumps({"a": 1}))
    assert [tuple(r) for r in files.read_blob(spark, f"{tmp_path}/flat")["unigrams"].collect()] == [("a", 1)]


def test_pairs(spark, tmp_path):
    rows = [(a, w) for i, w in enumerate(["kaixo", 'q"', "eta"]) for a in ("x", "y,", "x")] + [("z", "[]")]
    files.write_pairs(spark.createDataFrame(rows, "typed string, committed string").repartition(4), f"{tmp_path}/p")
    assert sorted((r["typed"], r["committed"]) for r in json.loads(one_text(tmp_path / "p"))) == sorted(rows)
    assert sorted(map(tuple, files.read_pairs(spark, f"{tmp_path}/p").collect())) == sorted(rows)
    (tmp_path / "alt").write_text(json.dumps([{"typo": a, "correct": w} for a, w in rows]))
    (tmp_path / "jsonl").write_text("\n".join(json.dumps({"typed": a, "committed": w}) for a, w in rows))
    for name in ("alt", "jsonl"):
        assert sorted(map(tuple, files.read_pairs(spark, f"{tmp_path}/{name}").collect())) == sorted(rows)
    every = S.shortcut_pairs(spark)
    files.write_pairs(every, f"{tmp_path}/s")
    assert sorted(map(tuple, files.read_pairs(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, every.collect()))


def test_dictionary_files(spark, tmp_path):
    words = spark.createDataFrame([("eta", 255), ("ez", 255), ("a,b", 200), ("kaixo", 7), ("zero", 0)], "word string, f long")
    bigrams = spark.createDataFrame([("kaixo", "ez", 9), ("kaixo", "eta", 99), ("eta", "a,b", 5), ("eta", "ez", 5), ("none", "ez", 4)], "w1 string, w2 string, f long")
    header = files.dictionary_header("xx", "Test", 17)
    files.write_dictionary(V.dictionary_lines(words, bigrams), header, f"{tmp_path}/d")
    (file,) = (tmp_path / "d").glob("part-*.gz")
    want = [header, " word=eta,f=255", "  bigram=ez,f=5", " word=ez,f=255", " word=kaixo,f=7", "  bigram=eta,f=99", "  bigram=ez,f=9"]
    assert gzip.decompress(file.read_bytes()).decode().splitlines() == want
    (tmp_path / "plain.combined").write_text("\n".join([*want, " word=a=b,f=1,f=3"]) + "\n")
    entries = [("eta", None, 255), ("eta", "ez", 5), ("ez", None, 255), ("kaixo", None, 7), ("kaixo", "eta", 99), ("kaixo", "ez", 9)]
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(map(tuple, files.read_dictionary(spark, f"{tmp_path}/d").collect()), key=key) == sorted(entries, key=key)
    assert sorted(map(tuple, files.read_dictionary(spark, f"{tmp_path}/plain.combined").collect()), key=key) == sorted([*entries, ("a=b,f=1", None, 3)], key=key)
    assert sorted(map(tuple, V.parsed_lines(V.numbered_lines(V.dictionary_lines(words, bigrams))).collect()), key=key) == sorted(entries, key=key)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        got = files.read_dictionary(spark, f"{tmp_path}/plain.combined")
        assert sorted(map(tuple, got.collect()), key=key) == sorted([*entries, ("a=b,f=1", None, 3)], key=key)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sources_that_fail_are_skipped(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 2)], "text string, n int").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("x", 1)], "other string, n int").write.json(f"{tmp_path}/j")
    rows, skipped = files.scan_sources(spark, {"p": ("parquet", f"{tmp_path}/p"), "gone": ("parquet", f"{tmp_path}/none"), "no text": ("json", f"{tmp_path}/j")})
    assert sorted(map(tuple, rows.collect())) == [("p", ""), ("p", "a")] and set(skipped) == {"gone", "no text"}
    assert files.scan_sources(spark, {})[0].count() == 0


def test_shards_and_sources(spark, tmp_path):
    for d, name, text in (("a", "shard_00000.txt", "one\n\ntwo\n"), ("b", "shard_00001.txt", "three\n"), ("b", "note.txt", "no\n")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / name).write_text(text)
    got = files.read_shards(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert sorted(map(tuple, got.collect())) == [("", "shard_00000.txt"), ("one", "shard_00000.txt"), ("three", "shard_00001.txt"), ("two", "shard_00000.txt")]
    assert sorted(map(tuple, files.read_sources(spark, f"{tmp_path}/b").collect())) == [("note", "no"), ("shard_00001", "three")]


def test_token_bin(spark, tmp_path):
    import numpy as np

    rows = [(i, list(range(i % 7, i))) for i in range(200)]
    df = spark.createDataFrame(rows, "s long, ids array<int>").repartition(5)
    path = f"file://{tmp_path}/t"
    flat = [x for _, ids in rows for x in ids]
    assert files.write_token_bin(df, "s", "ids", path, parts=3) == len(flat) == files.write_token_bin(df.limit(1), "s", "ids", path)
    assert np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "t").glob("*.bin"))]).tolist() == flat
    assert [x for r in files.read_token_bin(spark, path).orderBy("file").collect() for x in r.ids] == flat
    with pytest.raises(Exception, match="more than 16 bits"):
        files.write_token_bin(spark.createDataFrame([(1, [70000])], "s long, ids array<int>"), "s", "ids", f"file://{tmp_path}/u")


def test_metrics_logs_and_reports(spark, tmp_path):
    for i in range(3):
        files.append_metrics(spark.createDataFrame([(i, i + 1, i + 2, 9)], "step int, top1 int, top5 int, n int"), f"{tmp_path}/m")
    lines = [x for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ["0,1,2,9", "1,2,3,9", "2,3,4,9", "step,top1,top5,n"]
    assert files.read_metrics(spark, f"{tmp_path}/m", "step int,top1 int,top5 int,n int").agg(F.sum("top5")).first()[0] == 9
    at = F.to_timestamp(F.lit("2024-02-03 04:05:06"))
    files.append_events(files.event_lines(spark.range(2), F.lit("progress"), at, {"step": F.col("id"), "loss": F.lit("0.5")}), f"{tmp_path}/l")
    log = spark.read.text(f"{tmp_path}/l").withColumnRenamed("value", "line")
    assert sorted(r.line for r in log.collect()) == [f"[progress] t=2024-02-03T04:05:06Z step={i} loss=0.5" for i in range(2)]
    more = spark.createDataFrame([(1, "[error] what=a a=b=c word a=2"), (2, "noise"), (3, "[error] what=b"), (4, "[done]"), (5, "[my kind] x=1")], "n long, line string")
    assert [r.kv for r in files.errors(more).orderBy("n").collect()] == [{"what": "a", "a": "2"}, {"what": "b"}]
    assert {r.kind: r.kv for r in files.latest(more, "n").collect()} == {"error": {"what": "b"}, "done": {}, "my kind": {"x": "1"}}
    rows = spark.createDataFrame([(2, "b", None), (1, "a", [1, 2])], "id long, t string, x array<int>")
    files.write_report(rows.agg(F.count("*").alias("n")), rows, "id", 'm "q"', f"{tmp_path}/r")
    assert json.loads(one_text(tmp_path / "r")) == {"name": 'm "q"', "aggregate": {"n": 2}, "rows": [{"id": 1, "t": "a", "x": [1, 2]}, {"id": 2, "t": "b", "x": None}]}


def model_file(version=3):
    text = lambda x: struct.pack("<Q", len(x)) + x.encode()
    fields = [text("general.name") + struct.pack("<I", 8) + text("old"), text("size") + struct.pack("<II", 4, 7), text("bytes") + struct.pack("<IIQ2B", 9, 0, 2, 5, 6), text("x.y") + struct.pack("<If", 6, 0.5)]
    infos = text("t") + struct.pack("<IQQIQ", 2, 3, 4, 0, 0)
    head = struct.pack("<4sIQQ", b"GGUF", version, 1, len(fields)) + b"".join(fields) + infos
    return head + bytes(-len(head) % 32) + bytes(range(48))


def test_model_headers(spark, tmp_path):
    data = model_file()
    new = files.rewritten(data, strip=("size",), override={"general.name": "new name", "added": 3, "blob": b"\x01\x02\x03"}, version=2)
    got = {k: (kind, sub, v) for k, kind, sub, v in files.parse_metadata(new)}
    assert got == {"bytes": (9, 0, "[5, 6]"), "x.y": (6, None, "0.5"), "general.name": (8, None, "new name"), "added": (4, None, "3"), "blob": (9, 0, "[1, 2, 3]")}
    assert struct.unpack_from("<I", new, 4)[0] == 2 and new[-48:] == bytes(range(48)) and (len(new) - 48) % 32 == 0
    assert files.rewritten(data) == data
    (tmp_path / "m.bin").write_bytes(data)
    assert bytes(files.rewrite_metadata(spark, f"{tmp_path}/m.bin", strip=("x.y",)).first().content) == files.rewritten(data, strip=("x.y",))
    kv = spark.createDataFrame([({"a": "1", "b": "2"},)], "kv map<string,string>")
    assert kv.select(files.overridden(files.stripped(F.col("kv"), "a"), {"b": "3", "c": "4"})).first()[0] == {"b": "3", "c": "4"}
    with pytest.raises(ValueError):
        files.parse_metadata(b"none of it")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nn: {x: 1, y: 2}\nmodes: {mini: {n: {x: 5}}, empty: }\n")
    assert config.read_config(f"{tmp_path}/c.yaml", "mini") == {"a": 1, "n": {"x": 5, "y": 2}}
    assert config.read_config(f"{tmp_path}/c.yaml") == config.read_config(f"{tmp_path}/c.yaml", "empty") == {"a": 1, "n": {"x": 1, "y": 2}}
    assert config.read_config(None) == {}
    with pytest.raises(FileNotFoundError):
        config.read_config(f"{tmp_path}/none.yaml")


def test_slot_report(spark):
    slots = spark.createDataFrame([(174, "<XBU>"), (4, "<F0>"), (5, "<F1>")], "id long, piece string")
    sections = spark.createDataFrame([(174, 176, "control"), (4, 27, "filler")], "lo long, hi long, section string")
    assert [r.line for r in files.slot_report(slots, sections).orderBy("place").collect()] == ["## filler (4-27)", "- 4: <F0>", "- 5: <F1>", "## control (174-176)", "- 174: <XBU>"]


def test_small_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [1.0, None, math.inf, math.nan, 2.0], "▁«Kaixo!» ", "kaixo, zer")], "w array<string>, x array<double>, p string, t string")
    r = df.select(T.padded_words(F.col("w"), 2, 28).alias("cut"), T.padded_words(F.col("w"), 5, 28).alias("filled"), T.with_space(F.col("w")).alias("s"), T.finite(F.col("x")).alias("x"), T.normal_word(F.col("p")).alias("n"), T.first_word(F.col("t")).alias("f")).first()
    assert r.cut == ["a", "b"] and r.filled == ["a", "b", "c", "<FUTO28>", "<FUTO29>"] and r.s == ["a▁", "b▁", "c▁"] and r.x == [1.0, 2.0] and r.n == "kaixo" and r.f == "kaixo"


def test_documents_in_parts_are_whole_on_end(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i:03}", 1 + i % 7) for i in range(300)], "word string, f long")
    pairs = spark.createDataFrame([(f"w{i:03}", f"w{j:03}", 3) for i in range(0, 300, 9) for j in (1, 2, 299)], "w1 string, w2 string, f long")
    lines = V.dictionary_lines(words, pairs)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files.write_dictionary(lines, "head", f"{tmp_path}/d")
        files.write_counts(words.withColumnRenamed("f", "cnt"), f"{tmp_path}/w")
        files.write_report(words.agg(F.count("*").alias("n")), words.withColumn("i", F.xxhash64("word") % 10**9 + 10**9), "i", "m", f"{tmp_path}/r")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted((tmp_path / "d").glob("part-*.gz"))
    assert len(parts) > 1
    text = gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode().splitlines()
    assert text == ["head", *(r.line for r in lines.orderBy(*V.line_order()).collect())]
    got = files.read_dictionary(spark, f"{tmp_path}/d")
    assert got.filter("bigram is null").count() == 300 and got.filter("word = 'w009' and bigram is not null").count() == 3
    for folder, n in (("w", 300), ("r", 2 + 1)):
        some = sorted((tmp_path / folder).glob("part-*"))
        whole = json.loads("".join(p.read_text() for p in some))
        assert len(some) > 1 and len(whole) == n
    assert len(whole["rows"]) == 300 and whole["aggregate"] == {"n": 300}
    assert files.read_counts(spark, f"{tmp_path}/w").count() == 300
