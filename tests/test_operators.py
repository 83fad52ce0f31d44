import json
import math
import random
import re
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.functions import text as T
from lexiforge.operators import order as O
from lexiforge.operators import sequences as S
from lexiforge.operators import vocab as V
from lexiforge.sources import config, files
from lexiforge.streaming import watch


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_noise_and_gates(spark):
    raw = ["RT @user: kaixo http://a.b/c #eguna 🙂 &amp; agur", "via @x bai", "@a b", "www.x.eu  z", "éla laé la", None]
    assert column(spark, raw[:4], T.strip_noise) == ["kaixo eguna agur", "bai", "b", "z"]
    assert column(spark, raw[4:], T.foreign_hits) == [1, 0]
    assert column(spark, ["a b la c", "", "eta " * 3 + "la " * 6, "la " * 6], T.strictly_own) == [False, True, False, False]
    assert column(spark, ["...", "", "a.", "  "], T.is_junk) == [True, True, False, True]
    assert column(spark, ["abc", "12345678", ""], T.estimate_tokens) == [1, 2, 1]


def test_words(spark):
    words = ["ñandú", "straße", "é", "a-b", "ño", "İz", ""]
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    assert column(spark, words[:5], T.keypresses) == [[f"<CHAR_{c}>" for c in plain(w).upper() if "A" <= c <= "Z"] for w in words[:5]]
    assert column(spark, ["«kaixo!»"], lambda c: F.array(*T.affixes(c)))[0] == ["«", "kaixo", "!»"]
    assert column(spark, [3000, 0, 1, 7], lambda c: T.scale_count(c, F.lit(3000)), "long") == [255, 1, *(max(1, min(255, round(255 - math.log(3000 / c) / math.log(1.15)))) for c in (1, 7))]
    assert column(spark, ["abcd"], lambda c: T.transpose(c, F.lit(1))) == ["acbd"]
    assert column(spark, ["Qz", "ñu"], lambda c: T.adjacent(c, F.lit(0), F.lit(1))) == ["Az", "ñu"]


def test_common_prefix_and_softmax(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([5], [6])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(T.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 0]
    got = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(T.log_softmax(F.col("x"), F.lit(2))).first()[0]
    assert got == pytest.approx(3 - math.log(sum(math.exp(v) for v in (1, 2, 3))))


def test_budget_crosses_ranges(spark):
    rng = random.Random(1)
    rows = [(i * 700, rng.randint(1, 30)) for i in range(200)]
    kept, total = [], 0
    for s, n in rows:
        if total >= 900:
            break
        kept.append(s)
        total += n
    got = O.within_budget(spark.createDataFrame(rows, "s long, n long"), "s", F.col("n"), 900)
    assert sorted(r.s for r in got.collect()) == kept


def test_packing_and_shards(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(3, 99) for _ in range(rng.randint(1, 9))]) for i in range(150)]
    flat = [x for _, ids in rows for x in ids]
    got = {r.chunk: r.ids for r in O.packed(spark.createDataFrame(rows, "s long, ids array<int>"), "s", "ids", 16).collect()}
    assert got == {k: flat[k * 16 : k * 16 + 16] for k in range(len(flat) // 16)}
    want, filled, shard = {}, 0, 0
    for i, ids in rows:
        if filled >= 20:
            filled, shard = 0, shard + 1
        filled += len(ids)
        want[i] = shard
    sized = spark.createDataFrame([("g", i, len(ids)) for i, ids in rows], "g string, s long, n long")
    assert {r.seq: r.shard for r in O.greedy_shards(sized, "g", "s", "n", 20).collect()} == want


def test_masks(spark):
    rng = random.Random(3)
    rows = [[rng.choice([1, 2, 3, 4]) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    span, fix = [], []
    for ids in rows:
        on, out = False, []
        for x in ids:
            on = on or x == 1
            out.append(1.0 if on else 0.5)
            on = on and x != 2
        span.append(out)
        a = ids.index(1) if 1 in ids else None
        b = next((i for i in range(a, len(ids)) if ids[i] == 2), len(ids) - 1) if a is not None else None
        fix.append([1.0 if a is not None and a <= i <= b else 0.5 for i in range(len(ids))])
    assert column(spark, rows, lambda c: S.span_mask(c, 1, 2, 0.5), "array<int>") == span
    assert column(spark, rows, lambda c: S.correction_mask(c, 1, 2, 0.5), "array<int>") == fix


def test_cdf_sample_is_bisection(spark):
    from bisect import bisect_right
    from itertools import accumulate

    words = [(f"w{i:03d}", (i * 37) % 91 + 1) for i in range(120)]
    total = list(accumulate(math.log(c + 1) for _, c in words))
    got = {r.i: r.word for r in S.cdf_sample(spark.createDataFrame(words, "word string, cnt long"), 500).collect()}
    assert len(got) == 500
    assert sum(got[i] != words[bisect_right(total, (i + 0.5) / 500 * total[-1])][0] for i in range(500)) == 0


def test_typos_change_words_and_follow_weights(spark):
    rows = [(i, w) for i, w in enumerate(["kaixo", "etxe", "ñabar", "mendia"] * 500)] + [(9999, "a"), (9998, "x1")]
    got = S.typos(spark.createDataFrame(rows, "i long, word string"), "word", "i").collect()
    assert all(r.typed != r.word and len(r.word) > 1 for r in got) and len(got) > 1700
    longer = sum(len(r.typed) > len(r.word) for r in got) / len(got)
    assert 0.15 < longer < 0.4


def test_pairs_keep_repeats(spark):
    got = S.shortcut_pairs(spark).collect()
    want = [(a, w) for w, forms in lang.SHORTCUTS.items() for a in forms if a != w]
    assert sorted((r.typed, r.committed) for r in got) == sorted(want)
    assert S.slot_layout(spark).count() == 300
    assert [r.id for r in S.slot_layout(spark).filter("kind = 'char'").orderBy("id").collect()] == list(range(182, 208))


def test_proper_nouns_ties(spark):
    caps = spark.createDataFrame([("BILBO", 5), ("Bilbo", 5), ("Etxe", 5), ("A'b", 9)], "word string, cnt long")
    low = spark.createDataFrame([("bilbo", 10), ("etxe", 50)], "word string, cnt long")
    assert [tuple(r) for r in V.proper_nouns(low, caps).collect()] == [("bilbo", "BILBO", 10)]


def test_files(spark, tmp_path):
    words = spark.createDataFrame([("kaixo", 3), ("eta", 9)], "word string, cnt long")
    files.write_counts(words, f"{tmp_path}/w")
    assert sorted(map(tuple, files.read_counts(spark, f"{tmp_path}/w").collect())) == [("eta", 9), ("kaixo", 3)]
    (tmp_path / "b.json").write_text(json.dumps({"unigrams": {"a": 1}, "proper": {}, "bigrams": {"a\tb": 2, "bad": 3}}))
    blob = files.read_blob(spark, f"{tmp_path}/b.json")
    assert [tuple(r) for r in blob["bigrams"].collect()] == [("a", "b", 2)] and blob["unigrams"].count() == 1
    lines = [(0, f"line {i}", i) for i in range(20)]
    files.write_shards(spark.createDataFrame(lines, "source long, text string, i long"), f"{tmp_path}/s", "source", "i", 40)
    assert spark.read.text(f"{tmp_path}/s").count() == 20 and spark.read.text(f"{tmp_path}/s").select("shard").distinct().count() == 4
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, str(tmp_path))
    log = spark.createDataFrame([(1, "[step] t=1 loss=2"), (2, "[step] t=2 loss=30"), (3, "noise")], "n long, line string")
    assert [r.kv["loss"] for r in files.latest(log, "n").collect()] == ["30"]
    head = struct.pack("<4sIQQ", b"GGUF", 3, 0, 2) + struct.pack("<Q1sI", 1, b"k", 4) + struct.pack("<I", 7) + struct.pack("<Q1sI", 1, b"a", 9) + struct.pack("<IQ2B", 0, 2, 5, 6)
    (tmp_path / "m.bin").write_bytes(head)
    assert [(r.key, r.value) for r in files.read_metadata(spark, f"{tmp_path}/m.bin").collect()] == [("k", "7"), ("a", "[5, 6]")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log").write_text("[step] t=1 loss=2\n[step] t=2 loss=30\n[error] what=x\n")
    seen = []
    watch.watch(watch.spikes(watch.log_stream(spark, f"{tmp_path}/in")), lambda df, n: seen.extend(r.kv["t"] for r in df.collect()), f"{tmp_path}/c", once=True).awaitTermination(60)
    assert seen == ["2"]


def test_dedup_of_a_stream(spark, tmp_path):
    """The first 200 characters decide, also over batches."""
    (tmp_path / "in").mkdir()
    long = "x" * 200
    seen = []
    for n, lines in enumerate([["a", "b", "a", long + "1"], ["b", "c", long + "2"]]):
        (tmp_path / "in" / f"f{n}").write_text("\n".join(lines) + "\n")
        stream = watch.dedup_stream(spark.readStream.text(f"{tmp_path}/in").withColumnRenamed("value", "text"))
        watch.watch(stream, lambda df, n: seen.extend(r.text for r in df.collect()), f"{tmp_path}/c", once=True).awaitTermination(60)
    assert sorted(seen) == ["a", "b", "c", long + "1"]


def test_a_cap_on_the_dictionary(spark):
    docs = spark.createDataFrame([("kaixo eta ez " * 9 + "eta " * 9,), ("Bilbo " * 9,), ("Bilbo bat " * 3,)], "text string")
    every = [(r.word, r.f) for r in V.dictionary(docs).collect()]
    assert every == sorted(every, key=lambda x: (-x[1], x[0])) and len(every) == 5
    assert [(r.word, r.f) for r in V.dictionary(docs, most=2).collect()] == every[:2]
    must = spark.createDataFrame([("falta",), ("ez",), ("x",), ("Bilbo",)], "word string")
    assert {r.word for r in V.dictionary(docs, must=must).collect()} == {w for w, _ in every} | {"falta"}
    assert tuple(V.rank_of(V.dictionary(docs), "ez").first())[1:] == (sum(f > dict(every)["ez"] for _, f in every), 5)
    assert tuple(V.rank_of(V.dictionary(docs), "none").first()) == (0, 5, 5)


def test_config():
    c = {"a": 1, "n": {"x": 1, "y": 2}, "modes": {"mini": {"n": {"x": 5}}}}
    assert config.settings(c, "mini") == {"a": 1, "n": {"x": 5, "y": 2}} and config.settings(None) == {}
    assert config.pick(None, c, "a") == 1 and config.pick(7, c, "a") == 7


def test_registry():
    import __spark_entry__ as e

    assert len(e.queries()) >= 60 and set(e.oracle_sql()) <= set(e.queries())
    assert not re.search(r"collect\(", "".join(map(str, e.oracle_sql().values())))


def test_scores_of_pairs_count_the_texts_once(spark):
    from lexiforge.operators import evals as E

    docs = spark.createDataFrame([("a b a c",), ("b a",), (None,)], "text string")
    steps = spark.createDataFrame([("a", "b")], "prev string, word string")
    for out in (E.mutual_information(docs), E.with_logprobs(steps, docs)):
        assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.w1, r.w2): r.cnt for r in E.mutual_information(docs).collect()} == {("a", "b"): 1, ("b", "a"): 2, ("a", "c"): 1}
