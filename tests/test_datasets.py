import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.functions import text as T
from lexiforge.operators import datasets as D
from lexiforge.operators import evals as E
from lexiforge.operators import order as O
from lexiforge.operators import pieces as P
from lexiforge.operators import sequences as S


def symbol(p):
    return {"<XBU>": 174, "<XBC>": 175, "<XEC>": 176}.get(p) or (182 + ord(p[6]) - 65 if len(p) > 1 else ord(p) + 304)


def texts(n=40):
    rng = random.Random(7)
    words = ["kaixo", "Mendia,", "(etxe)", "a", "x1", "ñabar!", "don't", "...", "egun"]
    return [(i * 13, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)] + [(9000, None), (9001, "")]


def test_symbol_ids(spark):
    rows = ["a<XBU><CHAR_Q><XBC>ñ<XEC>", "<CHAR_q>\n🙂", "", None]
    got = [r.ids for r in P.symbols(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "t").orderBy("i").collect()]
    assert got == [[symbol(p) for p in re.findall(lang.SYMBOL, t or "")] for t in rows]


def test_inline_corrections(spark):
    rows = texts()
    got = {r.s: r.corrupted for r in D.inline_corrected(spark.createDataFrame(rows, "s long, text string"), "s").collect()}
    assert len(got) == len(rows) and got[9000] == got[9001] == ""
    fixed = whole = 0
    for s, t in rows[:-2]:
        old, new = t.split(), got[s].split(" ") if got[s] else []
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            m = re.match(lang.INLINE, a)
            whole += m is not None and len(m[2]) > 1
            if a != b:
                keys = re.fullmatch(re.escape(m[1]) + r"<XBU>((?:<CHAR_[A-Z]>)*)<XBC>" + re.escape(m[2]) + "<XEC>" + re.escape(m[3]), b)
                assert keys
                fixed += 1
    assert 0.2 < fixed / whole < 0.45


def test_examples(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "s long, text string")
    corrupted = {r.s: r.corrupted for r in D.inline_corrected(df, "s").collect()}
    flat = [x for s, _ in rows for x in [1, *(symbol(p) for p in re.findall(lang.SYMBOL, corrupted[s])), 2]]
    got = D.inline_examples(df, "s", P.symbols, 64, 0.05).orderBy("chunk").collect()
    assert [r.input_ids for r in got] == [flat[i : i + 64] for i in range(0, len(flat) - 63, 64)]
    for r in got:
        on, want = False, []
        for x in r.input_ids:
            on = on or x == 174
            want.append(1.0 if on else 0.05)
            on = on and x != 176
        assert r.loss_weights == want and r.labels == r.input_ids
    pairs = spark.createDataFrame([(0, "kaxo", "kaixo"), (1, "x" * 90, "luze"), (2, "a", "a"), (3, "", "b"), (4, "mendai", "mendia")], "i long, typed string, committed string")
    got = {r.i: r for r in D.triple_examples(pairs, P.symbols, 32).collect()}
    assert set(got) == {0, 4}
    ids = [1, 174, *(182 + ord(c) - 65 for c in "KAXO"), 175, *(ord(c) + 304 for c in "kaixo"), 176, 2]
    assert got[0].input_ids == ids + [0] * (32 - len(ids)) and got[0].labels == ids + [-100] * (32 - len(ids))
    assert got[0].attention_mask == [1] * len(ids) + [0] * (32 - len(ids)) and got[0].loss_weights == [0.0] * 6 + [1.0] * 7 + [0.0] * 19


def test_mix(spark):
    plan = {r.i: (r.origin, r.pick) for r in D.mix_plan(spark, 5000, 1000, 40, 7).collect()}
    plain = [plan[i][1] for i in range(5000) if plan[i][0] == "plain"]
    assert sorted(plan) == list(range(5000)) and plain == list(range(1000))
    last = max(i for i in range(5000) if plan[i][0] == "plain")
    assert 0.55 < 1000 / (last + 1) < 0.65
    pairs = [plan[i] for i in range(5000) if plan[i][0] != "plain"]
    assert 0.2 < sum(o == "real" for o, _ in pairs) / len(pairs) < 0.3
    assert {p for o, p in pairs if o == "real"} == set(range(7)) and {p for o, p in pairs if o == "synthetic"} == set(range(40))
    assert {r.origin for r in D.mix_plan(spark, 50, 100, 5, 0).collect()} == {"plain", "synthetic"}
    assert {r.origin for r in D.mix_plan(spark, 50, 100, 0, 0).collect()} == {"plain"}
    df = spark.createDataFrame([(i, "kaixo mendia " * 9) for i in range(9)], "s long, text string")
    examples = D.triple_examples(spark.createDataFrame([(i, f"kaxo{chr(97 + i)}", "kaixo") for i in range(5)], "i long, typed string, committed string"), P.symbols, 32)
    got = D.mixed_examples(60, D.plain_examples(df, "s", P.symbols, 32), examples, examples.limit(0)).collect()
    assert sorted(r.i for r in got) == list(range(60)) and all(len(r.input_ids) == 32 == len(r.labels) == len(r.attention_mask) for r in got)


def test_loss_report(spark):
    rows = [(1, [5, 6, 7, -100], [0.0, 1.0, 0.5, 0.0], [1.0, 2.0, 9.0]), (2, [5, 6], [1.0, 0.8], [3.0]), (3, [-100, -100], [0.0, 0.0], [4.0])]
    df = spark.createDataFrame(rows, "i long, labels array<int>, loss_weights array<double>, ce array<double>")
    got = {r.i: tuple(r)[1:] for r in D.loss_report(df, "i", F.col("ce")).collect()}
    assert got == {1: ("triple", 2, 1.5, 1.5, round((1 + 2 * 0.5) / 1.5, 6)), 2: ("plain", 1, 0.8, 3.0, 3.0), 3: ("triple", 0, 0.0, 0.0, 0.0), None: ("batch", 3, 2.3, 2.0, round((1 + 1 + 2.4) / 2.3, 6))}


def test_model_files(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, (_, t) in enumerate(texts(5))]
    df = spark.createDataFrame(rows, "i long, text string").withColumn("extra", F.struct(F.lit(1).alias("a")))
    got = {r.i: r for r in P.decode(P.encoder(path)(df, "text"), "ids", path).collect()}
    assert all(got[i].ids == sp.encode(t or "") and got[i].decoded == sp.decode(sp.encode(t or "")) and got[i].extra.a == 1 for i, t in rows)
    assert {r.i: r.pieces for r in P.encode_pieces(df, "text", path).collect()} == {i: sp.encode(t or "", out_type=str) for i, t in rows}
    assert [r.piece for r in P.vocabulary(spark, path).orderBy("id").limit(3).collect()] == [sp.id_to_piece(i) for i in range(3)]
    chunks = D.plain_examples(df.select("i", "text"), "i", P.encoder(path), 16).orderBy("chunk").collect()
    flat = [x for _, t in rows for x in [1, *sp.encode(t or ""), 2]]
    assert [r.input_ids for r in chunks] == [flat[k : k + 16] for k in range(0, len(flat) - 15, 16)]


def test_packing_with_long_and_empty_rows(spark):
    rows = [(0, []), (1, list(range(100))), (2, []), (3, [7]), (5, list(range(31)))]
    flat = [x for _, ids in rows for x in ids]
    got = {r.chunk: r.ids for r in O.packed(spark.createDataFrame(rows, "s long, ids array<int>"), "s", "ids", 8).collect()}
    assert got == {k: flat[k * 8 : k * 8 + 8] for k in range(len(flat) // 8)}


@pytest.mark.parametrize("target", [1, 7, 64, 10_000])
def test_shards_of_one_group(spark, target):
    """Sizes of zero, sizes over the target and over many targets, numbers with gaps; the rows of one group come from several tasks."""
    rng = random.Random(target)
    rows = [(i * i * 7, rng.choice([0, 0, 1, 1, 2, 5, 13, 400])) for i in range(1500)]
    want, filled, shard = {}, 0, 0
    for i, n in rows:
        if filled >= target:
            filled, shard = 0, shard + 1
        filled += n
        want[i] = shard
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, n int").withColumn("g", F.lit(5))
    got = O.greedy_shards(df, "g", "i", "n", target)
    assert {r.seq: r.shard for r in got.collect()} == want and got.schema["g"].dataType.simpleString() == "int"


def test_shards_of_several_groups_and_batches(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([1, 5, 30])) for g in ("a", "b", None, "c") for i in range(rng.randint(1, 90))]
    want = {}
    for g in {r[0] for r in rows}:
        filled = shard = 0
        for _, i, n in sorted(r for r in rows if r[0] == g):
            if filled >= 20:
                filled, shard = 0, shard + 1
            filled += n
            want[g, i] = shard
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        shards = O.greedy_shards(spark.createDataFrame(rows, "g string, i long, n int"), "g", "i", "n", 20)
        got = {(r.g, r.seq): r.shard for r in shards.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_numbers_of_words(spark):
    words = ["a", "ab", "abc", "abcd", "b", "ñ", "zz", "éa", ""]
    got = {r.word: r.i for r in O.numbered(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(words, key=str.encode))}


def test_draws(spark):
    import hashlib

    big = 9_000_000_000_000_000_000
    want = int(hashlib.md5(f"mix:{big}".encode()).hexdigest()[20:30], 16) % 97
    assert spark.range(1).select(T.draw(F.lit(big), "mix", 2, 97)).first()[0] == want
    # No period, no number that is never drawn: two million draws of five million examples are as many different ones as chance gives.
    rows = D.mix_plan(spark, 2_100_000, 0, 5_000_000, 0, plain_share=0.0)
    got = rows.agg(F.countDistinct("pick").alias("n"), F.max("pick").alias("top")).first()
    assert abs(got.n - 5_000_000 * (1 - math.exp(-0.42))) < 5_000 and got.top > 4_999_900
    assert rows.alias("a").join(rows.alias("b"), F.expr("b.i = a.i + 1000003")).filter("a.pick = b.pick").count() < 10


@pytest.mark.parametrize("ids", [[i * 7_919_000_017 % 2**61 for i in range(3000)], [10**9 + i for i in range(12)], [i if i < 2900 else 2**60 + i for i in range(3000)], [], [5]])
def test_running_sums_of_any_numbers(spark, ids):
    rng = random.Random(1)
    rows = [(i, rng.randrange(100)) for i in ids]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, v long").repartition(3)
    got = sorted((r.seq, r.upto) for r in O.running_sum(df, "seq", F.col("v"), "upto", width=100).collect())
    want, total = [], 0
    for i, v in sorted(rows):
        total += v
        want.append((i, total))
    assert got == want
    if len(ids) > 1000:  # even ranges, however the numbers lie
        sizes = [r["count"] for r in df.groupBy(O.range_of(df, "seq", 100)).count().collect()]
        assert len(sizes) < 40 and max(sizes) < 300
    workers = sorted((r.seq, r.worker) for r in O.range_split(df.select("seq"), "seq", 6).collect())
    share = max(1, len(ids) // 6)
    assert workers == [(i, min(n // share, 5)) for n, i in enumerate(sorted(ids))]


def test_stamps_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    at = spark.createDataFrame([(1_704_067_200,), (1_720_000_001,)], "s long").select(F.timestamp_seconds("s").alias("at"))
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in at.select(T.utc_stamp(F.col("at"))).collect()] == ["2024-01-01T00:00:00Z", "2024-07-03T09:46:41Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_corrections_need_no_shuffle(spark):
    docs = spark.createDataFrame([(i, f"Kaixo mundu hau (esaldi) bat da {i}, eta «beste» bat.") for i in range(400)], "doc_id long, text string")
    plan = D.inline_corrected(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = D.inline_corrected(docs, "doc_id").collect()
    share = sum(r.corrupted.count("<XBU>") for r in rows) / sum(len([w for w in r.text.split() if re.search("[A-Za-z]", w)]) for r in rows)
    assert 0.25 < share < 0.36
    assert all(re.sub(r"<XBU>.*?<XBC>(.*?)<XEC>", r"\1", r.corrupted) == r.text for r in rows)


def test_scores_and_verdicts(spark):
    rows = [("c", 0, [-1.0, -3.0], [-2.0, -3.0]), ("c", 1, [-1.5], [-1.0]), ("c", 2, [], []), ("d", 0, [-5.0, math.nan], [-5.0]), ("d", 1, [-5.0], [-5.0])]
    df = spark.createDataFrame(rows, "case string, nth int, lps array<double>, base array<double>")
    scores = df.filter("case = 'c' and nth = 0").select(*[v.alias(k) for k, v in E.candidate_scores(F.col("lps"), F.col("base")).items()]).first()
    assert tuple(scores) == (-4.0, -2.0, 1.0, 0.5, 0.5)
    got = {r.method: (r.hits, r.n) for r in E.reranking(df, ["case"]).collect()}
    assert got == {"sum_logprob": (1, 2), "per_token": (1, 2), "surprisal_sum": (2, 2), "surprisal_ptok": (2, 2), "surprisal_ratio": (2, 2)}
    for oks, want in (([True, True], "healthy"), ([False], "broken"), ([True, False], "mixed"), ([], "healthy")):
        assert E.verdict(spark.createDataFrame([(o,) for o in oks], "ok boolean"), F.col("ok")).first().verdict == want


def test_corrections(spark):
    words = spark.createDataFrame([("kaixo", 9), ("kaixa", 20), ("kai", 50), ("xo", 1)], "word string, cnt long")
    pairs = spark.createDataFrame([("kaixp", "Kaixo"), ("kaxio", "kaixo"), ("zzzz", "xo"), ("KAIXO", "kaixo")], "typed string, committed string")
    topk = {r.typed: r.topk for r in E.corrections(pairs, words).collect()}
    assert topk == {"kaixp": ["kaixa", "kaixo"], "kaxio": ["kaixo"], "KAIXO": ["kaixa", "kaixo"]}
    hits = E.corrected_hits(pairs, E.corrections(pairs, words))
    assert tuple(E.accuracy(hits).first()) == (1, 3, 4)
    assert tuple(E.accuracy(E.corrected_hits(pairs, E.corrections(pairs, words), case=True)).first()) == (1, 2, 4)


def test_slots(spark):
    ours = S.slot_layout(spark)
    assert tuple(P.slot_verdict(P.compared_slots(ours, ours)).first()) == (34, 0, "match")
    assert tuple(P.slot_verdict(P.compared_slots(ours, ours.filter("id <> 200"))).first()) == (34, 1, "differ")
    own = {r.id: r.piece for r in S.slot_layout(spark, ("eta", "ez"), tuple(f"w{i}" for i in range(57)), ("🙂",)).collect()}
    assert sorted(own) == list(range(4, 304)) and own[28] == "eta▁" and own[30] == "<FUTO28>▁" and own[174] == "<XBU>" and own[182] == "<CHAR_A>" and own[263] == "w55▁" and own[264] == "🙂"
    df = spark.createDataFrame([([3, 4, 5],), ([3, 5],), ([],), ([7],)], "x array<int>")
    assert [r[0] for r in df.select(P.are_sequential(F.col("x"))).collect()] == [True, False, True, True]
    few = P.trainer_sample(spark.createDataFrame([("x" * n,) for n in range(30)], "text string"), 5, 20)
    assert few.count() == 5 and few.filter("length(text) > 20 or text = ''").count() == 0


def test_words_of_batches_are_typed_as_columns_are(spark):
    from lexiforge.functions import batches as B
    from lexiforge.operators import sequences as S

    words = ["kaixo", "Kaixo", "KAIXO", "eta", "Ez", "ñabar", "Ñu", "ßa", "ÿé", "don't", "''", "ab", "a", "Éíóúü", "×÷æø", "q'", "zzz"]
    rows = [(w, f"{n}.{i}") for n, w in enumerate(words) for i in range(60)]
    df = spark.createDataFrame(rows, "w string, k string").select("w", "k", S.typed_of(F.col("w"), F.col("k")).alias("typed"))
    got = df.select("*", T.triple(F.col("typed"), F.col("w")).alias("t")).collect()
    assert len({r.typed for r in got}) > 300
    for r in got:
        typed = B.typed_of(r.w, r.k, S.SHORTCUT_SHARE)
        assert typed == r.typed, r
        assert typed is None or f"<XBU>{typed.translate(B._KEYS)}<XBC>{r.w}<XEC>" == r.t


def test_spaces_and_pieces_of_batches(spark):
    texts = ["a\x1cb c\x85d e　f \t g\x1f", "<XBU", ">x<CHAR_A", "<CHAR_A><XEC><<XBC>>", "", None, "\x00<XBU>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    want = {r.i: (r.w, r.ids) for r in df.select("i", F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "").alias("w"), T.symbol_ids(F.col("text")).alias("ids")).collect()}
    got = {r.i: r.ids for r in P.symbols(df, "text").collect()}
    from lexiforge.functions import batches as B

    assert {i: (B.words(t or ""), got[i]) for i, t in enumerate(texts)} == want


def test_symbols_and_corrections_are_made_in_batches(spark):
    df = spark.createDataFrame([(1, "kaixo mundu")], "s long, text string")
    assert "MapInArrow" in P.symbols(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in D.inline_corrected(df, "s")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("length", [1, 7, 50])
def test_packing_joins_texts_before_ids_are_made_and_shuffles_ends_of_rows_only(spark, length):
    texts = ["abcdefghij" * 5, "", None, "xyz", "k" * 7, "longer text " * 9, "a"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = O.packed(df, "doc_id", "ids", length, made=lambda x: P.symbols(x, "text"))
    flat = [ord(c) + lang.FIRST_FREE for t in texts for c in t or ""]
    want = {i: flat[i * length : (i + 1) * length] for i in range(len(flat) // length)}
    assert {r.chunk: r.ids for r in got.collect()} == want and got.count() == len(want)
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, x in enumerate(lines) if "MapInArrow" in x) < min(i for i, x in enumerate(lines) if "Join" in x)
    aggregates = [x for x in lines if "collect_list" in x]
    assert "Union" in lines[0] and len(aggregates) == 1
