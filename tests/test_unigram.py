"""Unigram training and segmentation against all segmentations of short words."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.operators import order as O
from lexiforge.operators import unigram as U


def cuts(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in cuts(word[k:]):
            yield [word[:k], *rest]


def scored(word, score, unknown, whole=True):
    """Each segmentation of a word with its log probability."""
    for c in cuts(word):
        s = [score.get(p, unknown if len(p) == 1 else None) if whole or p != word else None for p in c]
        if None not in s:
            yield c, sum(s)


def random_pieces(rng, words):
    subs = sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)})
    kept = [s for s in subs if len(s) == 1 or rng.random() < 0.5]
    return U.Pieces(kept, np.array([-rng.uniform(1, 9) for _ in kept]))


def test_lattices_against_all_segmentations():
    rng = random.Random(3)
    for _ in range(20):
        words = sorted({"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 7))) for _ in range(12)})
        pieces = random_pieces(rng, words[:8])
        score = dict(zip(pieces.text, pieces.score.tolist(), strict=True))
        cnt = np.array([rng.randint(1, 9) for _ in words])
        want, likelihood = Counter(), 0.0
        for w, n in zip(words, cnt.tolist(), strict=True):
            all_ = list(scored(w, score, pieces.unknown))
            z = math.log(sum(math.exp(s) for _, s in all_))
            likelihood += n * z
            for c, s in all_:
                for p in c:
                    if p in score:
                        want[p] += n * math.exp(s - z)
        got, z = U.expected(words, cnt, pieces)
        assert z == pytest.approx(likelihood) and got == pytest.approx([want[p] for p in pieces.text])
        for whole in (True, False):
            paths, scores = U.best(words, pieces, whole)
            for w, path, s in zip(words, paths, scores, strict=True):
                top = max(scored(w, score, pieces.unknown, whole), key=lambda x: x[1], default=None)
                if top is None:
                    assert s == -math.inf
                else:
                    found = [pieces.text[p] if p >= 0 else chr(-1 - p) for p in path]
                    assert s == pytest.approx(top[1]) and (found, pytest.approx(s)) in [(c, x) for c, x in scored(w, score, pieces.unknown, whole)]


TEXTS = ["the cat sat on the mat\nthe cats sat", "a hat  and a cat", "<XBU>the<XBC>cat<XEC> that", None, "", "chat chats hats é", "the that then thence"] * 3


def brute_training(words, most, seeds, shrink, steps):
    """The same training by plain loops."""
    chars, subs = Counter(), Counter()
    for w, n in words.items():
        for i in range(len(w)):
            chars[w[i]] += n
            for j in range(i + 2, len(w) + 1):
                subs[w[i:j]] += n
    chosen = sorted((s for s in subs if subs[s] > 1), key=lambda s: (-subs[s] * len(s), s))[:seeds]
    counts = dict(chars) | {s: subs[s] for s in chosen}
    score = {p: math.log(c / sum(counts.values())) for p, c in counts.items()}

    def expect():
        unknown, out, z_all = min(score.values()) - U.UNKNOWN, Counter(), 0.0
        for w, n in words.items():
            all_ = list(scored(w, score, unknown))
            z = math.log(sum(math.exp(s) for _, s in all_))
            z_all += n * z
            for c, s in all_:
                for p in c:
                    out[p] += n * math.exp(s - z)
        return out, z_all

    log = []
    while True:
        for _ in range(steps):
            c, z = expect()
            log.append(z)
            c = {p: max(c[p], U.FLOOR) if len(p) == 1 else c[p] for p in score if len(p) == 1 or c[p] > 0}
            score = {p: math.log(v / sum(c.values())) for p, v in c.items()}
        if len(score) <= most:
            return score, log
        c, z = expect()
        log.append(z)
        unknown = min(score.values()) - U.UNKNOWN
        loss = {p: c[p] * (score[p] - max(s for _, s in scored(p, score, unknown, False))) for p in score if len(p) > 1}
        singles = [p for p in score if len(p) == 1]
        kept = sorted(loss, key=lambda p: (-loss[p], p))[: max(most, int(len(score) * shrink)) - len(singles)]
        score = {p: score[p] for p in [*singles, *kept]}


def test_training_against_plain_loops(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    reserved = ("<XBU>", "<XBC>", "<XEC>")
    table = U.word_table(texts, reserved=reserved)
    words = {r.word: r.cnt for r in table.collect()}
    assert words["the" + lang.SPACE_MARK] == 12 and words["the"] == 3 and words[lang.SPACE_MARK] == 6 and not set(reserved) & set(words)
    got = U.train(table, 30, seeds=60, coverage=1.0)
    want, log = brute_training(words, 30, 60, 0.75, 2)
    assert dict(zip(got.pieces.text, got.pieces.score.tolist(), strict=True)) == pytest.approx(want)
    assert [z for *_, z in got.log] == pytest.approx(log)
    for a, b in zip(got.log, got.log[1:], strict=False):
        assert a[0] != b[0] or b[2] >= a[2] - 1e-6 * abs(a[2])
    rows = U.vocabulary(got.pieces, reserved)
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[4][1] == "<XBU>" and rows[7][1] == "<0x00>"
    by_id = {r[0]: r for r in rows}
    encoder = U.Encoder(rows)
    hostile = [*TEXTS[:7], "unknown ж <XEC> 😀", "  two  spaces ", "x" * 3000, "<" * 50_000 + "<XBU>" * 3, "long " * 40_000]
    frame = spark.createDataFrame(list(enumerate(hostile)), "i long, text string")
    for r in encoder.column(frame, "text").collect():
        raw = b"".join(bytes([x - encoder.bytes]) if by_id[x][3] == "byte" else by_id[x][1].encode() for x in r.ids)
        assert raw.decode() == (r.text or "").replace(" ", lang.SPACE_MARK).replace("\n", "")
    assert U.train(U.word_table(texts.limit(0)), 30).log == []


def test_coverage_and_cases(spark):
    words = spark.createDataFrame([("aaaa", 100), ("ab", 10), ("ac", 1), ("walk", 3), ("walking", 2), ("walks", 1), ("sing", 4)], "word string, cnt long")
    known = {r.piece for r in U.alphabet(words, 0.9).collect()}
    assert known == {"a", "k", "l", "w", "g", "i", "n"} or "c" not in known
    seeds = {r.piece for r in U.seed_pieces(words, U.alphabet(words, 0.9), 100).collect()}
    assert "aa" in seeds and not any("c" in s for s in seeds)
    cases = {(r.word, r.root, r.suffix) for r in U.morpheme_cases(words, ("ing", "s")).collect()}
    assert cases == {("walking", "walk", "ing"), ("walks", "walk", "s")}


@pytest.mark.parametrize("k", [0, 1, 7, 500, 4_999, 5_000, 6_000])
def test_least_k(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice([rng.randrange(-(10**6), 10**6), 5, rng.randrange(10)]), i) for i in range(5_000)]
    df = spark.createDataFrame(rows, "u long, i long").repartition(3)
    got = sorted((r.u, r.i) for r in O.least_k(df, "u", ["i"], k, buckets=8).collect())
    assert got == sorted(rows)[:k]


def test_reserved_pieces_are_tried_only_where_one_can_begin(spark):
    """The longest reserved piece at each place, found behind a look at its first character, so that hundreds of them cost texts without them nothing."""
    own = ("<a>", "<ab>", "<ab>▁", "😀", "😀x", "[q]", "-", "^")
    text = "u<ab> w <a><ab>x 😀xy😀 [q]]-^ \\E<\n<ab" * 2
    pattern, plain = U._any_of(own), sorted(own, key=len, reverse=True)
    assert len(pattern) == 1 and pattern[0].startswith("(?=[") and U._any_of(()) == []
    got = spark.createDataFrame([(text,), (None,)], "text string").select(U.pretokens(F.col("text"), own).alias("w")).collect()
    want, rest = [], ""
    marked, at = text.replace(" ", lang.SPACE_MARK), 0
    while at < len(marked):
        piece = next((p for p in plain if marked.startswith(p, at)), None)
        c = piece or marked[at]
        if piece or c == "\n":
            want += [rest] * bool(rest) + [piece] * bool(piece)
            rest = ""
        elif c == lang.SPACE_MARK:
            want, rest = [*want, rest + c], ""
        else:
            rest += c
        at += len(c)
    assert got[0].w == want + [rest] * bool(rest) and got[1].w == []


def test_a_task_segments_a_word_once(spark):
    rows = U.vocabulary(U.Pieces(["a", "b", "ab"], np.array([-1.0, -1.0, -1.5])))

    class Once(U.Encoder):
        def words(self, words):
            assert len(words) == len(set(words)) and not self.__dict__.setdefault("seen", set()) & set(words)
            self.seen.update(words)
            return super().words(words)

    texts = spark.createDataFrame([(i, f"ab a{'b' * (i % 3)}") for i in range(1000)], "i long, text string").coalesce(1)
    out = {r.i: r.ids for r in Once(rows).column(texts, "text").collect()}
    by = {r[1]: r[0] for r in rows}
    assert len(out) == 1000 and out[1][-1] == by["ab"] and out[0][-1] == by["a"]


@pytest.mark.parametrize("head", [1, 18])
def test_pieces_are_found_behind_others_of_their_first_bits(monkeypatch, head):
    monkeypatch.setattr(U, "HEAD", head)
    monkeypatch.setattr(U, "_TAIL", np.uint64(64 - head))
    rng = random.Random(head)
    p = U.Pieces([a + b for a in "abcde" for b in "vwxyz"], np.log(np.full(25, 0.04)))
    keys = np.array([*p.keys.tolist(), *(rng.getrandbits(64) for _ in range(200)), 0, 2**64 - 1], np.uint64)
    rng.shuffle(keys)
    want = [int(np.flatnonzero(p.keys == k)[0]) if k in p.keys else -1 for k in keys]
    assert p.find(keys).tolist() == want and p.find(keys.reshape(-1, 1)).ravel().tolist() == want


def test_a_step_takes_small_batches_together_and_is_the_same_without_logarithms(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 8, 40]))) for _ in range(60)]
    p = U.Pieces(["a", "b", "c", "ab", "bca", "cc", "abab"], np.log(np.array([0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1])))
    cnt = np.array([rng.randint(1, 9) for _ in words])
    total, likelihood = U.expected(words, cnt, p)
    monkeypatch.setattr(U, "UNLIKELY", 0.0)
    by_logs, same = U.expected(words, cnt, p)
    assert np.allclose(total, by_logs, rtol=1e-9) and math.isclose(likelihood, same, rel_tol=1e-12)
    calls = []
    whole = U.expected
    monkeypatch.setattr(U, "expected", lambda *a: calls.append(len(a[0])) or whole(*a))
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 10]), pa.array(cnt[i : i + 10])], ["word", "cnt"]) for i in range(0, 60, 10)]
    (out,) = U._summed(p)(iter(batches))
    assert calls == [60] and math.isclose(out.column(1)[-1].as_py(), likelihood, rel_tol=1e-12)


@pytest.mark.parametrize("odd", ["", "é", "é𝒳", "\0", "\0.$é"])
def test_seeds_hold_no_unknown_character_and_substrings_are_made_once(spark, odd):
    rng = random.Random(8)
    rows = [("".join(rng.choice("abc" + odd) for _ in range(rng.randint(1, 9))), rng.randint(1, 4)) for _ in range(60)]
    rows = list(dict(rows).items())
    words = spark.createDataFrame(rows, "word string, cnt long").cache()
    known = words.sparkSession.createDataFrame([(c, 1) for c in "abc"], "piece string, cnt long")
    plans = []
    got = U.seed_pieces(words, known, 12, 4, kept=lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    counts = Counter()
    for w, n in rows:
        for i in range(len(w)):
            for k in range(2, min(4, len(w) - i) + 1):
                counts[w[i : i + k]] += n
    want = sorted(((-n * len(s), s) for s, n in counts.items() if n > 1 and not set(s) & set(odd)))[:12]
    assert sorted((r.piece, r.cnt) for r in got.filter("cnt > 1 or length(piece) > 1").collect()) == sorted((s, -m // len(s)) for m, s in want)
    assert plans[0].count("Join") == 0
