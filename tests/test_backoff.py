import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.operators import backoff as K
from lexiforge.operators import evals as E

UNKNOWN = "zzz"


class Plain:
    """The model by loops over dictionaries."""

    def __init__(self, texts):
        self.tri = Counter()
        for t in texts:
            w = [K.START] * 2 + [x.lower() for x in re.findall(lang.WORD_B, t or "")]
            self.tri.update(zip(w, w[1:], w[2:]))
        before, befores = defaultdict(set), defaultdict(set)
        for u, v, w in self.tri:
            before[v, w].add(u)
            befores[w].add(v)
        self.two = {(v, w): sum(n for (a, b, c), n in self.tri.items() if (b, c) == (v, w)) if v == K.START else len(us) for (v, w), us in before.items()}
        self.one = {w: len(vs) for w, vs in befores.items()}
        self.d = [self.discount(x.values()) for x in (self.tri, self.two, self.one)]

    @staticmethod
    def discount(counts):
        c = Counter(counts)
        return c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5

    def rung(self, counts, d, w, below):
        if not counts:
            return below
        n = sum(counts.values())
        return max(counts.get(w, 0) - d, 0) / n + d * len(counts) / n * below

    def p(self, u, v, w):
        p1 = self.rung(self.one, self.d[2], w, 1 / (len(self.one) + 1))
        p2 = self.rung({c: n for (b, c), n in self.two.items() if b == v}, self.d[1], w, p1)
        return self.rung({c: n for (a, b, c), n in self.tri.items() if (a, b) == (u, v)}, self.d[0], w, p2)


def corpus(seed, words="ba be bi bo bu da de".split(), n=25):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 9))) for _ in range(n)] + [None, "", "12 .", "Ba be Ba be Ba be"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_are_those_of_the_plain_model_and_sum_up_to_one(spark, seed):
    texts = corpus(seed)
    plain, m = Plain(texts), K.model(frame(spark, texts))
    vocabulary = [*plain.one, UNKNOWN]
    contexts = {*((u, v) for u, v, _ in plain.tri), ("bi", UNKNOWN), (UNKNOWN, "ba"), (UNKNOWN, UNKNOWN)}
    asked = [(u, v, w) for u, v in contexts for w in vocabulary]
    got = {(r.w1, r.w2, r.w3): r.p for r in K.shares(spark.createDataFrame(asked * 2, "w1 string, w2 string, w3 string"), m).collect()}
    assert len(got) == len(asked)
    assert got == pytest.approx({a: plain.p(*a) for a in asked}, abs=1e-12)
    for u, v in contexts:
        assert sum(got[u, v, w] for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_best_words_are_the_best_of_the_vocabulary(spark):
    texts = corpus(3, words=[a + b for a in "bdgklm" for b in "aeiou"], n=80)
    plain, m = Plain(texts), K.model(frame(spark, texts))
    contexts = sorted({(u, v) for u, v, _ in plain.tri})[::7] + [("x", "y"), ("x", "ba"), (K.START, K.START)]
    out = K.best_words(spark.createDataFrame(contexts * 2, "prev2 string, prev string"), m, k=3).collect()
    assert len(out) == len(set(contexts))
    for r in out:
        best = sorted(plain.one, key=lambda w: (-round(plain.p(r.prev2, r.prev, w), 12), w))[:3]
        assert [round(plain.p(r.prev2, r.prev, w), 12) for w in r.topk] == [round(plain.p(r.prev2, r.prev, w), 12) for w in best]


def test_losses_keystrokes_and_plausible_words(spark):
    texts = corpus(4)
    plain, m = Plain(texts), K.model(frame(spark, texts))
    talk = ["ba be bi", "da", "", None, "bo qq bo ba de", "ba be bi da bu", "ba be da da ba"]
    rows = frame(spark, talk)
    split = [[x.lower() for x in re.findall(lang.WORD_B, t or "")] for t in talk]
    got = {r.id: (r.loss, r.n) for r in E.turn_losses(rows, ["id"], lambda s: K.with_loss(s, m)).collect()}
    for i, w in enumerate(split):
        p = [K.START] * 2 + w
        lps = [math.log(plain.p(*p[j : j + 3])) for j in range(len(w))]
        assert (i in got) == bool(w)
        if w:
            assert got[i] == (pytest.approx(-sum(lps) / len(lps), abs=2e-6), len(w))
    best = {}
    predict = lambda c: K.best_words(c, m, k=2)
    chars = top1 = topk = 0
    right = defaultdict(set)
    for w in split:
        p = [K.START] + w
        for j in range(1, len(w)):
            best[p[j - 1], p[j]] = None
            right[p[j - 1], p[j]].add(w[j])
    for r in predict(spark.createDataFrame(list(best), "prev2 string, prev string")).collect():
        best[r.prev2, r.prev] = r.topk
    fits = lambda guess, w: guess == w or len(guess) >= 2 and w.startswith(guess)
    cases = []
    for w in split:
        p = [K.START] + w
        for j in range(1, len(w)):
            t = best[p[j - 1], p[j]]
            chars, top1, topk = chars + len(w[j]), top1 + len(w[j]) * fits(t[0], w[j]), topk + len(w[j]) * any(fits(x, w[j]) for x in t)
        if len(w) >= 4:
            i = max(2, int(len(w) * 0.6))
            cases.append((w[i - 2], w[i - 1]))
    k = E.keystrokes(rows, rows, ["id"], predict).first()
    assert (k.chars, k.saved_top1, k.saved_topk) == (chars, top1, topk)
    n = E.next_word_plausible(rows, predict).first()
    assert (n.top1, n.topk, n.n) == (sum(best[c][0] in right[c] for c in cases), sum(bool(right[c] & set(best[c])) for c in cases), len(cases))


def test_model_of_no_words(spark):
    m = K.model(frame(spark, [None, "", "..."]))
    one = spark.createDataFrame([("a", "b", "c")], "w1 string, w2 string, w3 string")
    assert [r.p for r in K.shares(one, m).collect()] == [1.0]
    assert K.best_words(one.select(F.col("w1").alias("prev2"), F.col("w2").alias("prev")), m).collect() == []


def test_large_tables_are_columnar_and_no_side_of_scoring_goes_through_the_driver(spark):
    m = K.model(frame(spark, corpus(5)))
    assert all(t.inputFiles() for t in (m.three, m.two, m.pairs, m.words, m.one))
    rows = frame(spark, ["ba be bi bo", "da de"])
    for out in (E.turn_losses(rows, ["id"], lambda s: K.with_loss(s, m)), E.objective_losses(rows, ["id"], rows, lambda s: K.with_loss(s, m)), K.best_words(spark.createDataFrame([("ba", "be")], "prev2 string, prev string"), m)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_parts_have_all_that_a_word_in_the_middle_needs(spark, monkeypatch):
    """Many parts, and frequent words dealt over several of them: shares and best words stay those of the plain model, and rows of the table of trigrams grow with the texts by parts only."""
    monkeypatch.setattr(K, "PART", 300)
    monkeypatch.setattr(K, "BLOCK", 500)
    texts = corpus(6, words=[a + b for a in "bdgklm" for b in "aeiou"], n=60) + ["the cat the dog the cow the cat"] * 20
    plain, m = Plain(texts), K.model(frame(spark, texts).repartition(3))
    assert m.parts.n > 3 and m.parts.salts.get("the", 1) > 1 and m.three.count() <= m.parts.n
    asked = [(u, v, w) for u, v in {*((u, v) for u, v, _ in plain.tri), ("the", UNKNOWN), (UNKNOWN, "the"), ("cow", "the")} for w in [*plain.one, UNKNOWN]]
    got = {(r.w1, r.w2, r.w3): r.p for r in K.shares(spark.createDataFrame(asked, "w1 string, w2 string, w3 string"), m).collect()}
    assert got == pytest.approx({a: plain.p(*a) for a in asked}, abs=1e-12)
    assert {(r.w1, r.w2, r.w3): r.p for r in K.all_shares(m).collect()} == pytest.approx({a: plain.p(*a) for a in plain.tri}, abs=1e-12)
    contexts = sorted({(u, v) for u, v, _ in plain.tri}) + [("x", "y"), ("x", "the"), (K.START, K.START)]
    for r in K.best_words(spark.createDataFrame(contexts, "prev2 string, prev string"), m, k=3).collect():
        best = sorted(plain.one, key=lambda w: (-round(plain.p(r.prev2, r.prev, w), 12), w))[:3]
        assert [round(plain.p(r.prev2, r.prev, w), 12) for w in r.topk] == [round(plain.p(r.prev2, r.prev, w), 12) for w in best]


def test_what_parts_have_of_words_is_shuffled_once_to_be_scored(spark, monkeypatch):
    """Sums know the parts they go back to: only parts and what they are told are dealt by part, and no join makes what they are told."""
    monkeypatch.setattr(K, "PART", 300)
    texts = corpus(8, n=200)
    m = K.model(frame(spark, texts))
    plan = K.all_shares(m)._jdf.queryExecution().executedPlan().toString()
    assert m.parts.n > 3 and plan.count("Exchange") == 2 and "Join" not in plan
    of_words = m.two.filter(~F.col("key").rlike("[ \t]"))
    befores = defaultdict(set)
    for _, v, w in Plain(texts).tri:
        befores[w].add(v)
    assert {r.key: {x.n for x in r.rows} for r in of_words.groupBy("key").agg(F.collect_list(F.struct("n")).alias("rows")).collect()} == {w: {len(vs)} for w, vs in befores.items()}


def test_parts_answer_for_their_words_without_a_join(spark, monkeypatch):
    """What comes after a context is ranked where its word is: answers are read from one table. Only dealt words are put together, in one shuffle."""
    texts = corpus(9, n=60)
    contexts = spark.createDataFrame([("ba", "be"), ("x", "y"), ("x", "ba")], "prev2 string, prev string")
    plan = lambda m: K.best_words(contexts, m)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join", plan(K.model(frame(spark, texts))))
    monkeypatch.setattr(K, "PART", 100)
    m = K.model(frame(spark, texts))
    assert m.parts.salts and "SortMergeJoin" not in plan(m)
