import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge import lang
from lexiforge.operators import backoff as K
from lexiforge.operators import channel as C
from lexiforge.operators import evals as E


def edits(a, b):
    """Unrestricted edit distance with swaps, by its own recurrence over last places of letters."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, l, same = last.get(b[j - 1], 0), at, a[i - 1] == b[j - 1]
            if same:
                at = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def some_words(rng, n, letters="aenr", most=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)})


def test_edits_equal_the_plain_recurrence():
    rng = random.Random(2)
    words = some_words(rng, 60, "abñ")
    a, b = [x for x in words for _ in words], words * len(words)
    got, cost = C.distances(a, b, C.Costs())
    free, _ = C.distances(a, b, C.Costs(1, 1, 1, 1))
    for x, y, g, f, c in zip(a, b, got, free, cost, strict=True):
        want = edits(x, y)
        assert (g == want) if want <= 2 else g > 2
        assert f == g and (c == 0) == (x == y) and c <= g


def test_every_candidate_within_two_edits_is_found(spark):
    rng = random.Random(3)
    words, typed = some_words(rng, 120), some_words(rng, 80) + ["a" * 33, "n" * 29, "Aen", "", None]
    words += ["n" * 30, "n" * 31]
    w = spark.createDataFrame([(x, i + 1) for i, x in enumerate(words)], "word string, cnt long")
    t = spark.createDataFrame([(x,) for x in [*typed, "Aen"]], "typed string")
    got = sorted((r.typed, r.word, r.edits) for r in C.candidates(t, w).collect())
    want = sorted((x, y, edits(x.lower(), y)) for x in typed if x for y in words if len(y) <= 30 and edits(x.lower(), y) <= 2)
    assert got == want
    assert C.candidates(t, w.limit(0)).collect() == [] and C.candidates(t.limit(0), w).collect() == []


def test_costs_of_slips():
    pairs = {("etxe", "etxe"): 0, ("etce", "etxe"): 0.5, ("ñoa", "noa"): 0.3, ("noa", "ñoa"): 0.3, ("exte", "etxe"): 0.7, ("etxxe", "etxe"): 0.6, ("ama", "amma"): 0.6, ("etpe", "etxe"): 1, ("etce", "etxea"): 1.5, ("ab", "bca"): 1.7, ("aab", "ab"): 0.6}
    _, cost = C.distances([a for a, _ in pairs], [b for _, b in pairs], C.Costs())
    assert list(cost) == pytest.approx(list(pairs.values()))
    assert "c" in lang.ADJACENT["x"]


def test_ranks_without_and_with_a_context(spark):
    words = spark.createDataFrame([("etxe", 10), ("etze", 10), ("ete", 40), ("mendi", 5)], "word string, cnt long")
    typed = spark.createDataFrame([("etce",), ("Mendj",), ("qqqqqq",)], "typed string")
    top = {r.typed: r.topk for r in C.corrections(typed, words, k=2).collect()}
    by = lambda w, n, cost: -(math.log(n) - 6 * cost)
    assert top == {"etce": sorted(["etxe", "etze", "ete"], key=lambda w: by(w, dict(etxe=10, etze=10, ete=40)[w], dict(etxe=0.5, etze=1, ete=1)[w]))[:2], "Mendj": ["mendi"]}
    m = K.model(spark.createDataFrame([("gure etze",)] * 9 + [("nire etxe",)] * 9 + [("bat bi",)] * 3, "text string"))
    asked = spark.createDataFrame([(K.START, "gure", "etme"), (K.START, "nire", "etme")], "prev2 string, prev string, typed string")
    best = {r.prev: r.topk[0] for r in C.corrections_in_text(asked, words, m).collect()}
    assert best == {"gure": "etze", "nire": "etxe"}
    hits = E.accuracy(E.corrected_hits(spark.createDataFrame([("etce", "etxe"), ("Mendj", "Mendi")], "typed string, committed string"), C.corrections(typed, words))).first()
    assert (hits.top1, hits.topk, hits.n) == (2, 2, 2)


def test_pairs_are_measured_where_they_meet_and_only_candidates_are_shuffled(spark):
    """Both sides are dealt by their keys, none is sent to all tasks, and pairs are measured before any shuffle of pairs. Without costs, candidates are the same."""
    rng = random.Random(5)
    w = spark.createDataFrame([(x, i) for i, x in enumerate(some_words(rng, 60))], "word string, cnt long")
    t = spark.createDataFrame([(x,) for x in some_words(rng, 60)], "typed string")
    plan = C.candidates(t, w)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    lines = plan.split("\n")
    measured = next(i for i, x in enumerate(lines) if "MapInArrow" in x and "edits" in x)
    met = next(i for i, x in enumerate(lines) if i > measured and "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in lines[measured:met])
    columns = ["typed", "word", "cnt", "edits"]
    assert sorted(C.candidates(t, w, None).collect()) == sorted(C.candidates(t, w).select(*columns).collect())


def test_deletions_are_all_of_a_word_once():
    rng = random.Random(6)
    words = some_words(rng, 60, "abñ") + ["", "n" * 32]
    whose, keys, gone = (x.tolist() for x in C.deletions(pa.array(words)))
    text = {}
    for i, word in enumerate(words):
        left = {word, *(word[:a] + word[a + 1 :] for a in range(len(word)))}
        left |= {x[:a] + x[a + 1 :] for x in left for a in range(len(x)) if len(x) > len(word) - 2}
        mine = [(k, g) for w, k, g in zip(whose, keys, gone, strict=True) if w == i]
        assert len(mine) == len(left) and sorted(g for _, g in mine) == sorted(len(word) - len(x) for x in left)
        text[word] = {k for k, g in mine if g == 0}
    whole = {k: w for w, (k,) in text.items()}
    assert len(whole) == len(text)
    for i, k in zip(whose, keys, strict=True):
        if k in whole:
            short, long = whole[k], words[i]
            rest = iter(long)
            assert len(long) - len(short) <= 2 and all(c in rest for c in short)


def test_neighbours_are_those_of_the_keyboard_both_ways():
    letters = sorted({x for a, bs in lang.ADJACENT.items() for x in a + bs})
    pairs = [(x, y) for x in letters for y in letters if x != y]
    _, cost = C.distances([x for x, _ in pairs], [y for _, y in pairs], C.Costs(accent=1))
    near = {p for p, c in zip(pairs, cost, strict=True) if c == 0.5}
    assert near == {p for a, bs in lang.ADJACENT.items() for b in bs for p in ((a, b), (b, a))}


@pytest.mark.parametrize("name", ["channel_acc", "channel_candidates"])
def test_words_of_the_texts_are_counted_once(spark, monkeypatch, name):
    from lexiforge.plans import evaluations, registry

    counted, count = [], evaluations.V.word_counts
    monkeypatch.setattr(evaluations.V, "word_counts", lambda *a, **k: counted.append(1) or count(*a, **k))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(counted) == 1


def every_candidate_scored(asked, words, m, k):
    """The best candidates by the share of each of them after each context."""
    found = asked.select("prev2", "prev", "typed").distinct().join(C.candidates(asked, words).select("typed", "word", "cost"), "typed")
    out = {}
    for r in K.with_loss(found, m).select("prev2", "prev", "typed", "word", F.round(F.col("lp") - C.Costs().weight * F.col("cost"), 9).alias("s")).collect():
        out.setdefault(r[:3], []).append((-r.s, r.word))
    return {c: [w for _, w in sorted(x)[:k]] for c, x in out.items()}


@pytest.mark.parametrize("part", [K.PART, 400])
def test_corrections_in_text_are_the_best_of_all_candidates_and_measure_pairs_once(spark, monkeypatch, part):
    """With words dealt over parts and without; contexts and words that the texts lack, ties, and what is typed in capitals or like nothing."""
    monkeypatch.setattr(K, "PART", part)
    monkeypatch.setattr(K, "LOOKED_UP", 50)
    rng = random.Random(11)
    kinds = some_words(rng, 80)
    texts = [" ".join(rng.choice(kinds[: rng.choice([3, 12, 60])]) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    m = K.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert bool(m.parts.salts) == (part == 400)
    words = spark.createDataFrame([(w, 3 + i % 7) for i, w in enumerate(kinds[:70] + ["zuzu"])], "word string, cnt long")
    some = lambda: rng.choice([K.START, "qqqqqq", *kinds])
    rows = [(some(), rng.choice([kinds[0], kinds[1], some()]), rng.choice(kinds)) for _ in range(150)]
    rows = [(a, b, w[:1] + w[2:] if i % 3 else w.upper()) for i, (a, b, w) in enumerate(rows)] + [(K.START, kinds[0], "xxxxxxxxxxxxxxxxxx"), (K.START, kinds[0], "")]
    asked = spark.createDataFrame(rows, "prev2 string, prev string, typed string")
    got = C.corrections_in_text(asked, words, m, 3)
    want = every_candidate_scored(asked, words, m, 3)
    assert {(r.prev2, r.prev, r.typed): r.topk for r in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("== Initial Plan ==")[0].split("\n") if "MapInArrow" in x and "edits" in x]) == 1
