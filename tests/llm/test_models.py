import math

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import linear, neighbours, quality, toxicity

from .fixtures import documents, frame, with_clashes

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("module", [quality, toxicity])
def test_separates_what_labels_separate(spark, module):
    label = "quality" if module is quality else "toxic"
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = " ".join(f"w{(i * 7 + j) % 31}" for j in range(20))
        marked = words.upper().replace(" ", "!! ") if module is quality else words + " nastyword" + "abc"[i % 3]
        rows.append((i, marked if bad else words, "en", "s", 1))
        labels.append((i, int(not bad), int(bad)))
    labels += [(1, 1, 0), (None, 1, 1), (2, None, None), (10**6, 1, 1)]
    got = module.score_documents(with_clashes(frame(spark, rows + documents())), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    want = {i: (q if label == "quality" else t) for i, q, t in labels}
    held = [r for r in got[: len(rows)] if r.held_out]
    assert held and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_or_rows(spark, module):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in module.score_documents(frame(spark, documents()), none).collect()} == {0.5}
    assert module.score_documents(frame(spark, []), none).count() == 0


def test_character_grams_equal_brute_force():
    """Features of a text are its character n-grams: equal texts after lower-casing and joining have equal features, and a changed letter changes only the grams over it."""
    texts = ["Ärger über Öl", "ärger  über\nöl", "ärger über öd", "", "a"]
    got = [set(x.tolist()) for x in toxicity._presence(pa.array(texts))]

    def grams(t):
        t = f" {' '.join(t.lower().split())} "
        return {t[i : i + k] for k in toxicity.ORDERS for i in range(len(t) - k + 1)}

    assert [len(g) for g in got] == [len(grams(t)) for t in texts]
    assert got[0] == got[1] and len(got[0] & got[2]) == len(grams(texts[0]) & grams(texts[2]))


def test_naive_bayes_ratios_and_strength():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        y = i % 2
        at = np.unique(np.append(rng.integers(100, 400, 30), [7] if y else []))
        rows.append((at.astype(np.int64), np.zeros(0), y))
    ratio = toxicity._ratios(rows)
    n = [sum(len(a) for a, _, y in rows if y == k) + (1 << toxicity.BITS) * toxicity.SMOOTH for k in (0, 1)]
    assert np.isclose(ratio[7], np.log(201 / n[1]) - np.log(1 / n[0])) and (ratio[100:400] == 0).all()
    w = toxicity._train(rows)
    assert w[7] > 0 and np.count_nonzero(w[:-1]) == 1


def test_ftrl_equals_brute_force():
    """The sparse updates against the algorithm written out for single numbers."""
    rng = np.random.default_rng(2)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.2
    model = linear.Ftrl(12, alpha, beta, l1, l2)
    z, n = [0.0] * 12, [0.0] * 12
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(200):
        at = rng.choice(12, 4, replace=False)
        x, y = rng.normal(size=4), int(rng.integers(0, 2))
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, v, a in zip(at, x, w, strict=True):
            g = (p - y) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - s * a
            n[i] += g * g
        model.update(at, x, y, 1.0)
        assert np.allclose(model.weights(), [weight(i) for i in range(12)])


def test_held_out_rows_teach_nothing(spark):
    from zlib import crc32

    rows = [(i, "good words here" if i % 2 else "BAD!! WORDS!!", "en", "s", 1) for i in range(300)]
    df = frame(spark, rows)
    truth = [(i, i % 2, 0) for i in range(300)]
    turned = [(i, (1 - q) if crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in truth]
    a, b = ({r.doc_id: r.score for r in quality.score_documents(df, spark.createDataFrame(x, LABELS)).collect()} for x in (truth, turned))
    assert a == b
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in quality.score_documents(df, spark.createDataFrame(truth, LABELS)).collect())


def brute(queries, rows, k):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = {}
    for qi, q in queries:
        if qi is None or not good(q):
            continue
        best = {}
        for ci, c in rows:
            if ci is not None and ci != qi and good(c) and len(c) == len(q):
                s = float((np.array(q, np.float64) * np.array(c, np.float64)).sum())
                best[ci] = max(best.get(ci, -math.inf), s)
        out[qi] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, vectors[i % 60]) for i in range(300)] + [(i, (np.array(vectors[3]) * (1 + i * 1e-7)).astype(np.float32).tolist()) for i in range(300, 330)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [float("inf")] * 8), (480, [None] + [1.0] * 7), (500, []), (None, vectors[0]), (20, vectors[0]), (40, vectors[40]), (520, [1.0, 2.0]), (521, [2.0, 1.0])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    for k in (5, 400):
        got = {}
        for r in neighbours.search(df.filter("vec_id % 20 = 0"), df, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        want = brute([x for x in dict(rows).items() if x[0] is not None and x[0] % 20 == 0 and x[0] not in (20, 40)], rows, k)
        for q, best in want.items():
            assert [c for c, _ in got.get(q, [])] == [c for c, _ in best], (k, q)
            assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in best], rtol=0, atol=1e-12)
    assert neighbours.search(df.filter("false"), df).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-323, 1.0])
def test_doubles_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-9, 10, 6) * size).tolist()) for i in range(90)] + [(100 + i, (rng.normal(size=6) * 10.0 ** rng.integers(-300, 300)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 200):
        got = {}
        for r in neighbours.search(df.filter("vec_id % 20 = 0"), df, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        with np.errstate(all="ignore"):
            for q, v in rows:
                if q % 20 or not any(v):
                    continue
                s = {c: float((np.array(v) * np.array(w)).sum()) for c, w in rows if c != q and any(w)}
                best = sorted(s.items(), key=lambda x: (math.inf if x[1] != x[1] else -x[1], x[0]))[:k]
                assert [c for c, _ in got[q]] == [c for c, _ in best], (q, k)
                assert np.array_equal([x for _, x in got[q]], [x for _, x in best], equal_nan=True)


def test_heaps_equal_sorting():
    rng = np.random.default_rng(6)
    heaps, rows = neighbours.Heaps(4), []
    for _ in range(500):
        rows.append((int(rng.integers(0, 5)), int(rng.integers(0, 30)), float(rng.choice([1.0, 2.0, 3.0, math.nan, math.inf, -math.inf, rng.normal()]))))
        heaps.push(*rows[-1])
    got = {}
    b = heaps.emptied()
    for q, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
        got.setdefault(q, set()).add((c, str(s)))
    for q in range(5):
        best = {}
        for i, c, s in rows:
            if i == q and (c not in best or (-math.inf if s != s else s) > (-math.inf if best[c] != best[c] else best[c])):
                best[c] = s
        want = sorted(best.items(), key=lambda x: (math.inf if x[1] != x[1] else -x[1], x[0]))[:4]
        assert {c for c, _ in got[q]} == {c for c, _ in want}


def test_training_rows_are_bounded(spark, monkeypatch):
    """Rows that repeat an id count once, and features beyond the bound are left out, in an order that does not depend on partitions."""
    rows = [(i % 50, i % 2, np.array([i % 50], np.int32).tobytes(), np.ones(1, np.float32).tobytes()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, y int, at binary, x binary")
    fit = lambda d: linear.fit_in_one_task(d, lambda data: np.array([len(data), *(a[0] for a, _, _ in data)]))
    one, two = fit(df.repartition(3)), fit(df.repartition(7))
    assert one[0] == 50 and sorted(one[1:]) == list(range(50)) and one.tolist() == two.tolist()
