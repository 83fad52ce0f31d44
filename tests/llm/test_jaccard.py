import random
import re

import numpy as np

from lexiforge.llm import jaccard
from lexiforge.llm.components import components
from lexiforge.llm.shared import Tables

from .fixtures import documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def planted(seed, groups=25):
    rng = random.Random(seed)
    voc = [f"v{i}" for i in range(300)]
    hot = [rng.choice(voc) for _ in range(30)]
    texts = []
    for _ in range(groups):
        n = rng.choice([4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 150])
        base = [rng.choice(voc) for _ in range(n)]
        if rng.random() < 0.4:
            base = hot + base
        texts.append(base)
        for _ in range(rng.randint(1, 8)):
            w = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, 2 + len(w) // 40)):
                k = rng.randrange(len(w) + 1)
                op = rng.random()
                if op < 0.4:
                    w.insert(k, rng.choice(voc))
                elif op < 0.7 and len(w) > 1:
                    w.pop(min(k, len(w) - 1))
                else:
                    w = w + [rng.choice(voc)] if rng.random() < 0.5 else [rng.choice(voc)] + w
            texts.append(w)
    rows = [(i, " ".join(w).replace("v1", "V1") if rng.random() < 0.3 else " ".join(w), "en", "s", 1) for i, w in enumerate(texts)]
    rows += [(1000 + r[0], *r[1:]) for r in documents(seed)]
    rng.shuffle(rows)
    return rows


def test_entries_meet_for_every_linked_pair():
    import pyarrow as pa

    for seed in range(25):
        rows = planted(seed, groups=60)
        token, starts, cls = jaccard.shingle_sets(pa.array([r[1] or "" for r in rows]))
        value, count = np.unique(token, return_counts=True)
        for least in (3, 10**9):
            f = value[count >= least]
            entry, owner = jaccard.entries(token, starts, f, np.argsort(np.argsort(count[count >= least], kind="stable"), kind="stable"))
            has = [set() for _ in rows]
            for e, o in zip(entry.tolist(), owner.tolist(), strict=True):
                has[o].add(e)
            sets = [set(token[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            assert [len(s) for s in sets] == [len(shingles(r[1])) for r in rows]
            for i in range(len(rows)):
                for j in range(i):
                    x, y = sets[i], sets[j]
                    if x and y and x != y and 100 * len(x & y) >= 80 * len(x | y):
                        assert has[i] & has[j], (rows[i][1], rows[j][1])


def test_equals_brute_force(spark, monkeypatch):
    for seed, frequent in ((1, 200), (2, 3)):
        monkeypatch.setattr(jaccard, "FREQUENT_SETS", frequent)
        rows = planted(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(with_clashes(frame(spark, rows).repartition(4)), Tables(spark)).collect()}
        assert got == brute(rows)


def near_copies(seed, copies, words=60):
    """Copies of one text with random edits, most of them too many to be linked with each other, so that they share entries and stay apart."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        for k in rng.sample(range(words), rng.randint(0, 5)):
            w[k] = f"x{rng.randrange(3 * copies)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rng.shuffle(rows)
    return rows


def test_large_near_copy_group(spark, monkeypatch):
    for seed, entry, tile, frequent in ((1, 8, 128, 200), (2, 2, 7, 10)):
        monkeypatch.setattr(jaccard, "SMALL_ENTRY", entry)
        monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
        monkeypatch.setattr(jaccard, "FREQUENT_SETS", frequent)
        rows = near_copies(seed, 300)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows).repartition(4), Tables(spark)).collect()}
        want = brute(rows)
        assert got == want and 20 < len({c for _, c in want.values()}) < 290


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(12)]
    for columns in (1, 7, 4096):
        got = jaccard.intersections(sets[:5], sets[5:], columns)
        assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[5:]] for x in sets[:5]]


def test_one_of_each_group_stays(spark):
    rows = planted(3, groups=8) + [(None, "some text without id", None, None, None)]
    kept = sorted(r.doc_id for r in jaccard.keep_one(frame(spark, rows), Tables(spark)).collect() if r.doc_id is not None)
    want = brute([r for r in rows if r[0] is not None])
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_ids_and_nothing(spark):
    text = " ".join(map(str, range(30)))
    rows = [(7, text, "en", "s", 1), (7, text, "en", "s", 1), (3, text + " x", "en", "s", 1), (9, None, "en", "s", 1), (None, text, "en", "s", 1)]
    got = sorted((r.doc_id is not None, r.doc_id, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows), Tables(spark)).collect())
    assert got == [(False, None, 3), (True, 3, 3), (True, 7, 3), (True, 7, 3), (True, 9, 9)]
    assert jaccard.near_duplicates(frame(spark, []), Tables(spark)).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
