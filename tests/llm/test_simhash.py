"""SimHash components against all pairs, hashes against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexiforge.llm import simhash as S
from lexiforge.llm.components import components
from lexiforge.llm.shared import Tables

from .fixtures import DOCS, documents, frame, with_clashes

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = [w for w in (text or "").translate(AZ).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def by_hand(fps):
    """The least index that links reach, of fingerprints by index."""
    n, parent = len(fps), list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_hash_is_the_library_s():
    rng = random.Random(1)
    data = rng.randbytes(4000)
    at = [(rng.randrange(3000), n) for n in [*range(80), 0, 500, 7, 31, 32, 33]]
    got = S.xxh64(np.frombuffer(data, np.uint8), np.array([a for a, _ in at]), np.array([n for _, n in at]))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in at]
    end = S.xxh64(np.frombuffer(data, np.uint8), np.array([3999, 3990]), np.array([1, 10]))
    assert end.tolist() == [xxhash.xxh64_intdigest(data[3999:], 42), xxhash.xxh64_intdigest(data[3990:], 42)]


def test_fingerprints(monkeypatch):
    texts = [t for _, t, *_ in documents(4)] + ["One TWO three", "ÀB c", "one two", " a\x0bb\x0cc ", "x " * 5000, "word"]
    monkeypatch.setattr(S, "COUNT_AT_ONCE", 100)
    assert S.fingerprints(pa.array([t or "" for t in texts])).tolist() == [fingerprint(t) for t in texts]


def test_references_tell_groups():
    """The coordinates of a group are different for all of its values, and the same whatever other groups hold."""
    rng = np.random.default_rng(0)
    for g in range(S.GROUPS):
        seen = {}
        for value in range(16):
            others = rng.integers(0, 1 << 63, 20).astype(np.uint64) & np.uint64(~(15 << (4 * g)) & (1 << 64) - 1)
            x = others | np.uint64(value << (4 * g))
            table = S.distances(x)
            own = table[:, 32 + 4 * g : 36 + 4 * g] - table[:, :1]
            assert len({tuple(r) for r in own.tolist()}) == 1
            seen[tuple(own[0].tolist())] = value
        assert len(seen) == 16
    for path in range(216):
        assert len(set(S._agreed(path, 3))) == 14


def planted(seed, n):
    """Fingerprints with chains, dense balls and strays at every distance."""
    rng = random.Random(seed)
    out = [0, 1, 3, 7, (1 << 64) - 1]
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 1, 3])):
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 4])):
                x ^= 1 << b
            out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))) for _ in range(n)]
    out += [centre ^ rng.getrandbits(20) << 7 for _ in range(n)]
    rng.shuffle(out)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("crowd", [2, 10, 256])
def test_links_against_all_pairs(spark, crowd):
    fps = planted(crowd, 300)
    want = by_hand(fps)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    tables = Tables(spark)
    labels = {r.v % (1 << 64): r.c for r in components(S.links(rows, tables, crowd), tables).collect()}
    got: dict = {}
    same = [got.setdefault(labels.get(x, ("alone", x)), i) for i, x in enumerate(fps)]
    assert same == want


def test_documents(spark):
    rng = random.Random(9)
    rows = documents(8, n=80, words=300)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 150]
    for i, t in enumerate(long[:20]):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        rows += [(1000 + i, " ".join(words), "en", "s", 0), (2000 + i, t.upper().replace(" ", "\n"), "en", "s", 0)]
    rows += [(rows[0][0], "another text of that id", "en", "s", 0), (None, long[0], "en", "s", 0), (None, "only here, without an id", "en", "s", 0)]
    want = by_hand([fingerprint(r[1]) for r in rows])
    least: dict = {}
    for root, r in zip(want, rows, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((str(r[0]), fingerprint(r[1]), str(least.get(root))) for root, r in zip(want, rows, strict=True))
    for df in (frame(spark, rows), with_clashes(frame(spark, rows))):
        got = S.near_duplicates(df, Tables(spark)).collect()
        assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    assert sum(a[2] != a[0] for a in want) > 10


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS), Tables(spark)).count() == 0
