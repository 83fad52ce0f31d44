import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lexiforge.llm import substrings
from lexiforge.llm.shared import Tables, gram_hashes

from .fixtures import documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    texts = sorted(((i, WORD.findall(t or "")) for i, t, *_ in rows), key=lambda x: x[0])
    for i, w in texts:
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    out = {}
    for i, w in texts:
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (i, p):
                gone.update(range(p, p + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


def planted(seed):
    rng = random.Random(seed)
    rows = documents(seed, n=50, words=90)
    passage = " ".join(f"p{rng.randint(0, 9)}" for _ in range(70))
    out = []
    for i, t, *rest in rows:
        if t and rng.random() < 0.5:
            w = t.split(" ")
            k = rng.randint(0, len(w))
            a = rng.randint(0, 40)
            t = " ".join(w[:k] + passage.split(" ")[a : a + rng.randint(15, 60)] + w[k:])
        out.append((i, t, *rest))
    out.append((5000, "ab " * 200, "en", "s", 1))
    out.append((5001, "ab " * 30 + "cd " * 25 + "ab " * 30, "en", "s", 1))
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = planted(seed)
        got = substrings.dedup_substrings(with_clashes(frame(spark, rows).repartition(5)), Tables(spark), text_too=True).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_blocks_and_batches_do_not_matter(spark, monkeypatch):
    rows = planted(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = substrings.dedup_substrings(frame(spark, rows).repartition(3), Tables(spark), text_too=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_an_id_with_different_texts(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"{c}{rng.randint(0, 9)}{k}" for k in range(60)) for c in "ab")
    rows = [(7, a, "en", "s", 1), (7, "three words only", "en", "s", 1), (7, b, "en", "s", 1), (7, a, "en", "s", 1), (9, a + " " + b, "en", "s", 1), (3, b, "en", "s", 1)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(frame(spark, rows).repartition(3), Tables(spark), text_too=True).collect())
    assert got == [(3, 60, 0, b), (7, 3, 0, "three words only"), (7, 60, 0, a), (7, 60, 0, a), (7, 60, 60, ""), (9, 120, 120, "")]


def test_one_gram_in_very_many_windows(spark):
    gram = " ".join(f"hot{i}" for i in range(8))
    rows = [(i, " ".join([f"l{i}_{k}" for k in range(15)] + [gram] + [f"r{i}_{k}" for k in range(15)]), "en", "s", 1) for i in range(3000)]
    rows += [(5000, rows[1][1], "en", "s", 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows).repartition(6), Tables(spark)).collect()}
    assert got == {i: (38, 0) for i in range(3000)} | {5000: (38, 38)}


def test_spans_of_other_words_stay(spark, monkeypatch):
    """With a hash that tells nothing, every span is a false one until its words are compared."""
    rows = planted(2)

    def poor(h, k, seed=0):
        out = gram_hashes(h, k, seed)
        return out if seed != 1 else (out & np.uint64(0xFFFF)) | np.uint64(1 << 20)

    got = {}
    for name, f in (("real", gram_hashes), ("poor", poor)):
        edges = substrings._edges(1)
        monkeypatch.setattr(substrings, "gram_hashes", f)
        table = pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "nth": [0] * len(rows), "text": [r[1] for r in rows]})
        got[name] = [b for b in edges(iter([table])) if b.column("kind")[0].as_py() == substrings.SPANS]
    real, poor_ = ({(d, p + i) for b in got[k] for x in b.column("data") for (doc, _), (pos, n) in [substrings._opened(x.as_buffer(), 1)] for d, p, m in zip(doc.tolist(), pos.tolist(), n.tolist(), strict=True) for i in range(m)} for k in ("real", "poor"))
    assert poor_ <= real and len(real) > 100


def test_false_spans_are_found_at_their_source(spark, monkeypatch):
    rows = planted(5)
    real = substrings.repeated_spans
    doc = next(r[0] for r in rows if len(WORD.findall(r[1] or "")) > 45)

    def with_false(docs, tables, size):
        return real(docs, tables, size).unionByName(spark.createDataFrame([(doc, 0, 2, 20, rows[0][0], 0, 1), (doc, 0, 3, 9, 10**9, 0, 0)], substrings.SPAN))

    monkeypatch.setattr(substrings, "repeated_spans", with_false)
    got = substrings.dedup_substrings(frame(spark, rows), Tables(spark), text_too=True).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_repeated_rows_and_nulls(spark):
    text = " ".join(map(str, range(40)))
    rows = [(None, text, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, "en", "s", 1)]
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows), Tables(spark)).collect())
    assert got == [(False, None, 40, 0), (True, 1, 40, 40), (True, 1, 40, 40), (True, 2, 0, 0)]
    assert substrings.dedup_substrings(frame(spark, []), Tables(spark)).count() == 0
