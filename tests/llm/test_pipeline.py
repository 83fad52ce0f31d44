import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexiforge.llm import quality, tokens
from lexiforge.llm.shared import Tables

from .fixtures import DOCS, documents, frame, helper_names, with_clashes
from .test_documents import brute_lines, line_rows
from .test_jaccard import brute as brute_components
from .test_jaccard import near_copies
from .test_tokens import crc, ids_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = "the quick brown fox jumps over the lazy dog near river banks today"


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rows = [(i, t, *r) for i, (_, t, *r) in enumerate(documents(11, n=40))]
    rows += [(1000 + r[0], *r[1:]) for r in near_copies(3, 25)]
    rows += [((2000 + r[0]) if r[0] is not None else None, *r[1:]) for r in line_rows(2)]
    rows += [(3000 + i, f"clean words {i} {'abc'[i % 3]} {ITEM if i == 2 else ''} end", "en", "s", 9) for i in range(6)]
    rows += [(4000 + i, " ".join(f"SHOUT{k}!!!" for k in range(i, i + 30)), "en", "s", 9) for i in range(40)]
    rows += [(3000, "another text of this id", "en", "s", 1), (None, ITEM, None, None, None), (1003, None, "en", "s", None)]
    return rows


def brute(spark, rows, labels, items):
    """The documents that each stage leaves, and the pieces, by plain loops. Weights are those of the operator: its updates have tests of their own."""
    df = frame(spark, rows)
    weights = quality.fit(df, labels, quality.remainder(3, 1))
    scores = [float(quality.score_texts(weights, pa.array([r[1] or ""]))[0]) for r in rows]
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    left = [[*rows]]
    rows = [(r[0], t, r[2], r[3], len(t) if t is not None else None) for r, t, n in brute_lines(rows) if not (n and t == "")]
    left.append(rows)
    key = {}  # rows of one id with different texts are compared each by itself
    for r in rows:
        key.setdefault((r[0], r[1]), len(key))
    groups = brute_components([(k, t) for (_, t), k in key.items()])
    names = {}
    for (i, _), k in key.items():
        if i is not None:
            c = groups[k][1]
            names[c] = min(names.get(c, i), i)
    gone = {i for (i, _), k in key.items() if i is not None and names[groups[k][1]] != i}
    rows = [r for r in rows if r[0] not in gone]
    left.append(rows)
    sets = [shingles(x) for x in items]
    rows = [r for r in rows if not any(x and 100 * len(shingles(r[1]) & x) >= 80 * len(x) for x in sets)]
    left.append(rows)
    return left


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(not 4000 <= i < 5000), 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    for name, df in (("documents", with_clashes(frame(spark, rows))), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    left = brute(spark, rows, labels, [ITEM, None, ""])
    assert [len(x) for x in left] != [len(rows)] * 4 and len(left[0]) == len(rows) - 40
    docs, tables = spark.read.parquet(f"{tmp_path}/documents.parquet"), Tables(spark)
    columns = docs.columns
    order = lambda x: sorted(x, key=repr)
    for k, (want, (_, stage)) in enumerate(zip(left, corpus_pipeline.STAGES, strict=False)):
        docs = tables.put(stage(spark, docs, str(tmp_path)), f"s{k}")
        assert docs.columns == columns
        got = docs.collect()
        assert order((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == order(tuple(r) for r in want), k
        assert all(r.part == 1 for r in got)
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    want = []
    for r in left[-1]:
        ids = ids_of(path, r[1])
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 1024 * 1024, len(ids), 1024), len(ids)]
        want += [(r[0], p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        assert np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() == [o for o, _ in sorted(spans)] and sum(n for _, n in spans) <= 1024


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_nothing_and_nulls(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_short_lines_that_recur_go(spark):
    texts = [f"All rights reserved.\n\nown {c} \n{n}" for n, c in enumerate("pqrs")]
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {n: t if n == 0 else t.removeprefix("All rights reserved.\n") for n, t in enumerate(texts)}


def test_clashes_are_of_the_code():
    assert {"_drop", "_doc", "_row", "_th"} & set(helper_names())
