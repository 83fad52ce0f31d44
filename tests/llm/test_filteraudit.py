"""The filter audit against a simulation of every order."""

from itertools import permutations

from lexiforge.llm import filteraudit
from lexiforge.llm.shared import Tables

from .fixtures import DOCS, frame, with_clashes

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = ["A"] * (len(words) < 200) + ["B"] * (100 * len(set(words)) < 50 * len(words)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + ["D"] * any(c in "#$%&*|" for c in text)
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs):
            fails.append("E")
        rows.append((lang or "", doc_id, frozenset(fails)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[2]]
                kept = [r for r in left if f not in r[2]]
                fails = [r for r in mine if f in r[2]]
                out[part, "".join(order), step + 1] = [len(kept), len(gone), len(fails) - len(gone), sum(r[2] == {f} for r in mine), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
                left = kept
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG + " A" * 40, "en"), (4, LONG + " #", "de"), (5, "a " * 300, "de"), (6, "a " * 300 + "$", None), (7, None, None), (8, "", "en"), (9, "", ""),
    (2, LONG, "en"), (2, "twice the id", "en"), (None, LONG, "en"), (None, None, "fr"), (10, "É Z\x0bq r", "fr"), (11, "x" * 100_000, "fr"), (12, (LONG + " é" * 90 + " Q|") * 40, "de"),
]
ROWS = [(i, t, lang, "s", len(t or "")) for i, t, lang in ROWS]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (11, 1, 0), (8, 1, 1)]


def test_against_all_orders(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = by_hand(ROWS, LABELS)
    assert found(filteraudit.audit(frame(spark, ROWS), labels, Tables(spark))) == want
    assert len(want) == 600 * 4
    clash = with_clashes(frame(spark, ROWS))
    assert found(filteraudit.audit(clash, with_clashes(labels), Tables(spark))) == want


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(filteraudit.audit(frame(spark, ROWS), none, Tables(spark))) == by_hand(ROWS, [])
    assert filteraudit.audit(spark.createDataFrame([], DOCS), none, Tables(spark)).count() == 0


def test_lattice(spark):
    edges = spark.range(1).select(filteraudit.lattice().alias("e")).selectExpr("inline(e)").collect()
    steps = filteraudit.steps(spark).collect()
    assert len({(e.applied, e.next) for e in edges}) == 80 and len(steps) == 600
    taken = {}
    for s in steps:
        taken[s.applied, s.next] = taken.get((s.applied, s.next), 0) + 1
    assert taken == {(e.applied, e.next): e.paths for e in edges}
