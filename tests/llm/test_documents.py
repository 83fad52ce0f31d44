import random
import re

from lexiforge.llm import decontamination, linededup
from lexiforge.llm.shared import Tables

from .fixtures import documents, frame, with_clashes


def brute_lines(rows):
    """The rows (doc_id, text, ...) with recurring lines dropped, and each row's number of dropped lines."""
    mask = lambda line: re.sub(r"[^ ]*[0-9][^ ]*", "<*>", re.sub(r"^ | $", "", re.sub(r"[ \t-\r]+", " ", line)))
    masks = [[mask(x) for x in r[1].split("\n")] if r[1] is not None else [] for r in rows]
    docs = {}
    for r, ms in zip(rows, masks, strict=True):
        for m in ms:
            if len(m.split(" ")) >= 4 or re.search(r"[^\W\d_]", m):
                docs.setdefault(m, set()).add(r[0])
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    drop = {m: first(ids) for m, ids in docs.items() if len(ids) >= 3}
    leaves = {}
    for m in docs:
        w = m.split(" ")
        if len(w) >= 4:
            leaves.setdefault((len(w), *w[:3]), []).append(m)
    found = {}
    for (k, *_), kinds in leaves.items():
        d, n = min(k * 30 // 100, 7), k - 3
        groups = {}
        for m in kinds:
            w = m.split(" ")[3:]
            for s in range(d + 1 if n > d else 1):
                part = tuple(w[-(-s * n // (d + 1)) : -(-(s + 1) * n // (d + 1))]) if n > d else ()
                groups.setdefault((s, part), []).append(m)
        for group in groups.values():
            total = len(set().union(*(docs[m] for m in group)))
            votes = [{} for _ in range(k)]
            for m in group:
                for p, w in enumerate(m.split(" ")):
                    votes[p].setdefault(w, set()).update(docs[m])
            # Of two tokens in more than half of the documents, the one in more of them, or the greater.
            shape = [max(((len(v), w) for w, v in c.items() if 2 * len(v) > total and w != "<*>"), default=(0, None))[1] for c in votes]
            taken = [m for m in group if 100 * sum(a == b for a, b in zip(m.split(" "), shape, strict=True)) >= 70 * k]
            if len(group) > 1 and len(set().union(*(docs[m] for m in taken))) >= 3:
                ids = first({first(docs[m]) for m in taken})
                for m in taken:
                    found[m] = first({found.get(m, ids), ids})
    drop = found | drop
    out = []
    for r, ms in zip(rows, masks, strict=True):
        gone = [m in drop and r[0] != drop[m] for m in ms]
        text = None if r[1] is None else "\n".join(x for x, g in zip(r[1].split("\n"), gone, strict=True) if not g)
        out.append((r, text, sum(gone)))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    shapes = [[rng.choice(["we", "all", "see"]), "have", rng.choice(["a", "no"]), *(rng.choice("abcdefg") * 3 for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 26, 40])))] for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 9)):
            w = list(rng.choice(shapes))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(["x", "12", "yy", "z9z", "q"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) if rng.random() < 0.3 else " ".join(w))
        lines += rng.sample(["--", "All rights", "Menu", "", "4", "- 5 -"], rng.randint(0, 3))
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], (2, texts[9], "en", "s", 1), (None, texts[1], None, None, 1), (None, None, None, None, None), (90, None, "en", "s", None), (91, "", "en", "s", 0)]


def test_lines_equal_brute_force(spark):
    for seed in range(3):
        rows = line_rows(seed)
        got = sorted(repr((r.doc_id, r.text, r._n_dropped if "_n_dropped" in r else r.n_dropped)) for r in linededup.dedup_lines(frame(spark, rows).repartition(3), Tables(spark)).collect())
        want = brute_lines(rows)
        assert got == sorted(repr((r[0], t, n)) for r, t, n in want) and sum(n for *_, n in want) > 40


def test_lines(spark):
    # Lines that differ in one word only would be one generalised template; these differ in all words.
    own = [" ".join(f"{c}{w}" for w in ("lark", "moss", "pond", "reed", "silt")) for c in "abcdefgh"]
    texts = [f"All rights are reserved here\n{own[i]}\nPage {i} of 90 in all\nshort one\n--" for i in range(6)]
    texts += ["this line was written by Ann yesterday\n" + own[6], "this line was written by Bob yesterday", "this line was written by Eve yesterday"]
    texts += ["All rights are preserved here\n" + own[7]]  # a variant of a line that recurs as it is
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(50, None, "en", "s", None), (51, "", "en", "s", 0), (0, texts[0], "en", "s", 1), (None, texts[1], None, None, 1)]
    df = with_clashes(frame(spark, rows))
    out = linededup.dedup_lines(df, Tables(spark))
    assert linededup.count_columns(df) == ("__n_lines", "__n_dropped") or linededup.count_columns(df) == ("_n_lines", "_n_dropped")
    lines, dropped = linededup.count_columns(df)
    assert out.columns == [*df.columns, lines, dropped]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.text, r[lines], r[dropped], r.n_chars))
        assert r.n_dropped == 1 and r.part == 1
    assert sum(map(len, by.values())) == len(rows)
    assert by[0] == [(texts[0], 5, 0, len(texts[0]))] * 2
    for i in range(1, 6):
        left = f"{own[i]}\n--"
        assert by[i] == [(left, 5, 3, len(left))]
    assert by[6][0][0] == texts[6] and by[7][0][0] == "" and by[8][0][0] == "" and by[9][0][0] == own[7]
    assert by[50] == [(None, 0, 0, None)] and by[51] == [("", 1, 0, 0)]
    assert by[None][0][2] == 3
    assert linededup.dedup_lines(frame(spark, []), Tables(spark)).count() == 0


def test_a_document_with_several_variants_is_one(spark):
    one = "alpha beta gamma delta {} rho sigma"
    rows = [(1, "\n".join(one.format(w) for w in ("one", "two")), "en", "s", 1), (2, one.format("three"), "en", "s", 1)]
    assert [r.n_dropped for r in linededup.dedup_lines(frame(spark, rows), Tables(spark)).collect()] == [0, 0]
    rows += [(3, one.format("four") + "\nits own", "en", "s", 1), (3, "\n".join([one.format("five"), "its own"]), "en", "s", 1)]
    got = sorted((r.doc_id, r.n_dropped) for r in linededup.dedup_lines(frame(spark, rows), Tables(spark)).collect())
    assert got == [(1, 0), (2, 1), (3, 1), (3, 1)]
    assert sorted((r[0], n) for r, _, n in brute_lines(rows)) == got


def test_a_very_long_line(spark):
    line = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}" for i in range(6000))
    rows = [(i, f"{line} end{'xyz'[i]} {line}\nown {'xyz'[i]}", "en", "s", 1) for i in range(3)]
    assert [r.n_dropped for r in linededup.dedup_lines(frame(spark, rows), Tables(spark)).orderBy("doc_id").collect()] == [0, 1, 1]


def test_benchmark_items(spark):
    item = "the quick brown fox jumps over the lazy dog near river banks today"
    words = item.split()
    rows = documents() + [(9000, "x y z " * 500 + item.upper() + " w" * 300, "en", "s", 1), (9001, " ".join(words[:11]), "en", "s", 1), (9002, " ".join(words[:9]), "en", "s", 1), (9003, "tiny item", "en", "s", 1), (9000, item, "en", "s", 1), (None, item, None, None, None)]
    items = spark.createDataFrame([(1, item), (1, item), (2, "tiny item"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    df = with_clashes(frame(spark, rows).withColumnRenamed("source", "item"))
    got = sorted(tuple(r) for r in decontamination.contaminated(df, items, Tables(spark)).collect())
    assert got == [(9000, 1, 9, 9), (9003, 2, 1, 1)] or got == [(9000, 1, 9, 9), (9003, 2, 1, 1), (9001, 1, 7, 9)]
    left = decontamination.clean(frame(spark, rows), items, Tables(spark))
    left = left.collect()
    assert {9000, 9003, None} & {r.doc_id for r in left} == set() and len(left) == len(rows) - len(got) - 2
    clashing = with_clashes(frame(spark, rows))
    assert decontamination.clean(clashing, items, Tables(spark)).columns == clashing.columns
    assert decontamination.contaminated(frame(spark, []), items, Tables(spark)).count() == 0


def test_every_document_with_most_of_an_item_is_found(spark, monkeypatch):
    import random

    rng = random.Random(5)
    voc = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows = []
    for i in range(120):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 300))]
        part = rng.choice(items)[1].split()
        a, b = rng.randint(0, 3), rng.randint(0, 6)
        k = rng.randint(0, len(w))
        rows.append((i, " ".join(w[:k] + part[a : len(part) - b] + w[k:]), "en", "s", 1))

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(d, i, len(sh(t) & sh(x)), len(sh(x))) for d, t, *_ in rows for i, x in items if sh(x) and 100 * len(sh(t) & sh(x)) >= 80 * len(sh(x))}
    for limit in (500_000, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        got = {tuple(r) for r in decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), Tables(spark)).collect()}
        assert got == want and len(want) > 20
