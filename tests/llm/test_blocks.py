"""Blocks of text, and operators over texts that are longer than a block, in one process."""

import numpy as np
import pyarrow as pa

from lexiforge.llm import jaccard, packing, substrings, tokens
from lexiforge.llm.shared import blocks, one

from .fixtures import documents
from .test_substrings import brute, planted


def batches(rows, size, **columns):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), **columns})
    return table.to_batches(max_chunksize=size)


def test_blocks_keep_all_rows_in_order():
    rows = documents(3)
    for size in (1, 4, 100):
        for most in (1, 50, 1000, 10**6):
            got = list(blocks(iter(batches(rows, size)), "text", most))
            assert [(i, t) for b in got for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)] == [(r[0], r[1] or "") for r in rows]
            for b in got:
                n = [len(t.encode()) for t in b["text"].to_pylist()]
                assert sum(n) - (n[-1] if n else 0) <= most
    assert list(blocks(iter([]), "text")) == []


def test_substrings_over_small_blocks(monkeypatch):
    """Edges, repeated edges and paths, with every text a block of its own or several of them in one."""
    for seed, most, parts in ((1, 1, 3), (2, 300, 1), (3, 2000, 7)):
        monkeypatch.setattr(substrings, "EDGE_BYTES", most)
        rows = planted(seed)
        zero = pa.array([0] * len(rows), pa.int64())
        table = pa.table({"doc": [r[0] for r in rows], "nth": zero, "text": pa.array([r[1] for r in rows], pa.string())})

        def dealt(found):
            by = {}
            for b in found:
                for i, p in enumerate(b.column("part").to_pylist()):
                    by.setdefault(p, []).append(b.slice(i, 1))
            return by.values()

        edges = dealt(substrings._edges(parts)(iter(table.to_batches(max_chunksize=5))))
        places = dealt(b for part in edges for b in substrings._settle(parts)(iter(part)))
        spans = [r for part in places for b in substrings._paths(iter(part)) for r in b.to_pylist()]
        words = {r[0]: substrings.split_words(pa.array([r[1] or ""]))[0].to_pylist() for r in rows}
        for s in spans:
            if s["src_pos"] is not None:
                n = s["n"] + substrings.WINDOW - 1
                assert words[s["doc"]][s["pos"] : s["pos"] + n] == words[s["src_doc"]][s["src_pos"] : s["src_pos"] + n]
                assert (s["src_doc"], s["src_pos"]) < (s["doc"], s["pos"])
        want = brute(rows)
        for i, w in words.items():
            gone = {p for s in spans if s["doc"] == i for p in range(s["pos"], s["pos"] + s["n"] + substrings.WINDOW - 1)}
            assert (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)) == (want[i][0], want[i][1], want[i][3])


def test_sets_and_pieces_do_not_depend_on_blocks(monkeypatch):
    rows = documents(5)
    whole, starts, cls = jaccard.shingle_sets(pa.array([r[1] or "" for r in rows]))
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    ids, ends = tokens.encode(path, pa.array([r[1] or "" for r in rows]))
    at = 0
    for block in blocks(iter(batches(rows, 3)), "text", 200):
        token, s, c = jaccard.shingle_sets(one(block["text"]))
        owner, cols = packing.pieces_of(one(block["text"]), path, 64, True)
        for k in range(len(block)):
            i = at + k
            assert token[s[k] : s[k + 1]].tolist() == whole[starts[i] : starts[i + 1]].tolist() and c[k] == cls[i]
            pieces = [x for o, x in zip(owner.tolist(), cols[-1].to_pylist(), strict=True) if o == k]
            assert [x for p in pieces for x in p] == ids[ends[i] : ends[i + 1]].tolist() and all(len(p) <= 64 for p in pieces)
        at += len(block)
    assert at == len(rows) and np.diff(starts).max() > 1000
