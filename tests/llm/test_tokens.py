import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import packing, sharding, tokenfile, tokens
from lexiforge.llm.shared import Tables

from .fixtures import DOCS, documents, frame, with_clashes

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
HARD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "it's 's 't\n's", "Žižek  x́ y", "12 3 4x5 <|endoftext|> <|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x <|Startoftext|>c", "ab　 c", "naïve é ΑΣ ΑΣ. x\r\ny", "end\n", "\tfoo", "aaaaaaa aaaa", "İx Ⱥ Ȿ ß ǅ", "a b", "🙂 x🙂", "!!??!! a,b;c", "x\x00y"]


@cache
def library(path, special_as_text=False):
    """A tokenizer of its own, with the library's defaults."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return t


def ids_of(path, text, special_as_text=False):
    return library(path, special_as_text).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file", FILES)
def test_hard_texts(file):
    path = tokens.tokenizer_path(file)
    for special_as_text in (False, True):
        ids, ends = tokens.encode(path, pa.array(HARD), special_as_text=special_as_text)
        for i, t in enumerate(HARD):
            assert ids[ends[i] : ends[i + 1]].tolist() == ids_of(path, t, special_as_text), t
    assert (50256 if file == FILES[0] else 49407) in ids_of(path, "hello <|endoftext|> world")


@pytest.mark.parametrize("keep", [0, 3, 60])
def test_known_pieces_do_not_matter(keep, monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", keep)
    monkeypatch.setattr(tokens, "TOGETHER", 5)
    monkeypatch.setattr(tokens, "KEEP_BYTES", 6)
    monkeypatch.setattr(tokens, "_loaded", {})
    path = tokens.tokenizer_path(FILES[0])
    for seed in range(6):
        texts = [r[1] or "" for r in documents(seed, n=6)]
        ids, ends = tokens.encode(path, pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [ids_of(path, t) for t in texts]


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("aAbé' \n\t1,!ßĀ<|>"), st.characters(exclude_categories=("Cs",)))), max_size=6))
def test_equals_library(file, texts):
    path = tokens.tokenizer_path(file)
    ids, ends = tokens.encode(path, pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [ids_of(path, t) for t in texts]


def test_token_file(spark):
    path = tokens.tokenizer_path(FILES[1])
    rows = documents() + [(3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (None, "no id", None, None, None)]
    out = f"{Tables(spark).top}/t"
    tokenfile.write_tokens(with_clashes(frame(spark, rows)), out, path)
    got = [tuple(r) for r in tokenfile.token_digests(spark, out).collect()]
    want, start = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = ids_of(path, t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenfile.read_tokens(spark, out).filter("doc_id = 6").select("n_tokens").count() == 1


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_of_one_id(spark, hot):
    path = tokens.tokenizer_path(FILES[1])
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "z", "en", "s", 1)] + [(hot, f"{'word ' * (i % 9)}{i % 40}", "en", "s", 1) for i in range(300)]
    out = f"{Tables(spark).top}/t"
    tokenfile.write_tokens(frame(spark, rows), out, path, parts=8)
    read = sorted(((r.part, r.part_start, r.doc_id, r.ids) for r in tokenfile.read_tokens(spark, out).collect()), key=lambda r: r[:2])
    assert max(sum(r[0] == p for r in read) for p in {r[0] for r in read}) < 150
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r[2], r[3]) for r in read] == [(i, ids_of(path, t)) for i, t in order]
    starts = [0]
    for *_, ids in read:
        starts.append(starts[-1] + len(ids))
    got = sorted((r.start, r.doc_id is None, r.n_tokens, r.ids_crc32) for r in tokenfile.token_digests(spark, out).collect())
    assert got == [(s, r[2] is None, len(r[3]), crc(r[3])) for s, r in zip(starts, read, strict=False)]


def test_token_file_of_nothing(spark):
    out = f"{Tables(spark).top}/t"
    tokenfile.write_tokens(frame(spark, []), out, tokens.tokenizer_path(FILES[1]))
    assert tokenfile.token_digests(spark, out).count() == 0


def test_packing(spark):
    path = tokens.tokenizer_path(FILES[0])
    rows = documents() + [(3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (None, "no id", None, None, None)]
    df = with_clashes(frame(spark, rows))
    packed = packing.pack(df, path, Tables(spark))
    got = packed.collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(ids_of(path, t))
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_bin.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    for i, all_ids in ids.items():
        if len(all_ids) > 1:
            continue
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        at = 0
        for k, (p, s, n, c) in enumerate(pieces):
            assert (p, s) == (k, at) and c == crc(all_ids[0][s : s + n]) and (k == 0 or n == 1024)
            at += n
        assert at == len(all_ids[0]) and (len(pieces) == 1) == (at <= 1024)
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(by_bin) <= -(-total // 1024) + 1
    made = {r.sequence_id: r.ids for r in packing.sequences(df, packed, path).collect()}
    assert sum(map(len, made.values())) == total
    assert packing.pack(frame(spark, []), path, Tables(spark)).count() == 0


def test_best_fit_takes_fullest():
    assert packing.best_fit(np.array([6, 5, 4, 5, 10]), 10).tolist() in ([1, 2, 1, 2, 0],)


def test_best_fit_equals_brute_force():
    """The fullest bin with room takes each item, largest first; which of equally full bins does not matter to the fills."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        sizes = rng.integers(1, capacity + 1, rng.integers(0, 80))
        fills = []
        for n in sorted(sizes.tolist(), reverse=True):
            room = [(capacity - f, i) for i, f in enumerate(fills) if f + n <= capacity]
            if room:
                fills[min(room)[1]] += n
            else:
                fills.append(n)
        got = packing.best_fit(sizes, capacity)
        assert sorted(np.bincount(got, weights=sizes).astype(int).tolist() if len(sizes) else []) == sorted(fills)


def test_cuts_equal_brute_force():
    lengths = [1, 7, 8, 9, 16, 17, 40]
    owner, number, start, length = packing.cut(np.append(0, np.cumsum(lengths)), 8)
    want = []
    for i, n in enumerate(lengths):
        cuts = [0, *range(n - (n - 1) // 8 * 8, n, 8), n]
        want += [(i, k, a, b - a) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert list(zip(owner.tolist(), number.tolist(), start.tolist(), length.tolist(), strict=True)) == want


def test_rounds_of_packing_fill_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 40)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(n)), "en", "s", 1) for i, n in enumerate(rng.integers(1, 700, 400))]
    got = packing.pack(frame(spark, rows).repartition(12), tokens.tokenizer_path(FILES[0]), Tables(spark)).collect()
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sorted(r.doc_id for r in got) == list(range(400)) and max(fills.values()) <= 1024
    assert len(fills) <= 1.06 * -(-sum(fills.values()) // 1024)


def test_shards_equal_brute_force(spark):
    """The tree descended by plain loops, with the hashes of another library."""
    import math
    import struct

    import xxhash
    from pyspark.sql import functions as F

    def shard(key, node, seed):
        if node.shard is not None:
            return node.shard

        def draw(child):
            h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(child.name.encode(), h))
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / child.weight

        return shard(key, min((c for c in node.children if c.weight > 0), key=draw), seed)

    uneven = sharding.Node("root", children=(sharding.tree(2, 2, 3), sharding.Node("x", children=(sharding.Node("big", 12, 5.0), sharding.Node("none", 13, 0.0)))))
    for root in (sharding.tree(), sharding.grown(sharding.tree()), uneven):
        keys = [None, *range(0, 4000, 7), -5, 1 << 60]
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(F.col("k"), root).alias("s")).collect()
        assert {r.k: r.s for r in rows} == {k: shard(k, root, 7) for k in keys}


def test_selective_reads(spark, tmp_path):
    """Metadata alone, or the tokens of few documents, take a small part of the file's bytes."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(0, 5000)}" for _ in range(120)), "en", "s", 1) for i in range(20_000)]
    out = f"file://{tmp_path}/t"
    tokenfile.write_tokens(frame(spark, rows), out, tokens.tokenizer_path(FILES[1]), parts=2)
    whole = few = meta = groups = hit = 0
    for path in sorted((tmp_path / "t").glob("*.parquet")):
        f = pq.ParquetFile(path)
        assert f.metadata.row_group(0).column(3).has_offset_index
        for g in range(f.metadata.num_row_groups):
            columns = {f.metadata.row_group(g).column(c).path_in_schema.split(".")[0]: f.metadata.row_group(g).column(c) for c in range(f.metadata.num_columns)}
            size = {k: c.total_compressed_size for k, c in columns.items()}
            whole += sum(size.values())
            meta += size["n_tokens"]
            groups += 1
            low, high = columns["doc_id"].statistics.min, columns["doc_id"].statistics.max
            if low <= 77 <= high:
                hit += 1
                few += size["ids"] + size["doc_id"]
            assert "RLE_DICTIONARY" in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert meta < 0.02 * whole and hit == 1 < groups and few < 0.7 * whole
    assert tokenfile.read_tokens(spark, out).filter("doc_id = 77").count() == 1


def test_sharding(spark):
    rows = [(i, f"text {i % 50}", "en", "s", 6) for i in range(3000)] + [(5, "text 5", "en", "s", 1), (None, None, None, None, None)]
    df = sharding.shard_documents(with_clashes(frame(spark, rows)))
    got = df.collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
        assert r.size == (8 if r.doc_id is None else 8 + len(f"text {r.doc_id % 50}"))
        assert r.text_crc32 == (0 if r.doc_id is None else zlib.crc32(f"text {r.doc_id % 50}".encode()))
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(80 < len(v) < 175 for v in slots.values())
    assert 60 < sum(r.grown_shard == 24 for r in got) < 190
    cut = sharding.with_slots(frame(spark, rows).selectExpr("doc_id", "pmod(doc_id, 3) shard", "text"), "shard", ["doc_id", "text"], rows_a_bucket=100).collect()
    for s in range(3):
        here = [r.slot for r in cut if r.shard == s]
        assert sorted(here) == list(range(len(here)))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_weights_move_keys_only_into_what_grew(spark):
    small = sharding.tree(2, 1, 2)
    big = sharding.Node("root", children=(small.children[0], sharding.Node("r1", children=(sharding.Node("r1k0", children=(sharding.Node("s2", 2, 3.0), sharding.Node("s3", 3))),))))
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), small).alias("a"), sharding.shard_of(F.col("id"), big).alias("b")).collect()
    assert all(r.b >= 2 for r in rows if r.a != r.b)
    assert 0.42 < sum(r.b == 2 for r in rows) / 4000 < 0.58
