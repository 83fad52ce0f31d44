"""Encoding with public tokenizers, many texts at once.

Both vocabularies split texts at ASCII spaces before they merge bytes, so the ids of a text are those of its pieces in order. The library encodes each distinct piece of a block once, many of them in one string (calls and long strings cost it more than the merges), and a worker keeps some for its next blocks. Where a piece's ids end in such a string is told by the ids: in one vocabulary by pieces that begin with the space, in the other by tokens that end a word, for pieces that are a word with or without a stop or comma, and for the rest by a control character set between pieces. Texts in which a cut at a space could matter (runs of white space, other Unicode spaces, the string of an added token) go to the library whole. Tests hold the ids against the library's own.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

END_ID = 2
#: A text with one of these is encoded whole: white space next to a space, white space outside ASCII, or the mark.
_ODD = r"\x01|(^|[\x09-\x0D ])[\x09-\x0D ]|[\x09-\x0D ]$|[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Pieces whose ids a worker keeps between blocks; none of them is longer than KEEP_BYTES.
KEEP, KEEP_BYTES = 200_000, 64
#: Text bytes that a worker encodes at once; pieces in one string.
ENCODE_BYTES, TOGETHER = 4_000_000, 64
MARK = "\x01"
#: Pieces of one word, or of two with the stop or comma.
_SIMPLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_loaded: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The library's tokenizer of a file, and the pieces that a worker knows."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        # Any case: a vocabulary may look for its added tokens in normalised text.
        added = [regex.sub(r"([^\w\s])", r"\\\1", t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.whole = "|".join([_ODD, *(f"(?i:{a})" for a in added)])
        # Ids of pieces that begin with a space, if the vocabulary writes it; else the id of the mark.
        plain = self.library.encode(" a b", add_special_tokens=False)
        vocabulary = self.library.get_vocab()
        if len(plain.ids) == 2 and all(t.startswith("Ġ") for t in plain.tokens):
            self.space = " "
            self.begins, self.mark = np.zeros(max(vocabulary.values()) + 1, bool), None
            self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        else:
            self.space = ""
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            (self.mark,) = self.library.encode(f"a {MARK} b", add_special_tokens=False).ids[1:-1]
        self.keep = KEEP
        self.known: tuple = (pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        ids, sizes = [], []
        for i in range(0, len(texts), 2048):  # an Encoding is many times its ids
            lists = [e.ids for e in self.library.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _joined(self, pieces: list[str], between: str, after: str = "") -> np.ndarray:
        return self.texts([f"{self.space}{between.join(pieces[j : j + TOGETHER])}{after}" for j in range(0, len(pieces), TOGETHER)])[0]

    def _beginning(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(pieces, " ")
        return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))

    def _simple(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(pieces, " ")
        words = np.fromiter((1 + (x[-1] in ".,") for x in pieces), np.int64, len(pieces))
        ends, last = np.flatnonzero(self.ends[ids]), np.cumsum(words) - 1
        return ids, np.diff(np.append(-1, ends[last])) if len(ends) == words.sum() else words[:0]

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(pieces, f" {MARK} ", f" {MARK}")
        marks = ids == self.mark
        return ids[~marks], np.diff(np.append(-1, np.flatnonzero(marks))) - 1

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that follow a space, and how many each has. No piece has white space at an end, or the mark."""
        if self.mark is None:
            return self._by(self._beginning, pieces.to_pylist())
        simple = np.asarray(pc.match_substring_regex(pieces, _SIMPLE))
        a, na = self._by(self._simple, pieces.filter(pa.array(simple)).to_pylist())
        b, nb = self._by(self._marked, pieces.filter(pa.array(~simple)).to_pylist())
        at = np.argsort(np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple))))
        lists = _lists(np.concatenate((a, b)), np.concatenate((na, nb))).take(pa.array(at))
        return np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists), dtype=np.int64)

    def _by(self, how, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Some pieces at a time; each by itself where the ids of a string do not fall into as many parts."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), TOGETHER * 64):
            some = pieces[i : i + TOGETHER * 64]
            got, size = how(some)
            if len(size) != len(some) or size.sum() != len(got) or (size < 1).any():
                got, size = self.texts([f" {x}" for x in some])
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that follow a space, and the number of each piece among them."""
        known, values, sizes = self.known
        found = pc.index_in(pieces, value_set=known)
        new = pieces.filter(pc.is_null(found))
        a, na = self.pieces(new.cast(pa.string()))
        at = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        at[at < 0] = len(known) + np.arange(len(new))
        values, sizes = np.concatenate((values, a)), np.concatenate((sizes, na))
        if len(known) + len(new) <= self.keep and (not len(new) or pc.max(pc.binary_length(new)).as_py() <= KEEP_BYTES):
            self.known = (pa.concat_arrays([known, new.cast(pa.string())]), values, sizes)
        elif len(pieces) <= self.keep:  # what this block has, from now on
            some = np.asarray(pc.less_equal(pc.binary_length(pieces), KEEP_BYTES))
            kept = _lists(values, sizes).take(pa.array(at[some]))
            self.known = (pieces.filter(pa.array(some)).cast(pa.string()), np.asarray(kept.flatten()), np.asarray(pc.list_value_length(kept), dtype=np.int64))
        return values, sizes, at


def load(path: str, special_as_text: bool = False) -> Encoder:
    if (path, special_as_text) not in _loaded:
        _loaded[path, special_as_text] = Encoder(path, special_as_text)
    return _loaded[path, special_as_text]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def encode(path: str, text: pa.Array, end_id: int | None = END_ID, special_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint32), and where each text's ids begin, with the end. No text may be null. end_id closes each text unless None. The string of an added token is that token, or ordinary text if special_as_text."""
    e = load(path, special_as_text)
    text = text.cast(pa.string())
    odd = np.asarray(pc.match_substring_regex(text, e.whole))
    pieces = pc.split_pattern(text.filter(pa.array(~odd)), " ")
    bounds = np.asarray(pieces.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    coded = pieces.flatten().dictionary_encode()
    codes, firsts = np.asarray(coded.indices), bounds[:-1]
    values, sizes, at = e.spaced(coded.dictionary)
    parts = [
        (values, sizes),
        e.texts(coded.dictionary.take(pa.array(codes[firsts])).to_pylist()),  # the first piece of a text has no space before it
        e.texts(text.filter(pa.array(odd)).to_pylist()),
        (np.array([] if end_id is None else [end_id], np.uint32), np.ones(int(end_id is not None), np.int64)),
    ]
    base = np.cumsum([0] + [len(p[1]) for p in parts])
    codes = at[codes]
    codes[firsts] = base[1] + np.arange(len(firsts))
    # The order of list numbers over all texts: a plain text's pieces, an odd text's single list, then the end.
    units = np.ones(len(text), np.int64)
    units[~odd] = np.diff(bounds)
    starts = np.append(0, np.cumsum(units + int(end_id is not None)))
    order = np.full(int(starts[-1]), base[3], np.int64)
    order[starts[:-1][odd]] = base[2] + np.arange(int(odd.sum()))
    order[np.repeat(starts[:-1][~odd] - bounds[:-1], np.diff(bounds)) + np.arange(len(codes))] = codes
    lists = _lists(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).take(pa.array(order))
    return np.asarray(lists.flatten()), np.asarray(lists.offsets, dtype=np.int64)[starts]
