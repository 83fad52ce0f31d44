"""What column functions do to each character or word of long texts, over Arrow batches: inside of lambdas, Spark interprets built-in functions value by value. Results are those of functions.text and operators.sequences, and tests hold them together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from .. import lang
from . import text as T

#: Rows of a batch that are handled at once.
ROWS = 256


def added(df: DataFrame, text: str, out: str, kind: DataType, make) -> DataFrame:
    """df with a column that `make` gives for ROWS values of the text column at a time."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, make(part)], [*part.schema.names, out])

    make_of, make = make, lambda part: make_of(pc.fill_null(part.column(at), "").to_pylist(), part)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, kind)]))


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of so many rows at least, but for the last."""
    some, n = [], 0
    for batch in batches:
        some, n = [*some, batch], n + len(batch)
        if n >= rows:
            yield pa.concat_batches(some)
            some, n = [], 0
    if n:
        yield pa.concat_batches(some)


def symbol_ids(texts: list[str]) -> pa.ListArray:
    """text.symbol_ids of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    out, keep = codes + lang.FIRST_FREE, np.ones(len(codes), bool)
    opens = np.flatnonzero(codes == ord("<"))
    room = ends[np.searchsorted(ends, opens, "right")] - opens if len(opens) else opens
    padded = np.pad(codes, (0, 8))
    is_at = lambda i, word: np.logical_and.reduce([padded[i + j] == ord(c) for j, c in enumerate(word)])
    for piece, slot in (("<XBU>", lang.XBU), ("<XBC>", lang.XBC), ("<XEC>", lang.XEC)):
        here = opens[is_at(opens, piece) & (room >= 5)]
        out[here] = slot
        for j in range(1, 5):
            keep[here + j] = False
    letter = padded[opens + 6]
    here = opens[is_at(opens, "<CHAR_") & (letter >= 65) & (letter <= 90) & (padded[opens + 7] == ord(">")) & (room >= 8)]
    out[here] = padded[here + 6] - 65 + lang.CHAR_A
    for j in range(1, 8):
        keep[here + j] = False
    upto = np.concatenate(([0], np.cumsum(keep)))
    return pa.ListArray.from_arrays(pa.array(upto[np.concatenate(([0], ends)).astype(np.int64)], pa.int32()), pa.array(out[keep], pa.int32()))


_MARKS = str.maketrans(*T._MARKS)
_KEYS = {i: "".join(f"<CHAR_{u}>" for u in chr(i).translate(_MARKS).upper() if "A" <= u <= "Z") for i in range(0x100)}
_NOT_SPACES = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_INLINE = re.compile(lang.INLINE)


def words(text: str) -> list[str]:
    """A text's words between spaces of Unicode; Python's own split takes four control characters for spaces."""
    return [w for w in _SPACES.split(text) if w] if _NOT_SPACES.search(text) else text.split()


def _draws(kind: str, key: str) -> tuple[int, int, int]:
    """The three parts of text.draw."""
    d = md5(f"{kind}:{key}".encode()).digest()
    return int.from_bytes(d[:5]), int.from_bytes(d[5:10]), int.from_bytes(d[10:15])


def typo_try(w: str, key: str, t: int) -> str:
    """text.typo_try of a word of letters."""
    r, at, k = _draws(f"typo{t}", key)
    r, n = r % 100, len(w)
    accent, near, swap, left_out, put_in, _ = lang.RULE_BOUNDS
    i = at % n
    if r < accent:
        return w.translate(_MARKS)
    if r < near:
        c = w[i]
        keys = lang.ADJACENT.get(c.lower())
        if keys is None:
            return w
        new = keys[k % len(keys)]
        return w[:i] + (new if c == c.lower() else new.upper()) + w[i + 1 :]
    if r < swap:
        i = at % max(n - 1, 1)
        return w if n < 3 else w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]
    if r < left_out:
        return w if n <= 2 else w[:i] + w[i + 1 :]
    if r < put_in:
        i = at % (n + 1)
        return w[:i] + "abcdefghijklmnopqrstuvwxyz"[k % 26] + w[i:]
    return w[:i] + w[i] + w[i:]


def typed_of(w: str, key: str, share: int) -> str | None:
    """sequences.typed_of of a word of letters."""
    if len(w) < 2:
        return None
    forms = lang.SHORTCUTS.get(w.lower())
    if forms:
        first, which, _ = _draws("alias", key)
        if first % 100 < share:
            form = forms[which % len(forms)]
            form = form[:1].upper() + form[1:] if w[0] != w[0].lower() else form
            if form != w:
                return form
    for t in (1, 2):
        typed = typo_try(w, key, t)
        if typed != w:
            return typed
    return None


@lru_cache(1 << 16)
def _parts(w: str) -> tuple[str, ...] | None:
    m = _INLINE.fullmatch(w)
    return m and m.groups()


def inline_corrected(text: str, seq: str | None, below: int, draws: int, share: int) -> str:
    """datasets.inline_corrected of a text: words whose draw is less than `below` are written as typed and meant."""
    out = words(text)
    if seq is None:
        return " ".join(out)
    for at, w in enumerate(out):
        key = f"{seq}.{at}"
        if int.from_bytes(md5(f"rate:{key}".encode()).digest()[:5]) % draws < below and (parts := _parts(w)):
            before, core, after = parts
            typed = typed_of(core, key, share)
            if typed is not None:
                out[at] = f"{before}<XBU>{typed.translate(_KEYS)}<XBC>{core}<XEC>{after}"
    return " ".join(out)
