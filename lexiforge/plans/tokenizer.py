"""Queries on a unigram tokenizer that is trained on the documents: its pieces, the documents' ids by it, and how well it splits words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pieces as P
from ..operators import sequences as S
from ..operators import unigram as U
from .base import c, docs, kept, q

#: Pieces with the reserved ones and the bytes, and seeds of the training.
PIECES, SEEDS = 4096, 20_000
#: Endings of inflected words in the documents' languages.
ENDINGS = ("s", "es", "en", "er", "ed", "ing", "ly", "ment", "ion", "keit", "ung", "ó", "a", "o")


def reserved(s) -> tuple[str, ...]:
    """The reserved pieces in order of their slots."""
    return tuple(r.piece for r in S.slot_layout(s).orderBy("id").collect())


def trained(s, d) -> tuple[U.Training, tuple[str, ...]]:
    own = reserved(s)
    # A word costs far more than its bytes tell, so the table is dealt to all cores.
    words = kept(U.word_table(docs(s, d), reserved=own).repartition(4 * s.sparkContext.defaultParallelism))
    return U.train(words, PIECES - 4 - len(own) - 256, SEEDS, kept=kept), own


def encoder(s, d) -> U.Encoder:
    training, own = trained(s, d)
    return U.Encoder(U.vocabulary(training.pieces, own))


def _pieces(s, d):
    training, own = trained(s, d)
    rows = [(i, p, round(score, 6), kind) for i, p, score, kind in U.vocabulary(training.pieces, own)]
    return s.createDataFrame(rows, "id long, piece string, score double, kind string")


def _encoded(s, d):
    rows = encoder(s, d).column(docs(s, d).select("doc_id", "text"), "text")
    return rows.select("doc_id", c(F.size("ids"), "n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").cast("binary")).alias("digest"))


def _morphemes(s, d):
    words = docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct()
    return P.morpheme_accuracy(encoder(s, d).segmented(U.morpheme_cases(kept(words), ENDINGS)))


# Expectation maximisation and best paths are held against plain loops in tests.
q("unigram_pieces", _pieces)
q("unigram_encoded", _encoded)
q("unigram_morphemes", _morphemes)
