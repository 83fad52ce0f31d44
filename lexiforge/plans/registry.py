"""All queries over the operators, and their SQL."""

from __future__ import annotations

from . import corpus, evaluations, language, sequences, spelling, tokenizer, typos, vocabulary  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "dictionary"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
