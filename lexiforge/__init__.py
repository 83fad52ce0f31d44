"""Corpus analytics on Spark: cleaning, vocabularies, typo pairs, token sequences and evaluation as DataFrame operators."""
