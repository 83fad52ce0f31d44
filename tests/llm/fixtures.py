"""Small document tables with the cases that every operator must stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60, words=60, vocabulary=40):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randint(1, words))) for _ in range(n)]
    texts += [texts[0], texts[1], texts[1] + " more", None, "", "  ", "\n", "one", "two words", "a\tb\n\nc  d ", "x" * 3000, " ".join(rng.choice(voc) for _ in range(4000))]
    rng.shuffle(texts)
    return [(i * 3, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def helper_names():
    """The names of columns that the operators make for themselves, from their code."""
    import pathlib
    import re

    import lexiforge.llm

    top = pathlib.Path(lexiforge.llm.__file__).parent
    return sorted({n for f in top.glob("*.py") for n in re.findall(r"[\"'.](_[a-z][a-z_0-9]*)[\"']", f.read_text())})


def with_clashes(df):
    """The table with more columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["part", "shard", "slot", "words", "n", "key", "size", "bucket", "score", "rank", "line_no", "item_id", "class", "component_id", "value", "pos", "doc", "nth", "spans", "asked", "entry", "comp", "token", "law", "start", "piece", "length", "fill", "members", "mix", "sequence_id", "n_lines", "n_dropped", "n_words", "held_out", "predicted", "y", "digest", "kind", "data", "s", "t"]
    return df.select("*", *[F.lit(1).alias(c) for c in [*names, *helper_names()] if c not in df.columns])
