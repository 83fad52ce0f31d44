import re
from collections import Counter

from lexiforge import lang
from lexiforge.operators import backoff as K
from lexiforge.operators import evals as E
from lexiforge.operators import vocab as V

TEXTS = [None, "", "one", "Ba ba be", "be ba", "12 .", "ba BE bo ba be", "Ñu ñu d'e-f"] * 3


def test_pairs_are_counted_in_blocks_within_their_texts(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)
    want = Counter()
    for t in TEXTS:
        w = [x.lower() for x in re.findall(lang.WORD_B, t or "")]
        want.update(zip(w, w[1:]))
    assert {(r.w1, r.w2): r.cnt for r in V.bigram_counts(docs).collect()} == want


def test_reranked_pairs_are_dealt_by_their_first_word_once(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
        n = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (E.reranked(docs), E.mutual_information(docs))]
        pmi = {}
        for r in E.mutual_information(docs).collect():
            pmi.setdefault(r.w1, []).append((-r.pmi, r.w2))
        assert {r.w1: r.best for r in E.reranked(docs).collect()} == {w: min(x)[1] for w, x in pmi.items()}
    finally:
        spark.conf.set(key, before)
    assert n[0] == n[1]
