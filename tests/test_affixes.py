import random
import re

from pyspark.sql import functions as F

from lexiforge.operators import affixes as A
from lexiforge.sources import lexicon

STEMS, RULES = "stem string, flag string", "kind string, flag string, strip string, gain string, cond string, cross boolean"


def fits(word, rule):
    _, _, strip, _, cond, _ = rule
    if rule[0] == "S":
        return word.endswith(strip) and re.search(f"(?:{cond})$", word)
    return word.startswith(strip) and re.search(f"^(?:{cond})", word)


def put(word, rule):
    kind, _, strip, gain, _, _ = rule
    return word[: len(word) - len(strip)] + gain if kind == "S" else gain + word[len(strip) :]


def forms(stems, rules):
    """All forms of each stem, by loops."""
    flags = {}
    for s, f in stems:
        flags.setdefault(s, set()).add(f)
    out = set()
    for s, fs in flags.items():
        out.add((s, s))
        mine = [r for r in rules if r[1] in fs and r[1] is not None]
        for r in mine:
            if fits(s, r):
                out.add((s, put(s, r)))
        for a in (r for r in mine if r[0] == "S" and r[5] and fits(s, r)):
            mid = put(s, a)
            out.update((s, put(mid, b)) for b in mine if b[0] == "P" and b[5] and fits(mid, b))
    return out


def test_reversed_rules_accept_what_expansion_makes(spark):
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("aenr") for _ in range(rng.randint(0, n)))
    for _ in range(3):
        rules = sorted({(rng.choice("PS"), rng.choice("XYZ"), part(1), part(2), rng.choice(["", "[^a]", "a", "n", "[ae]"]), rng.random() < 0.6) for _ in range(14)})
        stems = [(part(4) + "n", rng.choice(["X", "Y", "Z", None])) for _ in range(40)]
        stems += [(s, "X") for s, _ in stems[:9]] + [stems[0]]
        want = forms(stems, rules)
        s, r = spark.createDataFrame(stems, STEMS), spark.createDataFrame(rules, RULES)
        assert {tuple(x) for x in A.expanded(s, r).collect()} == want
        words = sorted({f for _, f in want} | {part(7) for _ in range(300)})
        rows = spark.createDataFrame([(w,) for w in [*words, words[1], None, ""]], "word string")
        got = [x.word for x in A.accepted(rows, s, r).collect()]
        ok = {f for _, f in want if f}
        assert len(got) == len(set(got)) and set(got) == ok & set(words)
        assert {x.word for x in A.rejected(rows, s, r).collect()} == set(words) - ok - {""}


def test_case_forms(spark):
    s = spark.createDataFrame([("etxe", "A"), ("Ane", "A")], STEMS)
    r = spark.createDataFrame([("S", "A", "", "k", "", True)], RULES)
    words = ["etxe", "Etxe", "ETXEK", "eTxe", "Anek", "ANEK", "ane", "anek", "Etxera"]
    got = {x.word for x in A.accepted(spark.createDataFrame([(w,) for w in words], "word string"), s, r).collect()}
    assert got == {"etxe", "Etxe", "ETXEK", "Anek", "ANEK"}


def test_no_stems_and_no_rules(spark):
    words = spark.createDataFrame([("a",), (None,)], "word string")
    none, rules = spark.createDataFrame([], STEMS), spark.createDataFrame([], RULES)
    assert A.accepted(words, none, rules).collect() == []
    assert [x.word for x in A.rejected(words, none, rules).collect()] == ["a"]
    one = spark.createDataFrame([("a", None)], STEMS)
    assert [x.word for x in A.accepted(words, one, rules).collect()] == ["a"]


def test_files(spark, tmp_path):
    (tmp_path / "x.dic").write_text("3\netxe/AB\nmendi\nur/B po:noun\n\n")
    (tmp_path / "x.aff").write_text("SET UTF-8\n\nSFX A Y 2\nSFX A 0 k [^a]\nSFX A e ia/C e\nPFX B N 1\nPFX B 0 ber .\n")
    assert sorted((r.stem, r.flag or "") for r in lexicon.read_stems(spark, f"{tmp_path}/x.dic").collect()) == [("etxe", "A"), ("etxe", "B"), ("mendi", ""), ("ur", "B")]
    rules = lexicon.read_rules(spark, f"{tmp_path}/x.aff")
    assert sorted(map(tuple, rules.select("kind", "flag", "strip", "gain", "cond", "cross").collect())) == [("P", "B", "", "ber", "", False), ("S", "A", "", "k", "[^a]", True), ("S", "A", "e", "ia", "e", True)]
    long = spark.createDataFrame([("AaBb",)], "f string").select(lexicon._flags(F.col("f"), "long").alias("f")).first().f
    assert long == ["Aa", "Bb"]
