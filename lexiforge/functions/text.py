"""Column functions on texts and words. All are built-in expressions; none is a UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lang

_WS = r"(?U)\s+"


def _plain_letters() -> tuple[str, str]:
    """Letters that are one base character with marks (Latin, Greek, Cyrillic), and their base characters."""
    found = []
    for c in map(chr, (*range(0xC0, 0x530), *range(0x1E00, 0x2000))):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            found.append((c, base))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


_MARKS = _plain_letters()


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often it is used: explode() of one value keeps the optimizer from writing the expression out again at each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_runs(text: Column) -> Column:
    return matches(F.coalesce(text, F.lit("")), lang.WORD_RUN)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / lang.CHARS_A_TOKEN)).cast("bigint")


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WS, " "))


def strip_tags(text: Column) -> Column:
    return tidy(F.regexp_replace(F.coalesce(text, F.lit("")), lang.TAG, " "))


def strip_noise(text: Column) -> Column:
    """URLs, forwarding prefixes, mentions, hash signs, pictographs and entities go, in this order."""
    x = F.regexp_replace(text, r"https?://(?U:\S+)|www\.(?U:\S+)", " ")
    edge = r"[\p{L}\p{N}_]"
    x = F.regexp_replace(x, rf"(?iu)(?<!{edge})(?:rt|via)(?!{edge})(?U:\s*)(?:@{edge}+(?U:\s*))?:?(?U:\s*)", " ")
    x = F.regexp_replace(x, lang.MENTION, " ")
    x = F.regexp_replace(x, lang.HASHTAG, "$1")
    x = F.regexp_replace(x, f"[{lang.EMOJI_RANGES}]+", " ")
    return tidy(F.regexp_replace(x, lang.ENTITY, " "))


def hits(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon))).cast("bigint")


# The gates take a text, or its word_runs as `runs` where several of them look at one text.


def foreign_hits(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return hits(word_runs(text) if runs is None else runs, p.foreign)


def own_hits(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return hits(F.transform(word_runs(text) if runs is None else runs, F.lower), p.own)


def n_runs(text: Column, runs: Column | None = None) -> Column:
    return F.size(word_runs(text) if runs is None else runs).cast("bigint")


def foreign_ratio(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return F.coalesce(F.try_divide(foreign_hits(text, p, runs), n_runs(text, runs)), F.lit(0.0))


def likely_own(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return ~((foreign_hits(text, p, runs) > lang.FOREIGN_HITS) & (own_hits(text, p, runs) == 0))


def strictly_own(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return likely_own(text, p, runs) & (foreign_ratio(text, p, runs) <= lang.FOREIGN_SHARE)


def is_junk(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _WS), lambda w: w != "")).cast("bigint")


def keepable(text: Column, p: lang.Profile = lang.DEFAULT, runs: Column | None = None) -> Column:
    return ~is_junk(text) & (n_words(text) >= lang.MIN_WORDS) & strictly_own(text, p, runs)


def scale_count(count: Column, top: Column) -> Column:
    """Counts on a log scale of 1 to 255; rounding is half-even."""
    f = F.lit(float(lang.SCALE_TOP)) - F.log(top / count) / F.log(F.lit(lang.SCALE_BASE))
    return F.when(count <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(lang.SCALE_TOP), F.bround(f, 0).cast("int")))).cast("bigint")


def strip_marks(word: Column) -> Column:
    """Letters without their marks. Most words are ASCII, and a search is cheaper than a replacement."""
    return F.when(word.rlike(r"[^\x00-\x7f]"), F.translate(F.regexp_replace(word, r"\p{Mn}", ""), *_MARKS)).otherwise(word)


def key_letters(word: Column) -> Column:
    """The letters of a word that have a key, as upper-case text."""
    return F.regexp_replace(F.upper(strip_marks(word)), "[^A-Z]", "")


def keys_text(word: Column) -> Column:
    """The keypress pieces of a word, as one text."""
    return F.regexp_replace(key_letters(word), "([A-Z])", "<CHAR_$1>")


def keypresses(word: Column) -> Column:
    return matches(keys_text(word), "<CHAR_[A-Z]>")


def char_ids(word: Column) -> Column:
    return F.transform(matches(key_letters(word), "[A-Z]"), lambda c: F.lit(lang.CHAR_A - 65) + F.ascii(c))


def triple(typed: Column, meant: Column) -> Column:
    return F.concat(F.lit("<XBU>"), keys_text(typed), F.lit("<XBC>"), meant, F.lit("<XEC>"))


def _parts(w: Column, i: Column) -> tuple[Column, Column, Column]:
    """What is before 0-based place i, the character there, and what follows."""
    return F.substring(w, F.lit(1), i), F.substring(w, i + 1, F.lit(1)), F.substring(w, i + 2, F.length(w))


def transpose(w: Column, i: Column) -> Column:
    a, c, rest = _parts(w, i)
    return F.when(F.length(w) < 3, w).otherwise(F.concat(a, F.substring(rest, 1, 1), c, F.substring(rest, F.lit(2), F.length(w))))


def delete(w: Column, i: Column) -> Column:
    a, _, rest = _parts(w, i)
    return F.when(F.length(w) <= 2, w).otherwise(F.concat(a, rest))


def double(w: Column, i: Column) -> Column:
    a, c, rest = _parts(w, i)
    return F.concat(a, c, c, rest)


def insert(w: Column, i: Column, letter: Column) -> Column:
    return F.concat(F.substring(w, F.lit(1), i), letter, F.substring(w, i + 1, F.length(w)))


def adjacent(w: Column, i: Column, k: Column) -> Column:
    """The i-th character becomes its k-th neighbour on the keyboard, in its case; without neighbours it stays."""
    a, c, rest = _parts(w, i)
    keys = F.create_map(*[x for key, near in lang.ADJACENT.items() for x in (F.lit(key), F.lit(near))])
    near = F.try_element_at(keys, F.lower(c))
    new = F.substring(near, F.pmod(k, F.length(near)).cast("int") + 1, F.lit(1))
    return F.when(near.isNull(), w).otherwise(F.concat(a, F.when(c == F.lower(c), new).otherwise(F.upper(new)), rest))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: for expressions inside of lambdas, which nothing else shares."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def draw(seq: Column, kind: str, part: int, modulus: int) -> Column:
    """A number below modulus (2^40 at most) from a sequence number, which may be a text: ten hex digits of a digest of kind and number, so draws of different kinds, parts or numbers do not follow each other, and none repeats with a period. Each kind has three parts. SQL can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{kind}:"), seq.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("bigint"), F.lit(modulus).cast("bigint"))


#: All that a draw can be.
ANY = 1 << 40


def typo_try(w: Column, seq: Column, t: int) -> Column:
    """Try number t at a typo by the weighted rules; the word itself where it changes nothing."""

    def made(d: Column) -> Column:
        r, at, k = F.get(d, F.lit(0)), F.get(d, F.lit(1)), F.get(d, F.lit(2))
        n = F.greatest(F.length(w), F.lit(1))
        i = F.pmod(at, n).cast("int")
        rules = (
            strip_marks(w),
            adjacent(w, i, k),
            transpose(w, F.pmod(at, F.greatest(F.length(w) - 1, F.lit(1))).cast("int")),
            delete(w, i),
            insert(w, F.pmod(at, n + 1).cast("int"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(k, F.lit(26)).cast("int") + 1, F.lit(1))),
            double(w, i),
        )
        out = rules[-1]
        for bound, m in reversed(list(zip(lang.RULE_BOUNDS[:-1], rules[:-1], strict=True))):
            out = F.when(r < bound, m).otherwise(out)
        return out

    return let(F.array(*(draw(seq, f"typo{t}", part, m) for part, m in enumerate((100, ANY, ANY)))), made)


def affixes(word: Column) -> tuple[Column, Column, Column]:
    """What precedes the letters of a word, the letters, and what follows."""
    p = r"^([^\p{L}']*)([\p{L}']+)([^\p{L}']*)$"
    return tuple(F.regexp_extract(word, p, k) for k in (1, 2, 3))


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), lang.FIRST_WORD, 0)


def normal_word(word: Column) -> Column:
    """A predicted word as it is compared: without the space mark, trimmed, lower-cased, without punctuation at its ends."""
    return F.btrim(F.lower(F.trim(F.replace(word, F.lit(lang.SPACE_MARK), F.lit("")))), F.lit(lang.WORD_EDGES))


def same_word(a: Column, b: Column, case: bool = False) -> Column:
    """Equality of words, without regard to case unless `case`."""
    return a == b if case else F.lower(a) == F.lower(b)


def padded_words(words: Column, n: int, start: int) -> Column:
    """Exactly n words: cut, or filled up with filler pieces numbered on from start."""
    short = F.greatest(F.lit(n) - F.size(words), F.lit(0))
    fill = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("<FUTO"), (i + start).cast("string"), F.lit(">")))
    return F.slice(F.concat(words, F.slice(fill, F.lit(1), short)), 1, n)


def with_space(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(w, F.lit(lang.SPACE_MARK)))


def finite(values: Column) -> Column:
    """An array without nulls, NaN and infinities."""
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def utc_stamp(at: Column) -> Column:
    """A timestamp as text in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp_ntz(at.cast("timestamp").cast("timestamp_ntz"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\t", a, b)


def unpaired(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "\t")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def symbol_ids(text: Column) -> Column:
    """Ids of a text by its symbols: a reserved piece (typed, corrected, end, a key) has its slot, any other character a number behind all slots."""
    pieces = matches(F.coalesce(text, F.lit("")), lang.SYMBOL)
    slot = lambda p: F.when(F.length(p) == 1, F.ascii(p) + lang.FIRST_FREE).when(p == "<XBU>", lang.XBU).when(p == "<XBC>", lang.XBC).when(p == "<XEC>", lang.XEC).otherwise(F.ascii(F.substring(p, 7, 1)) - 65 + lang.CHAR_A)
    return F.transform(pieces, lambda p: slot(p).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of two arrays' common prefix."""
    same = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size(a), F.size(b)) - 1, F.lit(0))), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))


def log_softmax(row: Column, i: Column) -> Column:
    top = F.array_max(row)
    return F.get(row, i) - top - F.log(F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
