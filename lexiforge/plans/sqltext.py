"""Pieces of SQL that several queries are held against, as functions of SQL expressions."""

from __future__ import annotations

from .. import lang
from ..functions import text as T
from ..operators import datasets as D
from ..operators import sequences as S

A, B = lang.WORD_A.replace("'", "''"), lang.WORD_B.replace("'", "''")


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def draw(seq: str, kind: str, part: int, modulus: int) -> str:
    return f"CAST('0x' || substr(md5('{kind}:' || ({seq})), {1 + 10 * part}, 10) AS BIGINT) % {modulus}"


def keys(word: str) -> str:
    """The keypress pieces of a word, as one text."""
    letters = f"list_filter(string_split(upper(strip_accents(replace({word}, 'ß', 'ss'))), ''), lambda x: regexp_matches(x, '^[A-Z]$'))"
    return f"array_to_string(list_transform({letters}, lambda x: '<CHAR_' || x || '>'), '')"


def triple(typed: str, meant: str) -> str:
    return f"('<XBU>' || {keys(typed)} || '<XBC>' || {meant} || '<XEC>')"


def transpose(w: str, i: str) -> str:
    return f"CASE WHEN length({w}) < 3 THEN {w} ELSE {w}[1:{i}] || {w}[{i} + 2] || {w}[{i} + 1] || {w}[{i} + 3:] END"


def delete(w: str, i: str) -> str:
    return f"CASE WHEN length({w}) <= 2 THEN {w} ELSE {w}[1:{i}] || {w}[{i} + 2:] END"


def double(w: str, i: str) -> str:
    return f"{w}[1:{i}] || {w}[{i} + 1] || {w}[{i} + 1] || {w}[{i} + 2:]"


def insert(w: str, i: str, letter: str) -> str:
    return f"{w}[1:{i}] || {letter} || {w}[{i} + 1:]"


def adjacent(w: str, i: str, k: str) -> str:
    c = f"{w}[{i} + 1]"
    near = f"CASE lower({c}) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in lang.ADJACENT.items())} END"
    new = f"(({near})[({k}) % length({near}) + 1])"
    return f"CASE WHEN {near} IS NULL THEN {w} ELSE {w}[1:{i}] || CASE WHEN {c} = lower({c}) THEN {new} ELSE upper({new}) END || {w}[{i} + 2:] END"


def shortcut(w: str, seq: str) -> str:
    forms = f"CASE lower({w}) {' '.join(f"WHEN '{k}' THEN {list(v)}" for k, v in lang.SHORTCUTS.items())} END"
    form = f"({forms})[{draw(seq, 'alias', 1, T.ANY)} % len({forms}) + 1]"
    cased = f"CASE WHEN {w}[1] <> lower({w}[1]) THEN upper(({form})[1]) || ({form})[2:] ELSE {form} END"
    return f"CASE WHEN {draw(seq, 'alias', 0, 100)} < {S.SHORTCUT_SHARE} THEN nullif({cased}, {w}) END"


def with_typos(name: str, source: str, word: str, seq: str) -> str:
    """CTEs that end in `name`: source with a column typed, without rows that have none."""
    tries = []
    drawn = [f"{draw(seq, f'typo{t}', j, m)} AS {c}{t}" for t in (1, 2) for j, m, c in ((0, 100, "r"), (1, T.ANY, "at"), (2, T.ANY, "k"))]
    n = f"greatest(length({word}), 1)"
    for t in (1, 2):
        i = f"CAST(at{t} % {n} AS INT)"
        made = [
            f"strip_accents({word})",
            adjacent(word, i, f"k{t}"),
            transpose(word, f"CAST(at{t} % greatest(length({word}) - 1, 1) AS INT)"),
            delete(word, i),
            insert(word, f"CAST(at{t} % ({n} + 1) AS INT)", f"'abcdefghijklmnopqrstuvwxyz'[k{t} % 26 + 1]"),
            double(word, i),
        ]
        ladder = " ".join(f"WHEN r{t} < {b} THEN {m}" for b, m in zip(lang.RULE_BOUNDS, made, strict=True))
        tries.append(f"nullif(CASE {ladder} END, {word}) AS try{t}")
    ok = f"length({word}) >= 2 AND regexp_matches({word}, '{lang.ELIGIBLE.replace(chr(39), chr(39) * 2)}')"
    return f"""{name}_drawn AS MATERIALIZED (SELECT *, {', '.join(drawn)}, {shortcut(word, seq)} AS alias FROM {source} WHERE {ok}),
{name}_tried AS MATERIALIZED (SELECT *, {', '.join(tries)} FROM {name}_drawn),
{name} AS MATERIALIZED (SELECT *, coalesce(alias, try1, try2) AS typed FROM {name}_tried WHERE coalesce(alias, try1, try2) IS NOT NULL)"""


#: word, cnt and i of all words seen three times.
WORDS = f"""w AS MATERIALIZED (SELECT word, cnt, row_number() OVER (ORDER BY word) AS i FROM (
  SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(text, '{A}'))) AS word FROM documents) t GROUP BY word HAVING count(*) >= 3) g)"""


def sampled(name: str, n: int, at: str) -> str:
    """CTEs that end in `name`: i and word of n draws at `at`, an expression of i."""
    return f"""{name}_cells AS MATERIALIZED (SELECT word, ln(cnt + 1) AS wt, sum(ln(cnt + 1)) OVER (ORDER BY word) AS hi, sum(ln(cnt + 1)) OVER () AS total FROM w),
{name} AS MATERIALIZED (SELECT i, word FROM (SELECT range AS i, {at} AS u FROM range({n})) r JOIN {name}_cells ON u >= (hi - wt) / total AND u < hi / total)"""


def symbol_ids(text: str) -> str:
    """The ids of a text by symbols, between the marks."""
    one = f"CASE WHEN length(x) = 1 THEN unicode(x) + {lang.FIRST_FREE} WHEN x = '<XBU>' THEN {lang.XBU} WHEN x = '<XBC>' THEN {lang.XBC} WHEN x = '<XEC>' THEN {lang.XEC} ELSE unicode(x[7]) - 65 + {lang.CHAR_A} END"
    return f"list_concat(list_concat([{lang.BOS}], list_transform(regexp_extract_all({text}, '{lang.SYMBOL}'), lambda x: {one})), [{lang.EOS}])"


INLINE = lang.INLINE.replace("'", "''")
#: doc_id and corrupted of all documents.
CORRUPTED = f"""tok AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS ws FROM documents) t),
cores AS MATERIALIZED (SELECT doc_id, place, word, regexp_extract(word, '{INLINE}', 2) AS core, concat(doc_id, '.', place) AS k FROM tok),
chosen AS (SELECT * FROM cores WHERE core <> '' AND {draw('k', 'rate', 0, D.DRAWS)} < {int(lang.TYPO_RATE * D.DRAWS)}),
{with_typos('fixed', 'chosen', 'core', 'k')},
rewritten AS (SELECT t.doc_id, t.place, coalesce(regexp_extract(t.word, '{INLINE}', 1) || {triple('f.typed', 'f.core')} || regexp_extract(t.word, '{INLINE}', 3), t.word) AS word FROM tok t LEFT JOIN fixed f ON f.doc_id = t.doc_id AND f.place = t.place),
corrupted AS MATERIALIZED (SELECT d.doc_id, coalesce(r.corrupted, '') AS corrupted FROM documents d LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS corrupted FROM rewritten GROUP BY doc_id) r ON r.doc_id = d.doc_id)"""


def chunks(name: str, source: str, length: int) -> str:
    """CTEs that end in `name`: chunk, p (from 1) and id of a source's rows (doc_id, ids), packed."""
    return f"""{name}_ids AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM {source}),
{name}_flat AS (SELECT id, row_number() OVER (ORDER BY doc_id, place) - 1 AS n FROM {name}_ids),
{name} AS MATERIALIZED (SELECT CAST(n // {length} AS BIGINT) AS chunk, n % {length} + 1 AS p, id FROM {name}_flat WHERE n < (SELECT count(*) FROM {name}_flat) // {length} * {length})"""


def span_weights(name: str, source: str, key: str, low: float) -> str:
    """CTEs that end in `name`: a source's rows (key, p, id) with w, 1 inside of inline corrections."""
    return f"""{name}_last AS (SELECT *, max(CASE WHEN id = {lang.XBU} THEN p END) OVER (PARTITION BY {key} ORDER BY p) AS begun, max(CASE WHEN id = {lang.XEC} THEN p END) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM {source}),
{name} AS (SELECT *, CASE WHEN begun IS NOT NULL AND (ended IS NULL OR begun > ended) THEN 1.0 ELSE {low} END AS w FROM {name}_last)"""
