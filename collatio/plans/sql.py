"""The normalisations as DuckDB expressions, for the oracle: look-arounds are written with groups."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from ..functions.lexicon import CURRENCY_ROWS, FINANCE_ROWS, HEADER_MARKERS, NUMBER, RATE_ROWS, SHARE_ROWS, TOKEN


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def proof(x: str) -> str:
    out = f"translate(coalesce({x}, ''), {q(chr(160) + '‘’“”–—•')}, {q(chr(32) + chr(39) * 2 + chr(34) * 2 + '---')})"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def text(x: str) -> str:
    out = proof(x)
    for symbol in "$€£¥~":
        out = f"replace({out}, {q(symbol + ' ')}, {q(symbol)})"
    return out


_names = count()


def once(x: str, use: Callable[[str], str]) -> str:
    """``use`` of an expression that is written, and computed, once."""
    v = f"v{next(_names)}"
    return f"list_transform([{x}], lambda {v}: {use(v)})[1]"


def no_marks(x: str) -> str:
    a = sub(text(x), r"^\s*\(?\d{1,2}\)?\s+([A-Za-z])", r"\1", "")
    b = lambda v: sub(sub(v, r"\(\s*\d{1,2}\s*\)\s*$", "", ""), r"([A-Za-z])\d{1,2}(\s*)$", r"\1\2", "")
    return strip(once(a, lambda v: f"CASE WHEN regexp_matches({v}, '[A-Za-z]') THEN {b(v)} ELSE {v} END"))


def key(x: str) -> str:
    out = sub(no_marks(x), r"\bwww\.", "", "gi")
    for pattern, to in ((r"([$€£¥~])\s+(\(?\d)", r"\1\2"), (r"\(\s+(\d)", r"(\1"), (r"(\d)\s+%", r"\1%"), (r"(\d)\s+\)", r"\1)"), (r"([+-])\s+(\d)", r"\1\2"), (r"\s+", " ")):
        out = sub(out, pattern, to)
    return f"lower(trim({out}))"


def row_key(x: str) -> str:
    out = sub(no_marks(x), r"^[\s'\"`‘’“”\-–—•]+", "", "")
    out = sub(sub(out, r"\(\s*\d+\s*\)"), r"\[\s*\d+\s*\]")
    return key(f"trim({sub(out, r'\s+', ' ')})")


def no_lead(x: str) -> str:
    bare = sub("l", r"^\s*[-–—•]+\s*", "", "")
    line = f"CASE WHEN regexp_matches({bare}, '(?i)^\\s*%?\\s*of total\\s*$') THEN {sub(bare, r'^\s*%+\s*', '', '')} ELSE {sub(bare, r'^\s*[%\-–—•]+\s*([A-Za-z])', r'\1', '')} END"
    return strip(f"array_to_string(list_transform(string_split({text(x)}, chr(10)), lambda l: {line}), chr(10))")


def alnum(x: str) -> str:
    return f"trim({sub(key(no_lead(x)), '[^0-9a-z]+', ' ')})"


def no_refs(x: str) -> str:
    out = sub(sub(sub(text(x), r"\(\s*\d+\s*\)"), r"([A-Za-z])\)", r"\1"), r"\(\s*$", "", "")
    return key(out)


def words_of(key_expr: str) -> str:
    """Words of an expression that is a key already."""
    return f"list_filter(string_split({sub(key_expr, '[^0-9a-z]+', ' ')}, ' '), lambda w: w <> '')"


def bag(x: str) -> str:
    return words_of(key(x))


def grams_of(key_expr: str) -> str:
    return f"CASE WHEN length(replace({key_expr}, ' ', '')) < 2 THEN [] ELSE list_transform(range(1, length(replace({key_expr}, ' ', ''))), lambda i: substring(replace({key_expr}, ' ', ''), i, 2)) END"


def tokens(x: str) -> str:
    return f"regexp_extract_all({proof(x)}, {q(TOKEN)})"


def is_number(t: str) -> str:
    return f"regexp_full_match({t}, {q(NUMBER)})"


def token_norm(t: str) -> str:
    return f"lower(CASE WHEN {is_number(t)} THEN replace({t}, ',', '') ELSE {t} END)"


def shared(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda v: least(len(list_filter({a}, lambda y: y = v)), len(list_filter({b}, lambda y: y = v))))), 0)"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * {shared(a, b)} / (len({a}) + len({b})) END"


def blend(ta: str, tb: str, ga: str, gb: str, a: str, b: str) -> str:
    return f"(0.5 * ({jaccard(ta, tb)}) + 0.35 * ({dice(ga, gb)}) + 0.15 * (least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}), 1)))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / len({a}) END"


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(m)})" for m in markers) + ")"


def headerish(x: str) -> str:
    k = row_key(x)
    w = bag(k)
    return f"({k} <> '' AND ({any_of(k, HEADER_MARKERS)} OR (len({w}) > 0 AND (len(list_filter({w}, lambda t: t NOT IN ('low', 'high'))) = 0 OR len(list_filter({w}, lambda t: NOT regexp_full_match(t, '\\d{{4}}'))) = 0))))"


def symbol(x: str) -> str:
    return rf"nullif(regexp_extract({text(x)}, '([$€£¥])\s*\(?\d', 1), '')"


def semantic(k: str) -> str:
    return f"CASE WHEN coalesce({k}, '') <> '' AND NOT {any_of(k, SHARE_ROWS)} AND {any_of(k, CURRENCY_ROWS)} THEN '$' END"


def finance(k: str) -> str:
    return f"({any_of(k, FINANCE_ROWS)} AND NOT {any_of(k, RATE_ROWS)})"
