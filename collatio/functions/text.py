"""String normalisation as Column expressions; every function takes and gives a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import HEADER_MARKERS, TOKEN

PROOF_FROM, PROOF_TO = " ‘’“”–—•", " ''\"\"---"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: expressions inside lambdas would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain_ascii(c: Column) -> Column:
    """Whether a text has ASCII only; told by its sizes, without a look at its characters."""
    return F.octet_length(c) == F.length(c)


#: A number as most cells hold it: an amount with a dollar sign, a count, a share.
BARE = r"^(?:\$ ?)?[0-9][0-9,]*+(?:\.[0-9]+)?%?\z"


def bare_number(c: Column) -> Column:
    """Whether a text is one plain number. As the other short ways below, it is told without lambdas, which no code is generated for."""
    return c.rlike(BARE)


def _plain(c: Column) -> Column:
    """Whether a text is its own key but for its case: single blanks, no marks at its ends, nothing that joins numbers with signs."""
    return c.rlike(r"^[A-Za-z][A-Za-z0-9 .,;:'\"!?/]*+(?<! |[A-Za-z][0-9]{1,2})\z") & ~F.contains(c, F.lit("  ")) & ~F.contains(F.lower(c), F.lit("www."))


def sub_if(c: Column, needed, pattern: str, to: str = "") -> Column:
    """``sub`` of texts that have what the pattern needs; a search for it costs less than the pattern."""
    return bound(c, lambda t: F.when(needed(t), sub(t, pattern, to)).otherwise(t))


def strip(c: Column) -> Column:
    return bound(c, lambda t: F.when(plain_ascii(t), F.btrim(t, F.lit(" \t\n\x0b\f\r"))).otherwise(sub(t, r"(?U)^\s+|\s+\z")))


def normalize_proof(c: Column) -> Column:
    """Typographic characters and entities as plain ones; spacing stays as evidence."""

    def written(out: Column) -> Column:
        for old, new in ENTITIES:
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    out = bound(F.coalesce(c, F.lit("")), lambda t: F.when(plain_ascii(t), t).otherwise(F.translate(t, PROOF_FROM, PROOF_TO)))
    out = bound(out, lambda t: F.when(F.contains(t, F.lit("&")), written(t)).otherwise(t))
    return F.when(plain_ascii(c) & ~F.contains(c, F.lit("&")), c).otherwise(out)


def normalize_text(c: Column) -> Column:
    """As for proofs, and without the blank after a currency symbol or tilde."""
    out = normalize_proof(c)
    for symbol in "$€£¥~":
        out = F.replace(out, F.lit(symbol + " "), F.lit(symbol))
    return out


def _digit(c: Column) -> Column:
    return F.when(plain_ascii(c), c.rlike("[0-9]")).otherwise(c.rlike(r"(?U)\d"))


def strip_footnote_markers(c: Column) -> Column:
    def marked(text: Column) -> Column:
        bare = sub(text, r"(?U)^\s*\(?\d{1,2}\)?(?=\s+[A-Za-z])\s*")
        trailing = lambda t: sub(sub(t, r"(?U)\(\s*\d{1,2}\s*\)\s*$"), r"(?U)(?<=[A-Za-z])\d{1,2}(?=\s*$)")
        # both marks stand at the end
        last = lambda t: ~plain_ascii(t) | F.substring(F.btrim(t, F.lit(" \t\n\x0b\f\r")), -1, 1).isin(")", *"0123456789")
        return bound(bare, lambda t: F.when(last(t) & t.rlike("[A-Za-z]"), trailing(t)).otherwise(t))

    # marks are digits, so most texts take no pattern at all
    return strip(bound(normalize_text(c), lambda t: F.when(_digit(t), marked(t)).otherwise(t)))


def normalize_for_compare(c: Column) -> Column:
    """The key of exact matches: no footnote marks, numbers joined with their signs, single blanks, lower case."""
    return F.when(_plain(c), F.lower(c)).when(bare_number(c), F.replace(c, F.lit("$ "), F.lit("$"))).otherwise(compare_key(c))


def compare_key(c: Column) -> Column:
    """``normalize_for_compare`` of any text, by all its steps."""

    def joined(text: Column) -> Column:
        has = lambda x: lambda t: F.contains(t, F.lit(x))
        out = sub_if(text, lambda t: t.rlike("[$€£¥~]"), r"(?U)([$€£¥~])\s+(?=\(?\d)", "$1")
        for needed, pattern, to in ((has("("), r"(?U)\(\s+(?=\d)", "("), (has("%"), r"(?U)(\d)\s+%", "$1%"), (has(")"), r"(?U)(\d)\s+\)", "$1)"), (lambda t: t.rlike("[+-]"), r"(?U)([+-])\s+(?=\d)", "$1")):
            out = sub_if(out, needed, pattern, to)
        return out

    def key(text: Column) -> Column:
        # a blank between words stays as it is; only runs and other white space are replaced
        blanks = lambda t: ~plain_ascii(t) | F.contains(t, F.lit("  ")) | t.rlike(r"[\t\n\x0b\f\r]")
        return F.lower(F.trim(sub_if(F.when(_digit(text), joined(text)).otherwise(text), blanks, r"(?U)\s{2,}|[^\S ]", " ")))

    web = lambda t: F.when(F.contains(F.lower(t), F.lit("www.")), sub(t, r"(?iU)\bwww\.")).otherwise(t)
    return bound(bound(strip_footnote_markers(c), web), key)


def normalize_row_key(c: Column) -> Column:
    # a label's numbers in parentheses go wherever they stand; what is left is a key where the text has nothing else to lose
    left = F.rtrim(sub(c, r"\([0-9]++\)"))
    return F.when(c.rlike(r"^[A-Za-z][ -~]*+\z") & _plain(left), F.lower(left)).when(bare_number(c), F.replace(c, F.lit("$ "), F.lit("$"))).otherwise(row_key(c))


def row_key(c: Column) -> Column:
    """``normalize_row_key`` of any text, by all its steps."""
    text = sub(strip_footnote_markers(c), r"(?U)^[\s'\"`‘’“”\-–—•]+")
    text = sub(sub(text, r"(?U)\(\s*\d+\s*\)"), r"(?U)\[\s*\d+\s*\]")
    return normalize_for_compare(F.trim(sub(text, r"(?U)\s+", " ")))


def strip_leading_markers(c: Column) -> Column:
    """Without list dashes at the beginnings of lines, and without a percent sign before a label."""

    def line(x: Column) -> Column:
        bare = sub(x, r"(?U)^\s*[-–—•]+\s*")
        total = bare.rlike(r"(?iU)^\s*%?\s*of total\s*$")
        return F.when(total, sub(bare, r"(?U)^\s*%+\s*")).otherwise(sub(bare, r"(?U)^\s*[%\-–—•]+\s*(?=[A-Za-z])"))

    return strip(F.array_join(F.transform(F.split(normalize_text(c), "\n"), line), "\n"))


def normalize_alnum(c: Column) -> Column:
    """ASCII letters and digits of the key only."""
    return F.trim(sub(normalize_for_compare(strip_leading_markers(c)), "[^0-9a-z]+", " "))


def normalize_without_refs(c: Column) -> Column:
    text = sub(normalize_text(c), r"(?U)\(\s*\d+\s*\)")
    return normalize_for_compare(sub(sub(text, r"(?<=[A-Za-z])\)"), r"(?U)\(\s*$"))


def words_of_key(key: Column) -> Column:
    return F.filter(F.split(sub(key, "[^0-9a-z]+", " "), " "), lambda t: t != "")


def bag(c: Column) -> Column:
    """Lower-case ASCII words and numbers of the key."""
    return words_of_key(normalize_for_compare(c))


def grams_of_key(key: Column) -> Column:
    def cut(text: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
        return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(pairs)

    return bound(F.replace(key, F.lit(" "), F.lit("")), cut)


def bigrams(c: Column) -> Column:
    return grams_of_key(normalize_for_compare(c))


def visible(c: Column) -> Column:
    # a letter stays in the key, if it isn't of an entity or a web address
    shown = bare_number(c) | (c.rlike("[A-Za-z]") & ~F.contains(c, F.lit("&")) & ~F.contains(F.lower(c), F.lit("www.")))
    return F.when(shown, F.lit(True)).otherwise(compare_key(c).rlike("[a-z0-9]"))


def headerish(c: Column) -> Column:
    """Whether a cell reads like a column header: a marker in it, only low/high, only years, or a date."""
    from .lexicon import DATE

    def of_key(key: Column) -> Column:
        words = words_of_key(key)
        marked = key.contains(HEADER_MARKERS[0])
        for m in HEADER_MARKERS[1:]:
            marked = marked | key.contains(m)
        words_say = F.forall(words, lambda t: t.isin("low", "high")) | F.forall(words, lambda t: t.rlike(r"^\d{4}$"))
        return (key != "") & (marked | ((F.size(words) > 0) & (words_say | F.coalesce(c, F.lit("")).rlike("(?iU)" + DATE))))

    return bound(normalize_row_key(c), of_key)


def noise_line(c: Column) -> Column:
    """Codes in capitals and short shouted lines that page layouts leave in paragraphs."""
    line = strip(normalize_text(c))
    code = line.rlike(r"(?U)^\[?[A-Z0-9]{2,}(?:\s+[A-Z0-9]{1,4}){1,6}\]?$")
    letters, capitals = F.length(sub(line, r"\P{L}")), F.length(sub(line, r"\P{Lu}"))
    shouted = (F.size(F.regexp_extract_all(line, F.lit("(" + TOKEN + ")"))) <= 4) & (F.length(line) <= 28) & (capitals >= 0.75 * letters) & ~line.rlike("[.:;!?]")
    return (line != "") & (code | (~headerish(line) & (letters > 0) & shouted))


def normalize_page_paragraph(c: Column) -> Column:
    """A paragraph of a page without wrapped hyphens, page numbers, noise lines and glued prefixes."""
    text = sub(normalize_text(c), r"(?U)([A-Za-z])-\s*\n\s*([A-Za-z])", "$1-$2")
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"(?U)^\d{1,2}$") & ~noise_line(x))
    text = sub(F.array_join(lines, "\n"), r"(?U)(?:\n\s*)+\d{1,2}\s*$")
    text = sub(text, r"(?U)\b[A-Z][a-z]{4,}(and|or|the|to|of|for|with|from|by)\b", "$1")
    return normalize_for_compare(sub(text, r"(?U)\s*\n\s*", " "))


def shorten(c: Column, limit: int = 160) -> Column:
    text = F.trim(sub(normalize_text(c), r"(?U)\s+", " "))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def separator_symbol(c: Column) -> Column:
    """What stands between two tokens, without white space."""
    return sub(c, r"(?U)\s+")


def whitespace_signature(c: Column) -> Column:
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    return F.struct(count(" ").alias("spaces"), count("\t").alias("tabs"), count("\n").alias("lines"))


def describe_whitespace(c: Column) -> Column:
    s = whitespace_signature(c)

    def part(field: str, name: str) -> Column:
        n = s.getField(field)
        return F.when(n == 1, F.lit(f"1 {name}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {name}s")))

    said = F.concat_ws(", ", part("spaces", "space"), part("tabs", "tab"), part("lines", "line break"))
    return F.when(said == "", F.lit("no space")).otherwise(said)


def lead_label(c: Column, table_cell: Column | None = None) -> Column:
    """struct(lead, rest) where a short title-like first line stands before a longer body; else null."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    lead = F.try_element_at(lines, F.lit(1))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), " ")
    words = F.size(F.filter(F.split(lead, r"(?U)\s+"), lambda w: w != ""))
    titled = lead.rlike(r"^[A-Z][A-Za-z0-9'()/%& .-]+$") & ~lead.rlike("[.!?:;]$") & (F.length(lead) <= 64) & (words <= 8) & ~((words <= 1) & (F.length(lead) < 12))
    ok = (F.size(lines) >= 2) & titled & rest.rlike("^[\"'(]?[A-Z]") & (F.length(rest) >= 80)
    if table_cell is not None:
        ok = ok & ~table_cell
    return F.when(ok, F.struct(lead.alias("lead"), rest.alias("rest")))


def run_kind(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "text").when(c == "\t", "tab").when(c == "\n", "linebreak").when(c.rlike(r"(?U)^\s+\z"), "space")
        .when(c.rlike(r"^[$€£¥%~()\[\]{}:;,.!?/&+\-–—•]+\z"), "symbol").otherwise("text")
    )


def runs_text(runs: Column) -> Column:
    """struct(raw, proof, match) of a block's inline runs."""
    raw = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    return F.struct(raw.alias("raw"), normalize_proof(raw).alias("proof"), normalize_for_compare(normalize_proof(raw)).alias("match"))


def runs_flags(runs: Column) -> Column:
    has = lambda k: F.exists(runs, lambda r: r[k])
    return F.struct(has("bold").alias("bold"), has("italic").alias("italic"), has("underline").alias("underline"))


def distinct_in_order(a: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
