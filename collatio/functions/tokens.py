"""Tokens, numbers, dates and currency as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .lexicon import CURRENCY_ROWS, DATE, FINANCE_ROWS, NUMBER, RATE_ROWS, SHARE_ROWS, TOKEN
from .text import bare_number, bound, normalize_proof, normalize_text, strip, sub


def token_texts(c: Column) -> Column:
    """Numbers and words in order, as the token pattern finds them."""
    return F.regexp_extract_all(normalize_proof(c), F.lit("(" + TOKEN + ")"))


def is_number_token(t: Column) -> Column:
    """Of a token from ``token_texts``: numbers begin with a digit or a point, words with a letter."""
    return F.ascii(t) < 58


def norm_of_token(t: Column) -> Column:
    """``token_norm`` of a token from ``token_texts``, which has plain characters already and a comma only in numbers."""
    return F.lower(F.replace(t, F.lit(","), F.lit("")))


def token_kind(t: Column) -> Column:
    return F.when(t.rlike("^" + NUMBER + "$"), "number").otherwise("word")


def token_norm(t: Column) -> Column:
    text = strip(normalize_text(t))
    return F.lower(F.when(token_kind(text) == "number", F.replace(text, F.lit(","), F.lit(""))).otherwise(text))


def single_value(c: Column) -> Column:
    """The token of a cell that has exactly one."""
    several = c.rlike("^[A-Za-z]+ +[A-Za-z]")
    return F.when(bare_number(c), sub(c, r"^\$ ?")).when(several, None).otherwise(only_token(c))


def only_token(c: Column) -> Column:
    """``single_value`` of any text."""
    return bound(token_texts(c), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def is_single_number(c: Column) -> Column:
    """Whether a cell's one token is a number; never null."""
    # what begins with a letter has a word
    return F.when(bare_number(c), F.lit(True)).when(c.rlike("^[A-Za-z]"), F.lit(False)).otherwise(only_number(c))


def only_number(c: Column) -> Column:
    """``is_single_number`` of any text."""
    return bound(token_texts(c), lambda found: (F.size(found) == 1) & F.coalesce(F.get(found, F.lit(0)).rlike("^" + NUMBER + "$"), F.lit(False)))


def single_number(c: Column) -> Column:
    """A cell's one number with the parentheses and percent sign that belong to it, else null."""
    text = strip(normalize_proof(c))
    number = F.regexp_extract(text, r"(?U)(\(?(?:\d[\d,]*(?:\.\d+)?|\.\d+)%?\s*\)?\s*%?)[^\dA-Za-z]*$", 1)
    whole = sub(number, r"(?U)\s+")
    balanced = F.when(whole.startswith("(") & whole.contains(")"), whole).otherwise(sub(whole, "[()]"))
    return F.when((F.size(token_texts(c)) == 1) & (token_kind(single_value(c)) == "number") & (number != ""), balanced)


def parse_number(t: Column) -> Column:
    """struct(value, is_percent) of a number's text; null where it is none."""
    plain = F.struct(F.translate(t, "$,% ", "").try_cast("double").alias("value"), t.contains("%").alias("is_percent"))
    return F.when(bare_number(t), plain).otherwise(parsed(t))


def parsed(t: Column) -> Column:
    """``parse_number`` of any text."""
    text = strip(normalize_text(t))
    bare = F.replace(text, F.lit("%"), F.lit(""))
    inside = bare.startswith("(") & bare.endswith(")")
    body = sub(F.when(inside, sub(bare, r"^\(|\)$")).otherwise(bare), r"[$€£¥,~ ]")
    negative = inside | body.startswith("-")
    value = sub(sub(body, "^-"), r"^\+").try_cast("double")
    return F.when(value.isNotNull(), F.struct(F.when(negative, -value).otherwise(value).alias("value"), text.contains("%").alias("is_percent")))


def parsed_compatibility(a: Column, b: Column) -> Column:
    """1 for equal numbers, 0 for another sign, unit or order of magnitude, else less by half the relative gap.

    a, b: from ``parse_number``.
    """

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        p, q = x["value"], y["value"]
        apart = (p != 0) & (q != 0) & (F.abs(F.log10(F.when(p != 0, F.abs(p))) - F.log10(F.when(q != 0, F.abs(q)))) > 1.0)
        gap = F.abs(p - q) / F.greatest(F.abs(p), F.abs(q), F.lit(1.0))
        return (
            F.when(x.isNull() | y.isNull() | (x["is_percent"] != y["is_percent"]), 0.0).when(p == q, 1.0).when((p < 0) != (q < 0), 0.0)
            .when(F.coalesce(apart, F.lit(False)), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), gap * 0.5)))
        )

    return bound(F.struct(a.alias("x"), b.alias("y")), of)


def number_compatibility(a: Column, b: Column) -> Column:
    """As ``parsed_compatibility``, of the texts of two numbers."""
    return parsed_compatibility(parse_number(a), parse_number(b))


def date_phrases(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)(" + DATE + ")"))


def currency_symbol(c: Column) -> Column:
    found = F.regexp_extract(normalize_text(c), r"(?U)([$€£¥])\s*\(?\d", 1)
    return F.when(c.rlike(r"^\$ ?[0-9]"), "$").when(c.rlike("[$€£¥]"), F.when(found != "", found))


def _any(key: Column, markers: tuple[str, ...]) -> Column:
    out = key.contains(markers[0])
    for m in markers[1:]:
        out = out | key.contains(m)
    return out


def semantic_currency(row_key: Column) -> Column:
    """$ for rows that are earnings per share, unless they count shares."""
    return F.when((F.coalesce(row_key, F.lit("")) != "") & ~_any(row_key, SHARE_ROWS) & _any(row_key, CURRENCY_ROWS), "$")


def with_row_currency(cells, doc: str = "doc_id"):
    """Adds ``row_symbol``: of the first number of the row that shows one, itself first, else a lone symbol's cell.

    cells: (doc, table, row, col, order, text). Windows are over one table row.
    """
    row = Window.partitionBy(doc, "table", "row")
    shown = F.when(F.col("_number"), currency_symbol(F.col("text")))
    lone = bound(strip(normalize_text(F.col("text"))), lambda t: F.when(t.isin("$", "€", "£", "¥"), t))
    lone = F.when(~(bare_number(F.col("text")) | F.col("text").rlike("^[0-9A-Za-z]")), lone)  # what begins with more than a sign is none
    marked = cells.withColumn("_number", is_single_number(F.col("text")))
    marked = marked.withColumn("_own", shown).withColumn("_lone", lone)
    ordered = row.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return marked.withColumn("row_symbol", F.coalesce("_own", F.first("_own", True).over(ordered), F.when(F.col("_lone").isNull(), F.first("_lone", True).over(ordered)))).drop("_number", "_own", "_lone")


def with_table_currency(cells, doc: str = "doc_id"):
    """Adds ``table_symbol``: $ for large numbers in finance rows near cells that show a symbol and few percentages."""
    near = Window.partitionBy(doc, "table").orderBy("row").rangeBetween(-6, 6)
    token = single_value(F.col("text"))
    number = is_single_number(F.col("text"))
    told = cells.withColumn("_number", number).withColumn("_token", F.when(F.col("_number"), token)).withColumn("_shown", currency_symbol(F.col("text")).isNotNull())
    percents = F.sum(F.when(F.col("_token").endswith("%"), 1).otherwise(0)).over(near)
    shown = F.sum(F.when(F.col("_shown"), 1).otherwise(0)).over(near)
    told = told.withColumn("_percents", percents).withColumn("_near", shown)
    large = (F.abs(parse_number(F.col("_token"))["value"]) >= 100) | F.col("_token").contains(",")
    key = F.coalesce(F.col("row_key"), F.lit(""))
    ok = (key != "") & ~_any(key, RATE_ROWS) & (semantic_currency(key).isNotNull() | _any(key, FINANCE_ROWS))
    # what costs little decides first
    symbol = F.when(F.col("_number") & (F.col("_percents") < 2) & (F.col("_near") >= 1), F.when(ok, F.when(large, "$")))
    return told.withColumn("table_symbol", symbol).drop("_number", "_token", "_shown", "_percents", "_near")


def effective_currency(text: Column, prefix: Column, row_symbol: Column, table_symbol: Column, row_key: Column) -> Column:
    return F.coalesce(currency_symbol(text), F.when(prefix.isin("$", "€", "£", "¥"), prefix), row_symbol, table_symbol, semantic_currency(row_key))


def token_display(prefix: Column, spaces: Column, text: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), F.when(prefix.isNotNull(), F.repeat(F.lit(" "), spaces)).otherwise(""), text)


def difference_subject(left_kind: Column, right_kind: Column) -> Column:
    return F.when((left_kind == "number") & (right_kind == "number"), "number").when((left_kind == "word") & (right_kind == "word"), "word").otherwise("token")
