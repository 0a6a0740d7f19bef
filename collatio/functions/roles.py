"""Classification of blocks: sections, contacts, quotes, footnotes, page lines and structural roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aligned import fuzzy_schema
from .lexicon import CONTACT_LABELS, DEFAULT, EMAIL, PHONE, REPEATED_LABELS, STRICT_ROLES, Lexicon
from .similarity import similarity
from .text import bag, bound, headerish, normalize_alnum, normalize_for_compare, normalize_text, strip, strip_leading_markers, sub, visible
from .tokens import is_single_number, token_texts


def known_schema(c: Column, lexicon: Lexicon = DEFAULT, fuzzy: bool = False) -> Column:
    """Key of the section whose header a text is; exact and by pattern natively, nearly alike ones by alignment."""
    def of(normalized: Column) -> Column:
        found = F.lit(None).cast("string")
        for key, _, pattern in reversed(lexicon.schemas):
            found = F.when(normalized.rlike(f"^(?:{pattern})$"), key).otherwise(found)
        return found

    found = bound(normalize_alnum(c), of)
    return F.coalesce(found, fuzzy_schema(lexicon.schemas)(normalize_alnum(c))) if fuzzy else found


def contact_label(c: Column) -> Column:
    def of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, name in CONTACT_LABELS.items():
            out = F.when((key == label) | key.startswith(label + ":") | key.startswith(label + " "), name).otherwise(out)
        return out

    return bound(normalize_for_compare(c), of)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def contact_text(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    text = strip(normalize_text(c))
    short = (_words(text) <= 4) & text.rlike(r"^\p{Lu}")
    return (text != "") & (contact_label(text).isNotNull() | text.rlike("(?U)" + EMAIL) | text.rlike("(?U)" + PHONE) | (normalize_for_compare(c) == f"{lexicon.company.lower()}, inc.") | short)


def contact_role(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    text = strip(normalize_text(c))
    shouted = (F.upper(text) == text) & text.rlike(r"\p{Lu}")
    name = (_words(text) <= 4) & text.rlike(r"^\p{Lu}") & ~shouted
    return (
        F.when(text == "", None).when(contact_label(text).isNotNull(), "contact_label").when(text.rlike(lexicon.company_pattern), "contact_company")
        .when(text.rlike("(?U)" + EMAIL), "contact_email").when(text.rlike("(?U)" + PHONE), "contact_phone").when(name, "contact_name")
    )


def contact_fields(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """struct(label, company, phone, email, name); the name is what stands before the first other field."""
    none = lambda x: F.when(x != "", x)
    text = strip(normalize_text(c))
    label = F.regexp_extract(text, r"(?iU)^\s*((?:INVESTOR|EDITORIAL)\s+CONTACT:?)\s*", 1)
    rest = strip(sub(text, r"(?iU)^\s*((?:INVESTOR|EDITORIAL)\s+CONTACT:?)\s*"))
    company = F.regexp_extract(rest, lexicon.company_pattern, 0)
    phone, email = F.regexp_extract(rest, "(?U)" + PHONE, 0), F.regexp_extract(rest, "(?U)" + EMAIL, 0)
    at = lambda x: F.when(x != "", F.instr(rest, x) - 1).otherwise(F.length(rest))
    name = sub(F.substr(rest, F.lit(1), F.least(at(company), at(phone), at(email))), r"^[ ,;]+|[ ,;]+$")
    return F.struct(none(strip(label)).alias("label"), none(strip(company)).alias("company"), none(phone).alias("phone"), none(email).alias("email"), none(name).alias("name"))


def quote_role(c: Column) -> Column:
    key = normalize_for_compare(c)
    cfo = key.contains("chief financial officer") | key.contains("finance chief") | key.rlike(r"\bcfo\b")
    ceo = key.contains("chief executive officer") | key.contains("president and ceo") | key.contains("president chief executive officer") | key.rlike(r"\bceo\b")
    return F.when(cfo, "cfo").when(ceo, "ceo")


SPEAKER = r"said\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z.'-]+){0,3})\s*,\s*([^\"”]+)"


def quote_speaker(c: Column) -> Column:
    """struct(speaker, title) of who is said to have said it."""
    title = normalize_for_compare(F.regexp_extract(c, SPEAKER, 2))
    return F.struct(normalize_for_compare(F.regexp_extract(c, SPEAKER, 1)).alias("speaker"), F.trim(sub(title, "[^a-z0-9]+", " ")).alias("title"))


def quote_lead(c: Column) -> Column:
    """The first twelve words of the first quotation, or of the text without one."""
    said = F.regexp_extract(normalize_text(c), "[\"“]([^\"”]{20,220})[\"”]", 1)
    return F.array_join(F.slice(bag(normalize_for_compare(F.when(said != "", said).otherwise(F.coalesce(c, F.lit(""))))), 1, 12), " ")


def quote_key(c: Column, placeholder: Column) -> Column:
    who = quote_speaker(c)
    return F.concat_ws("|", F.coalesce(quote_role(c), F.lit("")), who["speaker"], who["title"], quote_lead(c), F.when(placeholder, "1").otherwise(""))


def primary_quote(c: Column) -> Column:
    """From the first opening to the last closing mark, if that is 40 characters or more."""
    said = strip(F.regexp_extract(normalize_text(c), '(?s)["“].*["”]', 0))
    return F.when(F.length(said) >= 40, said)


def footnote_marker(c: Column) -> Column:
    found = F.regexp_extract(normalize_text(c), r"(?U)^\s*\(?(\d{1,2})\)?(?:\s+|$)", 1)
    return F.when(found != "", found)


# Keys of lines that page headers and footers hold.
CHROME = (
    r"\d{1,2}/\d{1,2}/\d{2,4},? \d{1,2}:\d{2} ?[ap]m", r"\d+/\d+", r"page \d+ of \d+", r"8-k", r"ex-?99\.1", r"ex-?99\.1 .*ex-?99\.1", r"exhibit 99\.1",
    r"[a-z]{2,}-w\d+-pf-\d+", r"\d{2}\.\d{2}\.\d{2}\.\d", r"[a-z0-9_-]{2,} \d{2}\.\d{2}\.\d{2}\.\d", r"[a-z0-9-]{4,} \d{2}\.\d{2}\.\d{2}\.\d", r"https?[:/].*sec\.gov/archives/edgar/.*",
)
CHROME_PAGES = ("1", "2", "3", "4", "5", "6", "7")


def page_chrome(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether a text is what stands around pages, not in them; blank texts are."""

    def of(key: Column) -> Column:
        out = (key == "") | key.rlike("^(?:" + "|".join(CHROME) + r")\z") | (key.contains("form 8-k") & key.contains(f"{lexicon.company.lower()}, inc."))
        for agent in lexicon.filing_agents:
            out = out | key.contains(agent.lower())
        return out

    return bound(normalize_for_compare(c), of) | strip(normalize_text(c)).isin(*CHROME_PAGES)


def page_section_line(line: Column, following: Column) -> Column:
    """A short title-case line before a longer one."""
    text = strip(normalize_text(line))
    n = F.size(token_texts(text))
    words = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z'’-]*)"))
    titled, lowered = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))), F.size(F.filter(words, lambda w: ~w.rlike("[A-Z]")))
    body = following.isNotNull() & (F.size(token_texts(following)) >= 8)
    shape = (F.length(text) <= 90) & n.between(2, 10) & ~headerish(text) & ~text.rlike("[.;,]$") & (F.size(words) > 0)
    return visible(text) & body & shape & (titled >= 0.7 * F.size(words)) & (lowered <= 0.35 * F.size(words))


def narrative_segments(c: Column) -> Column:
    """The visible lines of a page's block as segments: a section line begins one; the first line, if it is one, stands alone."""

    def cut(lines: Column) -> Column:
        section = F.transform(lines, lambda x, i: F.coalesce(page_section_line(x, F.get(lines, i + 1)), F.lit(False)))

        def step(flags: Column) -> Column:
            led = F.get(flags, 0)
            begins = lambda i: (i == 0) | ((i == 1) & led) | ((i > led.cast("int")) & F.get(flags, i))
            placed = F.transform(lines, lambda x, i: F.struct(begins(i).alias("begins"), x.alias("line")))
            last = lambda out: F.element_at(out, -1)
            grown = lambda out, x: F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws("\n", last(out), x["line"])))
            return F.aggregate(placed, F.array().cast("array<string>"), lambda out, x: F.when(x["begins"], F.array_append(out, x["line"])).otherwise(grown(out, x)))

        return bound(section, step)

    lines = F.filter(F.transform(F.split(normalize_text(c), "\n"), lambda x: strip(x)), lambda x: visible(x))
    return bound(lines, lambda x: F.when(F.size(x) < 2, F.array(strip(normalize_text(c)))).otherwise(cut(x)))


def page_focus(c: Column, page: Column) -> Column:
    """The segment of a page's block that is more like a text than the whole block, by .05 or up to .9; else null."""

    def best(p: Column) -> Column:
        own, whole = p["own"], p["whole"]
        rated = F.transform(p["segments"], lambda x, i: F.struct(similarity(own, normalize_for_compare(x)).alias("score"), (-i).alias("at"), x.alias("text")))
        return bound(F.struct(F.array_max(rated).alias("top"), similarity(own, whole).alias("full")), lambda r: F.when((r["top"]["score"] > r["full"]) & ((r["top"]["score"] >= 0.9) | (r["top"]["score"] - r["full"] >= 0.05)), r["top"]["text"]))

    told = F.struct(normalize_for_compare(c).alias("own"), normalize_for_compare(page).alias("whole"), narrative_segments(page).alias("segments"))
    # a block of one line has one segment
    return F.when(F.contains(page, F.lit("\n")), bound(told, lambda p: F.when(F.size(p["segments"]) > 1, best(p))))


def page_segments(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Narrative segments of page blocks: (key, segment, text)."""
    return blocks.select(*key, F.posexplode(narrative_segments(F.col("text"))).alias("segment", "text"))


def repeated_label(c: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The key of a short label that may stand many times in a table, else null."""

    def of(p: Column) -> Column:
        key, words = p["key"], p["words"]
        n, years = F.size(words), F.forall(words, lambda t: t.rlike(r"^\d{4}$"))
        digits = F.exists(words, lambda t: t.rlike(r"^\d+$"))
        named = key.isin(*REPEATED_LABELS, f"{lexicon.company.lower()} inc", f"{lexicon.company.lower()} inc.")
        short = named | (n <= 2) | F.forall(words, lambda t: F.length(t) <= 8)
        barred = (key == "") | (n == 0) | (n > 4) | (F.length(key) > 32) | F.exists(words, lambda t: t.isin("quote", "tbc"))
        return F.when(barred, None).when(years, key).when(digits & (n > 2), None).when(short, key)

    key = normalize_for_compare(strip_leading_markers(c))
    return bound(F.struct(key.alias("key"), bag(key).alias("words")), of)


def role_compatible(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (x == "") | (y == "") | (x == y) | (~x.isin(*STRICT_ROLES) & ~y.isin(*STRICT_ROLES))


def header_group(role: Column) -> Column:
    return F.when(role.isin("table_title", "table_subtitle"), "title_family").when(role == "table_column_header", "column_header_family")


def exact_like(match_type: Column) -> Column:
    return match_type.isin("exact", "exact_structural")


def long_narrative(text: Column, normalized: Column, table_cell: Column, heading: Column) -> Column:
    return ~table_cell & ~heading & (F.length(normalized) >= 160) & (F.size(token_texts(text)) >= 20)


def with_next_narrative(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``next_narrative``: the text of the next block that is no cell, footnote or blank."""
    after = Window.partitionBy(doc).orderBy("order").rowsBetween(1, Window.unboundedFollowing)
    told = F.when(~F.col("table_cell") & (F.col("kind") != "footnote") & visible(F.col("text")), F.col("text"))
    return blocks.withColumn("next_narrative", F.first(told, True).over(after))


def assign_roles(blocks: DataFrame, doc: str = "doc_id", lexicon: Lexicon = DEFAULT, fuzzy: bool = False) -> DataFrame:
    """Adds ``structure_role`` and ``family_table_index``.

    blocks: (doc, order, text, heading, bold, italic, table_cell, kind, table, row, col, row_slot). Windows run over
    one document, those of the first body row over its tables and their rows.
    """
    w = Window.partitionBy(doc).orderBy("order")
    text = strip(normalize_text(F.col("text")))
    n = F.size(token_texts(text))
    say = lambda k, by: F.lead(k, by).over(w)
    b = blocks.withColumn("_schema", known_schema(F.col("text"), lexicon, fuzzy)).withColumn("_n", n).withColumn("_t", text)
    cell_table = F.when(F.col("table_cell"), F.col("table"))
    b = b.withColumn("_cell_table", cell_table)
    b = b.withColumn("_soon", F.coalesce(say("_cell_table", 1), say("_cell_table", 2), say("_cell_table", 3)))
    plain = ~F.col("table_cell") & (F.col("kind") != "footnote")
    b = b.withColumn("_prev_header", F.coalesce((F.lag("_schema").over(w).isNotNull()) & ~F.lag("table_cell").over(w) & (F.lag("kind").over(w) != "footnote"), F.lit(False)))
    subtitled = F.col("_t").startswith("(") | (F.col("italic") & (F.col("_n") <= 20))
    title = (F.col("_soon").isNotNull()) & ~(F.col("_prev_header") & (F.col("_n") > 14) & ~F.col("_t").startswith("("))
    first_role = (
        F.when(~plain, None).when(F.col("_schema").isNotNull(), "section_header").when(title & subtitled, "table_subtitle")
        .when(title & (F.col("heading") | (F.col("_n") <= 14)), "table_title")
    )
    b = b.withColumn("_role", first_role)
    follows_title = (F.lag("_role").over(w) == "table_title") & F.col("_soon").isNull() & (F.col("_t").startswith("(") | F.col("italic") | (F.col("_n") <= 18))
    next_plain = ~say("table_cell", 1) & (say("kind", 1) != "footnote")
    lead = ~F.col("heading") & F.col("bold") & next_plain & visible(F.col("text")) & F.col("_n").between(1, 8) & (F.length("_t") <= 80) & (say("_n", 1) >= 12) & ~headerish(F.col("text"))
    base = F.when(F.col("heading"), "section_header").when(F.col("kind") == "footnote", "footnote").otherwise("paragraph")
    kept = title.isNotNull() & F.col("_soon").isNotNull()
    plain_role = F.coalesce(F.col("_role"), F.when(kept, base), F.when(follows_title, "table_subtitle"), F.when(F.coalesce(lead, F.lit(False)), "section_lead"), base)
    b = b.withColumn("_plain", plain_role).withColumn("_prev_soon", F.lag("_soon").over(w))
    number = is_single_number(F.col("text"))
    # the first body row is told by windows: an aggregate that is joined back would compute all blocks again
    cell = F.col("table_cell") & F.col("table").isNotNull()
    seen = F.when(cell & visible(F.col("text")), F.struct(F.coalesce("row_slot", F.lit(0)), F.col("col"), headerish(F.col("text")).alias("h")))
    b = b.withColumn("_number", number).withColumn("_seen", seen)
    row = Window.partitionBy(doc, "table", "row")
    b = b.withColumn("_numbers", F.sum(F.when(cell, F.col("_number").cast("int"))).over(row)).withColumn("_first", F.min("_seen").over(row))
    holds = cell & (F.col("_numbers") >= 1) & F.col("_first").isNotNull() & ~F.col("_first.h")
    b = b.withColumn("_body", F.min(F.when(holds, F.col("row"))).over(Window.partitionBy(doc, "table")))
    cell_role = (
        F.when(F.col("table").isNull(), "table_cell").when(F.col("_body").isNull() | (F.col("row") < F.col("_body")), "table_column_header").when(F.col("_number"), "table_data_cell")
        .when(F.coalesce("row_slot", F.lit(0)) == 0, "table_row_label").otherwise("table_data_label")
    )
    role = F.when(F.col("table_cell"), cell_role).otherwise(F.col("_plain"))
    family = F.when(F.col("table_cell"), F.col("table")).when(F.col("_plain") == "table_title", F.col("_soon")).when(F.col("_plain") == "table_subtitle", F.coalesce("_soon", "_prev_soon"))
    made = b.withColumn("structure_role", role).withColumn("family_table_index", family)
    return made.drop(*[c for c in made.columns if c.startswith("_")])
