"""Queries of differences that the operators explain, each with its SQL: sentences of parts, edited by rules of the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import diff, matching, review
from ..operators.matcher import Profile
from . import sql as S
from .comparison import CELLS_SQL, LINES, cells_of, left_lines, query, table

SENTENCE = "the part named {} is sold in many places, now more than ever"
#: (what stands on the left, what on the right, the comment).
EDITS = [
    ("sold", "shipped", "The word is different, shipped in html while sold in word."),
    ("many places", "many more places", "The word is extra in html, more. It is not present in word."),
    ("many places", "places", "The word is missing in html, many in word."),
    ("sold in", "sold for very little money in", "The words are extra in html, for very little money. They are not present in word."),
    ("more than", "more by 15 than", None),
    ("places, now", "places, now", None),
]
PROOF_EDITS = [
    ("many places", "many  places", "The spacing is different, html has 2 spaces between many and places while word has 1 space."),
    ("places, now", "places; now", "The symbol is different, html has ; between places and now while word has ,."),
    ("places, now", "places, now", None),
]


def pairs(spark, sf_dir, edits: list) -> DataFrame:
    """(pair_id, l, r) of each part's sentence and its edited form."""
    said = F.concat(F.lit(SENTENCE.partition("{}")[0]), "p_name", F.lit(SENTENCE.partition("{}")[2]))
    changed: Column = said
    for k, (a, b, _) in enumerate(edits):
        changed = F.when(F.col("p_partkey") % len(edits) == k, F.replace(said, F.lit(a), F.lit(b))).otherwise(changed)
    side = lambda text, name: F.struct(F.lit(0).alias("order"), text.alias("text"), F.lit("paragraph").alias("role")).alias(name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), side(said, "l"), side(changed, "r"))


def told(found: DataFrame, profile: Profile, group: str | None = None) -> DataFrame:
    from ..functions.text import normalize_for_compare

    same = normalize_for_compare(F.col("l.text")) == normalize_for_compare(F.col("r.text"))
    rated = found.withColumns({"match_type": F.when(same, "exact").otherwise("approx"), "score": F.when(same, 1.0).otherwise(0.97), "group_type": F.lit(group).cast("string")})
    return diff.comments(rated, profile).select("pair_id", "seq", "contents")


def expected(edits: list) -> str:
    cases = " ".join(f"WHEN {k} THEN {S.q(c)}" for k, (_, _, c) in enumerate(edits) if c)
    return f"SELECT pair_id, CAST(0 AS INTEGER) AS seq, contents FROM (SELECT p_partkey AS pair_id, CASE p_partkey % {len(edits)} {cases} END AS contents FROM part) WHERE contents IS NOT NULL"


@query(expected([(a, b, c or ("The word is extra in html, by. It is not present in word." if "by" in b else None)) for a, b, c in EDITS]) + f" UNION ALL SELECT p_partkey, 1, 'The number is extra in html, 15. It is not present in word.' FROM part WHERE p_partkey % {len(EDITS)} = 4")
def explained_words(spark, sf_dir):
    """Replaced, extra and missing words, a phrase, and a number with a word."""
    return told(pairs(spark, sf_dir, EDITS), Profile())


@query(expected(PROOF_EDITS))
def explained_spacing(spark, sf_dir):
    """Spaces and symbols between words that are equal, in proofreading."""
    return told(pairs(spark, sf_dir, PROOF_EDITS), Profile("html", True))


@query("SELECT CAST(o_orderkey AS BIGINT) AS pair_id, CAST(0 AS INTEGER) AS seq, 'The number is different, ' || (o_orderkey + 1000001) || '.5 in html while ' || (o_orderkey + 1000000) || '.5 in word.' AS contents FROM orders")
def explained_numbers(spark, sf_dir):
    """One number of several differs."""
    say = lambda n: F.concat(F.lit("A total of "), (F.col("o_orderkey") + n).cast("string"), F.lit(".5 was paid in 3 parts over 12 months"))
    side = lambda text, name: F.struct(F.lit(0).alias("order"), text.alias("text")).alias(name)
    return told(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), side(say(1_000_000), "l"), side(say(1_000_001), "r")), Profile())


@query("SELECT CAST(c_custkey AS BIGINT) AS pair_id, CAST(0 AS INTEGER) AS seq, 'The word is different, Leigh in html while Lee in word.' AS contents FROM customer WHERE c_custkey % 2 = 0")
def explained_contacts(spark, sf_dir):
    """A name alone against the same contact's line with all its fields."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.lit("Leigh")).otherwise(F.lit("Lee"))
    side = lambda text, k: F.struct(F.lit(0).alias("order"), text.alias("text")).alias(k)
    line = F.concat(F.lit("Investor Contact: Ann "), name, F.lit(" Example, Inc. 555-123-4567 ann@example.com"))
    return told(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"), side(F.lit("Ann Lee"), "l"), side(line, "r")), Profile(), "contact")


@query("""SELECT CAST(p_partkey AS BIGINT) AS pair_id, seq, contents FROM part, LATERAL (SELECT 0 AS seq, CASE p_partkey % 3 WHEN 0 THEN 'The number is different, 5 in html while 7 in word.' WHEN 1 THEN 'The word is different, ours in html while yours in word.' ELSE 'The number is extra in html, 5. It is not present in word.' END AS contents
UNION ALL SELECT 1, 'The word is missing in html, yours in word.' WHERE p_partkey % 3 = 2 UNION ALL SELECT 2, 'The word is different, a in html while b in word.')""")
def collapsed_pairs(spark, sf_dir):
    """An extra and a missing token of one kind next to each other are one difference; others stay."""
    extra, missing = "The {} is extra in html, {}. It is not present in word.", "The {} is missing in html, {} in word."
    kind = F.col("p_partkey") % 3
    first = F.when(kind == 0, extra.format("number", 5)).when(kind == 1, missing.format("word", "yours")).otherwise(extra.format("number", 5))
    second = F.when(kind == 0, missing.format("number", 7)).when(kind == 1, extra.format("word", "ours")).otherwise(missing.format("word", "yours"))
    said = F.array(first, second, F.lit("The word is different, a in html while b in word."))
    comments = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pair_id"), F.lit(0).alias("right_order"), F.lit(0).alias("token_index"), F.posexplode(said).alias("seq", "contents"))
    return review.collapse(comments).select("pair_id", "seq", "contents")


@query(f"""{LINES}, p AS (SELECT pair_id, ord // 8 AS page, min(ord) AS first, count(*) AS n FROM lft GROUP BY 1, 2)
SELECT pair_id, CAST(page AS INTEGER) AS page, CAST(first AS INTEGER) AS right_order, 'This PDF page contains content with no corresponding content in the Word document.' AS contents FROM p WHERE page % 2 = 1 AND n >= 5""")
def page_summaries(spark, sf_dir):
    """Every other page holds lines of its own only."""
    a = left_lines(spark, sf_dir)
    page = F.floor(F.col("order") / 8).cast("int")
    b = a.withColumn("page", page).withColumn("text", F.when(F.col("page") % 2 == 1, F.concat(F.lit("q"), F.md5(F.concat_ws("/", "pair_id", "order").cast("binary")))).otherwise(F.col("text")))
    from ..functions.text import normalize_for_compare

    keyed = [d.withColumn("norm", normalize_for_compare(F.col("text"))) for d in (a, b)]
    return review.page_summary(b, a, matching.exact_by_rank(*keyed)).select("pair_id", "page", F.col("right_order").cast("int").alias("right_order"), "contents")


#: Blocks of a part's page: (role, kind, marker, left text or None, right text or None, match type, group type).
PAGE = [
    ("section_header", "h2", None, "GAAP Results", "GAAP Result", "approx", None),
    ("paragraph", "p", None, "The results of the quarter show that revenue rose in all regions and margins widened too, as {} sold well.", "=", "exact", None),
    ("paragraph", "p", None, "“We are proud of {} and of all who made it this year,” said Ann Lee, Chief Financial Officer of the firm.", "“We are very proud of {} and of all who made it this year,” said Ann Lee, Chief Financial Officer of the firm.", "approx", "quote"),
    ("footnote", "footnote", "1", "1 A note on {} that stands below the text of the page.", "1 A note on {} that stands under the text of the page.", "approx", "footnote"),
    ("paragraph", "p", None, "Only here on the left of both sides, without a partner.", None, None, None),
    ("paragraph", "p", None, None, "Something else altogether was written over there, by someone.", None, None),
]


@query("SELECT p_partkey AS pair_id, b.* FROM part, (VALUES " + ", ".join(
    f"({k if a else 'CAST(NULL AS INTEGER)'}, {k if b else 'CAST(NULL AS INTEGER)'}, {S.q(kind) if kind else 'CAST(NULL AS VARCHAR)'}, {S.q(group) if group else 'CAST(NULL AS VARCHAR)'})" for k, (_, _, _, a, b, kind, group) in enumerate(PAGE)
) + ") b(left_order, right_order, match_type, group_type)")
def faithful_groups(spark, sf_dir):
    """The cascade on headers, prose, quotes, footnotes and blocks of one side."""
    from ..operators import compare, matcher

    def side(at: int) -> DataFrame:
        texts = [(k, (b[3] if b[4] == "=" else b[4]) if at else b[3]) for k, b in enumerate(PAGE)]
        rows = [F.struct(F.lit(k).alias("order"), F.lit(PAGE[k][0]).alias("structure_role"), F.lit(PAGE[k][1]).alias("kind"), F.lit(PAGE[k][2]).cast("string").alias("footnote_marker"), F.lit(PAGE[k][1] == "h2").alias("heading"), F.replace(F.lit(t), F.lit("{}"), F.col("p_name")).alias("text")) for k, t in texts if t]
        blocks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.inline(F.array(*rows)))
        return compare.completed(blocks).withColumn("family_table_index", F.lit(None).cast("int"))

    return matcher.match_pairs(side(0), side(1)).select("pair_id", "left_order", "right_order", "match_type", "group_type")


RULES = review.AppendixRules(("17",), 4, "part 5", 0, 2, "outstanding, part 1", ("3%",), r"^\d$", (3,), 1)


@query(f"""{CELLS_SQL}, b AS (SELECT *, row * 10 + col AS ord, {S.key('text')} AS k, (row * 10 + col) % 9 = 4 AND {S.key('text')} <> '17' AS own FROM cells),
h AS (SELECT *, sum(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id) AS held, row >= 2 AS inside, NOT own AND (contains(k, 'part 5') OR (row >= 2 AND (contains(k, 'outstanding, part 1') OR k = '3%' OR (regexp_full_match(trim(text), '\\d') AND (row = 3 OR col = 1))))) AS new FROM b),
t AS (SELECT *, held + sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY ord) AS total FROM h WHERE held < 4),
f AS (SELECT *, coalesce(sum(CASE WHEN inside AND total >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before FROM t)
SELECT pair_id, CAST(ord AS INTEGER) AS ord, text FROM b WHERE own UNION ALL SELECT pair_id, CAST(ord AS INTEGER), text FROM f WHERE new AND full_before = 0""")
def appendix_rows(spark, sf_dir):
    """Unmatched cells and rows that rules name, up to four a pair."""
    cells = cells_of(spark, sf_dir).withColumn("table_cell", F.lit(True))
    found = review.appendix_blocks(cells, cells.where("order % 9 = 4").select("pair_id", "order", "text"), RULES)
    return found.select("pair_id", F.col("order").cast("int").alias("ord"), "text")
