"""Queries of classifications, contacts, quotes, rectangles and checks, each with its SQL.

Texts of the tables rarely are headers, quotes or contacts, so such lines are made of them by rules of the ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import roles, text, tokens
from ..functions.lexicon import CONTACT_LABELS, DEFAULT, EMAIL, PHONE, REPEATED_LABELS, STRICT_ROLES
from ..operators import compare, matcher, matching, review
from ..sources import pages
from . import sql as S
from .comparison import CELL_KEYS, CELLS_SQL, COMMENTS, EDITED, KEYED, LINES, cell_pairs, cells_of, edited_cells, keyed, left_lines, query, slotted, table


def lined(spark, sf_dir, value):
    return left_lines(spark, sf_dir).select("pair_id", F.col("order").cast("int").alias("ord"), value.alias("value"))


def lines_sql(value: str) -> str:
    return f"{LINES} SELECT pair_id, CAST(ord AS INTEGER) AS ord, {value} AS value FROM lft"


# ---- texts -----------------------------------------------------------------


@query(r"""SELECT doc_id, 'Results of the quarter' AS lead, length(rest) AS rest_length FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS rest FROM documents) WHERE regexp_matches(rest, '^["''(]?[A-Z]') AND length(rest) >= 80""")
def led_documents(spark, sf_dir):
    """Documents under a title line, split into lead and rest."""
    led = text.lead_label(F.concat(F.lit("Results of the quarter\n"), "text"), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", led.alias("p")).where("p is not null").select("doc_id", "p.lead", F.length("p.rest").cast("long").alias("rest_length"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS u FROM d WHERE l IS NOT NULL)
SELECT doc_id, len(u) AS n, array_to_string(u, ' / ') AS said FROM e""")
def distinct_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.distinct_in_order(F.split("text", "\n")).alias("u"))
    return d.select("doc_id", F.size("u").cast("long").alias("n"), F.array_join("u", " / ").alias("said"))


@query(rf"""{LINES}, w AS (SELECT pair_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS t FROM lft)
SELECT pair_id, CASE WHEN t = chr(9) THEN 'tab' WHEN regexp_full_match(t, '\s+') THEN 'space' WHEN regexp_full_match(t, '[$€£¥%~()\[\]{{}}:;,.!?/&+\-–—•]+') THEN 'symbol' ELSE 'text' END AS kind, count(*) AS n FROM w GROUP BY 1, 2""")
def run_kinds(spark, sf_dir):
    """Kinds of all words of the lines."""
    words = left_lines(spark, sf_dir).select("pair_id", F.explode(F.filter(F.split("text", " "), lambda t: t != "")).alias("t"))
    return words.groupBy("pair_id", text.run_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"{KEYED} SELECT pair_id, CAST(ord AS INTEGER) AS ord, length(norm) >= 160 AND len({S.tokens('text')}) >= 20 AS value FROM lk")
def long_narrative(spark, sf_dir):
    a, _ = keyed(spark, sf_dir)
    no = F.lit(False)
    return a.select("pair_id", F.col("order").cast("int").alias("ord"), roles.long_narrative(F.col("text"), F.col("norm"), no, no).alias("value"))


@query(f"{CELLS_SQL} SELECT pair_id, row, col, replace(text, '$ ', '$  ') AS shown FROM cells WHERE col > 0")
def token_displays(spark, sf_dir):
    """Numbers with their sign as tokens are shown, two blanks after the sign."""
    sign = tokens.currency_symbol(F.col("text"))
    bare = F.regexp_replace("text", r"^\$ ", "")
    return cells_of(spark, sf_dir).where("col > 0").select("pair_id", "row", "col", tokens.token_display(sign, F.lit(2), bare).alias("shown"))


# ---- headers and labels ----------------------------------------------------

HEADERS = ["GAAP Results", "Reconciliation of 2024 Targets", "About Example", "Investor Contact:", "Forward-Looking Statements", "Example, Inc. Unaudited Condensed Consolidated Balance Sheets (1)"]
HEADED = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADERS)) + " ELSE p_name END"


def headed(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, HEADERS), F.col("p_name")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


@query(f"WITH h AS (SELECT p_partkey, {HEADED} AS text FROM part), k AS MATERIALIZED (SELECT p_partkey, {S.alnum('text')} AS k FROM h) SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_full_match(k, {S.q(p)}) THEN '{key}'" for key, _, p in DEFAULT.schemas) + " END AS section FROM k")
def section_schemas(spark, sf_dir):
    return headed(spark, sf_dir).select("p_partkey", roles.known_schema(F.col("text")).alias("section"))


LABELS = ["GAAP EPS", "Net income per diluted share", "Shares used in computing EPS", "Low", "2024", "Quote TBC", "A fairly long label of a row in a table", "Total (2)"]
LABELLED = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(LABELS)) + " ELSE p_name END"


def labelled(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, LABELS), F.col("p_name")), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))


@query(f"""WITH k AS MATERIALIZED (SELECT p_partkey, {S.key(S.no_lead('text'))} AS k FROM (SELECT p_partkey, {LABELLED} AS text FROM part)), w AS (SELECT *, {S.words_of('k')} AS w FROM k)
SELECT p_partkey, CASE WHEN k = '' OR len(w) = 0 OR len(w) > 4 OR length(k) > 32 OR list_has_any(w, ['quote', 'tbc']) THEN NULL WHEN len(list_filter(w, lambda t: NOT regexp_full_match(t, '\\d{{4}}'))) = 0 THEN k
 WHEN len(w) > 2 AND len(list_filter(w, lambda t: regexp_full_match(t, '\\d+'))) > 0 THEN NULL WHEN k IN ({', '.join(map(S.q, REPEATED_LABELS))}) OR len(w) <= 2 OR len(list_filter(w, lambda t: length(t) > 8)) = 0 THEN k END AS label FROM w""")
def repeated_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("p_partkey", roles.repeated_label(F.col("text")).alias("label"))


@query(f"WITH k AS MATERIALIZED (SELECT p_partkey, {S.row_key('text')} AS k FROM (SELECT p_partkey, {LABELLED} AS text FROM part)) SELECT p_partkey, {S.semantic('k')} AS symbol FROM k")
def semantic_currency(spark, sf_dir):
    return labelled(spark, sf_dir).select("p_partkey", tokens.semantic_currency(text.normalize_row_key(F.col("text"))).alias("symbol"))


@query(f"""{CELL_KEYS}, own AS (SELECT *, CASE WHEN col > 0 THEN {S.symbol('text')} END AS s, {S.semantic('row_key')} AS m FROM slots)
SELECT pair_id, row, col, coalesce({S.symbol('text')}, max(s) OVER (PARTITION BY pair_id, row), m) AS currency FROM own""")
def effective_currency(spark, sf_dir):
    """A cell's own symbol, else its row's, its table's, or what its row is about."""
    shown = compare.with_currency(compare.completed(slotted(spark, sf_dir)))
    return shown.select("pair_id", "row", "col", "currency")


ROLES = f"""{CELL_KEYS}, body AS (SELECT pair_id, min(row) AS first FROM slots WHERE col = 0 AND NOT {S.headerish('text')} GROUP BY 1),
roled AS MATERIALIZED (SELECT s.pair_id, s.row, s.col, CASE WHEN first IS NULL OR s.row < first THEN 'table_column_header' WHEN col > 0 THEN 'table_data_cell' ELSE 'table_row_label' END AS role FROM slots s LEFT JOIN body USING (pair_id))"""


@query(f"{ROLES} SELECT a.pair_id, a.row, a.col AS col_a, b.col AS col_b, a.role = b.role OR NOT (a.role IN ({', '.join(map(S.q, STRICT_ROLES))}) OR b.role IN ({', '.join(map(S.q, STRICT_ROLES))})) AS fit FROM roled a JOIN (SELECT pair_id, row, col, CASE WHEN col = 3 THEN 'paragraph' ELSE role END AS role FROM roled) b ON a.pair_id = b.pair_id AND a.row = b.row AND a.col < b.col")
def role_compatibility(spark, sf_dir):
    """Roles of cells of a row against each other; the last column stands for a paragraph."""
    told = roles.assign_roles(compare.completed(slotted(spark, sf_dir)), "pair_id").select("pair_id", "row", "col", F.col("structure_role").alias("role"))
    row = told.groupBy("pair_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "role"))).alias("cells"))
    both = row.select("pair_id", "row", F.explode("cells").alias("a"), "cells").select("pair_id", "row", "a", F.explode("cells").alias("b")).where("a.col < b.col")
    other = F.when(F.col("b.col") == 3, F.lit("paragraph")).otherwise(F.col("b.role"))
    return both.select("pair_id", "row", F.col("a.col").alias("col_a"), F.col("b.col").alias("col_b"), roles.role_compatible(F.col("a.role"), other).alias("fit"))


# ---- contacts, quotes and page lines ---------------------------------------

LABEL_SQL = lambda k: "(" + " OR ".join(f"{k} = '{x}' OR starts_with({k}, '{x}:') OR starts_with({k}, '{x} ')" for x in CONTACT_LABELS) + ")"


@query(f"""{KEYED}, t AS (SELECT pair_id, ord, norm, {S.strip(S.text('text'))} AS t FROM lk)
SELECT pair_id, CAST(ord AS INTEGER) AS ord, t <> '' AND ({LABEL_SQL('norm')} OR regexp_matches(t, {S.q(PHONE)}) OR regexp_matches(t, {S.q(EMAIL)}) OR norm = 'example, inc.' OR (len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) <= 4 AND regexp_matches(t, '^\\p{{Lu}}'))) AS value FROM t""")
def contact_texts(spark, sf_dir):
    return lined(spark, sf_dir, roles.contact_text(F.col("text")))


CONTACTS = ["Investor Contact: Ann Lee", "editorial contact", "Example, Inc.", "ann.lee@example.com", "call 555-123-4567", "Ann Lee", "ANN LEE", "a line of five words or more"]


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'contact_label' WHEN 1 THEN 'contact_label' WHEN 2 THEN 'contact_company' WHEN 3 THEN 'contact_email' WHEN 4 THEN 'contact_phone' WHEN 5 THEN 'contact_name' END AS role FROM part")
def contact_roles(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, CONTACTS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", roles.contact_role(said).alias("role"))


QUOTED = "'“' || text || '” said Ann Lee, Chief Financial Officer of it'"


def quoted(spark, sf_dir):
    return F.concat(F.lit("“"), F.col("text"), F.lit("” said Ann Lee, Chief Financial Officer of it"))


@query(f"""{LINES}, z AS (SELECT pair_id, ord, {S.text('q')} AS t FROM (SELECT pair_id, ord, {QUOTED} AS q FROM lft)),
l AS MATERIALIZED (SELECT pair_id, ord, t, {S.key("CASE WHEN regexp_extract(t, '[\"“]([^\"”]{20,220})[\"”]', 1) <> '' THEN regexp_extract(t, '[\"“]([^\"”]{20,220})[\"”]', 1) ELSE t END")} AS lead FROM z)
SELECT pair_id, CAST(ord AS INTEGER) AS ord, array_to_string(({S.bag('lead')})[:12], ' ') AS lead FROM l""")
def quote_leads(spark, sf_dir):
    return left_lines(spark, sf_dir).select("pair_id", F.col("order").cast("int").alias("ord"), roles.quote_lead(quoted(spark, sf_dir)).alias("lead"))


@query(f"""{LINES}, z AS (SELECT pair_id, ord, {S.strip("regexp_extract(" + S.text('q') + ", '[\"“](?:.|\\n)*[\"”]', 0)")} AS said FROM (SELECT pair_id, ord, {QUOTED} AS q FROM lft))
SELECT pair_id, CAST(ord AS INTEGER) AS ord, CASE WHEN length(said) >= 40 THEN said END AS said FROM z""")
def primary_quotes(spark, sf_dir):
    return left_lines(spark, sf_dir).select("pair_id", F.col("order").cast("int").alias("ord"), roles.primary_quote(quoted(spark, sf_dir)).alias("said"))


PAGE_LINES = ["Page 3 of 9", "8-K", "1/2/2024, 10:30 AM", "Exhibit 99.1", "5", "9", "EX-99.1", " "]


@query(f"""WITH l AS (SELECT p_partkey, CASE p_partkey % 10 {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PAGE_LINES))} ELSE p_name END AS text FROM part), k AS (SELECT *, {S.key('text')} AS k FROM l)
SELECT p_partkey, k = '' OR regexp_full_match(k, {S.q('|'.join(roles.CHROME))}) OR {S.strip(S.text('text'))} IN ('1', '2', '3', '4', '5', '6', '7') AS chrome FROM k""")
def page_chrome(spark, sf_dir):
    said = F.coalesce(F.get(F.array(*map(F.lit, PAGE_LINES)), (F.col("p_partkey") % 10).cast("int")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", roles.page_chrome(said).alias("chrome"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(round(l_discount * 100) AS DOUBLE) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(0.0, least(x + 20, 40.0) - greatest(x, 10.0)) * greatest(0.0, least(y + 4, 9.0) - greatest(y, 3.0)) AS area, x BETWEEN 10 AND 40 AND y BETWEEN 3 AND 9 AS inside FROM r""")
def rectangles(spark, sf_dir):
    """The overlap of rectangles with a fixed one, and whether it holds their corners."""
    x, y = F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 100)
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("ax0"), (x + 20).alias("ax1"), y.alias("ay0"), (y + 4).alias("ay1"), F.lit(10.0).alias("bx0"), F.lit(40.0).alias("bx1"), F.lit(3.0).alias("by0"), F.lit(9.0).alias("by1"))
    return r.select("l_orderkey", "l_linenumber", pages.overlap_area("a", "b").alias("area"), pages.holds_point("b", F.col("ax0"), F.col("ay0")).alias("inside"))


# ---- matching and checks ---------------------------------------------------


@query(f"{EDITED}, k AS MATERIALIZED (SELECT pair_id, ord, {S.key('l')} = {S.key('r')} AS same FROM bth) SELECT pair_id, CAST(ord AS INTEGER) AS left_order, CAST(ord AS INTEGER) AS right_order, CASE WHEN same THEN 'exact' ELSE 'approx' END AS match_type, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS score, false AS held FROM k")
def faithful_tables(spark, sf_dir):
    """The matching cascade on edited tables, with roles, slots and families: every cell meets its own."""
    side = lambda d: roles.assign_roles(compare.completed(d.drop("norm", "number", "alnum")), "pair_id")
    found = matcher.match_pairs(*map(side, edited_cells(spark, sf_dir)))
    return found.select("pair_id", "left_order", "right_order", "match_type", "score", "held")


REQUIRED = ["The number is different", "The currency symbol is different", "no such words"]
FORBIDDEN = ["The percent sign is different", "in word."]


@query(f"{COMMENTS}, c AS (SELECT contents FROM said WHERE contents IS NOT NULL), r(kind, text) AS (VALUES " + ", ".join([f"('required', {S.q(t)})" for t in REQUIRED] + [f"('forbidden', {S.q(t)})" for t in FORBIDDEN]) + ") SELECT kind, text, count(contents) AS n, CASE WHEN kind = 'required' THEN count(contents) > 0 ELSE count(contents) = 0 END AS ok FROM r LEFT JOIN c ON contains(contents, text) GROUP BY 1, 2")
def comment_checks(spark, sf_dir):
    return review.check_comments(cell_pairs(spark, sf_dir), REQUIRED, FORBIDDEN)


@query(f"""{COMMENTS} SELECT pair_id, row, col, CASE WHEN col = 3 THEN 550.0 ELSE 300.0 END AS x0 FROM said WHERE contents IS NOT NULL""")
def comment_places(spark, sf_dir):
    """Where notes go: the last column's tokens have rectangles of their own, other cells their rows'."""
    cells = cells_of(spark, sf_dir)
    at = lambda x: F.struct(F.lit(x).alias("x0"), (F.lit(40.0) + 18.0 * F.col("row")).alias("y0")).alias("rect")
    told = cell_pairs(spark, sf_dir).select("pair_id", "row", "col", F.col("order").alias("right_order"), F.lit(0).alias("token_index"), "contents")
    placed = review.placed(told, cells.where("col = 3").select("pair_id", "order", F.lit(0).alias("token_index"), at(550.0)), cells.select("pair_id", "order", at(300.0)))
    return placed.select("pair_id", "row", "col", F.col("rect.x0").alias("x0"))


@query(f"""{KEYED}, e AS (SELECT pair_id, count(*) AS n FROM ex GROUP BY 1), l AS (SELECT pair_id, count(*) AS n FROM lk GROUP BY 1)
SELECT l.pair_id, coalesce(e.n, 0) AS matched, l.n AS blocks FROM l LEFT JOIN e USING (pair_id)""")
def exact_shares(spark, sf_dir):
    """Exactly matched blocks of each pair."""
    a, b = keyed(spark, sf_dir)
    met = matching.exact_by_rank(a, b).groupBy("pair_id").agg(F.count("*").alias("matched"))
    return a.groupBy("pair_id").agg(F.count("*").alias("blocks")).join(met, "pair_id", "left").select("pair_id", F.coalesce("matched", F.lit(0)).alias("matched"), "blocks")
