"""Queries over the driver's tables, each with its SQL.

``documents`` give pairs: the left side is a document's lines, the right side the same lines with some dropped and
some edited by rules of the ids, so what differs is known. ``lineitem`` gives table cells in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aligned, roles, similarity, text, tokens
from ..lineage import dealt_by, met_in_place, spread
from ..operators import compare, diff, matcher, matching, review
from ..sources import docx, html, pages
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sides -----------------------------------------------------------------


def left_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Lines of documents; dealt: by pair, as whole texts, for queries whose lines of a pair meet."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), "text")
    docs = dealt_by(docs, "pair_id") if dealt else spread(docs)
    return docs.select("pair_id", F.posexplode(F.split("text", "\n")).alias("order", "text")).where("text <> ''")


def right_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    lines = left_lines(spark, sf_dir, dealt).where("(order + pair_id) % 7 <> 3")
    k = (F.col("order") + F.col("pair_id")) % 5
    first = F.concat(F.lit("Then "), F.col("text"))
    return lines.withColumn("text", F.when(k == 1, first).when(k == 2, F.regexp_replace("text", "[0-9]", "7")).otherwise(F.col("text")))


LINES = """WITH docs AS (SELECT doc_id AS pair_id, string_split(text, chr(10)) AS l FROM documents),
lft AS (SELECT * FROM (SELECT pair_id, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS text FROM docs) WHERE text <> ''),
rgt AS (SELECT pair_id, ord, CASE (ord + pair_id) % 5 WHEN 1 THEN 'Then ' || text WHEN 2 THEN regexp_replace(text, '[0-9]', '7', 'g') ELSE text END AS text
  FROM lft WHERE (ord + pair_id) % 7 <> 3)"""
KEYED = f"""{LINES},
lk AS MATERIALIZED (SELECT *, {S.key("text")} AS norm FROM lft), rk AS MATERIALIZED (SELECT *, {S.key("text")} AS norm FROM rgt),
lr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, norm ORDER BY ord) AS n FROM lk),
rr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, norm ORDER BY ord) AS n FROM rk),
ex AS (SELECT lr.pair_id, lr.ord AS l, rr.ord AS r FROM lr JOIN rr USING (pair_id, norm, n))"""


def keyed(spark, sf_dir):
    key = lambda d: d.withColumn("norm", text.normalize_for_compare(F.col("text")))
    return key(left_lines(spark, sf_dir)), key(right_lines(spark, sf_dir))


CELLS_SQL = """WITH li AS (SELECT l_orderkey AS pair_id, CAST(l_linenumber AS INTEGER) AS row, min(l_partkey) AS part, CAST(min(round(l_quantity)) AS BIGINT) AS qty,
  CAST(min(round(l_extendedprice * 100)) AS BIGINT) AS cents, CAST(min(round(l_discount * 100)) AS BIGINT) AS pct FROM lineitem GROUP BY 1, 2),
money AS MATERIALIZED (SELECT *, CAST(cents // 100000 AS VARCHAR) || ',' || lpad(CAST((cents // 100) % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS said FROM li),
cells AS (
  SELECT pair_id, 0 AS "table", row, 0 AS col, CASE WHEN part % 3 = 0 THEN 'Revenue of part ' ELSE 'Shares outstanding, part ' END || part || ' (' || (row % 9) || ')' AS text FROM money
  UNION ALL SELECT pair_id, 0, row, 1, CAST(qty AS VARCHAR) FROM money
  UNION ALL SELECT pair_id, 0, row, 2, CASE WHEN row % 2 = 0 THEN '$ ' ELSE '' END || said FROM money
  UNION ALL SELECT pair_id, 0, row, 3, pct || '%' FROM money)"""


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an order's lines meet once: rows, tables and pairs then lie where they are, and need no other shuffle
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount").repartition("l_orderkey")
    li = lines.groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("row")).agg(
        F.min("l_partkey").alias("part"), F.min(F.round("l_quantity")).cast("long").alias("qty"), F.min(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"), F.min(F.round(F.col("l_discount") * 100)).cast("long").alias("pct")
    )
    said = F.expr("concat(cents div 100000, ',', lpad(cast((cents div 100) % 1000 as string), 3, '0'), '.', lpad(cast(cents % 100 as string), 2, '0'))")
    label = F.concat(F.when(F.col("part") % 3 == 0, "Revenue of part ").otherwise("Shares outstanding, part "), "part", F.lit(" ("), F.col("row") % 9, F.lit(")"))
    texts = F.array(label, F.col("qty").cast("string"), F.concat(F.when(F.col("row") % 2 == 0, "$ ").otherwise(""), said), F.concat("pct", F.lit("%")))
    return li.select("pair_id", F.lit(0).alias("table"), "row", F.posexplode(texts).alias("col", "text")).withColumn("order", F.col("row") * 10 + F.col("col"))


CELL_KEYS = f"""{CELLS_SQL},
rowkeys AS MATERIALIZED (SELECT pair_id, "table", row, {S.row_key("text")} AS row_key FROM cells WHERE col = 0),
slots AS MATERIALIZED (SELECT cells.*, row * 10 + col AS ord, row_key, row_number() OVER w - 1 AS row_slot,
  CASE WHEN col > 0 THEN sum(CASE WHEN col > 0 THEN 1 ELSE 0 END) OVER w - 1 END AS numeric_slot FROM cells JOIN rowkeys USING (pair_id, "table", row) WINDOW w AS (PARTITION BY pair_id, "table", row ORDER BY col ROWS UNBOUNDED PRECEDING))"""


def slotted(spark, sf_dir) -> DataFrame:
    from ..sources.slots import with_slots

    return with_slots(cells_of(spark, sf_dir).withColumn("table_cell", F.lit(True)), "pair_id")


# ---- normalisation ---------------------------------------------------------


def _column_query(name: str, column: Callable, expr: str, source: str = "lines") -> None:
    def run(spark, sf_dir):
        return left_lines(spark, sf_dir).select("pair_id", F.col("order").cast("int").alias("ord"), column(F.col("text")).alias("value"))

    run.__name__ = name
    query(f"{LINES} SELECT pair_id, CAST(ord AS INTEGER) AS ord, {expr} AS value FROM (SELECT *, {S.key('text')} AS k FROM lft)")(run)


for _name, _column, _expr in (
    ("normalize_text", text.normalize_text, S.text("text")),
    ("normalize_proof", text.normalize_proof, S.proof("text")),
    ("strip_footnote_markers", text.strip_footnote_markers, S.no_marks("text")),
    ("normalize_compare", text.normalize_for_compare, S.key("text")),
    ("normalize_row_key", text.normalize_row_key, S.row_key("text")),
    ("strip_leading_markers", text.strip_leading_markers, S.no_lead("text")),
    ("alnum_key", text.normalize_alnum, S.alnum("text")),
    ("normalize_without_refs", text.normalize_without_refs, S.no_refs("text")),
    ("visible_text", text.visible, f"regexp_matches({S.key('text')}, '[a-z0-9]')"),
    ("headerish_text", text.headerish, S.headerish("text")),
    ("bag_size", lambda c: F.size(text.bag(c)), f"CAST(len({S.bag('text')}) AS INTEGER)"),
    ("bigram_count", lambda c: F.size(text.bigrams(c)), f"CAST(len({S.grams_of('k')}) AS INTEGER)"),
    ("separator_symbol", text.separator_symbol, S.sub("text", r"\s+")),
    ("describe_whitespace", text.describe_whitespace, "CASE length(text) - length(replace(text, ' ', '')) WHEN 0 THEN 'no space' WHEN 1 THEN '1 space' ELSE (length(text) - length(replace(text, ' ', ''))) || ' spaces' END"),
    ("shorten_text", lambda c: text.shorten(c, 40), f"CASE WHEN length(trim({S.sub(S.text('text'), r'\s+', ' ')})) <= 40 THEN trim({S.sub(S.text('text'), r'\s+', ' ')}) ELSE rtrim(substring(trim({S.sub(S.text('text'), r'\s+', ' ')}), 1, 39)) || '…' END"),
    ("quote_role", roles.quote_role, f"CASE WHEN contains({S.key('text')}, 'chief financial officer') OR contains({S.key('text')}, 'finance chief') OR regexp_matches({S.key('text')}, '\\bcfo\\b') THEN 'cfo' WHEN contains({S.key('text')}, 'chief executive officer') OR regexp_matches({S.key('text')}, '\\bceo\\b') THEN 'ceo' END"),
    ("footnote_marker", roles.footnote_marker, rf"nullif(regexp_extract({S.text('text')}, '^\s*\(?(\d{{1,2}})\)?(?:\s+|$)', 1), '')"),
):
    _column_query(_name, _column, _expr)


@query(f"{LINES} SELECT pair_id, CAST(ord AS INTEGER) AS ord, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_filter(t, lambda x: {S.is_number('x')})) AS INTEGER) AS n_numbers, array_to_string(list_transform(t, lambda x: {S.token_norm('x')}), ' ') AS norms FROM (SELECT pair_id, ord, {S.tokens('text')} AS t FROM lft)")
def diff_token_counts(spark, sf_dir):
    t = left_lines(spark, sf_dir).withColumn("t", tokens.token_texts(F.col("text")))
    numbers = F.size(F.filter("t", lambda x: tokens.is_number_token(x)))
    return t.select("pair_id", F.col("order").cast("int").alias("ord"), F.size("t").alias("n_tokens"), numbers.alias("n_numbers"), F.array_join(F.transform("t", lambda x: tokens.norm_of_token(x)), " ").alias("norms"))


@query()
def diff_tokens(spark, sf_dir):
    """Tokens with offsets; needs Python."""
    return left_lines(spark, sf_dir).select("pair_id", "order", F.explode(aligned.diff_tokens("text")).alias("t")).select("pair_id", "order", "t.*")


NUM = "CAST(replace(replace(regexp_replace(text, '^\\$ ', ''), ',', ''), '%', '') AS DOUBLE)"


@query(f"{CELLS_SQL} SELECT pair_id, row, col, {NUM} AS value, contains(text, '%') AS is_percent FROM cells WHERE col > 0")
def numeric_parse(spark, sf_dir):
    n = tokens.parse_number(F.col("text"))
    return cells_of(spark, sf_dir).where("col > 0").select("pair_id", "row", "col", n["value"].alias("value"), n["is_percent"].alias("is_percent"))


@query(f"""{CELLS_SQL}, n AS MATERIALIZED (SELECT pair_id, row, col, {NUM} AS v, contains(text, '%') AS p FROM cells WHERE col > 0)
SELECT a.pair_id, a.row, a.col AS col_a, b.col AS col_b, round(CASE WHEN a.p <> b.p THEN 0.0 WHEN a.v = b.v THEN 1.0 WHEN (a.v < 0) <> (b.v < 0) THEN 0.0
 WHEN a.v <> 0 AND b.v <> 0 AND abs(log10(abs(nullif(a.v, 0))) - log10(abs(nullif(b.v, 0)))) > 1 THEN 0.0 ELSE greatest(0.0, 1 - least(1.0, abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1) * 0.5)) END, 9) AS score
FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.row = b.row AND a.col < b.col""")
def numeric_compatibility(spark, sf_dir):
    n = cells_of(spark, sf_dir).where("col > 0").select("pair_id", "row", F.struct("col", tokens.parse_number(F.col("text")).alias("v")).alias("n"))
    # cells lie by (pair, row) already, so a row's numbers meet without a shuffle, each parsed once
    rows = n.groupBy("pair_id", "row").agg(F.array_sort(F.collect_list("n")).alias("all"))
    both = rows.select("pair_id", "row", "all", F.explode("all").alias("a")).select("pair_id", "row", "a", F.explode("all").alias("b")).where("a.col < b.col")
    return both.select("pair_id", "row", F.col("a.col").alias("col_a"), F.col("b.col").alias("col_b"), F.round(tokens.parsed_compatibility(F.col("a.v"), F.col("b.v")), 9).alias("score"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS phrase FROM orders")
def date_phrases(spark, sf_dir):
    said = F.concat(F.lit("as of "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" it was"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(tokens.date_phrases(said), F.lit(0)).alias("phrase"))


@query(f"{CELLS_SQL} SELECT pair_id, row, col, {S.symbol('text')} AS symbol FROM cells")
def currency_symbols(spark, sf_dir):
    return cells_of(spark, sf_dir).select("pair_id", "row", "col", tokens.currency_symbol(F.col("text")).alias("symbol"))


# ---- similarity and joins --------------------------------------------------

CAND = f"""{KEYED},
ml AS (SELECT pair_id, ord, norm FROM lk ANTI JOIN ex ON lk.pair_id = ex.pair_id AND lk.ord = ex.l), mr AS (SELECT pair_id, ord, norm FROM rk ANTI JOIN ex ON rk.pair_id = ex.pair_id AND rk.ord = ex.r),
lt AS (SELECT *, {S.words_of('norm')} AS t, {S.grams_of('norm')} AS g, CAST(greatest(1, round_even(length(norm) / 30.0, 0)) AS INTEGER) AS b FROM ml), rt AS (SELECT *, {S.words_of('norm')} AS t, {S.grams_of('norm')} AS g, CAST(greatest(1, round_even(length(norm) / 30.0, 0)) AS INTEGER) AS b FROM mr),
lw AS (SELECT pair_id, ord, list_filter(t, lambda x: length(x) >= 3) AS w FROM lt), rw AS (SELECT pair_id, ord, list_filter(t, lambda x: length(x) >= 3) AS w FROM rt),
lw2 AS (SELECT pair_id, ord, list_transform(list_distinct(w), lambda x: struct_pack(p := list_position(w, x), x := x)) AS d FROM lw),
lw3 AS (SELECT pair_id, ord, unnest(list_sort(d)[:3]).x AS word FROM lw2), rw3 AS (SELECT pair_id, ord, unnest(list_distinct(w)) AS word FROM rw),
cand AS (SELECT DISTINCT c.pair_id, c.l, c.r FROM (
  SELECT lw3.pair_id, lw3.ord AS l, rw3.ord AS r FROM lw3 JOIN rw3 USING (pair_id, word)
  UNION ALL SELECT lt.pair_id, lt.ord, rt.ord FROM lt JOIN rt ON lt.pair_id = rt.pair_id AND rt.b BETWEEN lt.b - 1 AND lt.b + 1) c
  JOIN lt ON lt.pair_id = c.pair_id AND lt.ord = c.l JOIN rt ON rt.pair_id = c.pair_id AND rt.ord = c.r
  WHERE least(greatest(length(lt.norm), 1), greatest(length(rt.norm), 1)) >= 0.45 * greatest(length(lt.norm), length(rt.norm), 1))"""


def loose_sides(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    ex = matching.exact_by_rank(a, b)
    return matching.prepared(matching.unmatched(a, ex, "left_order")), matching.prepared(matching.unmatched(b, ex, "right_order"))


@query(f"""{KEYED} SELECT (SELECT count(*) FROM lk) AS left_blocks, (SELECT count(*) FROM rk) AS right_blocks, (SELECT count(*) FROM ex) AS exact_matches,
(SELECT count(*) FROM lk) - (SELECT count(*) FROM ex) AS left_only, (SELECT count(*) FROM rk) - (SELECT count(*) FROM ex) AS right_only""")
def exact_block_match(spark, sf_dir):
    """Counts of exactly matched and one-sided blocks over all pairs."""
    a, b = keyed(spark, sf_dir)
    per_key = lambda d, n: d.groupBy("pair_id", "norm").agg(F.count("*").alias(n))
    # n-th copies pair with n-th copies, so a key's matches are the smaller count: no join of single rows is needed
    met = per_key(a, "l").join(per_key(b, "r"), ["pair_id", "norm"], "full_outer").select(F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    s = met.agg(F.sum("l").alias("left_blocks"), F.sum("r").alias("right_blocks"), F.sum(F.least("l", "r")).alias("exact_matches"))
    return s.select("*", (F.col("left_blocks") - F.col("exact_matches")).alias("left_only"), (F.col("right_blocks") - F.col("exact_matches")).alias("right_only"))


@query(f"{KEYED} SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order FROM ex")
def exact_pairs(spark, sf_dir):
    return matching.exact_by_rank(*keyed(spark, sf_dir))


@query(f"{KEYED} SELECT lk.pair_id, CAST(lk.ord AS INTEGER) AS ord FROM lk ANTI JOIN ex ON lk.pair_id = ex.pair_id AND lk.ord = ex.l")
def unmatched_left(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    return matching.unmatched(a, matching.exact_by_rank(a, b), "left_order").select("pair_id", F.col("order").alias("ord"))


@query(f"{KEYED} SELECT rk.pair_id, CAST(rk.ord AS INTEGER) AS ord FROM rk ANTI JOIN ex ON rk.pair_id = ex.pair_id AND rk.ord = ex.r")
def unmatched_right(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    return matching.unmatched(b, matching.exact_by_rank(a, b), "right_order").select("pair_id", F.col("order").alias("ord"))


@query(f"{CAND} SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order FROM cand")
def blocking_candidates(spark, sf_dir):
    return matching.candidates(*loose_sides(spark, sf_dir))


PAIRED = f"{CAND}, pr AS (SELECT c.pair_id, c.l, c.r, lt.t AS ta, rt.t AS tb, lt.g AS ga, rt.g AS gb, lt.norm AS a, rt.norm AS b FROM cand c JOIN lt ON lt.pair_id = c.pair_id AND lt.ord = c.l JOIN rt ON rt.pair_id = c.pair_id AND rt.ord = c.r)"


def candidate_pairs(spark, sf_dir):
    a, b = loose_sides(spark, sf_dir)
    side = lambda d, p: d.select("pair_id", F.col("order").alias(f"{p}_order"), F.col("norm").alias(p[0] + "n"), F.col("tokens").alias(p[0] + "t"), F.col("grams").alias(p[0] + "g"))
    return matching.candidates(a, b).join(side(a, "left"), ["pair_id", "left_order"]).join(side(b, "right"), ["pair_id", "right_order"])


@query(f"{PAIRED} SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order, round({S.jaccard('ta', 'tb')}, 9) AS jaccard, round({S.dice('ga', 'gb')}, 9) AS dice, round({S.overlap('ta', 'tb')}, 9) AS overlap, round({S.blend('ta', 'tb', 'ga', 'gb', 'a', 'b')}, 9) AS blend FROM pr")
def similarities(spark, sf_dir):
    c, r = F.col, lambda x: F.round(x, 9)
    p = candidate_pairs(spark, sf_dir)
    blend = similarity.similarity_of(c("lt"), c("rt"), c("lg"), c("rg"), c("ln"), c("rn"))
    return p.select("pair_id", "left_order", "right_order", r(similarity.jaccard(c("lt"), c("rt"))).alias("jaccard"), r(similarity.dice_numbered(c("lg"), c("rg"))).alias("dice"), r(similarity.overlap_ratio(c("lt"), c("rt"))).alias("overlap"), r(blend).alias("blend"))


@query(f"""{PAIRED}, sc AS (SELECT pair_id, l, r, round({S.blend('ta', 'tb', 'ga', 'gb', 'a', 'b')}, 9) AS score FROM pr)
SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order, score FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY score DESC, r) AS n FROM sc WHERE score >= 0.73) WHERE n = 1""")
def best_approx_match(spark, sf_dir):
    a, b = loose_sides(spark, sf_dir)
    return matching.best_of(matching.scored(matching.candidates(a, b), a, b), 0.73).withColumn("score", F.round("score", 9))


@query()
def staged_match(spark, sf_dir):
    return matching.staged(left_lines(spark, sf_dir), right_lines(spark, sf_dir))


@query(f"""WITH b AS (SELECT item_id, {S.key('text')} AS k FROM benchmark), d AS (SELECT doc_id, {S.key('text')} AS k FROM documents)
SELECT CAST(item_id AS BIGINT) AS item_id, doc_id FROM b JOIN d ON contains(d.k, b.k) WHERE b.k <> ''""")
def containment_join(spark, sf_dir):
    side = lambda d, k: d.select(F.col(k).alias("order"), text.normalize_for_compare(F.col("text")).alias("norm")).withColumn("tokens", text.bag(F.col("norm")))
    met = matching.contained(side(table(spark, sf_dir, "benchmark"), "item_id"), side(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id"))
    return met.select(F.col("left_order").alias("item_id"), F.col("right_order").alias("doc_id"))


@query(f"""{PAIRED} SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(b, a) THEN 0.99 WHEN len(ta) <= 4 THEN 0.0
 WHEN len(ta) >= 8 AND {S.overlap('ta', 'tb')} >= 0.94 THEN 0.9 + least(0.09, ({S.overlap('ta', 'tb')} - 0.94) * 1.5) WHEN len(ta) >= 20 AND {S.overlap('ta', 'tb')} >= 0.88 THEN 0.84 + least(0.05, ({S.overlap('ta', 'tb')} - 0.88) * 1.2) ELSE 0.0 END, 9) AS score FROM pr""")
def containment_scores(spark, sf_dir):
    return candidate_pairs(spark, sf_dir).select("pair_id", "left_order", "right_order", F.round(similarity.containment(F.col("ln"), F.col("rn")), 9).alias("score"))


@query(f"{PAIRED} SELECT pair_id, CAST(l AS INTEGER) AS left_order, CAST(r AS INTEGER) AS right_order, CASE WHEN len(ta) = 0 THEN 0.0 ELSE round(list_reduce(list_prepend(0, list_transform(range(1, len(tb) + 1), lambda i: CAST(i AS BIGINT))), lambda n, i: CASE WHEN n < len(ta) AND ta[n + 1] = tb[i] THEN n + 1 ELSE n END)::DOUBLE / len(ta), 9) END AS share FROM pr")
def subsequence_share(spark, sf_dir):
    return candidate_pairs(spark, sf_dir).select("pair_id", "left_order", "right_order", F.round(similarity.subsequence_ratio(F.col("lt"), F.col("rt")), 9).alias("share"))


# ---- tables ----------------------------------------------------------------


@query(f"{CELL_KEYS} SELECT pair_id, row, col, row_key, CAST(row_slot AS INTEGER) AS row_slot, CAST(numeric_slot AS INTEGER) AS numeric_slot FROM slots")
def cell_slots(spark, sf_dir):
    return slotted(spark, sf_dir).select("pair_id", "row", "col", "row_key", "row_slot", "numeric_slot")


def edited_cells(spark, sf_dir):
    """Left cells, and right ones with every third value's last digit set to 9 and no symbols in rows divisible by 4."""
    a = slotted(spark, sf_dir)
    hit = (F.col("col") > 0) & ((F.col("pair_id") + F.col("row") + F.col("col")) % 3 == 0)
    said = F.when(hit, F.regexp_replace("text", r"[0-9](%?)$", "9$1")).when(F.col("row") % 4 == 0, F.regexp_replace("text", r"^\$ ", "")).otherwise(F.col("text"))
    b = a.withColumn("text", said)
    number = F.when(F.col("col") > 0, tokens.single_value(F.col("text")))
    done = lambda d: d.withColumn("norm", text.normalize_for_compare(F.col("text"))).withColumn("number", number).withColumn("alnum", text.normalize_alnum(F.col("text")))
    return done(a), done(b)


EDITED = f"""{CELL_KEYS}, edited AS (SELECT * REPLACE (CASE WHEN col > 0 AND (pair_id + row + col) % 3 = 0 THEN regexp_replace(text, '[0-9](%?)$', '9\\1') WHEN row % 4 = 0 THEN regexp_replace(text, '^\\$ ', '') ELSE text END AS text) FROM slots),
bth AS MATERIALIZED (SELECT a.pair_id, a.row, a.col, a.ord, a.row_key, a.text AS l, b.text AS r FROM slots a JOIN edited b USING (pair_id, row, col))"""


@query(f"{EDITED} SELECT pair_id, ord AS left_order, ord AS right_order, CASE WHEN {S.key('l')} = {S.key('r')} THEN 'exact' ELSE 'approx' END AS match_type, CASE WHEN {S.key('l')} = {S.key('r')} THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS score FROM bth WHERE col > 0")
def same_cell_prematch(spark, sf_dir):
    return matching.same_cell(*edited_cells(spark, sf_dir))


@query(f"""{EDITED}, f AS (SELECT pair_id, list_distinct(list(row_key) FILTER (row_key IS NOT NULL)) AS k, count(*) FILTER (col > 0) AS numbers FROM slots GROUP BY 1)
SELECT pair_id, 0 AS left_table, 0 AS right_table, CAST(6 + CASE WHEN len(k) > 0 THEN 2.5 ELSE 0 END + 0.75 + 0.75 + 0.5 AS DOUBLE) AS score FROM f WHERE len(k) >= 2 AND numbers >= 2""")
def table_family_scores(spark, sf_dir):
    a, b = edited_cells(spark, sf_dir)
    return matching.family_scores(matching.table_families(a), matching.table_families(b))


@query(f"""{CELL_KEYS}, lab AS (SELECT pair_id, ord, row_number() OVER (PARTITION BY pair_id ORDER BY ord) - 1 AS n FROM slots WHERE col = 0),
gone AS (SELECT pair_id, ord, row_number() OVER (PARTITION BY pair_id ORDER BY ord) - 1 AS n FROM slots WHERE col = 0 AND (pair_id + row) % 4 <> 1)
SELECT lab.pair_id, lab.ord AS left_order, gone.ord AS right_order, CAST(n AS INTEGER) AS ordinal FROM lab JOIN gone USING (pair_id, n)""")
def ordinal_recovery(spark, sf_dir):
    lab = slotted(spark, sf_dir).where("col = 0").withColumn("structure_role", F.lit("table_row_label")).withColumn("family_table_index", F.col("table"))
    return matching.ordinal_pairs(lab, lab.where("(pair_id + row) % 4 <> 1")).select("pair_id", "left_order", "right_order", "ordinal")


@query(f"""{CELL_KEYS}, body AS (SELECT pair_id, min(row) AS first FROM slots WHERE col = 0 AND NOT {S.headerish('text')} GROUP BY 1)
SELECT s.pair_id, s.row, s.col, CASE WHEN first IS NULL OR s.row < first THEN 'table_column_header' WHEN col > 0 THEN 'table_data_cell' ELSE 'table_row_label' END AS role FROM slots s LEFT JOIN body USING (pair_id)""")
def structural_roles(spark, sf_dir):
    b = compare.completed(slotted(spark, sf_dir))
    return roles.assign_roles(b, "pair_id").select("pair_id", "row", "col", F.col("structure_role").alias("role"))


@query(f"""{CELL_KEYS}, m AS (SELECT *, CASE WHEN col > 0 THEN {S.symbol('text')} END AS own FROM slots)
SELECT pair_id, row, col, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY pair_id, row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS row_symbol FROM m""")
def row_currency(spark, sf_dir):
    return tokens.with_row_currency(slotted(spark, sf_dir), "pair_id").select("pair_id", "row", "col", "row_symbol")


@query(f"""{CELL_KEYS}, m AS (SELECT *, CASE WHEN col > 0 THEN {NUM} END AS v, sum(CASE WHEN contains(text, '%') THEN 1 ELSE 0 END) OVER w AS pc, sum(CASE WHEN {S.symbol('text')} IS NOT NULL THEN 1 ELSE 0 END) OVER w AS sy
 FROM (SELECT * REPLACE (CASE WHEN col = 3 AND row % 9 <> 0 THEN replace(text, '%', '') ELSE text END AS text) FROM slots) WINDOW w AS (PARTITION BY pair_id ORDER BY row RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING))
SELECT pair_id, row, col, CASE WHEN col > 0 AND (abs(v) >= 100 OR contains(text, ',')) AND pc < 2 AND sy >= 1 AND NOT {S.any_of('row_key', ("shares used in computing", "outstanding shares", "shares outstanding", "tax rate", "effective tax rate", "% of total", "operating margin"))} AND {S.any_of('row_key', ("revenue",))} THEN '$' END AS table_symbol FROM m""")
def table_currency(spark, sf_dir):
    few = slotted(spark, sf_dir).withColumn("text", F.when((F.col("col") == 3) & (F.col("row") % 9 != 0), F.replace("text", F.lit("%"), F.lit(""))).otherwise(F.col("text")))
    return tokens.with_table_currency(few, "pair_id").select("pair_id", "row", "col", "table_symbol")


# ---- comments --------------------------------------------------------------


def explained(pairs: DataFrame, profile: matcher.Profile = matcher.Profile()) -> DataFrame:  # noqa: B008
    """The comments of pairs (pair_id, l, r): sides are structs with order, text and what else is known of a block."""
    same = text.normalize_for_compare(F.col("l.text")) == text.normalize_for_compare(F.col("r.text"))
    rated = pairs.withColumns({"match_type": F.when(same, "exact").otherwise("approx"), "score": F.when(same, 1.0).otherwise(0.95), "group_type": F.lit(None).cast("string")})
    return diff.comments(rated, profile)


def cell_pairs(spark, sf_dir):
    """Comments of cells that differ, by the operator, with their places."""

    def side(cells: DataFrame, name: str) -> DataFrame:
        shown = compare.with_currency(compare.completed(cells.drop("norm", "number", "alnum")))
        return shown.where("col > 0").select("pair_id", "row", "col", F.struct("order", "text", "table_cell", "table", "row", "col", "row_key", "row_slot", "numeric_slot", "row_symbol", "currency").alias(name))

    a, b = edited_cells(spark, sf_dir)
    met_in_place(a, b)
    met = side(a, "l").join(side(b, "r"), ["pair_id", "row", "col"]).where(F.col("l.text") != F.col("r.text"))
    said = explained(met.select("pair_id", "l", "r"))
    return said.select("pair_id", F.floor(F.col("right_order") / 10).cast("int").alias("row"), (F.col("right_order") % 10).alias("col"), F.col("right_order").alias("order"), "contents")


TOK = lambda k: rf"regexp_replace({k}, '^\$ ', '')"
COMMENTS = f"""{EDITED}, shown AS (SELECT *, coalesce({S.symbol('l')}, '') AS lc, coalesce({S.symbol('r')}, '') AS rc FROM bth),
n AS (SELECT *, {TOK('l')} AS ln, {TOK('r')} AS rn, max(lc) OVER (PARTITION BY pair_id, row) AS lrow, max(rc) OVER (PARTITION BY pair_id, row) AS rrow FROM shown),
said AS (SELECT pair_id, row, col, ord, CASE WHEN replace(ln, ',', '') = replace(rn, ',', '') AND lc <> rc THEN 'The currency symbol is different, html has ' || rc || rn || ' while word has ' || lc || ln || '.'
 WHEN replace(ln, ',', '') <> replace(rn, ',', '') THEN 'The number is different, ' || (CASE WHEN rc <> '' THEN r ELSE rrow || rn END) || ' in html while ' || (CASE WHEN lc <> '' THEN l ELSE lrow || ln END) || ' in word.' END AS contents FROM n WHERE col > 0)"""


@query(f"{COMMENTS} SELECT pair_id, row, col, contents FROM said WHERE contents IS NOT NULL")
def cell_comments(spark, sf_dir):
    return cell_pairs(spark, sf_dir).select("pair_id", "row", "col", "contents")


@query(f"{COMMENTS} SELECT CASE WHEN contents LIKE 'The number%' OR contents LIKE 'The currency%' THEN 'high' ELSE 'medium' END AS confidence, 'critical' AS tier, count(*) AS n FROM said WHERE contents IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'medium', 'structural', count(*) FROM cells WHERE row % 4 = 1")
def review_tier_counts(spark, sf_dir):
    told = cell_pairs(spark, sf_dir).select("contents").unionByName(cells_of(spark, sf_dir).where("row % 4 = 1").select(F.lit("This DOCX content was not found in the HTML.").alias("contents")))
    return review.counts(told, [])


@query(f"{COMMENTS} SELECT pair_id, ord AS right_order, 0 AS token_index, contents, min(s) AS seq FROM (SELECT *, unnest([0, 1, 2]) AS s FROM said WHERE contents IS NOT NULL) GROUP BY ALL")
def dedupe_comments(spark, sf_dir):
    told = cell_pairs(spark, sf_dir).select("pair_id", F.col("order").alias("right_order"), F.lit(0).alias("token_index"), "contents", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    return review.dedupe(told)


@query(f"{COMMENTS} SELECT pair_id, ord AS right_order, '[High Confidence | Critical] ' || contents AS comment FROM said WHERE contents IS NOT NULL")
def grouped_comments(spark, sf_dir):
    told = cell_pairs(spark, sf_dir).select("pair_id", F.col("order").alias("right_order"), F.lit(0).alias("seq"), "contents")
    return review.grouped(told).select("pair_id", "right_order", F.explode("comments").alias("comment"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS pair_id, 'The date is different, ' || strftime(o_orderdate + INTERVAL 1 DAY, '%B ') || day(o_orderdate + INTERVAL 1 DAY) || ', ' || year(o_orderdate + INTERVAL 1 DAY) || ' in html while ' || strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) || ' in word.' AS contents FROM orders WHERE o_orderkey % 3 = 0""")
def date_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    say = lambda d: F.concat(F.lit("ended "), F.date_format(d, "MMMM d, yyyy"), F.lit(" as said"))
    later = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    side = lambda said, name: F.struct(F.lit(0).alias("order"), said.alias("text")).alias(name)
    return explained(o.select(F.col("o_orderkey").alias("pair_id"), side(say(F.col("o_orderdate")), "l"), side(say(later), "r"))).select("pair_id", "contents")


@query(f"""{KEYED}, bth AS (SELECT lk.pair_id, lk.ord, {S.tokens('lk.text')} AS x, {S.tokens('rk.text')} AS y FROM lk JOIN rk USING (pair_id, ord)),
n AS (SELECT pair_id, ord, list_filter(x, lambda t: {S.is_number('t')}) AS x, list_filter(y, lambda t: {S.is_number('t')}) AS y FROM bth),
z AS (SELECT pair_id, ord, list_filter(list_zip(x, y), lambda p: {S.token_norm('p[1]')} <> {S.token_norm('p[2]')}) AS d FROM n WHERE len(x) > 0 AND len(x) = len(y))
SELECT pair_id, CAST(ord AS INTEGER) AS ord, d[1][1] AS ours, d[1][2] AS theirs FROM z WHERE len(d) = 1""")
def single_number_differences(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    numbers = lambda c: F.filter(tokens.token_texts(c), lambda t: tokens.is_number_token(t))
    met = a.select("pair_id", "order", numbers(F.col("text")).alias("x")).join(b.select("pair_id", "order", numbers(F.col("text")).alias("y")), ["pair_id", "order"]).where("size(x) > 0 and size(x) = size(y)")
    off = F.filter(F.zip_with("x", "y", lambda p, q: F.when(tokens.norm_of_token(p) != tokens.norm_of_token(q), F.struct(p.alias("p"), q.alias("q")))), lambda d: d.isNotNull())
    return met.withColumn("d", off).where("size(d) = 1").select("pair_id", F.col("order").alias("ord"), F.col("d")[0]["p"].alias("ours"), F.col("d")[0]["q"].alias("theirs"))


@query(f"{KEYED} SELECT rk.pair_id, CAST(rk.ord AS INTEGER) AS right_order, 'This HTML block has no corresponding content in the DOCX.' AS contents FROM rk ANTI JOIN ex ON rk.pair_id = ex.pair_id AND rk.ord = ex.r WHERE regexp_matches(norm, '[a-z0-9]')")
def presence_comments(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    alone = matching.unmatched(b, matching.exact_by_rank(a, b), "right_order").where(F.col("norm").rlike("[a-z0-9]"))
    return alone.select("pair_id", F.col("order").alias("right_order"), F.lit("This HTML block has no corresponding content in the DOCX.").alias("contents"))


@query(f"""{KEYED}, c AS (SELECT pair_id, count(*) AS docx_blocks FROM lk GROUP BY 1), d AS (SELECT pair_id, count(*) AS html_blocks FROM rk GROUP BY 1), e AS (SELECT pair_id, count(*) AS exact_matches FROM ex GROUP BY 1)
SELECT pair_id, coalesce(docx_blocks, 0) AS docx_blocks, coalesce(html_blocks, 0) AS html_blocks, coalesce(exact_matches, 0) AS exact_matches, CAST(0 AS BIGINT) AS approx_matches, CAST(0 AS BIGINT) AS contained_matches,
coalesce(docx_blocks, 0) - coalesce(exact_matches, 0) AS docx_only, coalesce(html_blocks, 0) - coalesce(exact_matches, 0) AS html_only, CAST(0 AS BIGINT) AS held FROM c FULL JOIN d USING (pair_id) LEFT JOIN e USING (pair_id)""")
def comparison_summary(spark, sf_dir):
    a, b = keyed(spark, sf_dir)
    ex = matching.exact_by_rank(a, b)
    none = F.lit(None)
    both = ex.select("pair_id", "left_order", "right_order", F.lit("exact").alias("match_type"), F.lit(False).alias("held"))
    lo = matching.unmatched(a, ex, "left_order").select("pair_id", F.col("order").alias("left_order"), none.cast("int").alias("right_order"), none.cast("string").alias("match_type"), F.lit(False).alias("held"))
    ro = matching.unmatched(b, ex, "right_order").select("pair_id", none.cast("int").alias("left_order"), F.col("order").alias("right_order"), none.cast("string").alias("match_type"), F.lit(False).alias("held"))
    return review.summary(both.unionByName(lo).unionByName(ro))


@query("""WITH m AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, CAST(section AS BIGINT) AS section, min(turn) AS first_order, max(turn) AS last_order, count(*) AS blocks FROM m WHERE section > 0 GROUP BY 1, 2""")
def section_sessions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("order"), "role", "text")
    return matching.sections(turns, F.col("role") == "user").select(F.col("pair_id").alias("conv_id"), "section", "first_order", "last_order", "blocks")


@query("""SELECT conv_id, turn, first_value(CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_narrative FROM conversations""")
def next_narrative(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn"), F.col("turn").alias("order"), "text").withColumn("table_cell", F.lit(False)).withColumn("kind", F.lit("p"))
    return roles.with_next_narrative(turns, "conv_id").select("conv_id", "turn", "next_narrative")


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b\d{3}-\d{3}-\d{4}\b', 0), '') AS phone, nullif(regexp_extract(text, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b', 0), '') AS email FROM documents WHERE contains(text, '@')")
def contact_fields(spark, sf_dir):
    f = roles.contact_fields(F.col("text"))
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", f["phone"].alias("phone"), f["email"].alias("email"))


# ---- Python operators ------------------------------------------------------


@query()
def token_opcodes(spark, sf_dir):
    a, b = left_lines(spark, sf_dir), right_lines(spark, sf_dir)
    norms = lambda c: F.transform(tokens.token_texts(c), lambda x: tokens.norm_of_token(x))
    met = a.select("pair_id", "order", norms(F.col("text")).alias("x")).join(b.select("pair_id", "order", norms(F.col("text")).alias("y")), ["pair_id", "order"]).where("x <> y")
    return met.select("pair_id", "order", F.explode(aligned.opcodes("x", "y")).alias("c")).select("pair_id", "order", "c.*")


def doc_sides(spark, sf_dir, dealt=False):
    return left_lines(spark, sf_dir, dealt), right_lines(spark, sf_dir, dealt)


@query()
def faithful_match(spark, sf_dir):
    a, b = (compare.completed(x).withColumn("structure_role", F.lit("paragraph")).withColumn("family_table_index", F.lit(None).cast("int")) for x in doc_sides(spark, sf_dir, dealt=True))
    return matcher.match_pairs(a, b)


@query()
def text_comments(spark, sf_dir):
    return compare.Comparison().compare(*doc_sides(spark, sf_dir)).comments


@query()
def page_text_comments(spark, sf_dir):
    """The same pairs as a page extract, in proofreading."""
    return compare.Comparison(matcher.Profile("pdf", True)).compare(*doc_sides(spark, sf_dir)).comments


@query()
def collapsed_comments(spark, sf_dir):
    return review.collapse(compare.Comparison().compare(*doc_sides(spark, sf_dir)).comments)


@query()
def html_blocks(spark, sf_dir):
    return html.scan(spread(table(spark, sf_dir, "pages").select("page_id", "html"))).drop("runs")


@query()
def html_runs(spark, sf_dir):
    return html.scan(spread(table(spark, sf_dir, "pages").select("page_id", "html"))).select("doc_id", "order", F.explode("runs").alias("r")).select("doc_id", "order", "r.*")


def page_words(spark, sf_dir):
    """Words laid out on pages: a document's line is a row of 18 points, a character 5 points wide, six words a cluster."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    lines = left_lines(spark, sf_dir, dealt=True).select(F.col("pair_id").alias("doc_id"), F.floor(F.col("order") / 40).cast("int").alias("page"), (F.col("order") % 40).alias("n"), F.posexplode(words).alias("k", "text"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page", "n").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x0 = 5.0 * F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)) + 40.0 * F.floor(F.col("k") / 6)
    y0 = 40.0 + 18.0 * F.col("n")
    return lines.select("doc_id", "page", x0.alias("x0"), y0.alias("y0"), (x0 + 5.0 * F.length("text")).alias("x1"), (y0 + 10.0).alias("y1"), "text")


@query(f"""{LINES}, l2 AS (SELECT pair_id, ord, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM lft),
l3 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ord // 40 ORDER BY ord) - 1 AS line FROM l2 WHERE len(w) > 0),
l4 AS (SELECT pair_id, ord, line, w, unnest(range((len(w) + 5) // 6)) AS cluster FROM l3)
SELECT pair_id AS doc_id, CAST(ord // 40 AS INTEGER) AS page, CAST(line AS INTEGER) AS line, CAST(cluster AS INTEGER) AS cluster, array_to_string(w[cluster * 6 + 1 : cluster * 6 + 6], ' ') AS text FROM l4""")
def page_clusters(spark, sf_dir):
    return pages.clusters(page_words(spark, sf_dir)).select("doc_id", "page", "line", "cluster", "text")


@query()
def page_blocks(spark, sf_dir):
    return pages.blocks(page_words(spark, sf_dir))


def page_cells(spark, sf_dir):
    """Cells of an order's table as text blocks of a page: a row of 18 points, four columns."""
    x0 = F.element_at(F.array(*map(F.lit, (0.0, 300.0, 400.0, 550.0))), F.col("col") + 1)
    y0 = 40.0 + 18.0 * F.col("row")
    return cells_of(spark, sf_dir).select(F.col("pair_id").alias("doc_id"), F.lit(0).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 5.0 * F.length("text")).alias("x1"), (y0 + 10.0).alias("y1"), "text")


#: Single digits stand for page numbers on pages, and are no cells.
PAGE_ROWS = f"""{CELL_KEYS}, placed AS (SELECT *, col > 0 AND regexp_full_match(text, '[1-7]') AS chrome, dense_rank() OVER (PARTITION BY pair_id ORDER BY row) - 1 AS line, count(*) OVER (PARTITION BY pair_id) > 4 AS several FROM slots),
kept AS (SELECT pair_id AS doc_id, CAST(line AS INTEGER) AS row, col, text, row_key, several, CASE WHEN col > 0 THEN CAST(sum(CASE WHEN col > 0 THEN 1 ELSE 0 END) OVER w - 1 AS INTEGER) END AS numeric_slot, row_number() OVER w - 1 AS place
  FROM placed WHERE NOT chrome WINDOW w AS (PARTITION BY pair_id, line ORDER BY col ROWS UNBOUNDED PRECEDING))"""


@query(f"""{PAGE_ROWS} SELECT doc_id, row, CAST(col AS INTEGER) AS col, replace(text, '$ ', '') AS text, row_key, numeric_slot FROM kept WHERE several""")
def page_table_cells(spark, sf_dir):
    """Cells that are found again in the words of tables of two rows or more."""
    cells = page_cells(spark, sf_dir).select("doc_id", "page", "x0", "y0", "y1", F.posexplode(F.split("text", " ")).alias("k", "word"), F.split("text", " ").alias("all"))
    before = F.aggregate(F.slice("all", F.lit(1), F.col("k")), F.lit(0), lambda n, w: n + F.length(w) + 1)
    x0 = F.col("x0") + 5.0 * before
    words = cells.select("doc_id", "page", x0.alias("x0"), "y0", (x0 + 5.0 * F.length("word")).alias("x1"), "y1", F.col("word").alias("text"))
    return pages.blocks(words).where("table_cell").select("doc_id", "row", "col", "text", "row_key", "numeric_slot")


@query(f"""{PAGE_ROWS} SELECT doc_id, row, CAST(place AS INTEGER) AS col, replace(text, '$ ', '$') AS text, row_key, numeric_slot, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row, col) - 1 AS INTEGER) AS ord FROM kept""")
def page_standard_cells(spark, sf_dir):
    """Rows of text blocks."""
    return pages.standard_blocks(page_cells(spark, sf_dir)).select("doc_id", "row", "col", "text", "row_key", "numeric_slot", F.col("order").cast("int").alias("ord"))


@query()
def page_segments(spark, sf_dir):
    return roles.page_segments(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query()
def page_summary(spark, sf_dir):
    a, b = doc_sides(spark, sf_dir, dealt=True)
    met_in_place(a, b)
    right = b.withColumn("page", F.floor(F.col("order") / 8).cast("int")).withColumn("text", F.when(F.col("page") % 2 == 1, F.reverse("text")).otherwise(F.col("text")))
    ka, kb = (d.withColumn("norm", text.normalize_for_compare(F.col("text"))) for d in (a, right))
    return review.page_summary(right, a, matching.exact_by_rank(ka, kb, dealt=True), dealt=True)


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS text FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0B-\\x1F]', '', 'g'), chr(10)) AS s FROM documents)),
v AS (SELECT * FROM l WHERE regexp_matches({S.key('text')}, '[a-z0-9]'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS "order", 'p' AS kind, text, false AS heading, CAST(NULL AS INTEGER) AS heading_level, false AS list_item, false AS bold, false AS italic, false AS underline, false AS table_cell,
CAST(NULL AS INTEGER) AS "table", CAST(NULL AS INTEGER) AS row, CAST(NULL AS INTEGER) AS col, CAST(NULL AS VARCHAR) AS row_key, CAST(NULL AS INTEGER) AS row_slot, CAST(NULL AS INTEGER) AS numeric_slot FROM v""")
def docx_blocks(spark, sf_dir):
    """Word files made of the documents' lines, scanned back."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pyarrow as pa

    def made(batches):
        for batch in batches:
            files = []
            for said in batch.column(1).to_pylist():
                w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
                clean = "".join(c for c in said or "" if c >= " " or c == "\n")
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in clean.split("\n"))
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
                files.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    files = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(made, "doc_id long, content binary")
    return docx.scan_bytes(files).drop("runs")
