"""Native matching stages: joins and windows that also serve pairs too large for one task.

Sides have (pair_id, order, text, …) and, after ``prepared``, ``norm``, ``tokens`` and ``grams`` (numbered), each made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import numbered, set_overlap, similarity_of
from ..functions.text import grams_of_key, normalize_for_compare, words_of_key
from ..lineage import cut, met_in_place


def prepared(side: DataFrame) -> DataFrame:
    keyed = side if "norm" in side.columns else side.withColumn("norm", normalize_for_compare(F.col("text")))
    return keyed.withColumn("tokens", words_of_key(F.col("norm"))).withColumn("grams", numbered(grams_of_key(F.col("norm"))))


def short_key(norm: Column) -> Column:
    """A key's bytes if they are under 32, else their SHA-256: what tells long texts apart without carrying them."""
    return F.when(F.octet_length(norm) < 32, F.encode(norm, "utf-8")).otherwise(F.unhex(F.sha2(norm, 256)))


def exact_by_rank(left: DataFrame, right: DataFrame, dealt: bool = False) -> DataFrame:
    """The n-th copy of a text on one side with the n-th on the other: (pair_id, left_order, right_order).

    Both sides are dealt by text once, as short keys; copies are numbered and met where they lie.
    dealt: both sides lie by pair already, in as many parts.
    """
    side = lambda d, k: d.where("pair_id is not null and norm is not null").select("pair_id", short_key(F.col("norm")).alias("norm"), F.lit(k).alias("side"), "order")
    both = side(left, 0).unionByName(side(right, 1))
    both = both if dealt else both.repartition("pair_id", "norm")
    told = both.withColumn("n", F.row_number().over(Window.partitionBy("pair_id", "norm", "side").orderBy("order")))
    of = lambda k, d, name: F.max(F.when(F.col("side") == k, F.col("order"))).cast(d.schema["order"].dataType).alias(name)
    met = told.groupBy("pair_id", "norm", "n").agg(F.count("*").alias("sides"), of(0, left, "left_order"), of(1, right, "right_order"))
    return met.where("sides = 2").select("pair_id", "left_order", "right_order")


def unmatched(side: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    return side.join(matches.select("pair_id", F.col(column).alias("order")), ["pair_id", "order"], "left_anti")


def bucket(norm: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(norm) / 30).cast("int"))


def candidates(left: DataFrame, right: DataFrame, length_ratio: float = 0.45) -> DataFrame:
    """Pairs that share one of the left's first three longer words or lie in neighbouring length buckets.

    (pair_id, left_order, right_order), without doubles. Both joins are within a document pair.
    """
    long = F.filter("tokens", lambda t: F.length(t) >= 3)
    size = F.greatest(F.length("norm"), F.lit(1))
    lw = left.select("pair_id", F.col("order").alias("left_order"), size.alias("ls"), F.explode(F.slice(F.array_distinct(long), 1, 3)).alias("word"))
    rw = right.select("pair_id", F.col("order").alias("right_order"), size.alias("rs"), F.explode(F.array_distinct(long)).alias("word"))
    by_word = lw.join(rw, ["pair_id", "word"]).drop("word")
    at = bucket(F.col("norm"))
    lb = left.select("pair_id", F.col("order").alias("left_order"), size.alias("ls"), F.explode(F.sequence(at - 1, at + 1)).alias("b"))
    rb = right.select("pair_id", F.col("order").alias("right_order"), size.alias("rs"), at.alias("b"))
    both = by_word.unionByName(lb.join(rb, ["pair_id", "b"]).drop("b"))
    return both.where(F.least("ls", "rs") >= length_ratio * F.greatest("ls", "rs")).select("pair_id", "left_order", "right_order").distinct()


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds the blended similarity of candidate pairs."""
    side = lambda d, p: d.select("pair_id", F.col("order").alias(f"{p}_order"), F.col("norm").alias(f"{p}n"), F.col("tokens").alias(f"{p}t"), F.col("grams").alias(f"{p}g"))
    met = pairs.join(side(left, "left"), ["pair_id", "left_order"]).join(side(right, "right"), ["pair_id", "right_order"])
    c = F.col
    return met.select("pair_id", "left_order", "right_order", similarity_of(c("leftt"), c("rightt"), c("leftg"), c("rightg"), c("leftn"), c("rightn")).alias("score"))


def best_of(scores: DataFrame, floor: float) -> DataFrame:
    """Each left block's best partner, if good enough; ties go to the lower right order."""
    w = Window.partitionBy("pair_id", "left_order").orderBy(F.desc(F.round("score", 9)), "right_order")
    return scores.where(F.round("score", 9) >= floor).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def one_to_one(scores: DataFrame, floor: float) -> DataFrame:
    """Pairs that are each other's best, in rounds until none is left; what a round takes is gone for the next.

    Ties go to the lowest order on both sides. Where blocks of both sides all tie with one another, as copies of one
    line do, the n-th of one side takes the n-th of the other in the same round, as single rounds would in the end.
    Each round's rest is written once, so the plan doesn't double from round to round.
    """
    left = cut(scores.where(F.round("score", 9) >= floor))
    taken = left.limit(0)
    by = lambda *k: Window.partitionBy("pair_id", *k)
    place = lambda k, o: F.row_number().over(by(k).orderBy(F.desc("_s"), o))
    told = lambda c, w, cond: F.struct(F.count(F.when(cond, 1)).over(w), F.sum(F.when(cond, F.xxhash64(c).cast("decimal(20,0)"))).over(w))
    while not left.isEmpty():
        ties = left.withColumn("_s", F.round("score", 9)).withColumn("_a", F.max("_s").over(by("left_order"))).withColumn("_b", F.max("_s").over(by("right_order")))
        ties = ties.withColumn("_j", place("left_order", "right_order")).withColumn("_i", place("right_order", "left_order"))
        # the blocks that are best for each; if all of them are told the same, every block of a group ties with every other
        ties = ties.withColumn("_l", told("right_order", by("left_order"), F.expr("_s = _a"))).withColumn("_r", told("left_order", by("right_order"), F.expr("_s = _b"))).where("_s = _a and _s = _b")
        ties = ties.withColumn("_whole", (told("left_order", by("right_order", "_l"), F.lit(True)) == F.col("_r")) & (told("right_order", by("left_order", "_r"), F.lit(True)) == F.col("_l")))
        got = cut(ties.where("_whole and _i = _j or _i = 1 and _j = 1").select(*scores.columns))
        if got.isEmpty():
            break
        taken = taken.unionByName(got)
        left = cut(left.join(got.select("pair_id", "left_order"), ["pair_id", "left_order"], "left_anti").join(got.select("pair_id", "right_order"), ["pair_id", "right_order"], "left_anti"))
    return taken


def staged(left: DataFrame, right: DataFrame, floor: float = 0.73) -> DataFrame:
    """Exact pairs, then approximate ones among what is left: (pair_id, left_order, right_order, match_type, score)."""
    a, b = prepared(left), prepared(right)
    exact = exact_by_rank(a, b)
    rest_a, rest_b = unmatched(a, exact, "left_order"), unmatched(b, exact, "right_order")
    near = one_to_one(scored(candidates(rest_a, rest_b), rest_a, rest_b), floor)
    return exact.select("*", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score")).unionByName(near.select("pair_id", "left_order", "right_order", F.lit("approx").alias("match_type"), "score"))


def same_cell(left: DataFrame, right: DataFrame) -> DataFrame:
    """Single numbers in the same cell: score 1 for equal keys, else .95.

    Sides: (pair_id, order, table, row, col, norm, number, row_key, row_slot, numeric_slot), table numbers aligned.
    """
    met_in_place(left, right)
    keys = ["pair_id", "table", "row", "col"]
    names = ("order", "norm", "number", "row_key", "row_slot", "numeric_slot")
    a = left.where("number is not null").select(*keys, *[F.col(c).alias(f"l_{c}") for c in names])
    b = right.where("number is not null").select(*keys, *[F.col(c).alias(f"r_{c}") for c in names])
    agree = lambda k: F.coalesce(F.col(f"l_{k}") == F.col(f"r_{k}"), F.lit(True))
    row_alike = similarity_of(words_of_key(F.col("l_row_key")), words_of_key(F.col("r_row_key")), numbered(grams_of_key(F.col("l_row_key"))), numbered(grams_of_key(F.col("r_row_key"))), F.col("l_row_key"), F.col("r_row_key"))
    # as one case of another: parts of an "or" that stand in the condition twice would be computed for every pair first
    rows_agree = F.when(F.col("l_row_key") == F.col("r_row_key"), True).otherwise(F.coalesce(row_alike >= 0.94, F.lit(True)))
    met = a.join(b, keys).where(agree("row_slot") & agree("numeric_slot") & rows_agree)
    same = F.col("l_norm") == F.col("r_norm")
    return met.select("pair_id", F.col("l_order").alias("left_order"), F.col("r_order").alias("right_order"), F.when(same, "exact").otherwise("approx").alias("match_type"), F.when(same, 1.0).otherwise(0.95).alias("score"))


def ordinals(side: DataFrame) -> DataFrame:
    """Adds ``group`` and ``ordinal`` of headers and row labels within their table."""
    role = F.col("structure_role")
    group = F.when(role.isin("table_title", "table_subtitle"), "title").when(role == "table_column_header", "column").when(role == "table_row_label", "label")
    w = Window.partitionBy("pair_id", "family_table_index", "group").orderBy("order")
    return side.withColumn("group", group).where("group is not null and family_table_index is not null").withColumn("ordinal", F.row_number().over(w) - 1)


def ordinal_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    keys = ["pair_id", "family_table_index", "group", "ordinal"]
    a = ordinals(left).select(*keys, F.col("order").alias("left_order"))
    b = ordinals(right).select(*keys, F.col("order").alias("right_order"))
    return a.join(b, keys)


def table_families(cells: DataFrame) -> DataFrame:
    """Row keys, header texts and counts of each table: (pair_id, table, row_keys, headers, rows, numbers, comparable)."""
    header = F.when(F.col("number").isNull() & (F.col("alnum") != ""), F.struct("order", "alnum"))
    distinct = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["alnum"]))
    keys = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("row_key").isNotNull(), F.struct("order", F.col("row_key").alias("alnum"))))), lambda x: x["alnum"]))
    f = cells.groupBy("pair_id", "table").agg(keys.alias("row_keys"), F.slice(distinct(header), 1, 8).alias("headers"), F.count("numeric_slot").alias("numbers"))
    f = f.withColumn("rows", F.size("row_keys"))
    return f.withColumn("comparable", (F.col("rows") >= 2) & ((F.col("numbers") >= 2) | (F.size("headers") >= 3)))


def family_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scores of comparable tables of a pair, but for their titles: (pair_id, left_table, right_table, score)."""
    w = Window.partitionBy("pair_id").orderBy("table")
    side = lambda d, p: d.where("comparable").withColumn("rank", F.row_number().over(w)).select("pair_id", *[F.col(c).alias(p + c) for c in ("table", "row_keys", "headers", "rows", "numbers", "rank")])
    met = side(left, "l").join(side(right, "r"), "pair_id")
    part = lambda k: F.least("l" + k, "r" + k) / F.greatest(F.greatest("l" + k, "r" + k), F.lit(1))
    near = 1.0 - F.least(F.lit(1.0), F.abs(F.col("lrank") - F.col("rrank")) * 0.5)
    score = 6.0 * set_overlap(F.col("lrow_keys"), F.col("rrow_keys")) + 2.5 * set_overlap(F.col("lheaders"), F.col("rheaders")) + 0.75 * part("rows") + 0.75 * part("numbers") + 0.5 * near
    return met.select("pair_id", F.col("ltable").alias("left_table"), F.col("rtable").alias("right_table"), score.alias("score"))


def sections(blocks: DataFrame, header: Column) -> DataFrame:
    """Sections by a running count of headers: (pair_id, section, first_order, last_order, blocks, text)."""
    w = Window.partitionBy("pair_id").orderBy("order")
    marked = blocks.withColumn("section", F.sum(header.cast("int")).over(w)).where("section > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n")
    return marked.groupBy("pair_id", "section").agg(F.min("order").alias("first_order"), F.max("order").alias("last_order"), F.count("*").alias("blocks"), text.alias("text"))


#: Left sides of a containment join up to this many words are sent to every task; larger ones are shuffled.
WORDS_SENT = 1_000_000


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left texts that stand whole in right ones, found through a rare word of the left's.

    Sides: (pair_id or nothing shared, order, norm, tokens). A right text that holds a left one has the left's word in
    the fewest right texts; only places travel to the join by words, texts are fetched for pairs that it finds.
    """
    a = left.where(F.size("tokens") > 0).select(F.col("order").alias("left_order"), F.explode(F.array_distinct("tokens")).alias("word"))
    sought = a.select("word").distinct()
    sent = F.broadcast(sought) if sought.limit(WORDS_SENT + 1).count() <= WORDS_SENT else sought
    b = right.select(F.col("order").alias("right_order"), F.explode(F.array_distinct("tokens")).alias("word")).join(sent, "word")
    b = cut(b)  # places of sought words only, read twice
    # a word that no right text has rules its left text out
    often = a.join(b.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    key = often.groupBy("left_order").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = cut(key.join(b, "word").select("left_order", "right_order"))
    # the semi joins sink below what makes keys of texts, so only texts of pairs are read again
    texts = lambda d, o, k: d.select(F.col("order").alias(o), F.col("norm").alias(k)).join(met.select(o).distinct(), o, "left_semi")
    met = met.join(texts(left, "left_order", "ln"), "left_order").join(texts(right, "right_order", "rn"), "right_order")
    return met.where(F.col("rn").contains(F.col("ln"))).select("left_order", "right_order")
