"""Review tiers, counts and reports over comments, natively."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions.roles import page_chrome
from ..functions.text import normalize_for_compare, visible
from ..lineage import cut, dealt_by

#: Pairs of a batch that are read into Python at once.
PAIRS_READ = 64

CRITICAL = (
    "the word is different", "the number is different", "the date is different", "the currency symbol is different", "the percent sign is different", "the symbol is different",
    "the spacing is different", "the word is extra", "the word is missing", "the number is extra", "the number is missing",
)
TIER_LABELS = {"critical": "Critical", "text": "Text", "formatting": "Formatting", "structural": "Structural", "informational": "Info"}


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def tier(contents: Column) -> Column:
    return tier_of(normalize_for_compare(contents))


def tier_of(said: Column) -> Column:
    """The tier of a comment from its key."""
    structural = _any([said.contains(x) for x in ("broadly matched", "no corresponding content", "was not found in the html", "was not found in the pdf")])
    text = said.startswith("the footnote text is different") | said.startswith("the paragraph text is different")
    return (
        F.when(structural, "structural").when(said.startswith("formatting differs"), "formatting").when(text, "text")
        .when(_any([said.startswith(x) for x in CRITICAL]), "critical").otherwise("informational")
    )


def confidence(contents: Column) -> Column:
    return F.when(tier(contents) == "critical", "high").otherwise("medium")


def label(contents: Column) -> Column:
    t = tier(contents)
    name = F.lit("Info")
    for k, v in TIER_LABELS.items():
        name = F.when(t == k, v).otherwise(name)
    return F.concat(F.lit("["), F.initcap(confidence(contents)), F.lit(" Confidence | "), name, F.lit("]"))


def labelled(contents: Column) -> Column:
    return F.concat(label(contents), F.lit(" "), contents)


def counts(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Comments by confidence and tier."""
    # each comment's key is made once, and the confidence follows from the tier
    told = comments.select(*keys, normalize_for_compare(F.col("contents")).alias("_said")).select(*keys, tier_of(F.col("_said")).alias("tier"))
    n = told.groupBy(*keys, "tier").agg(F.count("*").alias("n"))
    return n.select(*keys, F.when(F.col("tier") == "critical", "high").otherwise("medium").alias("confidence"), "tier", "n")


def dedupe(comments: DataFrame) -> DataFrame:
    """The first of equal comments at one place of a pair."""
    w = Window.partitionBy("pair_id", "right_order", "token_index", "contents").orderBy("seq")
    return comments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def grouped(comments: DataFrame) -> DataFrame:
    """Labelled comments of each target block, in their order."""
    return comments.groupBy("pair_id", "right_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", labelled(F.col("contents")).alias("c")))), lambda x: x["c"]).alias("comments"))


EXTRA, MISSING = r"^The (number|word) is extra in (\w+), (.*)\. It is not present in word\.$", r"^The (number|word) is missing in (\w+), (.*) in word\.$"


def collapse(comments: DataFrame) -> DataFrame:
    """Neighbouring extra and missing comments of a block as one. In a run of such comments the pairs are 1-2, 3-4, …"""
    c = F.col("contents")
    e, m = c.rlike(EXTRA), c.rlike(MISSING)
    key = F.when(e, F.concat_ws("|", F.regexp_extract(c, EXTRA, 1), F.regexp_extract(c, EXTRA, 2))).when(m, F.concat_ws("|", F.regexp_extract(c, MISSING, 1), F.regexp_extract(c, MISSING, 2)))
    w = Window.partitionBy("pair_id", "right_order").orderBy("seq")
    b = comments.withColumn("_k", key).withColumn("_e", e)
    # a link to the next comment: one extra, one missing, of one kind; runs of links alternate by themselves
    b = b.withColumn("_link", F.coalesce((F.lead("_k").over(w) == F.col("_k")) & (F.lead("_e").over(w) != F.col("_e")), F.lit(False)))
    b = b.withColumn("_begins", F.when(F.coalesce(F.lag("_link").over(w), F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_begins").over(w))
    in_run = Window.partitionBy("pair_id", "right_order", "_run").orderBy("seq")
    b = b.withColumn("_at", F.row_number().over(in_run)).withColumn("_pair", F.floor((F.col("_at") - 1) / 2))
    value = F.struct(F.col("_e").alias("e"), F.when(F.col("_e"), F.regexp_extract(c, EXTRA, 3)).otherwise(F.regexp_extract(c, MISSING, 3)).alias("v"), F.col("_k").alias("k"))
    g = b.withColumn("_v", value).groupBy("pair_id", "right_order", "_run", "_pair").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min("token_index").alias("token_index"), F.min_by("contents", "seq").alias("contents"), F.max(F.when(F.col("_v.e"), F.col("_v.v"))).alias("theirs"), F.max(F.when(~F.col("_v.e"), F.col("_v.v"))).alias("ours"), F.max("_v.k").alias("k"))
    both = F.concat(F.lit("The "), F.split("k", r"\|")[0], F.lit(" is different, "), F.trim("theirs"), F.lit(" in "), F.split("k", r"\|")[1], F.lit(" while "), F.trim("ours"), F.lit(" in word."))
    return g.select("pair_id", "right_order", "seq", "token_index", F.when(F.col("n") == 2, both).otherwise(F.col("contents")).alias("contents"))


def anchored_tops(tops: list[dict], texts: list[str | None]) -> Iterator[tuple]:
    """(page, order) of those of a pair's blocks that equal, nearly equal or share most tokens with one of its texts."""
    keys = {b: None for x in texts if (b := s.no_refs(x))}
    sides = [(b, set(s.bag_of(b)), s.numbered_bag(b)) for b in keys]
    for top in tops:
        if len(s.bag_of(top["text"])) < 3 and len(s.key_of(top["text"])) < 24:
            continue
        a = s.no_refs(top["text"])
        words, own = set(s.bag_of(a)), s.numbered_bag(a)
        if not own:
            continue
        for b, others, theirs in sides:
            # pairs of letters and lengths add half at most, so few texts need them
            if a == b or (theirs and len(own & theirs) / min(len(own), len(theirs)) >= 0.82) or (len(words & others) >= 0.799 * len(words | others) and round(s.alike(a, b), 9) >= 0.9):
                yield top["page"], top["order"]
                break


def anchors(blocks: DataFrame, left: DataFrame, dealt: bool = False) -> DataFrame:
    """Those of the blocks (pair_id, page, order, text) that equal, nearly equal or share most tokens with one of left.

    Blocks of under three tokens and 24 characters are none. A pair's texts and its few blocks go to Python as one row.
    dealt: left lies by pair already, in parts of its own.
    """
    tops = blocks.groupBy("pair_id").agg(F.collect_list(F.struct("page", "order", "text")).alias("tops"))
    b = left.select("pair_id", "text")
    met = (b if dealt else dealt_by(b, "pair_id")).groupBy("pair_id").agg(F.collect_list("text").alias("texts")).join(tops, "pair_id").select("pair_id", "tops", "texts")
    names = ("pair_id", "page", "order")

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, PAIRS_READ):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, PAIRS_READ).columns), strict=True)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = batch.column(1).type.value_type
            kinds = [batch.column(0).type, top.field("page").type, top.field("order").type]
            rows = [(pair, page, order) for pair, tops, texts in pairs(batch) for page, order in anchored_tops(tops, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, kinds, strict=True)], list(names))

    return met.mapInArrow(found, ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in names)).distinct()


def page_summary(right: DataFrame, left: DataFrame, matches: DataFrame, least: int = 5, dealt: bool = False) -> DataFrame:
    """One comment for each page with ``least`` unmatched blocks or more, none matched, and no anchor for its first three.

    right: (pair_id, page, order, text); left: (pair_id, text); matches: (pair_id, right_order). Pages are told from
    places only; texts are fetched for the first blocks of pages that pass. dealt: both sides lie by pair already.
    """
    hits = matches.select("pair_id", F.col("right_order").alias("order"), F.lit(1).alias("hit")).distinct()
    ok = visible(F.col("text")) & ~page_chrome(F.col("text"))
    taken = right.select("pair_id", "page", "order", ok.alias("ok")).join(hits, ["pair_id", "order"], "left")
    loose = F.col("hit").isNull() & F.col("ok")
    pages = taken.groupBy("pair_id", "page").agg(F.count("hit").alias("matched"), F.count(F.when(loose, 1)).alias("loose"), F.slice(F.array_sort(F.collect_list(F.when(loose, F.col("order")))), 1, 3).alias("top"))
    pages = pages.where((F.col("matched") == 0) & (F.col("loose") >= least)).select("pair_id", "page", "top")
    pages = cut(pages)  # places only, read twice
    first = pages.select("pair_id", "page", F.explode("top").alias("order")).join(right.select("pair_id", "page", "order", "text"), ["pair_id", "page", "order"])
    anchored = anchors(first, left, dealt).select("pair_id", "page").distinct()
    said = "This PDF page contains content with no corresponding content in the Word document."
    return pages.join(anchored, ["pair_id", "page"], "left_anti").select("pair_id", "page", F.col("top")[0].alias("right_order"), F.lit(said).alias("contents"))


@dataclass(frozen=True)
class AppendixRules:
    """Rows that the appendix names beside unmatched blocks, until it holds ``most``.

    Cells with ``phrase`` in them; and in ``table`` from ``first_row`` on cells that hold a ``label``, equal one of ``labels``, or are
    a number like ``number`` in one of ``number_rows`` or in ``number_col``. ``left_out``: texts that are never named.
    """

    left_out: tuple[str, ...] = ()
    most: int = 28
    phrase: str = "gaap to non-gaap reconciliation"
    table: int = 1
    first_row: int = 19
    label: str = "per diluted share attributed to"
    labels: tuple[str, ...] = ("three months ended", "january 31,", "adjustments:", "amortization of acquired intangible assets", "stock-based compensation")
    number: str = r"^\$?\d\.\d{2}$"
    number_rows: tuple[int, ...] = (22, 25)
    number_col: int = 1


def appendix_blocks(blocks: DataFrame, unmatched: DataFrame, rules: AppendixRules) -> DataFrame:
    """(pair_id, order, text) of the appendix: unmatched blocks, and while these are fewer than ``most``, rows of the rules.

    blocks: (pair_id, order, text, table_cell, table, row, col); unmatched: (pair_id, order, text). Rows are added in
    reading order up to the first place in the table at which the appendix is full.
    """
    key = normalize_for_compare(F.col("text"))
    own = unmatched.where(~key.isin(*rules.left_out)) if rules.left_out else unmatched
    held = own.groupBy("pair_id").agg(F.count("*").alias("held"))
    b = blocks.join(own.select("pair_id", "order", F.lit(True).alias("own")), ["pair_id", "order"], "left").join(held, "pair_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    b = b.where(F.col("table_cell") & F.col("table").isNotNull() & (F.col("held") < rules.most)).withColumn("key", key)
    inside = (F.col("table") == rules.table) & (F.col("row") >= rules.first_row)
    number = F.trim("text").rlike(rules.number) & (F.col("row").isin(*rules.number_rows) | (F.col("col") == rules.number_col))
    named = F.col("key").contains(rules.phrase) | (inside & (F.col("key").contains(rules.label) | F.col("key").isin(*rules.labels) | number))
    upto = Window.partitionBy("pair_id").orderBy("order")
    b = b.withColumn("inside", inside).withColumn("new", named & F.col("own").isNull()).withColumn("total", F.col("held") + F.sum(F.col("new").cast("int")).over(upto))
    full = F.sum((F.col("inside") & (F.col("total") >= rules.most)).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    more = b.withColumn("full", F.coalesce(full, F.lit(0))).where("new and full = 0").select("pair_id", "order", "text")
    return own.select("pair_id", "order", "text").unionByName(more)


def summary(matches: DataFrame) -> DataFrame:
    """Counts of a pair from the full outer result of a matcher; contained matches have a column of their own."""
    has = lambda c: F.col(c).isNotNull()
    kind = F.col("match_type")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).alias
    return matches.groupBy("pair_id").agg(
        F.count_distinct("left_order").alias("docx_blocks"), F.count_distinct("right_order").alias("html_blocks"), n(kind.isin("exact", "exact_structural"))("exact_matches"), n(kind == "approx")("approx_matches"),
        n(kind == "contained")("contained_matches"), n(has("left_order") & kind.isNull() & ~F.col("held"))("docx_only"), n(has("right_order") & kind.isNull())("html_only"), n(F.col("held"))("held"),
    )


def summary_json(matches: DataFrame) -> DataFrame:
    s = summary(matches)
    return s.select("pair_id", F.to_json(F.struct(*[c for c in s.columns if c != "pair_id"])).alias("summary"))


def check_comments(comments: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """(kind, text, n, ok): how often each required and forbidden text is found in comments."""
    rules = [("required", t) for t in required] + [("forbidden", t) for t in forbidden]
    counts = comments.agg(*[F.count(F.when(F.col("contents").contains(t), 1)).alias(f"n{k}") for k, (_, t) in enumerate(rules)])
    each = [F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("text"), F.col(f"n{k}").alias("n")) for k, (kind, t) in enumerate(rules)]
    return counts.select(F.inline(F.array(*each))).withColumn("ok", F.when(F.col("kind") == "required", F.col("n") > 0).otherwise(F.col("n") == 0))


def placed(comments: DataFrame, token_rects: DataFrame, block_rects: DataFrame) -> DataFrame:
    """Where each comment's note goes: by its token's rectangle, else its block's."""
    t = token_rects.select("pair_id", F.col("order").alias("right_order"), "token_index", F.col("rect").alias("t"))
    b = block_rects.select("pair_id", F.col("order").alias("right_order"), F.col("rect").alias("b"))
    return comments.join(t, ["pair_id", "right_order", "token_index"], "left").join(b, ["pair_id", "right_order"], "left").withColumn("rect", F.coalesce("t", "b")).drop("t", "b")
