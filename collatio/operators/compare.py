"""One entry for comparing documents: blocks of both sides in, all results as DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.roles import assign_roles, page_focus
from ..functions.tokens import currency_symbol, effective_currency, with_row_currency, with_table_currency
from ..lineage import cut
from . import diff, matcher, review
from .matcher import Profile

DEFAULTS = {"heading": "false", "heading_level": "cast(null as int)", "bold": "false", "italic": "false", "underline": "false", "list_item": "false", "table_cell": "false", "kind": "'p'", "table": "cast(null as int)", "row": "cast(null as int)", "col": "cast(null as int)", "row_key": "cast(null as string)", "row_slot": "cast(null as int)", "numeric_slot": "cast(null as int)", "footnote_marker": "cast(null as string)"}


def completed(blocks: DataFrame) -> DataFrame:
    """Blocks with every column of the model; absent ones get their defaults."""
    return blocks.withColumns({k: F.expr(v) for k, v in DEFAULTS.items() if k not in blocks.columns})


def with_currency(blocks: DataFrame) -> DataFrame:
    """Adds row_symbol, table_symbol and ``currency``, the effective one: the text's own, else the row's, the table's, what the row is about."""
    b = with_table_currency(with_row_currency(blocks, "pair_id"), "pair_id")
    own = currency_symbol(F.col("text"))
    return b.withColumn("currency", effective_currency(F.col("text"), own, F.col("row_symbol"), F.col("table_symbol"), F.col("row_key")))


@dataclass
class Result:
    matches: DataFrame
    comments: DataFrame
    appendix: DataFrame
    counts: DataFrame
    summary: DataFrame


class Comparison:
    """compare(left, right): sides hold (pair_id, order, text) and any further block columns."""

    def __init__(self, profile: Profile = Profile(), lexicon: Lexicon = DEFAULT, appendix_rules: review.AppendixRules | None = None):  # noqa: B008
        self.profile, self.lexicon, self.appendix_rules = profile, lexicon, appendix_rules

    def side(self, blocks: DataFrame) -> DataFrame:
        b = completed(blocks)
        if "structure_role" not in b.columns:
            b = assign_roles(b, "pair_id", self.lexicon, fuzzy=True)
        return with_currency(b)

    def focused(self, matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        """Comments of matches whose right text is a page's block of several lines, by its segment that is most like the left text."""
        names = [c for c in (*DEFAULTS, "order", "text", "row_symbol", "currency")]
        packed = lambda d, k, o: d.select("pair_id", F.col("order").alias(o), F.struct(*names, F.col("structure_role").alias("role"), F.col("family_table_index").alias("family"), *([F.col("runs")] if "runs" in d.columns else [])).alias(k))
        met = matches.select("pair_id", "left_order", "right_order", "match_type", "score", "group_type").join(packed(a, "l", "left_order"), ["pair_id", "left_order"]).join(packed(b, "r", "right_order"), ["pair_id", "right_order"])
        met = met.withColumn("r", F.col("r").withField("text", F.coalesce(page_focus(F.col("l.text"), F.col("r.text")), F.col("r.text"))))
        return diff.comments(met, self.profile, self.lexicon)

    def compare(self, left: DataFrame, right: DataFrame) -> Result:
        a, b = self.side(left), self.side(right)
        # comments are made where a pair's blocks are matched, so that sides are computed once
        noted = cut(matcher.match_and_explain(a, b, self.profile, self.lexicon))
        matches = noted.where("contents is null").drop("contents", "seq", "token_index", "focus")
        comment = ("pair_id", "right_order", "seq", "token_index", "contents")
        told = noted.where("seq is not null").select(*comment)
        if self.profile.target == "pdf" and not (focused := noted.where("focus")).isEmpty():
            told = told.unionByName(self.focused(focused, a, b))
        sections = noted.where("contents is not null and right_order is not null and seq is null").withColumn("seq", F.lit(900_000)).select(*comment)
        told = told.unionByName(sections)
        left_only = matches.where("right_order is null and not held and not covered").join(a.select("pair_id", F.col("order").alias("left_order"), "text"), ["pair_id", "left_order"])
        if self.appendix_rules is not None:
            left_only = review.appendix_blocks(a, left_only.withColumnRenamed("left_order", "order"), self.appendix_rules).withColumnRenamed("order", "left_order")
        appendix = left_only.select("pair_id", "left_order", "text", F.lit(f"This DOCX content was not found in the {self.profile.target.upper()}.").alias("contents"))
        lost = noted.where("contents is not null and left_order is not null").select("pair_id", "left_order", "contents").join(a.select("pair_id", F.col("order").alias("left_order"), "text"), ["pair_id", "left_order"])
        appendix = appendix.unionByName(lost)
        if self.profile.target == "pdf" and not self.profile.proofread:
            appendix = appendix.limit(0)  # page extracts have an appendix in proofreading only
        told = review.dedupe(told)
        return Result(matches, told, appendix, review.counts(told.select("pair_id", "contents").unionByName(appendix.select("pair_id", "contents")), ["pair_id"]), review.summary(matches.drop("covered")))
