"""Document pairs on their way to the matcher, and the short ways of plain Python."""

import random

import pytest

from collatio.functions import scalar as s
from collatio.functions.aligned import tokens_of
from collatio.operators import compare, matcher
from collatio.plans import comparison, texts
from conftest import SF
from test_short_ways import PIECES


def test_keys_and_single_tokens_equal_all_steps():
    rng = random.Random(5)
    said = ["", "17", "$ 1,234.50", "5%", "17\n", "Sales3", "in Q3", "See www.a.com", "a  b", "ſo", "(5) %", "( 5", "Straße 12"]
    said += ["".join(rng.choice(PIECES) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    assert [t for t in said if s.key_of(t) != s.whole_key_of(t)] == []
    assert [t for t in said if s.only_token(t) != (tokens_of(t)[0] if len(tokens_of(t)) == 1 else None)] == []


@pytest.mark.parametrize(("query", "dealt"), [(texts.faithful_tables, 2), (comparison.faithful_match, 2)])
def test_pairs_are_put_together_where_they_lie(spark, query, dealt):
    """Both sides are dealt by pair once; no rows are dealt again, and no group is sent by itself."""
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == dealt and "CoGroup" not in plan and "MapInArrow" in plan


def test_sides_with_other_columns_and_pairs_without_an_id(spark):
    left = spark.createDataFrame([(1, 1, "b two"), (1, 0, "a one"), (None, 0, "c three")], "pair_id long, order int, text string")
    right = spark.createDataFrame([(1, 5, "a one", True), (None, 7, "c three", False), (2, 0, None, None)], "pair_id long, order int, text string, bold boolean")
    got = {(r.pair_id, r.left_order, r.right_order, r.match_type) for r in matcher.match_pairs(left, right).collect()}
    assert got == {(1, 0, 5, "exact"), (1, 1, None, None), (None, 0, 7, "exact"), (2, None, 0, None)}


def test_sides_are_computed_once_for_their_comments(spark):
    """Comments of matches come with them, and equal those of the pair's own rows."""
    a, b = comparison.doc_sides(spark, SF)
    told = compare.Comparison().compare(a.where("pair_id < 60"), b.where("pair_id < 60")).comments
    assert "documents.parquet" not in told._jdf.queryExecution().executedPlan().toString()
    assert told.where("contents like 'The word is extra in html, Then%'").count() > 0


def exchanged(df) -> list[str]:
    """What is dealt by keys, without what is broadcast."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_words_of_a_document_are_not_dealt_again(spark):
    """Texts are dealt by document, and their words become clusters where they lie."""
    assert len(exchanged(comparison.page_clusters(spark, SF))) == 1


def test_clusters_of_a_line():
    from collatio.sources import pages

    word = lambda x0, x1, text: (x0, 0.0, x1, 10.0, text)
    line = [word(100.0, 110.0, "c"), word(0.0, 10.0, "a"), word(20.0, 40.0, "b"), word(62.0, 70.0, "d"), word(100.0, 105.0, "b")]
    # a gap of 26 points parts them; two words begin at one place
    assert list(pages.clusters_of(line)) == [(0, 0.0, 0.0, 70.0, 10.0, "a b d"), (1, 100.0, 0.0, 110.0, 10.0, "b c")]


def test_page_summary_deals_texts_by_pair(spark):
    """No side is dealt by keys of texts: what meets lies by pair."""
    assert not [line for line in exchanged(comparison.page_summary(spark, SF)) if "norm" in line or "order" in line]
