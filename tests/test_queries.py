"""Registered queries against DuckDB on the smallest tables."""

import pandas as pd
import pytest

from collatio import plans
from conftest import SF

#: Cheap ones from each family; the driver runs all of them.
NAMES = ["exact_block_match", "normalize_compare", "diff_token_counts", "numeric_parse", "date_phrases", "best_approx_match", "containment_join", "cell_slots", "row_currency", "cell_comments", "review_tier_counts", "presence_comments", "section_sessions", "page_clusters",
         "numeric_compatibility", "same_cell_prematch", "grouped_comments", "similarities", "blocking_candidates", "table_family_scores", "page_table_cells", "page_standard_cells", "table_currency",
         "faithful_tables", "effective_currency", "role_compatibility", "contact_texts", "contact_roles", "quote_leads", "primary_quotes", "page_chrome", "comment_checks", "comment_places", "led_documents",
         "section_schemas", "repeated_labels", "semantic_currency", "run_kinds"]


def tidy(v):
    """A value as both engines' frames show it: missing ones None, whole numbers int, others rounded."""
    if isinstance(v, (list, dict)) or getattr(v, "shape", ()):
        return v
    if pd.isna(v):
        return None
    return (int(v) if v.is_integer() else round(v, 6)) if isinstance(v, float) else v


def rows(df):
    return sorted(str([tidy(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


def test_every_query_has_a_plan(spark):
    for name, q in plans.queries().items():
        if name in plans.oracle_sql():
            assert q(spark, SF).columns, name
