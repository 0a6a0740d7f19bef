import random

from pyspark.sql import functions as F

from collatio.functions import text, tokens
from collatio.operators import matching

PIECES = ["a", "B", "www.", "&lt;", "&", " ", "  ", "1", "23", "456", "(", "1)", "(2)", "( 3 )", "[4]", "$", "$ ", "%", " %", "~", "-", "+", ".", ",", "é", " ", "’", "—", "\n", "eps", "Revenue of part", "€", "12,345.67", "'", "!", "²", " "]


def test_short_ways_give_what_all_steps_give(spark):
    rng = random.Random(3)
    texts = ["", None, "17", "$ 1,234.50", "5%", "12.", "1,", "$5", "17\n", "Sales3 (4)", "Shares outstanding, part 12 (3)", "a (2) b", "a (2)b", "www.", "See www.a.com", "in 2024", "in Q3"]
    texts += ["".join(rng.choice(PIECES) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    c = F.col("text")
    both = {
        "key": (text.normalize_for_compare(c), text.compare_key(c)), "row_key": (text.normalize_row_key(c), text.row_key(c)), "visible": (text.visible(c), text.compare_key(c).rlike("[a-z0-9]")),
        "value": (tokens.single_value(c), tokens.only_token(c)), "number": (tokens.is_single_number(c), tokens.only_number(c)),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", *[F.struct(a.alias("short"), b.alias("whole")).alias(k) for k, (a, b) in both.items()]).collect()
    assert not [(k, r.text, r[k]) for r in got for k in both if r[k].short != r[k].whole]


def test_rows_of_equal_keys_are_not_compared(spark):
    """The similarity of row keys stands in the last case of the condition only, so equal keys pay nothing for it."""
    names = "pair_id long, `table` int, row int, col int, order int, norm string, number string, row_key string, row_slot int, numeric_slot int"
    left = spark.createDataFrame([(1, 0, 0, 1, 1, "5", "5", "sales of parts", 1, 0), (1, 0, 1, 1, 11, "6", "6", "costs of all the parts sold", 1, 0), (1, 0, 2, 1, 21, "7", "7", "tax", 1, 0), (1, 0, 3, 1, 31, "8", "8", None, 1, 0)], names)
    right = spark.createDataFrame([(1, 0, 0, 1, 1, "5", "5", "sales of parts", 1, 0), (1, 0, 1, 1, 11, "9", "9", "costs of all the parts sold.", 1, 0), (1, 0, 2, 1, 21, "7", "7", "quite another", 1, 0), (1, 0, 3, 1, 31, "8", "8", "x", 1, 0)], names)
    met = matching.same_cell(left, right)
    assert {(r.left_order, r.match_type) for r in met.collect()} == {(1, "exact"), (11, "approx"), (31, "exact")}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (l_row_key" in plan.replace("#", " #").replace("l_row_key #", "l_row_key#")


def test_parsed_numbers_equal_all_steps(spark):
    texts = ["17", "$ 1,234.50", "$5", "5%", "12.", "(5)", "-3", "1,2,3", "007", "", None, "~ 4", "9" * 320]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens.parse_number(F.col("text")).alias("a"), tokens.parsed(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_sides_dealt_by_pair_meet_as_they_lie(spark):
    from collatio.plans import comparison

    for kind, make in (("same_cell", comparison.same_cell_prematch), ("comments", comparison.cell_pairs)):
        plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # each side is dealt once, by order; broadcasts are no matter
        assert plan.count("Exchange hashpartitioning") == 2, kind


def test_cells_are_explained_without_their_confidence(monkeypatch):
    from collatio.operators import diff
    from collatio.operators.matcher import Block

    def unasked(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(diff, "confidence", unasked)
    cell = lambda t: Block(order=1, text=t, table_cell=True)
    assert diff.explain(cell("17"), cell("19"), 0.95, "approx") == [("The number is different, 19 in html while 17 in word.", 0)]
