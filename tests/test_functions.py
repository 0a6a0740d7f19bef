"""Column functions against golden values, and against their plain-Python forms."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from collatio.functions import aligned, roles, scalar, similarity, text, tokens
from collatio.functions.contacts import contact

SAMPLES = [
    None, "", "18\t%", "$    0.34", "(2.1) %", "1 Revenue grew 5", "Net income(2)", "- Item one", "% of total", "www.Example.com is up",
    "Range for Three Months Ending", "2024 2025", "Low", "as of January 31, 2024 it was", "“Quoted text”, said Ann Lee, Chief Executive Officer", "Ünïcode — dash • bullet &amp; more",
    "Investor Contact: Ann Lee Example, Inc. 555-123-4567 ann@example.com", "( 5 ) percent", "+ 7 and - 8", "GAAP Results", "forward-looking statements", "A\n\nb \n c",
    "no digits  but\tblanks\u00a0here", "WWW.shouted.example and www.plain.example 3", "Sales (3) rose 4 %", "(4) Sales", "Anna Bell", "ANNA BELL", "call 555-123-4567 or a@b.example", "Editorial Contact:", "editorial contacts", "\u2003wide\u2003blank 5\u2003%", "x (12)", "5",
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("native", "plain"),
    [
        (text.normalize_proof, aligned.proof), (text.normalize_text, aligned.plain), (text.normalize_for_compare, scalar.key_of), (text.normalize_row_key, scalar.row_key_of),
        (text.strip_footnote_markers, scalar.no_marks), (text.strip_leading_markers, scalar.no_lead), (text.normalize_alnum, scalar.alnum_of), (text.normalize_without_refs, scalar.no_refs),
        (lambda c: F.array_join(text.bag(c), " "), lambda t: " ".join(scalar.bag_of(t))), (text.visible, scalar.visible_text), (text.headerish, scalar.header_like), (roles.quote_role, scalar.role_of_quote),
        (roles.repeated_label, scalar.repeat_key), (roles.contact_label, lambda t: contact(t).label), (roles.contact_role, lambda t: (contact(t).value or [None])[0]), (roles.contact_text, lambda t: contact(t).like),
    ],
)
def test_native_equals_plain(spark, native, plain):
    assert column(spark, SAMPLES, native) == [plain(t) for t in SAMPLES]


def test_tokens():
    t = aligned.tokens_of("18\t%")
    assert [x["text"] for x in t] == ["18%"]
    t = aligned.tokens_of("$    0.34")[0]
    assert (t["text"], t["prefix_symbol"], t["spaces_before"]) == ("0.34", "$", 4)
    t = aligned.tokens_of("(2.1) %")[0]
    assert (t["text"], t["prefix_symbol"]) == ("(2.1)%", None)
    assert aligned.tokens_of(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_similarity_is_symmetric_and_bounded(a, b):
    assert scalar.alike(a, b) == pytest.approx(scalar.alike(b, a))
    assert 0 <= scalar.alike(a, b) <= 1 + 1e-9


def test_similarities_native(spark):
    pairs = [("a b c", "a b d"), ("", ""), ("x", ""), ("aaaa", "aa"), ("the quick fox", "the quick fox jumps")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(similarity.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([scalar.alike(*p) for p in pairs])


def test_numbers(spark):
    values = ["1,234.5", "(2.5)", "12%", "-3", "$ 7", "abc", "", "1e3", "(7)%", "+4", "5.", ".5", "(", "1 2", "--1", "%"]
    got = column(spark, values, tokens.parse_number)
    want = [scalar.number_of(v) for v in values]
    assert [tuple(x) if x else None for x in got] == want
    df = spark.createDataFrame([("100", "105"), ("1", "100"), ("5%", "5"), ("-1", "1"), ("0", "0.0")], "a string, b string")
    got = [r[0] for r in df.select(tokens.number_compatibility(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([scalar.number_match(*p) for p in [("100", "105"), ("1", "100"), ("5%", "5"), ("-1", "1"), ("0", "0.0")]])


def test_lead_and_contact(spark):
    body = "Revenue in the quarter rose on strong demand for products in all regions, and margins widened too."
    lead = column(spark, [f"Results Summary\n{body}", f"x\n{body}", None], text.lead_label)
    assert lead[0]["lead"] == "Results Summary" and lead[1] is None and lead[2] is None
    c = column(spark, ["Investor Contact: Ann Lee Example, Inc. 555-123-4567 ann@example.com"], roles.contact_fields)[0]
    assert (c["name"], c["company"], c["phone"], c["email"]) == ("Ann Lee", "Example, Inc", "555-123-4567", "ann@example.com")


def test_sections(spark):
    got = column(spark, ["GAAP Results", "Gaap Reslts", "Reconciliation of 2024 Targets", "other"], lambda c: roles.known_schema(c, fuzzy=True))
    assert got == ["gaap_results", "gaap_results", "reconciliation_targets", None]


def test_page_segments_and_focus(spark):
    body = "Revenue in the quarter rose on strong demand for products in all regions of the world."
    more = "The board looks at the year with confidence and thanks all who work for the firm."
    page = f"Quarterly Business Results\n{body}\nCompany Outlook\n{more}\nand adds no more."
    got = column(spark, [page, "one line", None, f"{body}\n{more}", f"A plain start of it\nCompany Outlook\n{more}"], roles.narrative_segments)
    assert got == [["Quarterly Business Results", body, f"Company Outlook\n{more}\nand adds no more."], ["one line"], [""], [f"{body}\n{more}"], ["A plain start of it", f"Company Outlook\n{more}"]]
    focus = lambda text: column(spark, [page, text, "x\ny"], lambda c: roles.page_focus(F.lit(text), c))
    assert focus(body) == [body, None, None]
    assert focus("nothing of the kind at all") [1:] == [None, None]
