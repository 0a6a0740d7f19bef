"""Sources, matcher, differences and review on small cases."""

import io
import zipfile

import pytest

from collatio.operators import compare, diff, matcher, matching, review
from collatio.operators.matcher import Block, Matcher, Profile
from collatio.sources import docx, html, pages


def cell(order, text, table, row, col, key, slot, numeric):
    return Block(order, text, table_cell=True, kind="td", table=table, row=row, col=col, row_key=key, row_slot=slot, numeric_slot=numeric, role="table_row_label" if numeric is None else "table_data_cell", family=table)


def test_same_cell_typo_is_an_approximate_match():
    left = [cell(110, "Revenue", 1, 11, 0, "revenue", 0, None), cell(111, "100.5", 1, 11, 1, "revenue", 1, 0)]
    right = [cell(110, "Revenue", 1, 11, 0, "revenue", 0, None), cell(111, "100.6", 1, 11, 1, "revenue", 1, 0)]
    assert Matcher(left, right, Profile()).run() == {1: (1, "approx", 0.95), 0: (0, "exact", 1.0)}


def test_tables_align_past_a_note():
    def tab(t, keys):
        return [c for r, k in enumerate(keys) for c in (cell(r * 10 + 100 * t, k, t, r, 0, k.lower(), 0, None), cell(r * 10 + 1 + 100 * t, str(r + 5 * t), t, r, 1, k.lower(), 1, 0))]

    left = tab(0, ["Revenue", "Costs", "Profit"]) + tab(1, ["Assets", "Debt"])
    right = [cell(0, "Note", 0, 0, 0, "note", 0, None)] + tab(1, ["Revenue", "Costs", "Profit"]) + tab(2, ["Assets", "Debt"])
    assert matcher.align_tables(left, right) == {0: 1, 1: 2}


def test_contact_run_is_one_group():
    blocks = [Block(i, t) for i, t in enumerate(["Investor Contact:", "Ann Lee", "Example, Inc.", "555-123-4567", "ann@example.com", "A long line of ordinary prose that is no contact."])]
    assert [g.members for g in matcher.groups(blocks)] == [[0, 1, 2, 3, 4]]


def test_repeated_label_stays_unmatched():
    left, right = [Block(0, "Low")], [Block(0, "Low"), Block(1, "Low")]
    assert Matcher(left, right, Profile()).exact(0, [0, 1]) is None


def one(a, b, **more):
    x, y = Block(0, a, role="paragraph"), Block(0, b, role="paragraph")
    return [c for c, _ in diff.explain(x, y, 0.97, "approx", profile=Profile(**more))]


def test_differences():
    assert one("Revenue was 5 in 2023 and 6 in all", "Revenue was 5 in 2024 and 6 in all") == ["The number is different, 2024 in html while 2023 in word."]
    assert one("on January 31, 2024 we met", "on January 30, 2024 we met") == ["The date is different, January 30, 2024 in html while January 31, 2024 in word."]
    assert one("the results of the quarter were strong", "the result of the quarter were strong") == ["The word is different, result in html while results in word."]
    assert one("We saw growth in all regions", "We saw growth in nearly every year in all regions")[0].startswith("The words are extra in html")
    a, b = cell(0, "5%", 0, 0, 1, "x", 1, 0), cell(0, "5", 0, 0, 1, "x", 1, 0)
    assert diff.explain(a, b, 0.95, "approx")[0][0] == "The percent sign is different, html has 5 while word has 5%."
    a, b = cell(0, "$100", 0, 0, 1, "x", 1, 0), cell(0, "100", 0, 0, 1, "x", 1, 0)
    assert diff.explain(a, b, 0.95, "approx")[0][0] == "The currency symbol is different, html has 100 while word has $100."


def test_extra_and_missing_collapse():
    found = diff.collapsed([("The number is extra in html, 6. It is not present in word.", 3), ("The number is missing in html, 5 in word.", 2)])
    assert found == [("The number is different, 6 in html while 5 in word.", 2)]


def test_native_collapse(spark):
    rows = [(1, 0, 0, 3, "The number is extra in html, 6. It is not present in word."), (1, 0, 1, 2, "The number is missing in html, 5 in word."), (1, 0, 2, 2, "The word is missing in html, x in word.")]
    got = review.collapse(spark.createDataFrame(rows, "pair_id long, right_order int, seq int, token_index int, contents string")).orderBy("seq").collect()
    assert [(r.seq, r.token_index, r.contents) for r in got] == [(0, 2, "The number is different, 6 in html while 5 in word."), (2, 2, "The word is missing in html, x in word.")]


def test_formatting():
    run = lambda t, **k: {"text": t, "bold": False, "italic": False, "underline": False, "hyperlink": False} | k
    a, b = Block(0, "Net income rose this year in every region we serve"), Block(0, "Net income rose this year in every region we serve")
    assert diff.formatting(a, b, [run(a.text)], [run("Net income", underline=True), run(" rose this year in every region we serve")]) == ['DOCX does not have underline on "Net income"; HTML has it.']
    assert diff.formatting(a, b, [run(a.text, underline=True)], [run(a.text, hyperlink=True)]) == []


def test_html():
    b = html.blocks("<body><h1>Title</h1><script>x</script><p>One <b>two</b><br>three<p>Four<div style='display: none'>no</div><ul><li>Item<li>Next</ul><table><tr><th>K</th><td>5</td></tr><tr><td>a<td>6</table>")
    assert [(x["kind"], x["text"]) for x in b] == [("h1", "Title"), ("p", "One two\nthree"), ("p", "Four"), ("li", "Item"), ("li", "Next"), ("th", "K"), ("td", "5"), ("td", "a"), ("td", "6")]
    assert [(x["row"], x["col"]) for x in b if x["table_cell"]] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert b[1]["bold"] and html.blocks(None) == []


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(body, styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    styles = '<w:docDefaults><w:rPrDefault><w:rPr><w:i/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="P"><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="C"><w:rPr><w:u w:val="single"/></w:rPr></w:style>'
    body = '<w:p><w:pPr><w:pStyle w:val="P"/></w:pPr><w:r><w:rPr><w:rStyle w:val="C"/></w:rPr><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Revenue</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>5</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    (tmp_path / "a.docx").write_bytes(word_file(body, styles))
    rows = {r.order: r for r in docx.scan(spark, str(tmp_path)).collect()}
    assert rows[0].runs[0].bold and rows[0].runs[0].italic and rows[0].runs[0].underline
    assert (rows[2].row_key, rows[2].row_slot, rows[2].numeric_slot) == ("revenue", 1, 0)
    spark.dataSource.register(docx.DocxSource)
    assert spark.read.format("docx").load(str(tmp_path)).count() == 3


def test_page_tables(spark):
    words = [(1, 0, x, 10.0 + 18 * y, x + 40, 20.0 + 18 * y, t) for y, line in enumerate([["Revenue", "100"], ["Costs", "90"], ["Profit", "10"]]) for x, t in zip((10.0, 300.0), line)]
    words.append((1, 0, 10.0, 200.0, 200.0, 210.0, "Some text after."))
    df = spark.createDataFrame(words, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.row, r.col): r.text for r in pages.blocks(df).collect() if r.table_cell}
    assert got == {(0, 0): "Revenue", (0, 1): "100", (1, 0): "Costs", (1, 1): "90", (2, 0): "Profit", (2, 1): "10"}


def page_words(lines):
    """Each line's words side by side; lines: (x0, y0, height, text)."""
    out = []
    for x0, y0, height, text in lines:
        for k, word in enumerate(text.split(" ")):
            x = x0 + 5.0 * len(" ".join(text.split(" ")[:k]) + " " * (k > 0))
            out.append((1, 0, x, y0, x + 5.0 * len(word), y0 + height, word, 612.0))
    return out


def test_page_paragraphs(spark):
    lines = [
        (20.0, 10.0, 10.0, "A line of text that goes on"), (20.0, 24.0, 10.0, "and on for a second line"),  # near
        (20.0, 62.0, 10.0, "and a third, as the paragraph is tall by now"), (260.0, 76.0, 10.0, "too far to the right"), (20.0, 90.0, 10.0, "Back left."),
        (20.0, 104.0, 10.0, "After a full stop a new one"), (20.0, 118.0, 10.0, "write to someone@example.com or call there"), (20.0, 200.0, 10.0, "page 3 of 9"),
        (20.0, 230.0, 10.0, "Wide lines " + "go on " * 16 + "to here."), (20.0, 244.0, 10.0, "Even after a stop it goes on"),
    ]
    df = spark.createDataFrame(page_words(lines), "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, page_width double")
    got = [r.text for r in pages.blocks(df).orderBy("order").collect()]
    text = [x[3] for x in lines]
    assert got == [" ".join(text[:3]), text[3], text[4], text[5], text[6], text[8] + " " + text[9]]


def test_page_rows_follow_the_mean_of_the_row(spark):
    # each word a little lower than the last: the row ends where one lies too far from the row's mean
    rects = [(1, 0, 40.0 * k, 100.0 + 1.8 * k, 40.0 * k + 30, 110.0 + 1.8 * k, f"w{k}") for k in range(8)]
    df = spark.createDataFrame(rects, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3)
    lines, middles = [], []
    for r in rects:
        middle = (r[3] + r[5]) / 2
        if middles and abs(middle - sum(middles) / len(middles)) > 6.0:
            lines.append(lines[-1] + 1)
            middles = []
        else:
            lines.append(lines[-1] if lines else 0)
        middles.append(middle)
    got = {r.text: r.line for r in pages.in_lines(df, 4.0, 0.6).collect()}
    assert got == {f"w{k}": n for k, n in enumerate(lines)} and max(lines) == 1


def test_standard_page_rows(spark):
    rects = [(1, 2, 10.0, 10.0, 90.0, 20.0, "Net revenue (1)"), (1, 2, 200.0, 11.0, 240.0, 21.0, "$ 1,200"), (1, 2, 300.0, 10.0, 340.0, 20.0, "n/a"), (1, 2, 10.0, 60.0, 90.0, 70.0, "Alone"), (1, 2, 10.0, 90.0, 20.0, 95.0, "7")]
    df = spark.createDataFrame(rects, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [(r.text, r.table, r.row, r.col, r.row_key, r.numeric_slot) for r in pages.standard_blocks(df).orderBy("order").collect()]
    assert got == [("Net revenue (1)", 2, 0, 0, "net revenue", None), ("$1,200", 2, 0, 1, "net revenue", 0), ("n/a", 2, 0, 2, "net revenue", None), ("Alone", None, None, None, None, None)]


def test_comparison_end_to_end(spark):
    left = spark.createDataFrame([(1, 0, "Revenue was 5 in 2023 for the firm"), (1, 1, "Only on the left side here")], "pair_id long, order int, text string")
    right = spark.createDataFrame([(1, 0, "Revenue was 5 in 2024 for the firm"), (1, 1, "Something new was put on the right, which is long")], "pair_id long, order int, text string")
    r = compare.Comparison().compare(left, right)
    said = {x.contents for x in r.comments.collect()}
    assert "The number is different, 2024 in html while 2023 in word." in said
    assert "This HTML block has no corresponding content in the DOCX." in said
    assert [x.left_order for x in r.appendix.collect()] == [1]
    s = r.summary.first()
    assert (s.docx_blocks, s.html_blocks, s.approx_matches, s.docx_only, s.html_only) == (2, 2, 1, 1, 1)


def test_staged_is_one_to_one(spark):
    rows = [(1, i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta gamma", "delta epsilon zeta eta"])]
    left = spark.createDataFrame(rows, "pair_id long, order int, text string")
    right = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "delta epsilon zeta etas")], "pair_id long, order int, text string")
    got = matching.staged(left, right).collect()
    assert sorted((r.left_order, r.right_order, r.match_type) for r in got) == [(0, 0, "exact"), (2, 1, "approx")]


def test_one_to_one_leaves_no_pair(spark):
    import random

    def by_hand(rows):
        out, a, b = [], set(), set()
        for p, i, j, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
            if s >= 0.73 and (p, i) not in a and (p, j) not in b:
                out.append((p, i, j))
                a.add((p, i))
                b.add((p, j))
        return sorted(out)

    rng = random.Random(9)
    rows = [(1, i, j, 0.8) for i in range(30) for j in range(25)]  # one line edited the same way each time
    rows += [(2, i, j, 0.75 + 0.01 * (i + j)) for i in range(8) for j in (i, i + 1)]  # a chain of rivals
    rows += [(p, i, j, rng.choice([0.7, 0.8, 0.9])) for p in (3, 4, 5) for i in range(9) for j in range(9) if rng.random() < 0.6]
    got = matching.one_to_one(spark.createDataFrame(rows, "pair_id long, left_order int, right_order int, score double"), 0.73)
    assert sorted((r.pair_id, r.left_order, r.right_order) for r in got.collect()) == by_hand(rows)


def test_staged_pairs_every_copy_of_an_edited_line(spark):
    made = lambda word: spark.createDataFrame([(1, i, f"the same long line of words {word}") for i in range(6)], "pair_id long, order int, text string")
    got = matching.staged(made("edited"), made("changed")).collect()
    assert sorted((r.left_order, r.right_order, r.match_type) for r in got) == [(i, i, "approx") for i in range(6)]


def test_page_summary_anchors(spark):
    first = {1: "alpha beta gamma delta epsilon zeta", 2: "alpha beta gamma delta epsilon zetas", 3: "alpha beta gamma delta epsilon one", 4: "Total sum", 5: "nothing like any other text"}
    rows = [(1, p, 10 * p + k, t if not k else f"page {'abcdef'[p]} loose {'abcdef'[k]} unlike") for p, t in first.items() for k in range(5)]
    right = spark.createDataFrame(rows, "pair_id long, page int, order int, text string")
    left = spark.createDataFrame([(1, 0, "alpha beta gamma delta epsilon zeta"), (1, 1, "Total sum"), (1, 2, "")], "pair_id long, order int, text string")
    none = spark.createDataFrame([], "pair_id long, right_order int")
    assert sorted(r.page for r in review.page_summary(right, left, none).collect()) == [4, 5]


def test_page_summary_and_ranks_carry_no_texts(spark, tmp_path):
    """Long texts that are read twice are shuffled twice at most, not once for each of their words."""
    import hashlib

    from pyspark.sql import functions as F

    from collatio.operators import matching

    said = lambda k: " ".join(hashlib.md5(f"{k} {i}".encode()).hexdigest() for i in range(200))
    left = spark.createDataFrame([(1, k, said(k % 30)) for k in range(40)], "pair_id long, order int, text string").withColumn("norm", F.col("text"))
    right = left.withColumn("page", F.floor(F.col("order") / 8).cast("int")).withColumn("text", F.when(F.col("page") == 1, F.reverse("text")).otherwise(F.col("text"))).withColumn("norm", F.col("text"))
    ranked = matching.exact_by_rank(left, right)
    assert sorted(map(tuple, ranked.collect())) == sorted([(1, k, k) for k in range(40) if k // 8 != 1 and k < 30] + [(1, *p) for p in ((30, 30), (31, 31), (32, 32), (33, 33), (34, 34), (35, 35), (36, 36), (37, 37))] + [(1, 8, 38), (1, 9, 39)])
    written = []
    for d in (ranked, review.page_summary(right, left, ranked)):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        written.append("sha2" in plan)
        assert "explode(array_distinct" not in plan
    assert written[0]
    assert [(r.page, r.right_order) for r in review.page_summary(right, left, ranked).collect()] == [(1, 8)]


@pytest.mark.parametrize("text,tier", [("The word is different, a in html while b in word.", "critical"), ("Formatting differs: x", "formatting"), ("The paragraph text is different. x", "text"), ("x was not found in the HTML.", "structural"), ("The words are extra in html, a b.", "informational")])
def test_tiers(spark, text, tier):
    from pyspark.sql import functions as F

    assert spark.range(1).select(review.tier(F.lit(text))).first()[0] == tier


def test_sections():
    from collatio.operators import sections

    prose = "Revenue and margins rose in the quarter as demand grew in all regions and costs stayed as they were before, which helped."
    left = [Block(0, "GAAP Results", role="section_header"), Block(1, prose), Block(2, "Financial Targets", role="section_header"), Block(3, "We expect more of it.")]
    right = [Block(0, "GAAP Results", role="section_header"), Block(1, "All of it was rewritten here.")]
    found = sections.section_families(left)
    assert [(f.schema, f.members) for f in found] == [("gaap_results", [0, 1]), ("financial_targets", [2, 3])]
    told, covered = sections.notes(left, right, {1, 2, 3}, "html", diff.shorten)
    assert covered == {1, 2, 3} and told[0][1] == 0 and told[0][2].startswith("This DOCX gaap_results section is broadly matched to the HTML")
    assert told[1][0] == 2 and told[1][2].startswith("This DOCX financial_targets section was not found in the HTML.")


def test_files_to_files(spark, tmp_path):
    from collatio import cli

    for side in ("left", "right"):
        (tmp_path / side).mkdir()
    text = "The results of the quarter show that revenue was {} in all regions"
    (tmp_path / "left" / "a.docx").write_bytes(word_file(f"<w:p><w:r><w:t>{text.format(12)}</w:t></w:r></w:p>", ""))
    (tmp_path / "left" / "alone.docx").write_bytes(word_file("<w:p><w:r><w:t>Alone</w:t></w:r></w:p>", ""))
    (tmp_path / "right" / "a.html").write_text(f"<p>{text.format(15)}</p><p>And a new paragraph that stands only here.</p>")
    cli.run(spark, str(tmp_path / "left"), str(tmp_path / "right"), str(tmp_path / "out"))
    told = {(r.name, r.contents) for r in spark.read.parquet(f"{tmp_path}/out/comments").collect()}
    assert ("a", "The number is different, 15 in html while 12 in word.") in told and {n for n, _ in told} == {"a"}
    summary = spark.read.parquet(f"{tmp_path}/out/summary").first()
    assert (summary.name, summary.docx_blocks, summary.html_blocks, summary.html_only) == ("a", 1, 2, 1)
    assert spark.read.json(f"{tmp_path}/out/summary-json").count() == 1


def test_windows_of_short_fragments():
    from collatio.functions.aligned import best_window

    assert best_window(["net", "income"], ["the", "net", "income", "rose"]) == 1.0
    assert best_window(["net", "incomes"], ["the", "net", "income", "rose"]) > 0.9
    assert best_window([], ["a"]) == best_window(["a"], []) == 0.0


def test_formatting_score_by_runs():
    from collatio.operators.matcher import Block, formatting_score

    run = lambda text, bold: {"text": text, "bold": bold, "italic": False, "underline": False, "hyperlink": False}
    a = Block(0, "net income rose", bold=True, runs=[run("net ", True), run("income", True), run(" rose", False)])
    same = Block(0, "net income rose", bold=True, runs=[run("net income", True), run(" rose", False)])
    other = Block(1, "net income rose", bold=True, runs=[run("net income ", False), run("rose", True)])
    plain = Block(2, "net income rose", bold=True)
    assert formatting_score(a, same) - formatting_score(a, other) == pytest.approx(1.25 - 0.4)
    assert formatting_score(a, plain) == pytest.approx(formatting_score(a, same) - 3 * (1.25 - 0.8))


def test_page_block_is_read_at_its_best_segment(spark):
    body = "Revenue in the quarter rose to {} million on strong demand for products in all regions of the world."
    left = spark.createDataFrame([(1, 0, body.format(12))], "pair_id long, order int, text string")
    right = spark.createDataFrame([(1, 0, f"Quarterly Results\n{body.format(15)}")], "pair_id long, order int, text string")
    said = [r.contents for r in compare.Comparison(Profile("pdf", True)).compare(left, right).comments.collect()]
    assert said == ["The number is different, 15 in pdf while 12 in word."]
