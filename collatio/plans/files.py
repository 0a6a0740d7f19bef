"""Queries that scan Word files and web pages made of the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import docx, html
from .comparison import CELL_KEYS, cells_of, left_lines, query

NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NAMESPACE}><w:style w:styleId="Base"><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/><w:basedOn w:val="Base"/></w:style></w:styles>'


def word_files(parts: DataFrame) -> DataFrame:
    """(doc_id, content): Word files from (doc_id, body, notes), the inner XML of their documents and footnotes."""
    import io
    import zipfile

    import pyarrow as pa

    def made(batches):
        for batch in batches:
            files = []
            for body, notes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {NAMESPACE}><w:body>{body}</w:body></w:document>")
                    z.writestr("word/styles.xml", STYLES)
                    if notes:
                        z.writestr("word/footnotes.xml", f"<w:footnotes {NAMESPACE}>{notes}</w:footnotes>")
                files.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    return parts.select("doc_id", "body", "notes").mapInArrow(made, "doc_id long, content binary")


def escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def around(before: str, c, after: str):
    return F.concat(F.lit(before), c, F.lit(after))


def table_rows(spark, sf_dir, cell: tuple[str, str], row: tuple[str, str]) -> DataFrame:
    """(doc_id, rows, n): an order's cells as rows of markup."""
    cells = cells_of(spark, sf_dir)
    by_row = cells.groupBy("pair_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: around(cell[0], x["text"], cell[1])), "").alias("cells"))
    return by_row.groupBy(F.col("pair_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: around(row[0], x["cells"], row[1])), "").alias("rows"), F.count("*").alias("n"))


def scanned_sql(head: str, cell: str, item: str, note: bool) -> str:
    """Expected blocks: a heading, a table, a list item, and a footnote of each order."""
    columns = "CAST({} AS INTEGER) AS ord, '{}' AS kind, {} AS text, {} AS heading, {} AS list_item, {} AS row, {} AS col, {} AS row_key, {} AS row_slot, {} AS numeric_slot"
    plain = lambda order, kind, text, heading, listed: columns.format(order, kind, text, heading, listed, *["CAST(NULL AS INTEGER)"] * 2, "CAST(NULL AS VARCHAR)", *["CAST(NULL AS INTEGER)"] * 2)
    cells = columns.format("line * 4 + col + 1", cell, "text", "false", "false", "CAST(line AS INTEGER)", "CAST(col AS INTEGER)", "row_key", "CAST(row_slot AS INTEGER)", "CAST(numeric_slot AS INTEGER)")
    told = f"""{CELL_KEYS}, t AS (SELECT *, dense_rank() OVER (PARTITION BY pair_id ORDER BY row) - 1 AS line FROM slots), o AS (SELECT pair_id, max(line) + 1 AS n FROM t GROUP BY 1)
SELECT pair_id AS doc_id, {cells} FROM t UNION ALL SELECT pair_id, {plain(0, head, "'Order ' || pair_id", 'true', 'false')} FROM o
UNION ALL SELECT pair_id, {plain('4 * n + 1', item, "'Rows: ' || n", 'false', 'true')} FROM o"""
    return told + (f" UNION ALL SELECT pair_id, {plain('4 * n + 2', 'footnote', chr(39) + '1 A note of order ' + chr(39) + ' || pair_id', 'false', 'false')} FROM o" if note else "")


def shown(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", F.col("order").alias("ord"), "kind", "text", "heading", "list_item", "row", "col", "row_key", "row_slot", "numeric_slot")


def order_files(spark, sf_dir) -> DataFrame:
    word = '<w:r><w:t xml:space="preserve">', "</w:t></w:r>"
    rows = table_rows(spark, sf_dir, (f"<w:tc><w:p>{word[0]}", f"{word[1]}</w:p></w:tc>"), ("<w:tr>", "</w:tr>"))
    title = around(f'<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr>{word[0]}Order ', F.col("doc_id").cast("string"), f"{word[1]}</w:p>")
    item = around(f'<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>Rows: ', F.col("n").cast("string"), f"{word[1]}</w:p>")
    note = around(f'<w:footnote w:id="-1" w:type="separator"><w:p>{word[0]}none{word[1]}</w:p></w:footnote><w:footnote w:id="2"><w:p>{word[0]}1 A note of order ', F.col("doc_id").cast("string"), f"{word[1]}</w:p></w:footnote>")
    return word_files(rows.select("doc_id", F.concat(title, around("<w:tbl>", F.col("rows"), "</w:tbl>"), item).alias("body"), note.alias("notes")))


@query(scanned_sql("p", "td", "p", True))
def docx_order_blocks(spark, sf_dir):
    """Word files of orders, with a heading's style, a table, a list item and a footnote, scanned back."""
    return shown(docx.scan_bytes(order_files(spark, sf_dir), with_runs=False))


@query("""SELECT l_orderkey AS doc_id, unnest(['Order ' || l_orderkey, 'Rows: ' || count(DISTINCT l_linenumber)]) AS text, unnest(['heading 2', 'list']) AS what, unnest([true, false]) AS bold, unnest([false, true]) AS italic, unnest([2, CAST(NULL AS INTEGER)]) AS heading_level FROM lineitem GROUP BY l_orderkey""")
def docx_styles(spark, sf_dir):
    """What styles, and what they are based on, make of the runs of headings and items."""
    told = docx.scan_bytes(order_files(spark, sf_dir), cells=False).where("heading or list_item").select("doc_id", F.explode("runs").alias("r"), "heading", "heading_level")
    return told.select("doc_id", "r.text", F.when(F.col("heading"), "heading 2").otherwise("list").alias("what"), "r.bold", "r.italic", "heading_level")


@query(scanned_sql("h2", "td", "li", False))
def html_order_blocks(spark, sf_dir):
    """Web pages of orders, with a heading, a table and a list item, scanned back."""
    rows = table_rows(spark, sf_dir, ("<td><span>", "</span>"), ("<tr>", ""))
    title, item = around("<h2>Order ", F.col("doc_id").cast("string"), "</h2>"), around("<ul><li><i>Rows:</i> ", F.col("n").cast("string"), "</ul>")
    page = F.concat(F.lit("<html><head><title>x</title><script>var a = '<p>no</p>'</script></head><body>"), title, around("<table><tbody>", F.col("rows"), "</table>"), item)
    return shown(html.scan(rows.select(F.col("doc_id").alias("page_id"), page.alias("html")), with_runs=False))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS ord, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, ord, regexp_replace(text, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') AS text FROM l), w AS (SELECT doc_id, ord, string_split(regexp_replace(text, '[ \t\r\f]+', ' ', 'g'), ' ') AS w FROM t WHERE regexp_matches(text, '[A-Za-z0-9]'))
SELECT doc_id, CAST(ord AS INTEGER) AS ord, w[1] AS bold_text FROM w WHERE len(w) > 1 AND regexp_matches(w[1], '^[A-Za-z0-9]+$') AND regexp_matches(array_to_string(w[2:], ' '), '[A-Za-z0-9]')""")
def html_bold_words(spark, sf_dir):
    """The first word of each line is bold in its paragraph; found again as a run of its own."""
    lines = left_lines(spark, sf_dir).select("pair_id", "order", F.trim(F.regexp_replace("text", r"[ \t\r\f]+", " ")).alias("t")).where(F.col("t").rlike("^[A-Za-z0-9]+ .*[A-Za-z0-9]"))
    first = F.substring_index("t", " ", 1)
    rest = F.substr("t", F.length(first) + 1)
    page = lines.select((F.col("pair_id") * 1_000_000 + F.col("order")).alias("page_id"), F.concat(F.lit("<p><b>"), first, F.lit("</b>"), escaped(rest), F.lit("</p>")).alias("html"))
    runs = html.scan(page).where("order = 0").select("doc_id", F.explode("runs").alias("r")).where("r.bold")
    return runs.select(F.floor(F.col("doc_id") / 1_000_000).cast("long").alias("doc_id"), (F.col("doc_id") % 1_000_000).cast("int").alias("ord"), F.col("r.text").alias("bold_text"))
