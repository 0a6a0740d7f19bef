"""Word files read in part."""

import io
import zipfile

from collatio.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def made(body: str, styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def test_blocks_outside_tables_are_those_of_the_whole_file():
    word = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    p = lambda x: f"<w:p>{x}</w:p>"
    cells = [p(word("one")), p(word("…")), p(""), p(word("a")) + p("") + p(word("b")), p("<w:del>" + word("gone") + "</w:del>"), p("<w:hyperlink>" + word("link") + "</w:hyperlink>"), p("<w:r><w:tab/><w:t>5</w:t><w:br/></w:r>"), p("<w:r><w:t/></w:r>")]
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    data = made(p(word("head")) + table + p(word("between")) + table + p(word("end")))
    whole = docx.parse(data)
    assert [b["order"] for b in whole] == list(range(len(whole))) and any(b["table_cell"] for b in whole)
    assert docx.parse(data, cells=False) == [b for b in whole if not b["table_cell"]]


def test_styles_that_files_share_are_read_once():
    style = '<w:style w:styleId="S"><w:rPr><w:b/></w:rPr></w:style>'
    docx.styles_of.cache_clear()
    found = [docx.parse(made(f'<w:p><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r><w:t>n {k}</w:t></w:r></w:p>', style)) for k in range(5)]
    assert all(b[0]["bold"] for b in found) and docx.styles_of.cache_info().misses == 1
