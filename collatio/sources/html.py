"""Saved web pages as blocks: a tolerant scan of any markup, one parse a page, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import scalar as s
from .slots import with_slots

# Tags by what they do.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "caption", "figcaption"}
ALWAYS = {"td", "th", "li", "pre", "blockquote", "caption", "figcaption"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "canvas", "head", "meta", "link", "iframe", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOLD, ITALIC, UNDERLINE = {"b", "strong"}, {"i", "em"}, {"u"}
#: A new one of these ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
BREAKS_P = {"div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "article", "section", "nav", "footer", "header"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def style(self, prop: str, value: str) -> bool:
        return "style" in self.attrs and bool(re.search(rf"{prop}\s*:\s*(?:{value})", self.attrs.get("style") or "", re.I))

    def hidden(self) -> bool:
        return self.tag in SKIPPED or "hidden" in self.attrs or (self.attrs.get("aria-hidden") or "").lower() == "true" or self.style("display", "none") or self.style("visibility", "hidden")


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def close_to(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES:
            self.close_to(CLOSES[tag], {"table", "ul", "ol"} - CLOSES[tag])
        if tag in BREAKS_P:
            self.close_to({"p"}, {"td", "th", "li", "table"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def run_kind(text: str) -> str:
    if text in ("\t", "\n"):
        return {"\t": "tab", "\n": "linebreak"}[text]
    if re.fullmatch(r"\s+", text):
        return "space"
    return "symbol" if re.fullmatch(r"[$€£¥%~()\[\]{}:;,.!?/&+\-–—•]+", text) else "text"


def runs(node: Node, look: tuple[bool, bool, bool, bool] = (False,) * 4) -> list[dict]:
    """Inline runs in order with their inherited look; blank runs that end lines fall together."""
    tag = node.tag
    look = (
        look[0] or tag in BOLD or node.style("font-weight", r"bold|bolder|[6-9]00"), look[1] or tag in ITALIC or node.style("font-style", "italic|oblique"),
        look[2] or tag in UNDERLINE or node.style(r"text-decoration(?:-line)?", r"[^;]*underline"), look[3] or tag == "a",
    )
    out: list[dict] = []
    for child in node.children:
        if isinstance(child, str):
            text = re.sub(r"[ \t\r\n\f]+", " ", child) if tag != "pre" else child
            for piece in re.split(r"(\s+)", text):
                if piece:
                    out.append({"text": piece, "kind": run_kind(piece), "bold": look[0], "italic": look[1], "underline": look[2], "hyperlink": look[3]})
        elif child.tag == "br":
            out.append({"text": "\n", "kind": "linebreak", "bold": look[0], "italic": look[1], "underline": look[2], "hyperlink": look[3]})
        elif not child.hidden() and child.tag not in ALWAYS:
            out += runs(child, look)
    return out


def joined(pieces: list[dict]) -> list[dict]:
    """Neighbouring runs of one look as one; without blanks at the ends."""
    out: list[dict] = []
    for r in pieces:
        if out and out[-1]["kind"] == "space" and r["kind"] == "space":
            continue
        same = out and all(out[-1][k] == r[k] for k in ("bold", "italic", "underline", "hyperlink"))
        if same and out[-1]["kind"] == "text" and r["kind"] in ("text", "space"):
            out[-1]["text"] += r["text"]
        elif same and out[-1]["kind"] == "space" and r["kind"] == "text":
            out[-1] = r | {"text": out[-1]["text"] + r["text"]}
        else:
            out.append(dict(r))
    while out and not out[0]["text"].strip() and out[0]["kind"] == "space":
        out.pop(0)
    while out and not out[-1]["text"].strip() and out[-1]["kind"] in ("space", "linebreak"):
        out.pop()
    if out:
        out[0]["text"], out[-1]["text"] = out[0]["text"].lstrip(" "), out[-1]["text"].rstrip(" ") if len(out) > 1 else out[-1]["text"].strip(" ")
    return [r | {"source_index": i} for i, r in enumerate(out)]


def lead_of(text: str) -> tuple[str, str] | None:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return None
    lead, rest = lines[0], " ".join(lines[1:])
    n = len(lead.split())
    fits = len(lead) <= 64 and n <= 8 and not re.search("[.!?:;]$", lead) and re.fullmatch(r"[A-Z][A-Za-z0-9'()/%& .-]+", lead) and not (n <= 1 and len(lead) < 12)
    return (lead, rest) if fits and re.match("[\"'(]?[A-Z]", rest) and len(rest) >= 80 else None


def split_runs(pieces: list[dict], lead: str) -> tuple[list[dict], list[dict]]:
    """Runs up to and after the line break that ends the lead."""
    at, seen = 0, ""
    for at, r in enumerate(pieces):  # noqa: B007
        if r["kind"] == "linebreak" and seen.strip() == lead:
            break
        seen += r["text"]
    return pieces[:at], pieces[at + 1 :]


def blocks(html: str | None) -> list[dict]:
    """All visible blocks of a page in reading order."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    out: list[dict] = []
    tables = [0]

    def holds_block(node: Node) -> bool:
        return any(not isinstance(c, str) and (c.tag in BLOCKS or holds_block(c)) for c in node.children)

    def emit(node: Node, place) -> None:
        pieces = joined(runs(node))
        text = "".join(r["text"] for r in pieces)
        if not s.visible_text(text):
            return
        cell, heading = node.tag in ("td", "th"), bool(re.fullmatch("h[1-6]", node.tag))
        parts = [(text, pieces)]
        if not cell and (lead := lead_of(text)):
            parts = list(zip(lead, split_runs(pieces, lead[0]), strict=True))
        for said, own in parts:
            out.append({
                "order": len(out), "kind": node.tag, "text": said, "heading": heading, "heading_level": int(node.tag[1]) if heading else None, "list_item": node.tag == "li",
                "bold": any(r["bold"] for r in own), "italic": any(r["italic"] for r in own), "underline": any(r["underline"] for r in own), "table_cell": cell,
                "table": place[0] if cell and place else None, "row": place[1] if cell and place else None, "col": place[2] if cell and place else None, "runs": own,
            })

    def walk(node: Node, place) -> None:
        for c in node.children:
            if isinstance(c, str) or c.hidden():
                continue
            here = place
            if c.tag == "table":
                here = (tables[0], [-1], [-1])
                tables[0] += 1
            elif c.tag == "tr" and place:
                place[1][0] += 1
                place[2][0] = -1
            elif c.tag in ("td", "th") and place:
                place[2][0] += 1
            if c.tag in BLOCKS and (c.tag in ALWAYS or not holds_block(c)):
                emit(c, (place[0], place[1][0], place[2][0]) if place else None)
                if c.tag in ALWAYS:
                    walk(c, here)
            else:
                walk(c, here)

    walk(tree.root, None)
    return out


RUN = pa.struct([("text", pa.string()), ("kind", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("hyperlink", pa.bool_()), ("source_index", pa.int32())])
SCHEMA = (
    "doc_id long, `order` int, kind string, text string, heading boolean, heading_level int, list_item boolean, bold boolean, italic boolean, underline boolean, table_cell boolean, "
    "`table` int, `row` int, `col` int, runs array<struct<text:string,kind:string,bold:boolean,italic:boolean,underline:boolean,hyperlink:boolean,source_index:int>>"
)
PLAIN = SCHEMA.partition(", runs ")[0]
FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("order", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("heading", pa.bool_()), ("heading_level", pa.int32()), ("list_item", pa.bool_()), ("bold", pa.bool_()),
    ("italic", pa.bool_()), ("underline", pa.bool_()), ("table_cell", pa.bool_()), ("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("runs", pa.list_(RUN)),
])


#: Blocks of several documents go out together, up to so many.
BLOCKS_SENT = 4_000


def sent(found: Iterable[tuple[int, list[dict]]], with_runs: bool = True) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (doc_id, blocks) as record batches, column by column."""
    names = [f.name for f in FIELDS if f.name != "doc_id" and (with_runs or f.name != "runs")]
    fields = [FIELDS.field("doc_id"), *(FIELDS.field(k) for k in names)]
    made = lambda ids, held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *([b[k] for b in held] for k in names)], fields, strict=True)], schema=pa.schema(fields))
    ids, held = [], []
    for ident, own in found:
        ids += [ident] * len(own)
        held += own
        if len(held) >= BLOCKS_SENT:
            yield made(ids, held)
            ids, held = [], []
    if held:
        yield made(ids, held)


def scan(pages: DataFrame, key: str = "page_id", html: str = "html", with_runs: bool = True) -> DataFrame:
    """(doc_id, order, kind, text, …): the blocks of all pages, with row keys and slots of table cells; runs, if asked for."""

    def rows(batches):
        for batch in batches:
            yield from sent(((i, blocks(h)) for i, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for h in [h.as_py()]), with_runs)

    return with_slots(pages.select(pages[key].cast("long").alias("doc_id"), pages[html].alias("html")).mapInArrow(rows, SCHEMA if with_runs else PLAIN))
