"""Word documents as blocks: paragraphs, table cells and footnotes with their inline runs.

``scan`` reads files as binary rows and parses each in an Arrow batch; ``DocxSource`` offers the same as a data
source (``spark.read.format("docx").load(path)``), a partition a file.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalar as s
from .html import FIELDS, PLAIN, SCHEMA, run_kind, sent
from .slots import with_slots

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LOOKS = ("b", "i", "u")
BREAKS = {W + "tab": "\t", W + "br": "\n"}
OFF = {"0", "false", "off", "none"}


def look_of(props) -> dict[str, bool]:
    """Bold, italic and underline that run properties set; absent ones are left to what is above."""
    out: dict[str, bool] = {}
    for tag in LOOKS if props is not None else ():
        if (node := props.find(W + tag)) is not None:
            out[tag] = (node.get(W + "val") or "true").lower() not in OFF
    return out


class Styles:
    """Document defaults and styles by id; a style adds to the one it is based on."""

    def __init__(self, root):
        self.defaults: dict[str, bool] = {}
        self.own: dict[str, tuple[str | None, dict[str, bool], str]] = {}
        self.known: dict[str | None, dict[str, bool]] = {None: {}}
        if root is None:
            return
        self.defaults = look_of(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"))
        for style in root.iter(W + "style"):
            based, name = style.find(W + "basedOn"), style.find(W + "name")
            self.own[style.get(W + "styleId")] = (None if based is None else based.get(W + "val"), look_of(style.find(W + "rPr")), "" if name is None else name.get(W + "val") or "")

    def look(self, ident: str | None) -> dict[str, bool]:
        chain, node = [], ident
        while node not in self.known and node in self.own and node not in chain:
            chain.append(node)
            node = self.own[node][0]
        found = self.known.get(node, {})
        for name in reversed(chain):
            found = self.known[name] = found | self.own[name][1]
        return found

    def name(self, ident: str | None) -> str:
        return self.own[ident][2] or ident if ident in self.own else ident or ""


def style_of(props, tag: str) -> str | None:
    node = props.find(W + tag) if props is not None else None
    return None if node is None else node.get(W + "val")


def runs_of(paragraph, styles: Styles) -> list[dict]:
    """Runs in order; what is set nearer to the run wins: defaults, paragraph style, paragraph, link, run style, run."""
    props = paragraph.find(W + "pPr")
    base = styles.defaults | styles.look(style_of(props, "pStyle")) | look_of(None if props is None else props.find(W + "rPr"))
    out: list[dict] = []

    def walk(node, look: dict[str, bool], link: bool) -> None:
        for child in node:
            if child.tag == W + "hyperlink":
                walk(child, look | styles.look("Hyperlink"), True)
            elif child.tag == W + "r":
                rpr = child.find(W + "rPr")
                style = style_of(rpr, "rStyle")
                own = look | styles.look(style) | look_of(rpr)
                linked = link or (style or "").lower() == "hyperlink"
                for t in child:
                    text = {W + "t": t.text or "", W + "tab": "\t", W + "br": "\n"}.get(t.tag, "")
                    if text:
                        out.append({"text": text, "kind": run_kind(text), "bold": own.get("b", False), "italic": own.get("i", False), "underline": own.get("u", False), "hyperlink": linked, "source_index": len(out)})
            elif child.tag not in (W + "pPr", W + "del"):
                walk(child, look, link)

    walk(paragraph, base, False)
    return out


def text_of(paragraph) -> str:
    """What the runs of a paragraph say together."""
    out: list[str] = []

    def walk(node) -> None:
        for child in node:
            if child.tag == W + "r":
                for t in child:
                    out.append((t.text or "") if t.tag == W + "t" else BREAKS.get(t.tag, ""))
            elif child.tag not in (W + "pPr", W + "del"):
                walk(child)

    walk(paragraph)
    return "".join(out)


@lru_cache(maxsize=64)
def styles_of(said: bytes | None) -> Styles:
    """The styles of a part; files of one maker share theirs, which are read once."""
    return Styles(None if said is None else ElementTree.fromstring(said))


def parse(data: bytes, cells: bool = True) -> list[dict]:
    """The blocks of a file; those of table cells, if asked for. Orders count all blocks in either case."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        read = lambda name: z.read(name) if name in names else None
        part = lambda name: None if (said := read(name)) is None else ElementTree.fromstring(said)
        document, notes, styles = part("word/document.xml"), part("word/footnotes.xml"), styles_of(read("word/styles.xml"))
    out: list[dict] = []
    passed = 0

    def emit(runs: list[dict], kind: str, **more) -> None:
        text = "".join(r["text"] for r in runs)
        if s.visible_text(text):
            any_of = lambda k: any(r[k] for r in runs)
            base = {"heading": False, "heading_level": None, "list_item": False, "table_cell": False, "table": None, "row": None, "col": None}
            out.append(base | {"order": len(out) + passed, "kind": kind, "text": text, "runs": runs, "bold": any_of("bold"), "italic": any_of("italic"), "underline": any_of("underline")} | more)

    body = document.find(W + "body") if document is not None else None
    tables = 0
    for node in body if body is not None else ():
        if node.tag == W + "p":
            props = node.find(W + "pPr")
            style = styles.name(style_of(props, "pStyle"))
            heading = bool(re.search("heading|title", style, re.I))
            level = re.search(r"\d+", style)
            emit(runs_of(node, styles), "p", heading=heading, heading_level=int(level.group()) if heading and level else None, list_item=props is not None and props.find(W + "numPr") is not None)
        elif node.tag == W + "tbl":
            for r, row in enumerate(node.findall(W + "tr")):
                for c, cell in enumerate(row.findall(W + "tc")):
                    if not cells:
                        passed += s.visible_text("\n".join(filter(None, map(text_of, cell.iter(W + "p")))))
                        continue
                    runs: list[dict] = []
                    for p in cell.iter(W + "p"):
                        more = runs_of(p, styles)
                        if runs and more:
                            runs.append({"text": "\n", "kind": "linebreak", "bold": False, "italic": False, "underline": False, "hyperlink": False, "source_index": len(runs)})
                        runs += [x | {"source_index": len(runs) + k} for k, x in enumerate(more)]
                    emit(runs, "td", table_cell=True, table=tables, row=r, col=c)
            tables += 1
    for note in notes.iter(W + "footnote") if notes is not None else ():
        if note.get(W + "type") is None and (note.get(W + "id") or "").isdigit():
            emit([r for p in note.iter(W + "p") for r in runs_of(p, styles)], "footnote")
    return out


def scan_bytes(files: DataFrame, key: str = "doc_id", content: str = "content", with_runs: bool = True, cells: bool = True) -> DataFrame:
    """Blocks of Word files in a binary column; their runs and those of table cells, if asked for."""

    def rows(batches):
        for batch in batches:
            yield from sent(((ident, parse(data, cells)) for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data), with_runs)

    return with_slots(files.select(files[key].cast("long").alias("doc_id"), files[content].alias("content")).mapInArrow(rows, SCHEMA if with_runs else PLAIN))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Word files under a path; doc_id is the hash of the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return scan_bytes(files.selectExpr("xxhash64(path) doc_id", "content"))


class DocxSource(DataSource):
    """spark.read.format("docx").load(folder): for folders that executors can open by path."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, " + SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options["path"])


class DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.endswith(".docx"))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            data = f.read()
        schema = pa.schema([("path", pa.string()), *FIELDS])
        found = [{"path": partition.value, "doc_id": None} | b for b in parse(data)]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)
