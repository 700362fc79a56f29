"""Slide decks as rows: the package's XML is read with the standard library, a file to a row of ``binaryFile``.

One row for each slide (kind slide, so that a slide without shapes is one), for each of its shapes that isn't a group (groups are walked), and for its notes. A deck that can't be read is a row with its error.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "source string, slide int, ord int, kind string, name string, placeholder string, `left` long, `top` long, width long, height long, "
    "paragraphs array<struct<level:int,kind:string,runs:array<struct<text:string,bold:boolean,italic:boolean>>>>, cells array<array<string>>, "
    "image binary, ext string, slide_w long, slide_h long, error string"
)
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Package names of placeholder kinds, and what a paragraph's marker is called.
KINDS = {"ctrTitle": "title", "sldNum": "slide_number", "dt": "date", "ftr": "footer", "hdr": "header", "subTitle": "subtitle", "obj": "object", "pic": "picture", "clipArt": "bitmap", "dgm": "org_chart", "tbl": "table"}
MARKERS = (("buChar", "bullet"), ("buAutoNum", "number"), ("buNone", "none"))


class Deck:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        root = self.xml("ppt/presentation.xml")
        size = root.find(f"{_P}sldSz")
        self.size = (int(size.get("cx")), int(size.get("cy"))) if size is not None else (None, None)
        links = self.links("ppt/presentation.xml")
        self.slides = [links[s.get(f"{_R}id")] for s in root.iter(f"{_P}sldId")]

    def xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def links(self, part: str) -> dict[str, str]:
        """Parts that ``part`` refers to, by id."""
        folder, name = posixpath.split(part)
        at = f"{folder}/_rels/{name}.rels"
        if at not in self.zip.namelist():
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in ElementTree.fromstring(self.zip.read(at))}

    def rows(self) -> Iterator[dict]:
        for n, part in enumerate(self.slides, 1):
            links, ord_ = self.links(part), 0
            yield {"slide": n, "ord": -1, "kind": "slide"}
            for shape in self.shapes(self.xml(part).find(f"{_P}cSld/{_P}spTree")):
                yield self.row(shape, links) | {"slide": n, "ord": ord_}
                ord_ += 1
            for target in links.values():
                if "/notesSlides/" in target:
                    yield from ({"slide": n, "ord": ord_, "kind": "notes", "paragraphs": paragraphs(s)} for s in self.xml(target).iter(f"{_P}sp") if place(s) == "body")

    def shapes(self, tree: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for shape in tree:
            if shape.tag == f"{_P}grpSp":
                yield from self.shapes(shape)
            elif shape.tag in (f"{_P}sp", f"{_P}pic", f"{_P}graphicFrame"):
                yield shape

    def row(self, shape: ElementTree.Element, links: dict[str, str]) -> dict:
        about = shape.find(f"*/{_P}cNvPr")
        out = {"name": about.get("name") if about is not None else None, "placeholder": place(shape), "paragraphs": paragraphs(shape)}
        at, size = next(shape.iter(f"{_A}off"), None), next(shape.iter(f"{_A}ext"), None)
        if at is not None and size is not None and size.get("cx"):
            out |= {"left": int(at.get("x")), "top": int(at.get("y")), "width": int(size.get("cx")), "height": int(size.get("cy"))}
        table, picture = next(shape.iter(f"{_A}tbl"), None), next(shape.iter(f"{_A}blip"), None)
        if table is not None:
            cells = [["\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p")) for cell in line.iter(f"{_A}tc")] for line in table.iter(f"{_A}tr")]
            return out | {"kind": "table", "cells": cells}
        if shape.tag == f"{_P}pic" and picture is not None and (target := links.get(picture.get(f"{_R}embed"))) in self.zip.namelist():
            return out | {"kind": "picture", "image": self.zip.read(target), "ext": posixpath.splitext(target)[1].lstrip(".")}
        if any(e.tag.endswith("}chart") for e in shape.iter()):
            return out | {"kind": "chart"}
        return out | {"kind": "text"}


def place(shape: ElementTree.Element) -> str | None:
    """The kind of a placeholder, or None for a shape that is none."""
    own = shape.find(f"*/{_P}nvPr/{_P}ph")
    if own is None:
        return None
    kind = own.get("type", "obj")
    return KINDS.get(kind, kind)


def paragraphs(shape: ElementTree.Element) -> list[dict]:
    body = shape.find(f"{_P}txBody")
    out = []
    for p in [] if body is None else body.iter(f"{_A}p"):
        look = p.find(f"{_A}pPr")
        kind = next((k for tag, k in MARKERS if look is not None and look.find(f"{_A}{tag}") is not None), None)
        runs = []
        for r in p:
            if r.tag in (f"{_A}r", f"{_A}fld"):
                style, text = r.find(f"{_A}rPr"), r.find(f"{_A}t")
                on = lambda key, style=style: style is not None and style.get(key) in ("1", "true")
                runs.append({"text": (text.text or "") if text is not None else "", "bold": on("b"), "italic": on("i")})
        out.append({"level": int(look.get("lvl", 0)) if look is not None else 0, "kind": kind, "runs": runs})
    return out


def shapes(files: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """The shapes of decks (source, content): columns ``SCHEMA``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    deck = Deck(raw.as_py())
                    rows = [{"source": at, "slide_w": deck.size[0], "slide_h": deck.size[1]} | r for r in deck.rows()]
                except Exception as e:
                    rows = [{"source": at, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in schema.names} for r in rows], schema)

    return files.select(source, content).mapInArrow(read, SCHEMA)
