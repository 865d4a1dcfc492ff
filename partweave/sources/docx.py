"""Text, boxes, pictures and properties of .docx archives, one row each. Only the archive itself is read in Python.

``docs`` has ``path`` and ``content``. A broken archive gives one row with ``error`` and no text, and
never fails the job. Elements inside ``Fallback`` copies are left out, so nothing is read twice.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from partweave.processors import guarded, with_fallbacks
from partweave.profiles import Profile
from partweave.session import BATCH_BYTES, give_back, ship, small_batches

#: Name spaces of the format; units.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
EMU_PER_POINT = 914400 / 72
RUNS = "path string, location string, run_idx int, text string, family string, size double, bold boolean, italic boolean, row_idx int, cell_idx int, merged boolean, error string"
BOXES = "path string, location string, text string, width double, height double, has_dimensions boolean, estimated boolean, error string"
IMAGES = "path string, location string, name string, extension string, length long, content binary, error string"
PROPERTIES = "path string, pages int, words int, characters int, paragraphs int, lines int, application string, creator string, created string, modified string, revision string, error string"


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Rows, and bytes of pictures and texts, after which what was read goes on.
_MOST_ROWS, _MOST_BYTES = 5000, BATCH_BYTES


def _per_archive(docs: DataFrame, schema: str, read: Callable[[zipfile.ZipFile], Iterator[dict]]) -> DataFrame:
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    ship(small_batches(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        found = list(read(archive))
                except Exception as e:  # a row for the report instead of a failed job
                    found = [{"error": f"{type(e).__name__}: {e}"[:500]}]
                for r in found:
                    r["path"] = path
                    size += len(r.get("content") or b"") + len(r.get("text") or "")
                rows += found
                if len(rows) > _MOST_ROWS or size > _MOST_BYTES:
                    out, rows, found, size = pa.RecordBatch.from_pylist(rows, schema=arrow), [], [], 0
                    yield out
                    out = None
            batch = content = None
            give_back()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select("path", "content").mapInArrow(run, schema)


#: Characters that the format forbids; some programs write them all the same.
_FORBIDDEN = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]|&#(?:0*(?:[0-8]|1[124-9]|2[0-9]|3[01])|[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]));")


#: Each byte, or a blank for one that is forbidden.
_BLANKS = bytes(32 if _FORBIDDEN.fullmatch(bytes([b])) else b for b in range(256))


def _cleaned(content: bytes) -> bytes:
    """``content`` with forbidden characters as blanks; it is searched for references only where it has any."""
    content = content.translate(_BLANKS)
    return _FORBIDDEN.sub(b" ", content) if b"&#" in content else content


def _lenient(content: bytes) -> ET.Element:
    return ET.fromstring(_cleaned(content))


def _tree(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    """A part of the archive, by the plain parser or, if that fails, by one that reads forbidden characters as blanks."""
    return _parse(archive.read(name))[0] if name in archive.namelist() else None


_parse = with_fallbacks(ET.fromstring, (_lenient,))


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ET.Element) -> Iterator[ET.Element]:
    return (c for c in node if _local(c.tag) != "Fallback")


#: What a run anchors; its text is not the run's.
_ANCHORED = ("drawing", "pict", "txbxContent")
#: What stands for text in a run, by tag; None is the element's own.
_PLAIN = f"{W}t"
_PIECES = {_PLAIN: None, f"{W}br": "\n", f"{W}cr": "\n", f"{W}tab": "\t"}


@lru_cache(4096)
def _apart(tag: str) -> bool:
    """Whether an element is no part of the run or paragraph that holds it: a copy, or something anchored."""
    return _local(tag) == "Fallback" or _local(tag) in _ANCHORED


_PROPS, _RUN = f"{W}rPr", f"{W}r"
_NO_FONT = (None, None, False, False)


def _font(run: ET.Element) -> tuple[str | None, float | None, bool, bool]:
    """Family, size, bold, italic."""
    props = run.find(_PROPS)
    if props is None:
        return _NO_FONT
    get = lambda tag, attr: props.find(W + tag).get(W + attr) if props.find(W + tag) is not None else None
    flag = lambda tag: props.find(W + tag) is not None and props.find(W + tag).get(W + "val") not in ("0", "false")
    size = get("sz", "val")
    return get("rFonts", "ascii"), float(size) / 2 if size else None, flag("b"), flag("i")


def _text(node: ET.Element) -> str:
    """The text of a run or paragraph, without that of text boxes and pictures that it anchors."""
    if len(node) == 1 and node[0].tag == _PLAIN and not len(node[0]):
        return node[0].text or ""
    found: list[str] = []

    def visit(inner: ET.Element) -> None:
        for c in inner:
            tag = c.tag
            if tag in _PIECES:
                found.append(_PIECES[tag] or c.text or "")
            elif _apart(tag):
                continue
            if len(c):
                visit(c)

    visit(node)
    return "".join(found)


def _parts(paragraph: ET.Element) -> Iterable[tuple]:
    """Text, family, size, bold and italic of each run."""
    every = list(paragraph.iter())
    # Most paragraphs hold runs of one text each and nothing else.
    if len(every) == 2 * len(paragraph) + 1 and [e.tag for e in every[1:]] == [_RUN, _PLAIN] * len(paragraph) and len(paragraph.findall(_RUN)) == len(paragraph):
        return [(t.text or "", *_NO_FONT) for t in every[2::2]]
    # Runs of text boxes are not part of the paragraph that anchors them.
    found: list[ET.Element] = []

    def collect(node: ET.Element) -> None:
        for c in node:
            if c.tag == _RUN:
                found.append(c)
            elif len(c) and not _apart(c.tag):
                collect(c)

    collect(paragraph)
    return ((_text(run), *_font(run)) for run in found)


def _runs(paragraph: ET.Element, location: str, place: dict) -> Iterator[dict]:
    for i, (text, family, size, bold, italic) in enumerate(_parts(paragraph)):
        yield {"location": location, "run_idx": i, "text": text, "family": family, "size": size, "bold": bold, "italic": italic, **place}


def _paragraphs(parent: ET.Element, prefix: str) -> Iterator[tuple[ET.Element, str, dict]]:
    """Paragraphs with their locations and, of those in tables, the places of their cells."""
    for i, p in enumerate(parent.findall(f"{W}p")):
        yield p, f"{prefix}paragraph_{i}", {}
    for t, table in enumerate(parent.findall(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            yield from _row_paragraphs(row, f"{prefix}table_{t}_row_{r}_", r)


def _row_paragraphs(row: ET.Element, prefix: str, r: int) -> Iterator[tuple[ET.Element, str, dict]]:
    for c, cell in enumerate(row.findall(f"{W}tc")):
        merge = cell.find(f"{W}tcPr/{W}vMerge")
        # A cell that continues a merged one repeats it; one that restarts a merge is a cell of its own.
        merged = merge is not None and merge.get(f"{W}val") != "restart"
        for k, p in enumerate(cell.findall(f"{W}p")):
            yield p, f"{prefix}cell_{c}_paragraph_{k}", {"row_idx": r, "cell_idx": c, "merged": merged}


def _blocks(parent: ET.Element, prefix: str) -> Iterator[dict]:
    for found in _paragraphs(parent, prefix):
        yield from _runs(*found)


def _read_runs(archive: zipfile.ZipFile, all_headers: bool = True) -> Iterator[dict]:
    body = _tree(archive, "word/document.xml")
    if body is None:
        raise ValueError("no document part")
    yield from _blocks(body.find(f"{W}body"), "")
    seen = set()
    for name in sorted(archive.namelist()):
        part = re.fullmatch(r"word/((header|footer)\d*)\.xml", name)
        if part and (all_headers or part[2] not in seen):
            seen.add(part[2])
            yield from _blocks(_tree(archive, name), f"{part[1]}_")


def text_runs(docs: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Runs of body, tables, headers and footers in scan order within each part.

    A profile without ``all_headers`` reads the first header and the first footer part only.
    """
    every = profile is None or profile.all_headers
    return _per_archive(docs, RUNS, lambda archive: _read_runs(archive, every))


def parsers(docs: DataFrame) -> DataFrame:
    """Which parser read each archive's document part: ``path``, ``parser``, ``error``."""

    def read(archive: zipfile.ZipFile) -> Iterator[dict]:
        _, _, name = _parse(archive.read("word/document.xml"))
        yield {"parser": "lenient" if name == "_lenient" else "standard"}

    return _per_archive(docs, "path string, parser string, error string", read)


def _whole_text(content: bytes, parse: Callable[[bytes], ET.Element] = ET.fromstring) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return "\n".join(_text(p) for p in parse(archive.read("word/document.xml")).iter(f"{W}p"))


def _without_forbidden(content: bytes) -> str:
    return _whole_text(content, _lenient)


def _name_only(content: bytes) -> str:
    """What is left of an archive that is cut short: the names in its local headers."""
    names = re.findall(rb"PK\x03\x04.{22}(..)..([\x20-\x7E]*)", content, re.DOTALL)
    if not names:
        raise ValueError("no local header")
    return "\n".join(name[: int.from_bytes(size, "little")].decode() for size, name in names)


#: The strategies of each category of operations on archives, in the order in which they are tried.
STRATEGIES = {"loading": (_without_forbidden, _name_only)}
GUARDED = "path string, text string, tries int, strategy string, fallback_used boolean, error_type string, error string"


def guarded_texts(docs: DataFrame, attempts: int = 2) -> DataFrame:
    """The text of each archive and how it was come by: ``tries``, ``strategy``, ``fallback_used``, and the error of the plain way, if any.

    No row fails the job; where every strategy fails, the text is null and the strategy ``none``.
    """
    ship(small_batches(docs.sparkSession))
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in GUARDED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = guarded("parse_archive", _whole_text, STRATEGIES, attempts)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = load(content.as_py())
                rows.append({"path": path, "text": out.value, "tries": out.tries, "strategy": out.strategy, "fallback_used": out.fallback_used, "error_type": out.error_type, "error": out.error})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            batch = content = out = rows = None
            give_back()

    return docs.select("path", "content").mapInArrow(run, GUARDED)


def unmerged(runs: DataFrame) -> DataFrame:
    """Without the cells that continue a vertically merged one."""
    return runs.where("merged IS NULL OR NOT merged")


def _size(box: ET.Element, above: list[ET.Element], text: str) -> dict:
    for node in reversed(above):
        for extent in [*node.findall(f"{WP}extent"), *node.findall(f"*/{A}xfrm/{A}ext")]:
            if extent.get("cx") and extent.get("cy"):
                return {"width": int(extent.get("cx")) / EMU_PER_POINT, "height": int(extent.get("cy")) / EMU_PER_POINT, "has_dimensions": True, "estimated": False}
        style = node.get("style") or ""
        w, h = (re.search(rf"(?:^|;)\s*{k}:\s*([0-9.]+)pt", style) for k in ("width", "height"))
        if w and h:
            return {"width": float(w[1]), "height": float(h[1]), "has_dimensions": True, "estimated": False}
    lines = text.split("\n")
    return {"width": 6.0 * max(map(len, lines)), "height": 12.0 * len(lines), "has_dimensions": bool(text), "estimated": True}


def _read_boxes(archive: zipfile.ZipFile) -> Iterator[dict]:
    root, found = _tree(archive, "word/document.xml"), []
    if root is None:
        raise ValueError("no document part")

    def visit(node: ET.Element, above: list[ET.Element]) -> None:
        if _local(node.tag) == "txbxContent":
            found.append((node, above))
            return
        for c in _children(node):
            visit(c, [*above, node])

    visit(root, [])
    for i, (box, above) in enumerate(found):
        text = "\n".join(t for t in (_text(p) for p in box.iter(f"{W}p")) if t.strip())
        yield {"location": f"textbox_{i}", "text": text, **_size(box, above, text)}


def text_boxes(docs: DataFrame) -> DataFrame:
    """Text boxes of the body with their size in points: from the nearest extent or style, else estimated."""
    return _per_archive(docs, BOXES, _read_boxes)


def _read_images(archive: zipfile.ZipFile) -> Iterator[dict]:
    rels = _tree(archive, "word/_rels/document.xml.rels")
    targets = [r.get("Target") for r in (rels.findall(f"{REL}Relationship") if rels is not None else []) if "image" in (r.get("Type") or "")]
    for i, target in enumerate(targets):
        name = f"word/{target}"
        content = archive.read(name) if name in archive.namelist() else None
        yield {"location": f"image_{i}", "name": target, "extension": target.rpartition(".")[2].lower() or "jpg", "length": len(content) if content is not None else None, "content": content, "error": None if content is not None else "missing part"}


def images(docs: DataFrame) -> DataFrame:
    """Pictures that the body refers to, a row each; one whose part is absent has an error."""
    return _per_archive(docs, IMAGES, _read_images)


def _read_properties(archive: zipfile.ZipFile) -> Iterator[dict]:
    app, core = _tree(archive, "docProps/app.xml"), _tree(archive, "docProps/core.xml")
    texts = {_local(e.tag): e.text for part in (app, core) if part is not None for e in part.iter()}
    number = lambda k: int(texts[k]) if (texts.get(k) or "").isdigit() else None
    pages = number("Pages")
    if pages is None and (body := _tree(archive, "word/document.xml")) is not None:
        pages = 1 + sum(1 for e in body.iter(f"{W}sectPr")) + sum(1 for e in body.iter(f"{W}br") if e.get(f"{W}type") == "page")
    yield {"pages": pages, "words": number("Words"), "characters": number("Characters"), "paragraphs": number("Paragraphs"), "lines": number("Lines"), "application": texts.get("Application"), "creator": texts.get("creator"), "created": texts.get("created"), "modified": texts.get("modified"), "revision": texts.get("revision")}


def properties(docs: DataFrame) -> DataFrame:
    """Document properties; pages are estimated from sections and breaks where they are not written."""
    return _per_archive(docs, PROPERTIES, _read_properties)


def _paragraph(parent: ET.Element, line: str) -> None:
    ET.SubElement(ET.SubElement(ET.SubElement(parent, f"{W}p"), f"{W}r"), f"{W}t").text = line


#: What stands before, between and after the runs of a paragraph, with the prefix that ElementTree would write.
_BEGIN, _NEXT, _END = "<ns0:p><ns0:r><ns0:t>", "</ns0:t></ns0:r><ns0:r><ns0:t> ", "</ns0:t></ns0:r></ns0:p>"


def _document(lines: list[str], last: ET.Element, by_word: bool) -> str:
    """The document part: a paragraph for each line, then what ``last`` holds. No element is made for a word, so a long text takes a few times its own memory."""
    paragraphs = escape("\n".join(lines))
    if by_word:
        paragraphs = paragraphs.replace(" ", _NEXT)
    paragraphs = paragraphs.replace("\n", _END + _BEGIN)
    rest = "".join(ET.tostring(e, encoding="unicode") for e in last)
    return f'<ns0:document xmlns:ns0="{W[1:-1]}"><ns0:body>{_BEGIN}{paragraphs}{_END}{rest}</ns0:body></ns0:document>'


def archive_of(text: str, rich: bool = False) -> bytes:
    """A minimal archive with a paragraph per line and a run per word.

    A ``rich`` one has a run per line, and also a table of two rows (first and last line; the first cell goes on below, and
    the number of lines), a header with the first line, a text box of 100 points and one for each line by
    50 with both lines, two pictures of which one is absent, and properties with the number of lines.
    """
    lines = text.split("\n")
    inner = ET.Element(f"{W}body")
    parts: dict[str, str | bytes] = {}
    if rich:
        table = ET.SubElement(inner, f"{W}tbl")
        for cells in (((lines[0], "restart"), (lines[-1], None)), ((lines[0], ""), (str(len(lines)), None))):
            row = ET.SubElement(table, f"{W}tr")
            for value, merge in cells:
                cell = ET.SubElement(row, f"{W}tc")
                if merge is not None:
                    ET.SubElement(ET.SubElement(cell, f"{W}tcPr"), f"{W}vMerge", {f"{W}val": merge} if merge else {})
                _paragraph(cell, value)
        drawing = ET.SubElement(ET.SubElement(ET.SubElement(inner, f"{W}p"), f"{W}r"), f"{W}drawing")
        inline = ET.SubElement(drawing, f"{WP}inline")
        ET.SubElement(inline, f"{WP}extent", {"cx": str(12700 * (100 + len(lines))), "cy": str(12700 * 50)})
        box = ET.SubElement(inline, f"{W}txbxContent")
        _paragraph(box, lines[0])
        _paragraph(box, lines[-1])
        header = ET.Element(f"{W}hdr")
        _paragraph(header, lines[0])
        rels = ET.Element(f"{REL}Relationships")
        for i, target in enumerate(("media/image1.png", "media/absent.jpeg")):
            ET.SubElement(rels, f"{REL}Relationship", {"Id": f"r{i}", "Type": "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image", "Target": target})
        app = ET.Element("Properties")
        for name, value in (("Pages", len(lines)), ("Words", len(text.split(" "))), ("Application", "Writer")):
            ET.SubElement(app, name).text = str(value)
        text_of = lambda e: ET.tostring(e, encoding="unicode")
        parts = {"word/header1.xml": text_of(header), "word/_rels/document.xml.rels": text_of(rels), "word/media/image1.png": b"p" * len(lines), "docProps/app.xml": text_of(app)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", _document(lines, inner, by_word=not rich))
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def archive_of_shapes(text: str) -> bytes:
    """An archive with three text boxes in shapes that archives are seen to have.

    The first is a drawing of 80 points and one for each line by 40 that holds the first line and the last
    one as a link, inside a wider frame, beside a fallback copy of it; the second a shape of older programs
    with a size in its style, with the first line; the third has no size, and both lines.
    """
    lines = text.split("\n")
    mc, wps, v = "{http://schemas.openxmlformats.org/markup-compatibility/2006}", "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}", "{urn:schemas-microsoft-com:vml}"
    body = ET.Element(f"{W}document")
    inner = ET.SubElement(body, f"{W}body")
    holder = lambda: ET.SubElement(ET.SubElement(inner, f"{W}p"), f"{W}r")

    def fill(box: ET.Element, linked: str | None) -> None:
        content = ET.SubElement(box, f"{W}txbxContent")
        _paragraph(content, lines[0])
        if linked is not None:
            p = ET.SubElement(content, f"{W}p")
            ET.SubElement(ET.SubElement(ET.SubElement(p, f"{W}hyperlink"), f"{W}r"), f"{W}t").text = linked

    either = ET.SubElement(holder(), f"{mc}AlternateContent")
    frame = ET.SubElement(ET.SubElement(ET.SubElement(either, f"{mc}Choice"), f"{W}drawing"), f"{WP}inline")
    ET.SubElement(frame, f"{WP}extent", {"cx": "12700000", "cy": "12700000"})
    shape = ET.SubElement(frame, f"{wps}wsp")
    form = ET.SubElement(ET.SubElement(shape, f"{wps}spPr"), f"{A}xfrm")
    ET.SubElement(form, f"{A}ext", {"cx": str(12700 * (80 + len(lines))), "cy": str(12700 * 40)})
    fill(ET.SubElement(shape, f"{wps}txbx"), lines[-1])
    fill(ET.SubElement(ET.SubElement(ET.SubElement(either, f"{mc}Fallback"), f"{W}pict"), f"{v}textbox"), lines[-1])
    styled = ET.SubElement(ET.SubElement(holder(), f"{W}pict"), f"{v}shape", {"style": "position:absolute;width:70.5pt;height:30pt"})
    fill(ET.SubElement(styled, f"{v}textbox"), None)
    fill(ET.SubElement(ET.SubElement(ET.SubElement(holder(), f"{W}pict"), f"{v}shape"), f"{v}textbox"), lines[-1])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", ET.tostring(body, encoding="unicode"))
    return out.getvalue()


def packed(texts: DataFrame, rich: bool = False, build: Callable[[str], bytes] | None = None) -> DataFrame:
    """``path`` and ``content``: archives made of ``path`` and ``text``, by ``build`` or as ``archive_of`` makes them.

    Archives are several times as long as their texts, so they go on by their bytes and not by the texts' batches.
    """
    ship(small_batches(texts.sparkSession))
    arrow = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str | None] = []
        made: list[bytes] = []
        size = 0
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                paths.append(path.as_py())
                made.append(build(text) if build else archive_of(text, rich))
                size += len(made[-1])
                if size >= _MOST_BYTES:
                    out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], schema=arrow)
                    paths, made, size = [], [], 0
                    yield out
                    out = None
                    give_back()
            batch = text = None
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], schema=arrow)

    return texts.select("path", "text").mapInArrow(run, "path string, content binary")
