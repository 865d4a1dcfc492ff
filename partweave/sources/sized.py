"""Runs of archives of any size: each file goes to a parser by its length, and on to the next where that fails.

``standard`` holds the document part as a tree. ``enhanced`` pulls it: a paragraph or table row is read,
given out and forgotten, so memory does not depend on the document. ``custom`` pulls it too and reads
characters that the format forbids as blanks. Large files are opened by their path where workers can
(``file:``), and then their bytes are in no column; elsewhere Spark reads them.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.session import give_back, ship, small_batches
from partweave.sources import docx
from partweave.sources.docx import W

#: Megabytes from which a file is large, very large, and too large; the parsers in the order in which they are tried.
LARGE_MB, VERY_LARGE_MB, MOST_MB = 100, 200, 500
LADDER = ("standard", "enhanced", "custom")
MB = 1 << 20
#: The columns that runs of one paragraph do not have in common, and a row without a run.
_OF_RUN = ("run_idx", "text", "family", "size", "bold", "italic")
_NO_RUN = (None,) * 5
#: Rows after which what was read goes on.
MOST_ROWS = 5000
SCHEMA = "path string, size_class string, parser string, tries int, location string, run_idx int, text string, family string, size double, bold boolean, italic boolean, row_idx int, cell_idx int, merged boolean, error string"


def size_class(length: Column, large: float = LARGE_MB, very_large: float = VERY_LARGE_MB, most: float = MOST_MB) -> Column:
    """The parser that a file of that many bytes begins with, or ``unsupported_size``."""
    return F.when(length > most * MB, "unsupported_size").when(length < large * MB, "standard").when(length < very_large * MB, "enhanced").otherwise("custom")


class _Clean:
    """Bytes of a stream with forbidden characters as blanks; an unfinished reference waits for the next read."""

    def __init__(self, base: io.BufferedIOBase) -> None:
        self.base, self.held = base, b""

    def read(self, n: int = -1) -> bytes:
        while True:
            chunk = self.base.read(n if n > 0 else 1 << 16)
            data = self.held + chunk
            at = data.rfind(b"&", -12) if chunk else -1
            end = at if at >= 0 and b";" not in data[at:] else len(data)
            self.held, out = data[end:], docx._cleaned(data[:end])
            if out or not chunk:
                return out


#: Bytes that are parsed at a time.
CHUNK = 1 << 14


def _pulled(archive: zipfile.ZipFile, clean: bool = False) -> Iterator[tuple[ET.Element, str, dict]]:
    """Paragraphs of the body in document order, as ``docx._paragraphs`` gives them; what one chunk completes is held, and the block that is still open."""
    with archive.open("word/document.xml") as raw:
        source, builder = _Clean(raw) if clean else raw, ET.TreeBuilder()
        # What is parsed grows below this element; no event is made for any other.
        top, parser = builder.start("top", {}), ET.XMLParser(target=builder)
        p = t = r = 0
        body, chunk, failed = None, b" ", None
        while chunk and failed is None:
            here = None
            try:
                chunk = source.read(CHUNK)
                parser.feed(chunk) if chunk else parser.close()
            except Exception as e:  # what was complete before is given out first
                failed, here = e, builder.start("here", {})
            if body is None and (body := top.find(f"*/{W}body")) is None:
                continue
            # The last block is open until the part has ended, or failed behind the body.
            ended = not chunk if failed is None else here not in body.iter()
            blocks = body[:] if ended else body[:-1]
            for block in [*blocks, *body[len(blocks) :]]:
                whole = ended or block is not body[-1]
                if block.tag == f"{W}p" and whole:
                    yield block, f"paragraph_{p}", {}
                    p += 1
                elif block.tag == f"{W}tbl":
                    for row in block[:] if whole else block[:-1]:
                        if row.tag == f"{W}tr":
                            yield from docx._row_paragraphs(row, f"table_{t}_row_{r}_", r)
                            r += 1
                    if whole:
                        t, r = t + 1, 0
                    else:
                        del block[:-1]
            del body[: len(blocks)]
        if failed is not None:
            raise failed


def pulled_runs(archive: zipfile.ZipFile, clean: bool = False) -> Iterator[dict]:
    """Runs of the body in document order, with the locations that ``docx.text_runs`` gives."""
    for found in _pulled(archive, clean):
        yield from docx._runs(*found)


def _tree(archive: zipfile.ZipFile) -> Iterator[tuple[ET.Element, str, dict]]:
    yield from docx._paragraphs(ET.fromstring(archive.read("word/document.xml")).find(f"{W}body"), "")


_PARSERS = {"standard": _tree, "enhanced": _pulled, "custom": lambda archive: _pulled(archive, clean=True)}


def _opened(path: str, content: pa.Scalar) -> object:
    return io.BytesIO(content.as_py()) if content.is_valid else unquote(urlparse(path).path)


def body_runs(files: DataFrame, large: float = LARGE_MB, very_large: float = VERY_LARGE_MB, most: float = MOST_MB, listed: bool = True) -> DataFrame:
    """Runs of the bodies of ``files`` (``path``, ``length``, ``content``) with ``size_class``, ``parser`` and ``tries``; a row without text where none reads it.

    Rows of a file that a parser has given out before it failed are not given again: the next one reads the
    same document, and goes on after them. A file that is too large is not read at all.

    Rows of a listing are taken in two passes, as it reads the bytes of a file only for rows that want them. ``files`` that
    are not ``listed`` but computed are taken in one, so that nothing is computed twice.
    """
    ship(small_batches(files.sparkSession))
    rows = files.withColumn("_class", size_class(F.col("length"), large, very_large, most))
    by_path = F.col("_class").isin("enhanced", "custom") & F.col("path").startswith("file:")
    unread = by_path | (F.col("_class") == "unsupported_size")
    none = F.lit(None).cast("binary").alias("content")
    if listed:
        rows = rows.where(~unread).select("path", "_class", "content").unionByName(rows.where(unread).select("path", "_class", none))
    else:
        rows = rows.select("path", "_class", F.when(~unread, F.col("content")).alias("content"))
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


    def read(path: str, first: str, content: pa.Scalar) -> Iterator[tuple[dict, int, list[tuple]]]:
        """What runs of one paragraph have in common, the number of the first one, and the runs; no runs where there is a row without text."""
        given, error, tries = 0, None, 0
        for name in LADDER[LADDER.index(first) :]:
            tries += 1
            seen = 0
            try:
                with zipfile.ZipFile(_opened(path, content)) as archive:
                    for paragraph, location, place in _PARSERS[name](archive):
                        runs, failed = [], None
                        try:
                            runs.extend(docx._parts(paragraph))
                        except Exception as e:  # the runs before it are given out
                            failed = e
                        common = {"parser": name, "tries": tries, "location": location} | place
                        for k in range(max(given - seen, 0), len(runs), MOST_ROWS):
                            yield common, k, runs[k : k + MOST_ROWS]
                        seen += len(runs)
                        given = max(given, seen)
                        if failed is not None:
                            raise failed
                    if not given:
                        yield {"parser": name, "tries": tries}, 0, []
                return
            except Exception as e:  # the next parser may do
                error = f"{type(e).__name__}: {e}"[:500]
        yield {"error": error, "tries": tries}, 0, []

    def made(common: list[dict], numbers: list[int | None], runs: list[tuple], sizes: list[int]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = dict(zip(_OF_RUN, (numbers, *zip(*runs, strict=True)), strict=True))
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.array([c.get(f.name) for c in common], f.type).take(of) for f in arrow]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, numbers, runs, sizes = [], [], [], []
        for batch in batches:
            for path, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for shared, k, found in [({"error": "unsupported size", "tries": 0}, 0, [])] if first == "unsupported_size" else read(path, first, content):
                    common.append({"path": path, "size_class": first} | shared)
                    sizes.append(len(found) or 1)
                    numbers += range(k, k + len(found)) if found else (None,)
                    runs += found or (_NO_RUN,)
                    if len(runs) >= MOST_ROWS:
                        yield made(common, numbers, runs, sizes)
                        common, numbers, runs, sizes = [], [], [], []
            batch = content = found = None
            give_back()
        if runs:
            yield made(common, numbers, runs, sizes)

    return rows.mapInArrow(run, SCHEMA)
