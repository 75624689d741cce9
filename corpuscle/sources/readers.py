"""Manuscript readers: text, EPUB and DOCX files of any file system that Spark reads, as documents.

Files come through the binaryFile source, so splitting, listing and credentials
are Spark's. A file that can't be read gives a row with a warning, not a failed job.
"""

from __future__ import annotations

import html.parser
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.plans.ship import ship

FORMATS = (".txt", ".epub", ".docx", ".pdf")
#: Encodings tried for text, in order; the last one reads any bytes.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SCHEMA = "path string, format string, title string, author string, text string, warnings array<string>"
_BLOCK = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "blockquote", "li", "br", "tr"}
_SKIP = {"script", "style", "nav"}
#: Takes (path, content) of a PDF and returns its text.
PdfReader = Callable[[str, bytes], str]


class _Text(html.parser.HTMLParser):
    """The visible text of a page, a line for each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in _SKIP and self.hidden > 0
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def page_text(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parts = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n\n".join(x for x in parts if x)


def read_text(content: bytes) -> tuple[str, list[str]]:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding), [] if encoding == ENCODINGS[0] else [f"read as {encoding}"]
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads any bytes")


def read_epub(content: bytes) -> tuple[str | None, str | None, str]:
    """(title, author, text) in spine order, items parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(z.read(root))
        meta = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in reversed(list(package.iter())) if e.tag.startswith("{http://purl.org/dc/elements/1.1/}")}
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        texts = [page_text(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), h))).decode("utf-8", "replace")) for h in spine]
    return meta.get("title") or None, meta.get("creator") or None, "\n\n".join(t for t in texts if t)


def read_docx(content: bytes) -> tuple[str | None, str | None, str]:
    """(title, author, text) with a blank line between paragraphs."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ET.Element("none")
    meta = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in core}
    texts = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
    return meta.get("title") or None, meta.get("creator") or None, "\n\n".join(t for t in texts if t.strip())


def title_of(text: str) -> str | None:
    """A title in the first lines: after 'Title:', or a line in capitals, or the quoted line after it."""
    found, fresh = None, False
    for line in (x.strip().lstrip("﻿") for x in text.split("\n")[:20]):
        if not line or "project gutenberg" in line.lower() or line.startswith("***"):
            continue
        if line.isupper() and 3 < len(line) < 100:
            if found is None and line not in {"CONTENTS", "TABLE OF CONTENTS", "INDEX", "FOREWORD", "DEDICATION"}:
                found, fresh = line.title(), True
            continue
        if fresh:
            quoted = re.sub(r"\s*\[\w+\]\s*$", "", line).strip().strip('"').strip() if line.startswith('"') else ""
            return quoted or found
        if line.lower().startswith("title:"):
            return line[6:].strip()
    return found


def author_of(text: str) -> str | None:
    """Who a text says it is by, in its first lines."""
    for line in text.split("\n")[:30]:
        m = re.match(r"(?:by|author:?|written by)\s+(.+)$", line.strip(), re.IGNORECASE)
        if m:
            return re.sub(r"\s+", " ", m[1].strip())
    return None


def read_manuscripts(spark: SparkSession, path: str, pdf: PdfReader | None = None) -> DataFrame:
    """(path, format, title, author, text, warnings) of every manuscript below a path.

    PDF files need a reader of the caller's; without one they, like broken files,
    give a row with a null text and a warning.
    """
    ship(spark)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(suffix.isin(*FORMATS)).select("path", suffix.alias("format"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                title = author = text = None
                notes: list[str] = []
                try:
                    if kind == ".txt":
                        text, notes = read_text(content)
                        title, author = title_of(text), author_of(text)
                    elif kind == ".epub":
                        title, author, text = read_epub(content)
                    elif kind == ".docx":
                        title, author, text = read_docx(content)
                    elif pdf is not None:
                        text = pdf(name, content)
                    else:
                        notes = ["no PDF reader was given"]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration) as e:
                    notes = [f"not readable: {type(e).__name__}"]
                out.append((name, kind[1:], title, author, text, notes))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved JSON documents of a declared schema; what doesn't parse is null in every column."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
