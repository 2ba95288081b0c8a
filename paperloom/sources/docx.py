"""Paragraphs of word-processor files: a table function over their bytes. A broken file is a row with an error, never a failure."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "pos int, text string, style string, mode string, error string"


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    names = {}
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        if name is not None:
            shown = name.get(f"{W}val") or ""
            names[style.get(f"{W}styleId") or ""] = "Heading" + shown[7:] if shown.startswith("heading") else shown
    return names


def _text(paragraph: ElementTree.Element, whole: bool) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif whole and node.tag == f"{W}tab":
            out.append("\t")
        elif whole and node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def paragraphs_of(content: bytes | None) -> Iterator[tuple[int, str, str, str, str | None]]:
    """(pos, text, style, mode, error). ``body`` has the paragraphs of the document's body with their styles; where that has no
    text, ``all`` has every paragraph, those in tables and boxes too, without tabs and breaks."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
            names = _styles(archive)
    except Exception as problem:  # noqa: BLE001
        yield 0, "", "", "none", f"{type(problem).__name__}: {problem}"[:200]
        return
    if body is None:
        yield 0, "", "", "none", "no body"
        return
    rows = []
    for pos, p in enumerate(body.findall(f"{W}p")):
        mark = p.find(f"{W}pPr/{W}pStyle")
        key = mark.get(f"{W}val") if mark is not None else None
        rows.append((pos, _text(p, True), names.get(key, key) if key else "Normal", "body", None))
    if not any(r[1].strip() for r in rows):
        rows = [(pos, _text(p, False), "", "all", None) for pos, p in enumerate(body.iter(f"{W}p"))]
    yield from rows


@F.udtf(returnType=SCHEMA)
class DocxParagraphs:
    def eval(self, content: bytes):
        yield from paragraphs_of(content)


def docx_paragraphs(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(<keep>, pos, text, style, mode, error): paragraphs that are not blank, normalised, and a row per file that can't be read."""
    spark = files.sparkSession
    spark.udtf.register("docx_paragraphs", DocxParagraphs)
    fields = ", ".join("f." + k for k in keep)
    rows = spark.sql(f"SELECT {fields}, p.* FROM {{files}} f, LATERAL docx_paragraphs(f.content) p", files=files.select(*keep, "content"))
    return rows.withColumn("text", normalize_text("text")).where("text <> '' OR error IS NOT NULL")
