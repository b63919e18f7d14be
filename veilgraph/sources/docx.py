"""Word documents: every part by its channel, and the text of each with its paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Part names and their channels; the first that fits counts. Parts of other names are told as unrecognised.
CHANNELS = (
    (r"word/document\.xml", "body"),
    (r"word/header\d*\.xml", "header"),
    (r"word/footer\d*\.xml", "footer"),
    (r"word/footnotes\.xml", "footnote"),
    (r"word/endnotes\.xml", "endnote"),
    (r"word/comments\w*\.xml", "comment"),
    (r"docProps/(?:core|app|custom)\.xml", "properties"),
    (r"word/media/.*|word/embeddings/.*", "binary"),
    (r"\[Content_Types\]\.xml|.*\.rels|word/(?:styles|settings|fontTable|numbering|webSettings|theme/.*|stylesWithEffects)(?:\.xml)?", "structural"),
)
ITEMS = "path string, part string, channel string, para int, text string, hidden boolean, note string"
#: Bytes of a part beyond which it is told but not read, as archives can be made to unpack without end.
LARGEST = 64 << 20


def channel_of(part: str) -> str:
    return next((c for p, c in CHANNELS if re.fullmatch(p, part)), "unrecognised")


def _paragraphs(xml: bytes) -> Iterator[tuple[int, str, bool]]:
    if b"<!DOCTYPE" in xml[:4096]:
        raise ElementTree.ParseError("a part with a document type")
    for n, p in enumerate(ElementTree.fromstring(xml).iter(f"{_W}p")):
        text = "".join(t.text or "" if t.tag in (f"{_W}t", f"{_W}delText") else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else "" for t in p.iter())
        if text:
            yield n, text, p.find(f".//{_W}vanish") is not None or p.find(f".//{_W}del") is not None


def items_of(path: str, content: bytes) -> Iterator[tuple]:
    """The items of one file. What can't be read is an item with a note and no text, never left out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        yield path, None, None, None, None, None, "not-a-zip"
        return
    for info in archive.infolist():
        channel = channel_of(info.filename)
        if channel in ("binary", "structural", "unrecognised", "properties"):
            yield path, info.filename, channel, None, None, None, None if channel == "structural" else "not-read"
        elif info.file_size > LARGEST:
            yield path, info.filename, channel, None, None, None, "too-large"
        else:
            try:
                for n, text, hidden in _paragraphs(archive.read(info)):
                    yield path, info.filename, channel, n, text, hidden, None
            except (ElementTree.ParseError, zipfile.BadZipFile, RuntimeError):
                yield path, info.filename, channel, None, None, None, "invalid"


def extract(files: DataFrame) -> DataFrame:
    """path, part, channel, para, text, hidden, note of Word files (path, content); hidden and deleted text included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for batch in batches:
            rows = [r for path, content in zip(batch["path"], batch["content"], strict=True) for r in items_of(path, content)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"para": "Int32", "hidden": "boolean"})

    return files.select("path", "content").mapInPandas(run, ITEMS)
