"""Documents of several media types to plain text, threats, anchors and citations."""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES, MOST_CHARS = 25_000_000, 20_000_000
MOST_UNPACKED, MOST_RATIO = 200_000_000, 200
HIDDEN = frozenset("script style template noscript svg".split())
BLOCKS = frozenset("p div br section article header footer main nav aside table tr ul ol blockquote pre figure hr dl dt dd form".split())


def normalise(text: str) -> str:
    """NFC, no control or format characters but line ends, tabs and form feeds, no blanks at line ends, two blank lines at most."""
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = "".join(c for c in text if c in "\n\t\f" or unicodedata.category(c)[0] != "C")
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]+(?=\n|$)", "", text)).strip("\n ")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "figcaption":
            self.out.append("\nFigure: ")
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(content: bytes) -> str:
    p = _Visible()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    return "\n".join(line.strip() for line in "".join(p.out).split("\n"))


def xml_text(content: bytes) -> str:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", content, re.IGNORECASE):
        raise ValueError("document type and entity declarations are not allowed")
    return "\n".join(t.strip() for t in ElementTree.fromstring(content).itertext() if t.strip())


def office_text(content: bytes) -> str:
    """Text of the parts of DOCX, PPTX, XLSX and ODT files, in order of their names."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = sorted((i for i in z.infolist() if re.search(r"^(word/document|ppt/slides/slide\d+|xl/sharedStrings|xl/worksheets/sheet\d+|content)\.xml$", i.filename)), key=lambda i: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)])
        if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED or any(i.file_size > MOST_RATIO * max(i.compress_size, 1000) for i in parts):
            raise ValueError("the archive unpacks to too much")
        return "\n\n".join(xml_text(z.read(i)) for i in parts)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "application/json": lambda b: json.dumps(json.loads(b), ensure_ascii=False, indent=2, sort_keys=True),
    "text/html": html_text, "application/xhtml+xml": html_text, "application/xml": xml_text, "text/xml": xml_text,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": office_text, "application/vnd.openxmlformats-officedocument.presentationml.presentation": office_text,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": office_text, "application/vnd.oasis.opendocument.text": office_text,
}


def parse(content: bytes, media_type: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Plain text of a document; raises ValueError for unknown media types, broken documents and those beyond the limits. `parsers` adds or replaces parsers (a PDF reader, say)."""
    if len(content) > MOST_BYTES:
        raise ValueError("too many bytes")
    kind = media_type.split(";")[0].strip().lower()
    f = {**PARSERS, **(parsers or {})}.get(kind) or ((lambda b: b.decode("utf-8", "replace")) if kind.startswith("text/") or kind.endswith("yaml") else None)
    if f is None:
        raise ValueError(f"no parser for {kind}")
    try:
        text = normalise(f(content))
    except (ElementTree.ParseError, zipfile.BadZipFile, json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ValueError(str(e)) from e
    if len(text) > MOST_CHARS:
        raise ValueError("too many characters")
    return text


def parsed(df: DataFrame, key: str, content: str, media_type: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """key, text, error: the text or why there is none; null content or media type has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c, m in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
                try:
                    rows.append((k, parse(bytes(c), m, parsers), None) if c is not None and m is not None else (k, None, "no content or media type"))
                except ValueError as e:
                    rows.append((k, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    slim = df.select(key, F.col(content).cast("binary"), media_type)
    return slim.mapInPandas(run, f"{key} {slim.dtypes[0][1]}, text string, error string")


def ingest(files: DataFrame, key: str, content: str, media_type: str) -> dict[str, DataFrame]:
    """Tables of a parsed ingest: derivation (key, derived id, text), threats, anchors, citations, rejected. Texts are parsed once, to the shared folder."""
    from lodestrata.functions.ids import source_id_column
    from lodestrata.functions.redact import scan
    from lodestrata.operators import citations, structure
    from lodestrata.session import Scratch

    both = Scratch(files.sparkSession, "parsed").table(parsed(files, key, content, media_type))
    good = both.filter("error is null").select(key, source_id_column(F.col("text").cast("binary")).alias("derived_id"), "text")
    return {"derivation": good, "threats": scan(good, key, "text"), "anchors": structure.extract(good, key, "text"), "citations": citations.extract(good, key, "text"), "rejected": both.filter("error is not null").select(key, "error")}
