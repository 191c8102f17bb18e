"""Structural anchors of texts: document, pages, sections, headings, paragraphs, list items, footnotes and captions.

One pass per text in Python, as places are offsets in code points and a line's meaning depends on its neighbours; texts are
spread over tasks as they are read and nothing is shuffled. Every line is read once by a small classifier; sections are
opened and closed on a stack, so a text costs its length however many headings it has.

Defined results: null is as the empty text, which still has a document and a page. Lines end as str.splitlines has it. A
text of more than `most` anchors gives none: it is reported by `oversized` instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

#: Kinds in order of precedence at one offset.
KINDS = ("document", "page", "section", "heading", "caption", "footnote", "list_item", "paragraph")
#: Words that begin a caption, roman digits, marks that end a caption's number, bullets.
CAPTIONED = ("figure", "fig.", "table", "chart", "diagram")
ROMAN, STOPS, BULLETS = frozenset("ivxlcdmIVXLCDM"), ".:-", "-+*"
#: Anchors a text may have.
MOST = 100_000
#: Blanks before a mark of Markdown, at most.
INDENT = 3
SCHEMA = "ordinal int, kind string, start long, stop long, level int, page int, label string, parent int, synthetic boolean"


def _run(text: str, member) -> int:
    """How many characters at the beginning are members."""
    n = 0
    while n < len(text) and member(text[n]):
        n += 1
    return n


def _blank(c: str) -> bool:
    return c in " \t"


class Line:
    """One line: where it stands, what it says, and what it may be."""

    __slots__ = ("start", "stop", "text", "body", "near")

    def __init__(self, start: int, text: str):
        self.start, self.stop, self.text = start, start + len(text), text
        indent = _run(text, _blank)
        self.body, self.near = text[indent:], indent <= INDENT

    @property
    def empty(self) -> bool:
        return not self.text.strip()

    def heading(self) -> tuple[int, str] | None:
        """Level and label of a heading that begins with number signs."""
        level = _run(self.body, lambda c: c == "#")
        rest = self.body[level:]
        if not self.near or not 1 <= level <= 6 or len(rest) < 2 or not _blank(rest[0]):
            return None
        title = rest.strip(" \t")
        bare = title.rstrip("#").rstrip(" \t")
        return level, (bare or title[:1]).strip()

    def underline(self) -> int | None:
        """Level that a line of equal signs or hyphens gives to the line before it."""
        mark = self.body.rstrip(" \t")
        if self.near and mark and mark[0] in "=-" and not mark.strip(mark[0]):
            return 1 if mark[0] == "=" else 2
        return None

    def block(self) -> tuple[str, str | None]:
        """Kind and label of a line of text."""
        if self.near and self.body.startswith("[^"):
            note, bracket, after = self.body[2:].partition("]")
            if note and bracket and after.startswith(":"):
                return "footnote", f"Footnote {note}"
        if self._captioned():
            return "caption", self.text.strip()[:200]
        if self.near and self._listed():
            return "list_item", None
        return "paragraph", None

    def _captioned(self) -> bool:
        low = self.body[:8].lower()
        word = next((w for w in CAPTIONED if low.startswith(w)), None)
        if word is None:
            return False
        rest = self.body[len(word) :]
        gap = _run(rest, _blank)
        tails = [rest[gap:]]
        if gap:
            number = rest[gap:]
            n = _run(number, str.isdecimal) or _run(number, ROMAN.__contains__)
            if n:
                tails.append(number[n:].lstrip(" \t"))
        return any(len(t) > 1 and t[0] in STOPS and _blank(t[1]) for t in tails)

    def _listed(self) -> bool:
        n = 1 if self.body[:1] and self.body[0] in BULLETS else 0
        if not n and (digits := _run(self.body, str.isdecimal)) and self.body[digits : digits + 1] in (".", ")"):
            n = digits + 1
        return bool(n) and _blank(self.body[n : n + 1] or "x")


def _lines(text: str, base: int) -> list[Line]:
    out, at = [], base
    for raw in text.splitlines(keepends=True):
        out.append(Line(at, raw.rstrip("\r\n")))
        at += len(raw)
    return out


def _anchor(kind: str, start: int, stop: int, up: dict | None, page: int | None, level: int | None = None, label: str | None = None) -> dict:
    return {"kind": kind, "start": start, "stop": stop, "level": level, "page": page, "label": label, "up": up, "synthetic": False}


def anchors(text: str | None, most: int = MOST) -> list[tuple] | None:
    """Rows of SCHEMA, in order of start, kind, longer first, ordinals from 1; parent is the ordinal of the enclosing section,
    page or document. None for a text of more than `most` anchors."""
    text = text or ""
    document = _anchor("document", 0, len(text), None, None)
    found, at = [document], 0
    pages = text.split("\f")
    for number, part in enumerate(pages, 1):
        page = _anchor("page", at, at + len(part), document, number, label=f"Page {number}")
        page["synthetic"] = len(pages) == 1
        found.append(page)
        found += _page(_lines(part, at), page)
        if len(found) > most:
            return None
        at += len(part) + 1
    found.sort(key=lambda d: (d["start"], KINDS.index(d["kind"]), d["start"] - d["stop"]))
    place = {id(d): i for i, d in enumerate(found, 1)}
    return [(i, d["kind"], d["start"], d["stop"], d["level"], d["page"], d["label"], d["up"] and place[id(d["up"])], d["synthetic"]) for i, d in enumerate(found, 1)]


def _page(lines: list[Line], page: dict) -> list[dict]:
    """Anchors of a page: sections are open until a heading of their level or a lesser one, text belongs to the innermost."""
    number, out = page["page"], []
    open_: list[dict] = []  # sections, outermost first
    block: dict | None = None  # the paragraph that lines may still join

    def opened(first: Line, last: Line, level: int, label: str) -> None:
        while open_ and open_[-1]["level"] >= level:
            open_.pop()["stop"] = first.start
        section = _anchor("section", first.start, page["stop"], open_[-1] if open_ else page, number, level, label)
        open_.append(section)
        out.extend((section, _anchor("heading", first.start, last.stop, section, number, level, label)))

    i = 0
    while i < len(lines):
        line, after = lines[i], lines[i + 1] if i + 1 < len(lines) else None
        head = line.heading()
        under = after.underline() if after and not head and not line.empty else None
        if head or under:
            last = line if head else after
            opened(line, last, *(head or (under, line.text.strip())))
            block, i = None, i + (1 if head else 2)
            continue
        kind, label = (None, None) if line.empty else line.block()
        if kind == "paragraph" and block:
            block["stop"] = line.stop
        elif kind:
            block = _anchor(kind, line.start, line.stop, open_[-1] if open_ else page, number, label=label)
            out.append(block)
        if kind != "paragraph":
            block = None
        i += 1
    return out


def extract(df: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """key and SCHEMA of every anchor of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]
        for b in batches:
            rows = [(k, *a) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for a in anchors(t, most) or ()]
            yield pd.DataFrame(rows, columns=names).astype({"level": "Int32", "page": "Int32", "parent": "Int32"})

    slim = spread(df.select(key, text))
    return slim.mapInPandas(run, f"{key} {slim.dtypes[0][1]}, {SCHEMA}")


def oversized(df: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """key of the texts with more than `most` anchors; only texts of as many characters can have them."""

    @F.pandas_udf("boolean")
    def over(s: pd.Series) -> pd.Series:
        return s.map(lambda t: anchors(t, most) is None)

    return df.filter(F.length(text) >= most // 2).select(key, text).filter(over(text)).select(key)
