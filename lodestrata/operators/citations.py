"""Identifiers and addresses that texts mention, with the relation their context signals.

Defined results: null and empty texts mention nothing; an identifier that no normaliser takes is no mention; identifiers
of different kinds may overlap, but an address within an identifier counts as the identifier alone. A text of more
mentions than `most` gives none, as one of too many anchors does.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import structure
from lodestrata.session import spread


def _words(*alternatives: str, gap: str = r"\s+") -> str:
    """Whole words or phrases; a plus stands for an optional s, a blank for a gap."""
    return r"(?:" + "|".join(a.replace("+", "s?").replace(" ", gap) for a in alternatives) + r")\b"


#: Public syntaxes of identifiers; the group is the value.
SYNTAX = {
    "doi": r"(?<![A-Za-z0-9])(?:doi:\s*|https?://doi\.org/)?(10\.\d{4,9}/\S+)",
    "pmid": r"\bPMID\s*:\s*([1-9][0-9]{0,8})\b",
    "pmcid": r"\b(?:PMCID\s*:\s*)?(PMC[1-9][0-9]*)\b",
    "arxiv": r"\barXiv\s*:\s*(\d{4}\.\d{4,5}(?:v[1-9][0-9]*)?)\b",
}
ADDRESS = r"https?://[^\s<>{}\[\]\"']+"
#: Relations and the words that signal them; among signals at one place the first relation counts.
SIGNALS = {
    "retracts": ("retract+", "retraction of", "retraction for"),
    "corrects": ("correct+", "correction of", "correction to", "correction for"),
    "updates": ("update+", "updated version of"),
    "reviews": ("review+", "review of"),
    "replies_to": ("replie+ to", "response to"),
    "mentions": ("mention+",),
    "cites": ("cite", "cites", "cited", "citation"),
}
#: Labels of sections that list references.
LISTS = ("reference+", "bibliography", "works cited", "sources")
#: Characters before a mention, within its anchor, in which a signal counts, and in which a link opens.
REACH, LINK = 96, 8
#: Mentions a text may have.
MOST = 100_000
#: Kinds of anchors that hold no others, in order of preference where several hold a mention.
LEAVES = ("footnote", "caption", "list_item", "paragraph", "heading")
SCHEMA = "kind string, raw string, start long, stop long, value string, locator string, relation string, signal string"

_SYNTAX = {kind: re.compile(p, re.IGNORECASE) for kind, p in SYNTAX.items()}
_ADDRESS = re.compile(ADDRESS, re.IGNORECASE)
_SIGNALS = [(name, re.compile(r"\b" + _words(*words), re.IGNORECASE)) for name, words in SIGNALS.items()]
_LISTS = re.compile(r"\b" + _words(*LISTS, gap=" "), re.IGNORECASE)
_HEADED = re.compile(r"(?:^|\n)[ \t]*#{1,6}[ \t]+" + _words(*LISTS, gap=" "), re.IGNORECASE)


def trimmed(token: str) -> str:
    """Without closing punctuation, and then without closing brackets that were not opened within, round ones first."""
    token = token.rstrip(".,;:!?'\">")
    for pair in ("()", "[]", "{}"):
        surplus = token.count(pair[1]) - token.count(pair[0])
        while surplus > 0 and token.endswith(pair[1]):
            token, surplus = token[:-1], surplus - 1
    return token


def doi_value(raw: str) -> str | None:
    """A DOI in lower case with percent signs decoded, null if it is none; as identifiers.doi."""
    value = unquote(raw.strip())
    for label in ("https://doi.org/", "http://doi.org/", "doi:"):
        if value.lower().startswith(label):
            value = value[len(label) :].strip()
            break
    value = value.rstrip(".,;")
    return value.casefold() if re.fullmatch(r"10\.\d{4,9}/\S+", value) else None


def public_address(raw: str) -> str | None:
    """A public http(s) address: scheme and host in lower case, without default port and fragment, with a path; else null."""
    try:
        parts = urlsplit(raw)
        host, port = (parts.hostname or "").encode("idna").decode("ascii").lower(), parts.port
    except (ValueError, UnicodeError):
        return None
    if not host or parts.username or parts.password or host == "localhost" or host.endswith(".local"):
        return None
    try:
        if not ipaddress.ip_address(host).is_global:
            return None
    except ValueError:
        pass  # a name
    scheme = parts.scheme.lower()
    shown = host if port in (None, 0, {"http": 80, "https": 443}.get(scheme)) else f"{host}:{port}"
    return urlunsplit((scheme, shown, parts.path or "/", parts.query, ""))


#: Normal form and canonical address by kind.
_VALUES: dict[str, Callable[[str], str | None]] = {"doi": doi_value, "pmid": str.strip, "pmcid": str.upper, "arxiv": str.casefold, "url": public_address}
LOCATORS: dict[str, Callable[[str], str]] = {
    "doi": lambda v: "https://doi.org/" + quote(v, safe="/():._-;"),
    "pmid": lambda v: f"https://pubmed.ncbi.nlm.nih.gov/{v}/",
    "pmcid": lambda v: f"https://www.ncbi.nlm.nih.gov/pmc/articles/{v}/",
    "arxiv": lambda v: f"https://arxiv.org/abs/{v}",
    "url": lambda v: v,
}


def occurrences(text: str) -> list[tuple[int, int, str, str, str]]:
    """start, stop, kind, raw, value of every identifier and address, in order."""
    found: set[tuple[int, int, str, str, str]] = set()
    covered: list[tuple[int, int]] = []
    for kind, pattern in _SYNTAX.items():
        for m in pattern.finditer(text):
            raw = trimmed(m.group(1))
            value = _VALUES[kind](raw)
            if value:
                found.add((m.start(1), m.start(1) + len(raw), kind, raw, value))
                covered.append(m.span())
    covered.sort()
    reach, furthest = [], 0  # the furthest end of all that begin up to each
    for _, z in covered:
        furthest = max(furthest, z)
        reach.append(furthest)
    starts = [a for a, _ in covered]
    for m in _ADDRESS.finditer(text):
        raw = trimmed(m.group())
        stop = m.start() + len(raw)
        i = bisect_right(starts, m.start()) - 1
        if (i < 0 or reach[i] < stop) and (value := public_address(raw)):
            found.add((m.start(), stop, "url", raw, value))
    return sorted(found)


def mentions(text: str | None, under_references: bool = False, most: int = MOST) -> list[tuple]:
    """Rows of SCHEMA of a text, in order; under_references: whether the whole text stands under a heading of references.

    The relation is that of the nearest signal before the mention, within its anchor; without one, a mention cites if its
    anchor or one above it is labelled as references, or if it is the target of a link.
    """
    text = text or ""
    found = occurrences(text)
    if not found or len(found) > most:
        return []
    rows = structure.anchors(text)
    if rows is None:
        return []
    leaves = [r for r in rows if r[1] in LEAVES]
    starts = [r[2] for r in leaves]
    listed: dict[int, bool] = {}  # by ordinal; parents come first
    for r in rows:
        listed[r[0]] = bool(_LISTS.search(r[6] or "")) or (r[7] is not None and listed[r[7]])
    out = []
    for start, stop, kind, raw, value in found:
        anchor = leaves[bisect_right(starts, start) - 1]  # no value spans lines, and no line but a blank one is without leaf
        before = text[max(anchor[2], start - REACH) : start]
        signals = [(m.start(), -k, name, m.group().casefold()) for k, (name, p) in enumerate(_SIGNALS) for m in p.finditer(before)]
        if signals:
            _, _, relation, signal = max(signals)
        elif under_references or listed[anchor[0]]:
            relation, signal = "cites", "reference-section"
        elif "](" in before[-LINK:] or _HEADED.search(before):
            relation, signal = "cites", "citation-syntax"
        else:
            relation, signal = "mentions", "identifier-occurrence"
        out.append((kind, raw, start, stop, value, LOCATORS[kind](value), relation, signal))
    return out


def extract(df: DataFrame, key: str, text: str, under_references: str | None = None) -> DataFrame:
    """key and SCHEMA of each mention.

    under_references: a boolean column, for texts that are parts of a document: whether their section lists references.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]
        for b in batches:
            yield pd.DataFrame([(k, *m) for k, t, u in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]) for m in mentions(t, bool(u))], columns=names)

    # texts without anything like a mention never leave the JVM
    under = F.coalesce(F.col(under_references), F.lit(False)) if under_references else F.lit(False)
    slim = spread(df.select(key, text, under.alias("_under"))).filter(F.col(text).rlike(r"(?i)10\.\d{4}|pmid|pmc[0-9]|arxiv|https?://"))
    return slim.mapInPandas(run, f"{key} {slim.dtypes[0][1]}, {SCHEMA}")


def under_references(anchors: DataFrame) -> DataFrame:
    """anchors (anchor_id, source_version_id, page_number, anchor_kind, anchor_start, exact_text) with under_references: whether the heading
    before each on its page, or its own, is one of references. Of headings above that one the level is not known.

    Only headings are sorted within a source: an anchor looks its heading up by a bounded cell of places, so that a source
    with a third of all anchors is no single task.
    """
    named = F.col("exact_text").rlike(r"(?i)" + _LISTS.pattern)
    place = ["_s", "page_number"]
    base = anchors.withColumn("_s", F.coalesce("source_version_id", F.concat(F.lit("anchor "), "anchor_id"))).withColumn("_c", F.floor(F.col("anchor_start") / CELL))
    heading = F.struct("anchor_start", F.when(F.col("anchor_kind") == "heading", 0).otherwise(1).alias("k"), "anchor_id")
    # the last heading of every cell of places, then of every cell up to this one: rows are cells, not anchors
    cells = base.filter("_c is not null").groupBy(*place, "_c").agg(F.max_by(named, F.when(F.col("anchor_kind") == "heading", heading)).alias("last"))
    before = Window.partitionBy(*place).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    known = cells.select(F.col("_s").alias("_t"), F.col("page_number").alias("_p"), F.col("_c").alias("_d"), F.last("last", ignorenulls=True).over(before).alias("_earlier"))
    here = Window.partitionBy(*place, "_c").orderBy(heading)
    own = F.last(F.when(F.col("anchor_kind") == "heading", named), ignorenulls=True).over(here)
    with_cell = base.withColumn("_own", own).join(known, (F.col("_s") == F.col("_t")) & F.col("page_number").eqNullSafe(F.col("_p")) & (F.col("_c") == F.col("_d")), "left")
    found = F.when(F.col("anchor_start").isNull(), (F.col("anchor_kind") == "heading") & named).otherwise(F.coalesce("_own", "_earlier"))
    return with_cell.withColumn("under_references", F.coalesce(found, F.lit(False))).select(*anchors.columns, "under_references")


#: Characters of a cell of places within a page.
CELL = 20_000
