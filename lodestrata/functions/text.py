"""Text functions: native expressions where Spark has them, Arrow functions where it has not."""

from __future__ import annotations

import html
import ipaddress
import re
import unicodedata
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    """Lower case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def label_of_id(c: Column) -> Column:
    """A readable label of an id: its last part, hyphens and underscores as blanks."""
    return F.regexp_replace(F.element_at(F.split(c, ":"), -1), "[-_]+", " ")


def escape_fts(c: Column) -> Column:
    """A term as a quoted string of a full-text query."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def escape_markdown(c: Column) -> Column:
    """Characters that Markdown reads as markup, escaped; line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"([\\`*_{}\[\]<>#|])", r"\\$1")


def turtle_literal(c: Column) -> Column:
    """A Turtle string literal: a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def term_matches(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text as whole words, whatever their case."""
    out = F.lit(0)
    for t in terms:
        out = out + F.rlike(F.lower(text), F.lit(rf"(?U)(?<!\w){re.escape(t.lower())}(?!\w)")).cast("int")
    return out


def window_around(text: Column, terms: list[str], width: int = 240) -> Column:
    """`width` characters of a text, beginning a third of it before the first match of any term."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*(F.instr(low, t.lower()) for t in terms)), lambda x: x > 0)) if terms else F.lit(None)
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 3)
    return F.trim(F.substring(text, start, F.lit(width)))


@pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding (ß as ss), which lower() is not."""
    return s.str.casefold()


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(T.StringType())
def plain_html(s: pd.Series) -> pd.Series:
    """A fragment without tags, entities resolved, white space collapsed."""
    return s.map(lambda t: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split()), na_action="ignore")


@pandas_udf(T.StringType())
def iri(s: pd.Series) -> pd.Series:
    """An identifier percent-encoded for use in an IRI."""
    return s.map(lambda t: quote(t, safe=":/-._~"), na_action="ignore")


def public_url(url: str | None) -> bool:
    """http or https, a host that is neither local nor a private address, no credentials."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".").lower()
        host.encode("idna")
        parts.port  # noqa: B018
    except (ValueError, UnicodeError):
        return False
    if parts.scheme not in ("http", "https") or not host or parts.username is not None or host == "localhost" or host.endswith((".localhost", ".local")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return "." in host


@pandas_udf(T.BooleanType())
def is_public_url(s: pd.Series) -> pd.Series:
    """public_url of each value; false for null."""
    return s.map(public_url)
