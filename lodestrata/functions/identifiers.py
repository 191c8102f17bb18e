"""Normalisers of research identifiers, as native expressions: null where the value is no such identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.session import BLANKS


def _text(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def _matched(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def doi(c: Column | str) -> Column:
    """Lower case, without scheme, resolver or label, percent signs decoded; 10.<4 to 9 digits>/<anything but blanks>."""
    bare = F.regexp_replace(_text(c), r"(?i)^(?:https?://(?:dx\.)?doi\.[a-z]+/|doi:\s*)", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    return F.lower(_matched(F.regexp_replace(decoded, r"[.,;]+$", ""), r"^(10\.[0-9]{4,9}/\S+)$"))


def doi_locator(c: Column | str) -> Column:
    """The address a DOI resolves at."""
    return F.concat(F.lit("https://doi.org/"), doi(c))


def pmid(c: Column | str) -> Column:
    """One to nine digits, the first no zero, with or without label or address."""
    return _matched(F.regexp_replace(_text(c), r"(?i)^(?:https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:\s*)", ""), r"^([1-9][0-9]{0,8})/*$")


def pmcid(c: Column | str) -> Column:
    """PMC and digits, the first no zero, with or without label or address."""
    bare = F.upper(F.regexp_replace(_text(c), r"(?i)^(?:https?://(?:www\.)?(?:pmc\.)?ncbi\.nlm\.nih\.gov/(?:pmc/)?articles/|https?://europepmc\.org/article/pmc/|pmcid:\s*)", ""))
    return _matched(bare, r"^(PMC[1-9][0-9]*)/*$")


def arxiv(c: Column | str) -> Column:
    """Numbers of the present style (0704.0001), with their version if they name one."""
    bare = F.lower(F.regexp_replace(_text(c), r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", ""))
    return _matched(bare, r"^([0-9]{4}\.[0-9]{4,5}(?:v[1-9][0-9]*)?)(?:\.pdf)?$")


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.when(x == "X", 10).otherwise(x.cast("int")))


def orcid(c: Column | str) -> Column:
    """Four groups of four; the last character is the check digit of ISO 7064 (modulo 11, radix 2)."""
    bare = F.upper(F.regexp_replace(_text(c), r"(?i)^(?:https?://(?:www\.)?orcid\.[a-z]+/|orcid:\s*)", ""))
    value = _matched(bare, r"^([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])$")
    d = _digits(F.regexp_replace(value, "-", ""))
    total = F.aggregate(F.slice(d, 1, 15), F.lit(0), lambda acc, x: (acc + x) * 2)
    return F.when((12 - total % 11) % 11 == F.try_element_at(d, F.lit(16)), value)


def issn(c: Column | str) -> Column:
    """Two groups of four; the last character makes the weighted sum a multiple of 11."""
    bare = F.upper(F.regexp_replace(_text(c), r"(?i)^issn:?\s*", ""))
    value = _matched(F.regexp_replace(bare, r"^([0-9]{4})([0-9]{3}[0-9X])$", "$1-$2"), r"^([0-9]{4}-[0-9]{3}[0-9X])$")
    d = _digits(F.regexp_replace(value, "-", ""))
    weights = F.array(*(F.lit(k) for k in range(8, 0, -1)))
    total = F.aggregate(F.zip_with(d, weights, lambda x, w: x * w), F.lit(0), lambda acc, x: acc + x)
    return F.when(total % 11 == 0, value)


def ror(c: Column | str) -> Column:
    """The nine characters of a ROR id: 0, six of Crockford's alphabet, two digits."""
    bare = F.lower(F.regexp_replace(_text(c), r"(?i)^(?:https?://(?:www\.)?ror\.[a-z]+/|ror:\s*)", ""))
    return _matched(bare, r"^(0[a-hj-km-np-tv-z0-9]{6}[0-9]{2})$")


NORMALISERS = {"doi": doi, "pmid": pmid, "pmcid": pmcid, "arxiv": arxiv, "orcid": orcid, "issn": issn, "ror": ror}


def normalised(kind: Column, value: Column) -> Column:
    """The normal form of a value of the kind named in a column; null for other kinds and bad values."""
    out = F.lit(None).cast("string")
    for name, f in NORMALISERS.items():
        out = F.when(kind == name, f(value)).otherwise(out)
    return out


def locator(kind: Column, value: Column) -> Column:
    """The canonical address of a normalised identifier."""
    return (
        F.when(kind == "doi", F.concat(F.lit("https://doi.org/"), value))
        .when(kind == "pmid", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), value, F.lit("/")))
        .when(kind == "pmcid", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), value, F.lit("/")))
        .when(kind == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), value))
        .when(kind == "orcid", F.concat(F.lit("https://orcid.org/"), value))
        .when(kind == "ror", F.concat(F.lit("https://ror.org/"), value))
        .when(kind == "url", value)
    )
