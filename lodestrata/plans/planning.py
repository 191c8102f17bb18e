"""Discovery plans: questions to exact and controlled terms, clamped and checked before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a question that are no terms.
STOPWORDS = frozenset("a an and are as at be by do does for from how in is it of on or that the to what which with".split())


#: Fixed value: the address whose mention makes an anchor worth more.
HOST = "github.com/"


@dataclass(frozen=True)
class DiscoveryPlan:
    """What to look for, where, and how much of it."""

    terms: tuple[str, ...]
    connectors: tuple[str, ...]
    limit: int
    pages: int
    lost: tuple[str, ...] = field(default=())  # what was asked for and cut down


def exact_terms(question: str) -> tuple[str, ...]:
    """Sorted distinct words of two characters and more, without stop words, in folded case."""
    return tuple(sorted({w for w in re.findall(r"\w[\w.-]+", question.casefold()) if w not in STOPWORDS}))


def compile_plan(question: str, synonyms: dict[str, list[str]], concepts: list[str], known_connectors: list[str], connectors: list[str], limit: int, pages: int, most: int = 1000, most_pages: int = 20) -> DiscoveryPlan:
    """Exact terms and those of the named concepts. Raises ValueError for unknown concepts or connectors, or if nothing is left to look for."""
    unknown = sorted({*concepts} - {*synonyms}) + sorted({*connectors} - {*known_connectors})
    if unknown:
        raise ValueError(f"unknown: {unknown}")
    controlled = {" ".join(t.casefold().split()) for c in concepts for t in synonyms[c]}
    terms = tuple(sorted({*exact_terms(question), *controlled} - {""}))
    if not terms:
        raise ValueError("nothing to look for")
    lost = tuple(f"{name} {asked} cut to {top}" for name, asked, top in (("limit", limit, most), ("pages", pages, most_pages)) if asked > top)
    return DiscoveryPlan(terms, tuple(sorted(set(connectors))), max(1, min(limit, most)), max(1, min(pages, most_pages)), lost)


def merged_terms(exact: Column, controlled: Column) -> Column:
    """Sorted distinct terms of two arrays, white space collapsed, in lower case."""
    clean = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " "))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(clean(exact), clean(controlled)), lambda t: t != "")))


def queue(explicit: list[str], gaps: DataFrame, limit: int) -> list[str]:
    """Explicit questions first, then those of open gaps by priority; a question once; at most `limit`."""
    rows = gaps.filter("status <> 'resolved'").select("question", "priority").orderBy(F.desc("priority"), "question").limit(limit + len(explicit)).collect()
    return list(dict.fromkeys([*explicit, *(r["question"] for r in rows)]))[:limit]


def selected(anchors: DataFrame, topic: list[str], domain: list[str], limit: int) -> DataFrame:
    """Of each source the `limit` anchors (source_id, anchor_id, ordinal, kind, text) that score most, back in order of ordinal.

    An anchor scores 4 for each topic word, 2 for each domain word, 3 if it names a repository host and 1 if it is a heading.
    """
    from pyspark.sql import Window

    words = F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))
    hits = lambda terms: F.size(F.array_intersect(words, F.array(*(F.lit(t.lower()) for t in terms)).cast("array<string>")))
    hosted = F.contains(F.lower("text"), F.lit(HOST)).cast("int")
    scored = anchors.withColumn("score", 4 * hits(topic) + 2 * hits(domain) + 3 * hosted + (F.col("kind") == "heading").cast("int"))
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "ordinal", "anchor_id"))
    return scored.withColumn("_n", best).filter(F.col("_n") <= limit).drop("_n").orderBy("source_id", "ordinal", "anchor_id")
