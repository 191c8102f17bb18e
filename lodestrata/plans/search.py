"""Ranked full-text retrieval: a compiled plan, an inverted index, and BM25 over two fields.

The plan is data (phrases, types, limit) and runs as one Catalyst query: postings are filtered by the plan's phrases (a
prefix is a range of tokens, so a sorted index is read in part), combined per record and field before the shuffle, scored
against the statistics of the whole corpus, and cut by a top-k that never sorts everything.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import spread

#: Words that a question may hold without asking for them.
STOPWORDS = frozenset("a an and are as at be by for from how in is of on or that the to what".split())
K1, B = 1.2, 0.75
#: Weights of title and body.
KNOWLEDGE, LIBRARY = (2.0, 1.0), (1.0, 2.0)


@dataclass(frozen=True)
class Plan:
    """A compiled question: sorted distinct terms, each a phrase of tokens of which the last is a prefix."""

    terms: tuple[str, ...]
    record_types: tuple[str, ...] = ()
    limit: int = 20
    compiler: str = "lodestrata-1"

    @property
    def expression(self) -> str:
        return " OR ".join('"' + t.replace('"', '""') + '"*' for t in self.terms)

    @property
    def phrases(self) -> list[tuple[str, ...]]:
        return [p for t in self.terms if (p := tuple(tokens(t)))]


#: Letters whose simple case folding is not their lower case.
_FOLD = {0xB5: 0x3BC, 0x17F: 0x73, 0x3C2: 0x3C3}


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and marks, in lower case, without diacritics."""
    low = unicodedata.normalize("NFD", text.lower().translate(_FOLD))
    out, word = [], []
    for c in low:
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            word.append(c)
        elif kind[0] != "M" and word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


def compile_question(question: str, record_types: tuple[str, ...] = (), limit: int = 20) -> Plan:
    """Raises ValueError if no term is left or the limit is out of 1 to 1000; search syntax in the question is inert."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    found = {t.casefold() for t in re.findall(r"\w[\w.-]*", question)}
    terms = tuple(sorted(t for t in found if t not in STOPWORDS))
    if not terms:
        raise ValueError("the question has no searchable term")
    return Plan(terms, tuple(sorted(set(record_types))), limit)


_WORD = re.compile(r"[^\W_]+")


def _class(kinds: tuple[str, ...]) -> str:
    """The code points below 0x10000 of general categories, as ranges of a character class: one without astral ranges is a quick table."""
    out, start = [], None
    for c in range(0x10001):
        ok = c < 0x10000 and unicodedata.category(chr(c)) in kinds
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_MARKS: list[re.Pattern] = []


def fast_tokens(text: str) -> list[str]:
    """As tokens, by regular expressions instead of a loop over characters."""
    low = text.lower()
    if low.isascii():
        return _WORD.findall(low)
    if not _MARKS:  # once per worker
        _MARKS.extend((re.compile(f"[{_class(('Mn', 'Mc', 'Me'))}]+"), re.compile(f"[{_class(('Co',))}]"), re.compile("[\u00b5\u017f\u03c2]")))
    if _MARKS[2].search(low):
        low = low.translate(_FOLD)
    low = unicodedata.normalize("NFD", low)
    if max(low) > "\uffff" or _MARKS[1].search(low):
        return tokens(text)
    return _WORD.findall(_MARKS[0].sub("", low))


POSTINGS = "token string, record_type string, record_id string, field int, n_tokens int, positions array<int>"


def postings_of(corpus: DataFrame) -> DataFrame:
    """POSTINGS of a corpus of record_type, record_id, title, body: a row for each distinct token of a field, and one of an empty token for
    each record; n_tokens is the record's length."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for kind, rid, *texts in zip(*(b.column(i).to_pylist() for i in range(4))):
                fields = [fast_tokens(t or "") for t in texts]
                size = sum(map(len, fields))
                out.append(("", kind, rid, -1, size, []))
                for field, words in enumerate(fields):
                    at: dict[str, list[int]] = {}
                    for p, t in enumerate(words):
                        at.setdefault(t, []).append(p)
                    out += [(t, kind, rid, field, size, p) for t, p in at.items()]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in POSTINGS.split(", ")])

    slim = spread(corpus.select("record_type", F.col("record_id").cast("string").alias("record_id"), "title", "body"))
    return slim.mapInArrow(post, POSTINGS)


class Index:
    """A stored inverted index: postings in order of token, and one row of statistics of the whole corpus.

    A question reads the ranges of its tokens and nothing else: they are pushed to the scan, and as files and row groups
    hold ranges of tokens, the rest is skipped. Lengths stand in the postings, so nothing is joined.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, corpus: DataFrame, path: str) -> Index:
        """Reads every text once. A token that very many records hold is cut by record, so no file or task is its alone."""
        spark = corpus.sparkSession
        postings_of(corpus).repartitionByRange("token", "record_type", "record_id").sortWithinPartitions("token", "record_type", "record_id").write.parquet(f"{path}/postings")
        index = cls(spark, path)
        records = index.postings().filter("token = ''")
        records.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_records")).write.parquet(f"{path}/statistics")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def statistics(self) -> tuple[int, int]:
        """Records and tokens of the corpus."""
        row = self.spark.read.schema("n_tokens long, n_records long").parquet(f"{self.path}/statistics").first()
        return row["n_records"], row["n_tokens"]


def wanted(plan: Plan) -> Column:
    """Whether a posting's token is one that the plan asks for, as ranges and values that a scan can use."""
    out = F.lit(False)
    for phrase in plan.phrases:
        *whole, last = phrase
        for t in whole:
            out = out | (F.col("token") == t)
        out = out | F.col("token").startswith(last)
    return out


def matches(postings: DataFrame, plan: Plan) -> DataFrame:
    """record_type, record_id, n_tokens and per phrase k the places in title and body, t<k> and b<k>, of every record with one."""
    phrases = plan.phrases
    parts = [(k, j, t, j == len(p) - 1, len(p)) for k, p in enumerate(phrases) for j, t in enumerate(p)]
    asked = F.array(*(F.when(F.col("token").startswith(t) if prefix else F.col("token") == t, F.struct(F.lit(k).alias("phrase"), F.lit(j).alias("j"), F.lit(n).alias("n"))) for k, j, t, prefix, n in parts))
    record = ["record_type", "record_id", "n_tokens"]
    hit = postings.filter(wanted(plan)).select(*record, "field", "positions", F.explode(F.filter(asked, lambda x: x.isNotNull())).alias("w"))
    found = hit.filter("w.n = 1").select(*record, "field", F.col("w.phrase").alias("phrase"), F.size("positions").alias("tf"))
    if any(n > 1 for *_, n in parts):
        # a phrase stands where each of its tokens, shifted back by its place, has the same position
        at = hit.filter("w.n > 1").select(*record, "field", "w", F.explode("positions").alias("p"))
        stands = at.groupBy(*record, "field", F.col("w.phrase").alias("phrase"), F.col("w.n").alias("n"), (F.col("p") - F.col("w.j")).alias("p")).agg(F.count_distinct("w.j").alias("m")).filter("m = n")
        found = found.unionByName(stands.select(*record, "field", "phrase", F.lit(1).alias("tf")))
    tf = [F.sum(F.when((F.col("phrase") == k) & (F.col("field") == f), F.col("tf")).otherwise(0)).alias(f"{'tb'[f]}{k}") for k in range(len(phrases)) for f in (0, 1)]
    return found.groupBy(*record).agg(*tf)


def _count(words: list[str], phrase: tuple[str, ...]) -> int:
    """Places where a phrase stands, its last token a prefix."""
    *whole, last = phrase
    if not whole:
        return sum(w.startswith(last) for w in words)
    n = len(whole)
    return sum(words[i : i + n] == whole and words[i + n].startswith(last) for i in range(len(words) - n) if words[i] == whole[0])


def scanned(corpus: DataFrame, plan: Plan) -> DataFrame:
    """record_type, record_id, n_tokens and per phrase k the places in title and body, t<k> and b<k>, of every record. One pass, no shuffle but to spread a small input."""
    phrases = plan.phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for title, body in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                t, x = fast_tokens(title or ""), fast_tokens(body or "")
                sizes.append(len(t) + len(x))
                found.append([_count(w, p) for p in phrases for w in (t, x)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["record_type", "record_id", "n_tokens", "tf"])

    slim = spread(corpus.select("record_type", F.col("record_id").cast("string").alias("record_id"), "title", "body"))
    found = slim.mapInArrow(run, "record_type string, record_id string, n_tokens int, tf array<int>")
    return found.select("record_type", "record_id", "n_tokens", *(F.get("tf", k).alias(name) for k, name in enumerate(_columns(plan))))


def _columns(plan: Plan) -> list[str]:
    return [f"{side}{k}" for k in range(len(plan.phrases)) for side in "tb"]


def analysed(corpus: DataFrame) -> DataFrame:
    """record_type, record_id, title, body, n_tokens with texts as their tokens, each after a blank: a table to write once and query often, without Python, join or shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            title, body = ([fast_tokens(t or "") for t in b.column(i).to_pylist()] for i in (2, 3))
            flat = lambda rows: pa.array(["".join(f" {t}" for t in r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), flat(title), flat(body), pa.array([len(x) + len(y) for x, y in zip(title, body)], pa.int32())], names=["record_type", "record_id", "title", "body", "n_tokens"]
            )

    slim = spread(corpus.select("record_type", F.col("record_id").cast("string").alias("record_id"), "title", "body"))
    return slim.mapInArrow(run, "record_type string, record_id string, title string, body string, n_tokens int")


def _places(tokens_: str, phrase: tuple[str, ...]) -> str:
    """SQL for the places where a phrase stands in a text of tokens, its last token a prefix: as a blank begins every token, those of the phrase's text."""
    text = "".join(f" {t}" for t in phrase)
    if phrase[0] in phrase[1:] or any(phrase[0].startswith(phrase[-1]) for _ in phrase[1:]):  # may overlap itself
        return f"regexp_count({tokens_}, r'(?={text})')"
    return f"cast((octet_length({tokens_}) - octet_length(replace({tokens_}, '{text}', ''))) / {len(text.encode())} as int)"


def counted_analysed(table: DataFrame, plan: Plan) -> DataFrame:
    """As scanned, from an analysed corpus; one pass of native expressions. Tokens are letters and digits, so they need no quoting."""
    tf = [_places(c, p) for p in plan.phrases for c in ("title", "body")]
    return table.selectExpr("record_type", "record_id", "n_tokens", *(f"{x} as {name}" for x, name in zip(tf, _columns(plan))))


def ranked(corpus: DataFrame | Index, plan: Plan, weights: tuple[float, float] = KNOWLEDGE, ready: bool = False) -> DataFrame:
    """record_type, record_id, score (lower is better), rank, truncated of the best plan.limit records.

    From an Index only the plan's postings are read; from a corpus all texts, in one pass; if `ready`, `corpus` is an analysed
    one. A filter by record type is applied after scoring and leaves the corpus statistics as they are. An empty corpus gives no rows.
    """
    from lodestrata.session import Scratch

    n = len(plan.phrases)
    spark = corpus.spark if isinstance(corpus, Index) else corpus.sparkSession
    dfs = [f"count_if(t{k} + b{k} > 0) as df{k}" for k in range(n)]
    if isinstance(corpus, Index):
        counts = Scratch(spark, "search").table(matches(corpus.postings(), plan))
        n_docs, tokens_ = corpus.statistics()
        total = counts.selectExpr(*dfs).first()
    else:
        counts = counted_analysed(corpus, plan) if ready else Scratch(spark, "search").table(scanned(corpus, plan))
        total = counts.selectExpr("count(*) as n", "sum(n_tokens) as t", *dfs).first()
        n_docs, tokens_ = total["n"], total["t"] or 0
    average = tokens_ / n_docs if n_docs and tokens_ else 1.0
    parts = []
    for k in range(n):
        idf = math.log((n_docs - total[f"df{k}"] + 0.5) / (total[f"df{k}"] + 0.5)) if n_docs else 0.0
        f = f"({weights[0]}D * t{k} + {weights[1]}D * b{k})"
        parts.append(f"{idf if idf > 0 else 1e-6!r}D * {f} * {K1 + 1!r}D / ({f} + {K1!r}D * ({1 - B!r}D + {B!r}D * n_tokens / {average!r}D))")
    hit = counts.filter(" + ".join(f"t{k} + b{k}" for k in range(n)) + " > 0")
    if plan.record_types:
        hit = hit.filter(F.col("record_type").isin(*plan.record_types))
    # as few rows as the question's limit, so they may come to the driver and be numbered there
    top = hit.selectExpr("record_type", "record_id", f"round(-({' + '.join(parts)}), 9) as score").orderBy("score", "record_type", "record_id").limit(plan.limit + 1).collect()
    best = top[: plan.limit]
    columns = {
        "record_type": pa.array([r["record_type"] for r in best], pa.string()), "record_id": pa.array([r["record_id"] for r in best], pa.string()), "score": pa.array([r["score"] for r in best], pa.float64()),
        "rank": pa.array(range(1, len(best) + 1), pa.int32()), "truncated": pa.array([len(top) > plan.limit] * len(best), pa.bool_()),
    }
    return spark.createDataFrame(pa.table(columns))


def snippets(top: DataFrame, corpus: DataFrame, plan: Plan, width: int = 24) -> DataFrame:
    """top with title and excerpt: the `width` body tokens that hold most matches, those in brackets. Only ranked records are read into Python."""
    first = [p[-1] for p in plan.phrases]

    def excerpt(text: str | None) -> str:
        spans = list(re.finditer(r"[^\W_]+", text or ""))
        if not spans:
            return ""
        hit = [any(t.startswith(p) for p in first for t in fast_tokens(s.group())[:1]) for s in spans]
        best = max(range(len(spans)), key=lambda i: (sum(hit[i : i + width]), -i))
        part, out, at = spans[best : best + width], [], None
        for s, h in zip(part, hit[best:]):
            out.append((text[at : s.start()] if at is not None else "") + (f"[{s.group()}]" if h else s.group()))
            at = s.end()
        return (" … " if best else "") + "".join(out) + (" … " if best + width < len(spans) else "")

    @F.pandas_udf("string")
    def excerpts(s: pd.Series) -> pd.Series:
        return s.map(excerpt)

    slim = corpus.select("record_type", F.col("record_id").cast("string").alias("record_id"), "title", "body")
    # the limit bounds `top`, so it can be broadcast
    return slim.join(F.broadcast(top), ["record_type", "record_id"]).withColumn("excerpt", excerpts("body")).drop("body")


def enriched(top: DataFrame, anchors: DataFrame, sources: DataFrame, threats: DataFrame) -> DataFrame:
    """Ranked anchors with their source and the sorted ids of its threats, by one join each of the few ranked rows instead of lookups per hit."""
    hit = anchors.select(F.col("anchor_id").alias("record_id"), "source_version_id", "anchor_kind", "anchor_start", "anchor_end").join(F.broadcast(top), "record_id")  # the limit bounds both sides of what follows
    with_source = sources.select("source_version_id", "source_uri", "license").join(F.broadcast(hit), "source_version_id", "right")
    ids = threats.join(F.broadcast(hit.select("source_version_id").distinct()), F.col("source_version") == F.col("source_version_id"), "left_semi").groupBy("source_version").agg(F.array_sort(F.collect_set("id")).alias("threat_ids"))
    return with_source.join(ids, F.col("source_version_id") == F.col("source_version"), "left").drop("source_version").withColumn("threat_ids", F.coalesce("threat_ids", F.array().cast("array<string>")))


def context(hits: DataFrame, budget: int = 16_000) -> DataFrame:
    """Exact texts in order of rank under a budget of characters: hits (rank, id, text) with used and complete; the last one may be cut.

    Raises ValueError for a budget outside 256 to 1,000,000. hits are as few as the search's limit.
    """
    if not 256 <= budget <= 1_000_000:
        raise ValueError("budget must be from 256 to 1,000,000 characters")
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("before")
    return (
        hits.withColumn("before", before)
        .filter(left > 0)
        .withColumn("complete", F.length("text") <= left)
        .withColumn("text", F.substring("text", F.lit(1), left.cast("int")))
        .withColumn("used", F.length("text"))
        .drop("before")
    )
