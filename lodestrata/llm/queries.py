"""The named queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, names, neardup, packing, quality, spans
from lodestrata.operators.shredding import distinct_responses
from lodestrata.session import Scratch, load, norm_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- 3: shared spans ----

#: Characters of a stretch that counts as shared.
SPAN = 160


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spans.records(load(spark, d, "library_anchor"), "anchor_id", "source_version_id", "exact_text", SPAN)
    return rows, spans.matches(rows, SPAN, Scratch(spark, "spans"))


_ID = "nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '')"
_AID, _SID = _ID.format(c="anchor_id"), _ID.format(c="source_version_id")
#: Every window of every text, compared as text.
_SPANS = f"""r as (select {_AID} anchor_id, coalesce({_SID}, '') src, any_value(exact_text) t from library_anchor where {_AID} is not null and length(exact_text) >= {SPAN} group by all),
w as (select anchor_id, src, i, substr(t, i, {SPAN}) x from r, unnest(range(1, length(t) - {SPAN} + 2)) u(i)), s as (select x from w group by x having count(distinct src) > 1),
c as (select anchor_id, i from w join s using (x)), g as (select *, case when i - lag(i) over (partition by anchor_id order by i) <= {SPAN} then 0 else 1 end fresh from c), h as (select *, sum(fresh) over (partition by anchor_id order by i) run from g),
spans as (select anchor_id, min(i)::bigint - 1 span_start, max(i)::bigint + {SPAN} - 1 span_end from h group by anchor_id, run)"""


@query(f"with {_SPANS} select anchor_id, span_start, span_end from spans")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each anchor that stand word for word in an anchor of another source."""
    rows, found = _spans(spark, d)
    ids = rows.select("rec", F.col("id").alias("anchor_id")).distinct()
    return spans.exact_spans(found).join(ids, "rec").select("anchor_id", "span_start", "span_end")


@query(
    f"""with {_SPANS}, p as (select anchor_id, sum(span_end - span_start)::bigint covered, count(*) n_spans from spans group by 1), a as (select {_AID} anchor_id, coalesce(max(length(exact_text)), 0) n_chars from library_anchor where {_AID} is not null group by 1)
select anchor_id, n_chars::int n_chars, coalesce(covered, 0) covered, coalesce(n_spans, 0) n_spans, case when covered > 0 then round(covered / n_chars, 6) else 0.0 end shared_share from a left join p using (anchor_id)"""
)
def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each anchor is shared: characters, covered characters and share, 0 of anchors with none, short or without text."""
    _, found = _spans(spark, d)
    covered = spans.exact_spans(found).groupBy("rec").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("covered"), F.count("*").alias("n_spans"))
    every = load(spark, d, "library_anchor").select(norm_id("anchor_id").alias("anchor_id"), F.length("exact_text").alias("n")).filter("anchor_id is not null")
    sizes = every.groupBy("anchor_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_chars")).withColumn("rec", F.xxhash64("anchor_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.when(F.col("covered") > 0, F.round(F.col("covered") / F.col("n_chars"), 6)).otherwise(0.0)
    return sizes.join(covered, "rec", "left").select("anchor_id", "n_chars", zero("covered"), zero("n_spans"), share.alias("shared_share"))


@query()
def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy passages: chains of exact stretches of two anchors, with score and identity of their alignment."""
    rows, found = _spans(spark, d)
    texts = rows.groupBy("rec").agg(F.min("text").alias("text"), F.min("id").alias("id"))
    chained = Scratch(spark, "chains").table(spans.chains(found))
    p = spans.passages(chained, texts)
    ids = texts.select("rec", "id")
    return p.join(ids.withColumnRenamed("id", "anchor_id"), "rec").join(ids.select(F.col("rec").alias("partner"), F.col("id").alias("partner_id")), "partner").drop("rec", "partner")


# ---- 4: near duplicates ----


def _near(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, d, "library_anchor"), "anchor_id", "exact_text", least=0.6, size=3, least_words=25)


#: Texts of 25 words and more as sets of three words in a row; copies of one text are one row of `t`.
_SETS = f"""a as (select distinct {_AID} anchor_id, exact_text x from library_anchor where {_AID} is not null and exact_text is not null), t as (select x, min(anchor_id) first, count(distinct anchor_id) n_copies, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') w from a group by x),
k as (select x, first, n_copies, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from t where len(w) >= 25), e as (select first, len(s) n, unnest(s) g from k),
m as (select p.first a, q.first b, any_value(p.n) n, any_value(q.n) o, count(*) shared from e p join e q on p.g = q.g and p.first < q.first group by 1, 2), near as (select a, b, shared / (n + o - shared) similarity from m where shared >= 0.6 * (n + o - shared) - 1e-9)"""


@query(
    f"""with {_SETS}, u as (select a.anchor_id, k.first from a join k using (x)), v as (select x.anchor_id y, z.anchor_id z from near join u x on x.first = near.a join u z on z.first = near.b union all select x.anchor_id, z.anchor_id from u x join u z using (first))
select distinct least(y, z) anchor_id_a, greatest(y, z) anchor_id_b from v where y <> z"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of anchors whose texts are nearly the same."""
    return _near(spark, d).select(F.col("id_a").alias("anchor_id_a"), F.col("id_b").alias("anchor_id_b"))


@query(f"with {_SETS} select distinct anchor_id, first class_id, n_copies from a join k using (x)")
def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each anchor with the class of equal texts it is in: class_id is the class's first anchor. With p4_class_pairs it holds every link, whatever the number of copies."""
    m = neardup.members(load(spark, d, "library_anchor"), "anchor_id", "exact_text", least_words=25)
    return m.select(F.col("id").alias("anchor_id"), "class_id", "n_copies")


@query(f"with {_SETS} select a class_a, b class_b, round(similarity, 6) similarity from near")
def p4_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal texts that are nearly the same, each by its first anchor, with their similarity."""
    base = neardup.based(load(spark, d, "library_anchor"), "anchor_id", "exact_text", 25)
    return neardup.class_pairs(base, 0.6, 3, 25).select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


# ---- 5: names ----


def _names(spark: SparkSession, d: str) -> DataFrame:
    authors = load(spark, d, "openalex_search", ("response_id", "search.results.authorships.author.display_name"))
    return names.openalex_names(distinct_responses(authors)).unionByName(names.epmc_names(distinct_responses(load(spark, d, "europe_pmc_search"))))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings that mean the same person or organisation."""
    return names.link(_names(spark, d))


@query()
def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its class, those of one reading, and the number of classes that this one is linked to."""
    return names.classes(_names(spark, d))


# ---- 7: encoding ----


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_column(load(spark, d, "documents"), "doc_id", "text")


@query()
def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and characters by language, for the size of the corpus in tokens."""
    docs = load(spark, d, "documents").select(F.struct("lang", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).alias("doc"), "text")
    counts = bpe.count_column(docs, "doc", "text").select("doc.*", "tokens")
    return counts.groupBy("lang").agg(
        F.count("*").alias("n_documents"), F.sum("tokens").alias("n_tokens"), F.sum("chars").alias("n_chars"), F.count_if(F.col("tokens") == 0).alias("n_empty"), F.max("tokens").alias("most_tokens")
    )


# ---- 8: packing ----


def _packings(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each single capacity (packing: its name), and of all capacities jointly (packing: joint)."""
    docs, sizes = load(spark, d, "documents"), load(spark, d, "container_size")
    permitted: dict[str, dict[str, int]] = {}  # container_size has three rows at any scale
    for r in sizes.filter("capacity_tokens > 0 and container_name is not null").orderBy("capacity_tokens", "container_name").toLocalIterator():
        permitted.setdefault(r["tokenizer_name"], {})[r["container_name"]] = r["capacity_tokens"]
    out = None
    for tokenizer, capacities in permitted.items():
        items = Scratch(spark, "tokens").table(bpe.count_column(docs, "doc_id", "text", tokenizer))
        for packing_, chosen in [*((n, {n: c}) for n, c in capacities.items()), ("joint", capacities)]:
            part = packing.pack(items, "doc_id", chosen).select(F.lit(tokenizer).alias("tokenizer_name"), F.lit(packing_).alias("packing"), "*")
            out = part if out is None else out.unionByName(part)
    if out is None:
        items = docs.select("doc_id", F.lit(0).alias("tokens"))
        out = packing.pack(items, "doc_id", {}).select(F.lit(None).cast("string").alias("tokenizer_name"), F.lit("joint").alias("packing"), "*")
    return out


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of each document or piece, for each capacity alone and for all jointly."""
    return _packings(spark, d)


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of each packing and container size."""
    per = _packings(spark, d).filter("container_id is not null").groupBy("tokenizer_name", "packing", "container_name", "container_id").agg(F.sum("tokens").alias("t"))
    sizes = load(spark, d, "container_size").select("container_name", "tokenizer_name", "capacity_tokens").distinct()
    return (
        per.groupBy("tokenizer_name", "packing", "container_name")
        .agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
        .join(F.broadcast(sizes), ["tokenizer_name", "container_name"])
        .withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
    )


# ---- 9: quality ----


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return quality.statistics(docs, quality.fit(docs, load(spark, d, "doc_label")))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk by more than half of their non-blank characters."""
    return _statistics(spark, d).filter("prose_share < 0.5").select("doc_id")


@query()
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and label shares of every document."""
    return _statistics(spark, d)
