"""Topic, identifier and library views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import closure
from lodestrata.session import Scratch


def valid_at(as_of, start: str = "valid_from", stop: str = "valid_until") -> Column:
    """Whether a row is valid at a moment; both ends count, null is open."""
    return (F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(stop).isNull() | (F.col(stop) >= as_of))


def topic_members(edges: DataFrame, root: str) -> DataFrame:
    """node, distance of a concept and all below it; raises ValueError for an unknown concept."""
    known = edges.select(F.col("concept_id").alias("node")).union(edges.select("parent_id")).filter(F.col("node") == root)
    if known.isEmpty():
        raise ValueError(f"unknown concept {root}")
    return closure.descendants(edges, known.select("node").distinct(), "concept_id", "parent_id")


def topic_claims(members: DataFrame, claims: DataFrame, evidence: DataFrame, as_of=None) -> DataFrame:
    """Accepted claims about members with their evidence, one row per claim and evidence, valid at as_of if given. Claims without evidence do not appear."""
    own = claims.filter("review_state = 'accepted'").join(members.select(F.col("node").alias("subject")), "subject", "left_semi")
    if as_of is not None:
        own = own.filter(valid_at(as_of))
    return own.join(evidence.select(F.col("claim_id").alias("id"), F.col("id").alias("evidence_id"), "source_id"), "id")


def topic_concepts(members: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts of a topic, whatever their review state, with synonyms and broader concepts as sorted JSON lists."""
    broader = edges.groupBy(F.col("concept_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set("parent_id"))).alias("broader"))
    own = concepts.join(members.select(F.col("node").alias("id")), "id", "left_semi").join(broader, "id", "left")
    empty = F.lit("[]")
    return own.select("id", "label", F.coalesce("broader", empty).alias("broader"), F.coalesce(F.to_json(F.array_sort(F.array_distinct(F.array_compact("synonyms")))), empty).alias("synonyms"))


def library_select(sources: DataFrame, ids: list[str] = (), uri_prefixes: list[str] = (), connectors: list[str] = (), repositories: list[str] = (), everything: bool = False) -> DataFrame:
    """The sources that any selector takes. Prefixes and repositories regardless of case. Raises ValueError for unknown ids or repositories."""
    some = F.lit(bool(everything))
    if ids:
        some = some | F.col("source_version_id").isin(*ids)
    for p in uri_prefixes:
        some = some | F.lower("source_uri").startswith(p.lower())
    if connectors:
        some = some | F.col("connector_id").isin(*connectors)
    if repositories:
        some = some | F.lower("repository").isin(*(r.lower() for r in repositories))
    out = sources.filter(F.coalesce(some, F.lit(False)))
    for wanted, column in ((list(ids), F.col("source_version_id")), ([r.lower() for r in repositories], F.lower("repository"))):
        if wanted:
            there = {r[0] for r in out.select(column).filter(column.isin(*wanted)).distinct().toLocalIterator()}  # as few as were asked for
            if unknown := sorted(set(wanted) - there):
                raise ValueError(f"unknown: {unknown}")
    return out


SEARCHABLE = ("heading", "paragraph", "list_item", "footnote", "caption")


def library_anchors(anchors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Searchable anchors of the chosen sources."""
    return anchors.filter(F.col("anchor_kind").isin(*SEARCHABLE)).join(chosen.select("source_version_id"), "source_version_id", "left_semi")


def describe(chosen: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sources, anchors and characters of a library, by connector."""
    per = anchors.groupBy("source_version_id").agg(F.count("*").alias("a"), F.sum(F.length("exact_text")).alias("c"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return chosen.join(per, "source_version_id", "left").groupBy("connector_id").agg(F.count("*").alias("n_sources"), zero("a").alias("n_anchors"), zero("c").alias("n_chars"))


def listing(anchors: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first anchors in order with total and truncated."""
    total = anchors.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    top = anchors.orderBy(*order).limit(limit).withColumn("_one", F.lit(1))
    return top.join(F.broadcast(total), "_one").drop("_one").withColumn("truncated", F.col("total") > limit)  # one row of total


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with position, the place of every row in a total order from 1; ranges of the order are numbered apart and then moved by what stands before them."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once, as a range drawn again could be another
    ranged = Scratch(df.sparkSession, "positions").table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    moved = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # as few as the ranges
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(moved), "_part").withColumn("position", (F.col("_before") + own).cast("int")).drop("_part", "_before")


def _object(predicate: str):
    from lodestrata.functions.text import turtle_literal

    return lambda v: F.struct(F.lit(predicate).alias("p"), turtle_literal(v.cast("string")).alias("o"))


def triples(df: DataFrame, subject: str, kind: str, fields: dict[str, str]) -> DataFrame:
    """s, p, o of each row: its type and one triple for each non-null field, or element of an array field; distinct."""
    types = dict(df.dtypes)
    parts = [F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit(f"lode:{kind}").alias("o")))]
    for field, predicate in fields.items():
        values = F.col(field) if types[field].startswith("array") else F.array(F.col(field))
        values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
        parts.append(F.transform(values, _object(predicate)))
    return df.select(F.concat(F.lit("<"), F.col(subject), F.lit(">")).alias("s"), F.explode(F.flatten(F.array(*parts))).alias("t")).select("s", "t.p", "t.o").distinct()
