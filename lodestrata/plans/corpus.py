"""The searchable records and relations of the engine, built from its input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import identifiers as I
from lodestrata.functions.ids import content_id_column
from lodestrata.operators import citations, dedup, shredding
from lodestrata.plans import documents
from lodestrata.session import load, norm_id
from lodestrata.sources import connectors


def sources(spark: SparkSession, d: str) -> DataFrame:
    """One row per source: of repeated or conflicting rows the first by (no license last, URI, connector, arrival)."""
    rows = load(spark, d, "library_source").withColumn("source_version_id", norm_id("source_version_id")).filter("source_version_id is not null")
    return dedup.pick(rows, ["source_version_id"], [F.col("license").isNull(), F.coalesce("source_uri", F.lit("")), F.coalesce("connector_id", F.lit("")), "acquired_at", "ingested_at"])


def threats(spark: SparkSession, d: str) -> DataFrame:
    """One row per observation, the earliest."""
    rows = load(spark, d, "threat_observation").withColumn("id", norm_id("id")).withColumn("source_version", norm_id("source_version")).filter("id is not null")
    return dedup.pick(rows, ["id"], ["detected_at", "ingested_at"])


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """One row per concept, the earliest to arrive."""
    rows = load(spark, d, "concept").withColumn("id", norm_id("id")).filter("id is not null")
    return dedup.pick(rows, ["id"], ["ingested_at", "recorded_at"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct concept_id, parent_id."""
    return load(spark, d, "concept_parent").select(norm_id("concept_id").alias("concept_id"), norm_id("parent_id").alias("parent_id")).filter("concept_id is not null and parent_id is not null").distinct()


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """One row per anchor, the earliest to arrive, without its threats."""
    rows = load(spark, d, "library_anchor").select(
        norm_id("anchor_id").alias("anchor_id"), norm_id("source_version_id").alias("source_version_id"), norm_id("derived_source_version_id").alias("derived_source_version_id"), "source_uri", "repository", "title", "anchor_kind", "anchor_start", "anchor_end", "page_number", "exact_text", "ingested_at"
    )
    return dedup.pick(rows.filter("anchor_id is not null"), ["anchor_id"], ["ingested_at", "source_uri", "anchor_start"])


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Discovery hits of both search tables."""
    oa = connectors.openalex_hits(shredding.openalex_table(shredding.distinct_responses(load(spark, d, "openalex_search", shredding.table_paths("works"))), "works"))
    ep = connectors.europe_pmc_hits(shredding.epmc_works(shredding.distinct_responses(load(spark, d, "europe_pmc_search"))))
    return oa.unionByName(ep)


def research_identifiers(hit: DataFrame) -> DataFrame:
    """kind, value, locator, id of the distinct identifiers that hits know."""
    return identified(hit.select(F.explode("known_ids").alias("k")).select(F.substring_index("k", ":", 1).alias("kind"), F.expr("substring(k, instr(k, ':') + 1)").alias("value")))


def identified(pairs: DataFrame) -> DataFrame:
    """kind, value, locator, id of the distinct identifiers (kind, value)."""
    return pairs.distinct().select("kind", "value", I.locator(F.col("kind"), F.col("value")).alias("locator"), content_id_column("identifier", kind=F.col("kind"), value=F.col("value")).alias("id"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and addresses that anchors mention, with relation and signal; id names anchor and place."""
    a = anchors(spark, d)
    refs = citations.extract(citations.under_references(a), "anchor_id", "exact_text", "under_references")
    return refs.withColumn("id", F.concat_ws("|", "anchor_id", "start", "kind", "value"))


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    """One open-access resolution per DOI of an OpenAlex work: the least (title, status, license) of the works that have it."""
    w = shredding.openalex_table(shredding.distinct_responses(load(spark, d, "openalex_search", shredding.table_paths("works"))), "works").withColumn("doi", I.doi("doi")).filter("doi is not null")
    one = F.struct(F.coalesce("display_name", F.lit("")).alias("title"), F.coalesce("open_access_oa_status", F.lit("")).alias("oa_status"), F.coalesce("primary_location_license", F.lit("")).alias("license"))
    best = w.select("doi", one.alias("r")).groupBy("doi").agg(F.min("r").alias("r"))
    return best.select(F.concat(F.lit("resolution:"), "doi").alias("id"), "doi", "r.title", "r.oa_status", F.lit(None).cast("string").alias("genre"), F.array("r.license").alias("locations"))


def controversy_claims(spark: SparkSession, d: str) -> DataFrame:
    """controversy_id, claim_id: the urgent claims of a customer and year are one controversy."""
    urgent = claims(spark, d).filter("object = '1-URGENT'")
    return urgent.select(F.concat_ws(":", F.lit("controversy"), "subject", "qualifiers").alias("controversy_id"), F.col("id").alias("claim_id"), "subject", "qualifiers")


def controversies(spark: SparkSession, d: str) -> DataFrame:
    """Controversies of customers: id, topic_concept_id, question, description, status (open while a claim of it is denied), review_state."""
    held = controversy_claims(spark, d).join(claims(spark, d).select(F.col("id").alias("claim_id"), "stance"), "claim_id")
    per = held.groupBy(F.col("controversy_id").alias("id"), F.col("subject").alias("topic_concept_id"), "qualifiers").agg(F.max(F.col("stance") == "denies").alias("denied"))
    return per.select(
        "id", "topic_concept_id", F.concat(F.lit("Was every order of "), "qualifiers", F.lit(" urgent for "), "topic_concept_id", F.lit("?")).alias("question"), F.lit("urgent priority").alias("description"),
        F.when(F.col("denied"), "open").otherwise("resolved").alias("status"), F.lit("accepted").alias("review_state"),
    )


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """An order as a gap of its customer: open until it is filled, its deadline a year after its date; its priority is the gap's."""
    o = load(spark, d, "orders")
    return o.select(
        F.concat(F.lit("gap:"), "o_orderkey").alias("id"), F.concat(F.lit("customer:"), "o_custkey").alias("topic_concept_id"), F.concat(F.lit("When was order "), "o_orderkey", F.lit(" filled?")).alias("question"),
        F.lit("missing-evidence").alias("kind"), F.col("o_orderpriority").alias("rationale"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), F.lit("accepted").alias("review_state"), (F.col("o_orderdate") + F.expr("interval 1 year")).alias("freshness_deadline"),
    )


def gap_claims(spark: SparkSession, d: str) -> DataFrame:
    """gap_id, claim_id: line items of 45 and more settle the gap of their order."""
    e = evidence(spark, d).filter("l_quantity >= 45")
    return e.select(F.regexp_replace("claim_id", "^claim:", "gap:").alias("gap_id"), "claim_id").distinct()


def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of each source, from its own row."""
    s = sources(spark, d)
    none = F.lit(None).cast("array<string>")
    return s.select(
        F.concat(F.lit("metadata:"), "source_version_id").alias("id"), "source_version_id", F.coalesce("repository", "source_uri").alias("title"), none.alias("authors"), F.col("connector_id").alias("publisher"),
        F.col("source_uri").alias("original_locator"), "license", none.alias("usage_conditions"), F.col("media_type").alias("provenance_note"),
    )


def associations(spark: SparkSession, d: str) -> DataFrame:
    """topic_concept_id, source_version_id, roles, recorded_at: a source is associated with the topics whose digest begins as its own does."""
    key = lambda x: F.substring(F.md5(x), 1, 2)
    s = sources(spark, d).select("source_version_id", "connector_id", F.col("ingested_at").alias("recorded_at"), key("source_version_id").alias("k"))
    t = concepts(spark, d).select(F.col("id").alias("topic_concept_id"), key("id").alias("k"))
    return s.join(t, "k").select("topic_concept_id", "source_version_id", F.to_json(F.array_compact(F.array("connector_id"))).alias("roles"), "recorded_at")


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """A supplier as a proposal: its nation as concept, its balance as claim."""
    s = load(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("proposal:"), "s_suppkey").alias("id"), F.lit("recorded").alias("provider"), F.concat(F.lit("model-"), "s_nationkey").alias("model"), F.concat(F.lit("nation "), "s_nationkey").alias("concepts"),
        F.col("s_name").alias("claims"), F.lit("").alias("controversies"), F.lit("").alias("gaps"), F.when(F.col("s_acctbal") < 0, "rejected").otherwise("proposed").alias("review_state"), F.lit("validator 1").alias("validator_version"),
    )


def relations(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations of every record type that can be searched, from the input tables."""
    c, none = F.col, F.lit(None).cast("string")
    a, h = anchors(spark, d), hits(spark, d)
    refs = references(spark, d).join(a.select("anchor_id", c("exact_text").alias("exact")), "anchor_id")
    return {
        "concept": concepts(spark, d),
        "claim": claims(spark, d).withColumn("asserted_by", F.lit("clerk")).withColumn("epistemic_status", F.lit("reported")),
        "evidence": evidence(spark, d).withColumn("exact", c("l_returnflag")),
        "controversy": controversies(spark, d), "gap": gaps(spark, d), "source": sources(spark, d).withColumn("id", c("source_version_id")), "source_metadata": source_metadata(spark, d), "threat": threats(spark, d),
        "discovery": h.select(hit_id().alias("id"), "title", F.array(none).alias("authors"), none.alias("publisher"), "locator", none.alias("snippet"), F.concat_ws(" ", "language", F.array_join("known_ids", " ")).alias("metadata")),
        "resolution": resolutions(spark, d), "document": load(spark, d, "documents").select(c("doc_id").alias("id"), "title", c("source").alias("source_id"), "text"),
        "anchor": a.select(c("anchor_id").alias("id"), c("anchor_kind").alias("kind"), c("title").alias("label"), c("anchor_start").alias("ordinal"), c("exact_text").alias("exact")),
        "identifier": research_identifiers(h), "reference": refs, "proposal": proposals(spark, d),
    }


def hit_id() -> Column:
    """The id of a hit."""
    return F.concat_ws("|", "connector_id", "upstream_id", "response_id", "rank")


def search_corpus(spark: SparkSession, d: str) -> DataFrame:
    """record_type, record_id, title, body of all record types that can be searched."""
    return documents.corpus(relations(spark, d))


# ---- claims and evidence of the star-schema tables, so that operators on claims have rows at any scale ----


def claims(spark: SparkSession, d: str) -> DataFrame:
    """An order as a claim of its customer: predicate order_priority, stance by status, valid for 90 days from its date."""
    o = load(spark, d, "orders")
    return o.select(
        F.concat(F.lit("claim:"), "o_orderkey").alias("id"), F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.lit("order_priority").alias("predicate"), F.col("o_orderpriority").alias("object"),
        F.date_format("o_orderdate", "yyyy").alias("qualifiers"), F.when(F.col("o_orderstatus") == "F", "asserts").when(F.col("o_orderstatus") == "O", "denies").otherwise("questions").alias("stance"),
        F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("accepted").alias("review_state"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_until"), F.col("o_orderkey").alias("key"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """A line item as evidence of its order's claim, from its supplier."""
    l = load(spark, d, "lineitem")
    return l.select(F.concat_ws(":", F.lit("evidence"), "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("claim:"), "l_orderkey").alias("claim_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("source_id"), "l_returnflag", "l_quantity")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """concept_id, parent_id, label: regions above nations above customers."""
    r, n, k = load(spark, d, "region"), load(spark, d, "nation"), load(spark, d, "customer")
    none = F.lit(None).cast("string")
    return (
        r.select(F.concat(F.lit("region:"), "r_regionkey").alias("concept_id"), none.alias("parent_id"), F.col("r_name").alias("label"))
        .unionByName(n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("concept_id"), F.concat(F.lit("region:"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label")))
        .unionByName(k.select(F.concat(F.lit("customer:"), "c_custkey").alias("concept_id"), F.concat(F.lit("nation:"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("label")))
    )
