"""Topic and identifier views in full: the parts of an answer, each one declarative join, in the order they are read.

Members of a topic (column node) are few against the tables they select from, but their number is the data's: every join is
left to the optimizer, which broadcasts them while they are small and merges sorted streams beyond. Orders are global
sorts, which Spark runs by ranges. Null keys join nothing; a missing list is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def listed(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out: the distinct non-null values of each key as a sorted JSON list."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(value))).alias(out))


def joined_ids(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out: the distinct non-null values of each key in order, joined by commas."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out))


def _about(df: DataFrame, members: DataFrame, topic: str = "topic_concept_id") -> DataFrame:
    return df.join(members.select(c("node").alias(topic)), topic, "left_semi")


def sources(members: DataFrame, associations: DataFrame, source: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each source associated with a member, with roles and time of the association and the metadata it may have, by URI and id; a source of two associations appears with both."""
    own = _about(associations, members).select("source_version_id", "roles", c("recorded_at").alias("associated_at")).distinct()
    meta = metadata.select("source_version_id", c("id").alias("metadata_id"), "title", "publisher", "original_locator", "provenance_note")
    out = own.join(source.select("source_version_id", "source_uri", "connector_id", "license"), "source_version_id").join(meta, "source_version_id", "left")
    return out.distinct().orderBy(F.asc_nulls_first("source_uri"), "source_version_id", "roles", "associated_at")


def threats(members: DataFrame, associations: DataFrame, source: DataFrame, threat: DataFrame) -> DataFrame:
    """Observations on the sources of a topic, the highest severity (as text) first, then by id."""
    own = _about(associations, members).select("source_version_id").distinct()
    known = source.select("source_version_id", "source_uri").join(own, "source_version_id", "left_semi")
    seen = threat.select("id", c("source_version").alias("source_version_id"), "threat_type", "status", "severity", "detected_at")
    return seen.join(known, "source_version_id").orderBy(F.desc_nulls_last("severity"), "id")


def claims(members: DataFrame, claim: DataFrame, evidence: DataFrame, as_of=None) -> DataFrame:
    """views.topic_claims in order of subject, predicate, claim and evidence."""
    from lodestrata.plans.views import topic_claims

    return topic_claims(members, claim, evidence, as_of).orderBy("subject", "predicate", "id", "evidence_id")


def controversies(members: DataFrame, controversy: DataFrame, controversy_claim: DataFrame) -> DataFrame:
    """Accepted controversies of a topic with their claims as a sorted JSON list, by status and question."""
    held = listed(controversy_claim, "controversy_id", "claim_id", "claim_ids").withColumnRenamed("controversy_id", "id")
    own = _about(controversy.filter("review_state = 'accepted'"), members).join(held, "id", "left")
    return own.withColumn("claim_ids", F.coalesce("claim_ids", F.lit("[]"))).orderBy("status", "question", "id")


def gaps(members: DataFrame, gap: DataFrame, gap_claim: DataFrame) -> DataFrame:
    """Accepted gaps of a topic with their claims as a sorted JSON list: open ones first, then by falling priority and question."""
    held = listed(gap_claim, "gap_id", "claim_id", "related_claim_ids").withColumnRenamed("gap_id", "id")
    own = _about(gap.filter("review_state = 'accepted'"), members).join(held, "id", "left")
    return own.withColumn("related_claim_ids", F.coalesce("related_claim_ids", F.lit("[]"))).orderBy((c("status") != "open").cast("int"), F.desc("priority"), "question", "id")


def provenance(reference: DataFrame, anchor: DataFrame, source: DataFrame) -> DataFrame:
    """References (id, anchor_id and more) with the anchor they stand in and the source it is from, original and derived; references whose anchor or source is unknown have none and are left out."""
    place = anchor.select("anchor_id", "source_version_id", "derived_source_version_id", "anchor_kind", "page_number")
    return reference.join(place, "anchor_id").join(source.select("source_version_id", "source_uri"), "source_version_id")


def references(members: DataFrame, associations: DataFrame, traced: DataFrame, identifier: DataFrame, hit_links: DataFrame, resolution_links: DataFrame) -> DataFrame:
    """References in the sources of a topic (traced: provenance()), with their identifier, and the hits and resolutions of it as ids joined by commas; by kind, value and id."""
    own = _about(associations, members).select("source_version_id").distinct()
    named = identifier.select("kind", "value", "locator", c("id").alias("identifier_id"))
    hits = joined_ids(hit_links, "identifier_id", "hit_id", "resolved_discovery_hit_ids")
    found = joined_ids(resolution_links, "identifier_id", "resolution_id", "resolved_open_access_resolution_ids")
    out = traced.drop("locator").join(own, "source_version_id", "left_semi").join(named, ["kind", "value"])
    out = out.join(hits, "identifier_id", "left").join(found, "identifier_id", "left")
    empty = lambda x: F.coalesce(c(x), F.lit(""))
    out = out.withColumn("resolved_discovery_hit_ids", empty("resolved_discovery_hit_ids")).withColumn("resolved_open_access_resolution_ids", empty("resolved_open_access_resolution_ids"))
    return out.orderBy("kind", "value", "id")


def resolution_links(identifier: DataFrame, resolution: DataFrame) -> DataFrame:
    """identifier_id, resolution_id, match_rule: a resolution is of the identifier whose DOI it has."""
    own = identifier.filter("kind = 'doi'").select(c("id").alias("identifier_id"), c("value").alias("doi"))
    return own.join(resolution.select("doi", c("id").alias("resolution_id")), "doi").select("identifier_id", "resolution_id", F.lit("doi").alias("match_rule"))


def identifier_view(kind: str, value: str, identifier: DataFrame, traced: DataFrame, threat: DataFrame, hit_links: DataFrame, resolution_links_: DataFrame) -> DataFrame:
    """What names an identifier: part (reference, hit, resolution), record_id, detail (relation or rule of the match), source_uri and threat_ids
    of a reference (those of its original and its derived source), place in order. Raises ValueError for an identifier that is not there."""
    own = identifier.filter((c("kind") == kind) & (c("value") == value))
    if own.isEmpty():
        raise ValueError(f"unknown identifier {kind}:{value}")
    refs = traced.filter((c("kind") == kind) & (c("value") == value))
    both = source_threats(refs.select("id", "source_version_id", "derived_source_version_id"), threat)
    refs = refs.join(both, "id", "left")
    none = F.lit(None).cast("string")
    ids = own.select(c("id").alias("identifier_id"))
    part = lambda df, name, rid, detail, uri=none, threats_=F.lit(""): df.select(F.lit(name).alias("part"), rid.alias("record_id"), detail.alias("detail"), uri.alias("source_uri"), threats_.alias("threat_ids"))
    out = part(refs, "reference", c("id"), c("relation"), c("source_uri"), F.coalesce("threat_ids", F.lit("")))
    out = out.unionByName(part(hit_links.join(ids, "identifier_id", "left_semi"), "hit", c("hit_id"), c("match_rule")))
    return out.unionByName(part(resolution_links_.join(ids, "identifier_id", "left_semi"), "resolution", c("resolution_id"), c("match_rule"))).distinct().orderBy("part", F.asc_nulls_first("source_uri"), "record_id")


def source_threats(rows: DataFrame, threat: DataFrame) -> DataFrame:
    """id, threat_ids (in order, joined by commas) of rows (id, source_version_id, derived_source_version_id): observations on either source."""
    at = rows.select("id", F.explode(F.array_distinct(F.array_compact(F.array("source_version_id", "derived_source_version_id")))).alias("source_version"))
    return joined_ids(at.join(threat.select("source_version", c("id").alias("threat_id")), "source_version"), "id", "threat_id", "threat_ids")


def ranked_repositories(source: DataFrame) -> DataFrame:
    """Repositories with their sources, the latest of them and the number of distinct URIs; most sources first, then the latest, then by name."""
    r = source.filter("repository is not null").groupBy(F.lower("repository").alias("repository"))
    out = r.agg(F.count("*").alias("n_sources"), F.count_distinct("source_uri").alias("n_uris"), F.max("acquired_at").alias("latest"))
    return out.orderBy(F.desc("n_sources"), F.desc_nulls_last("latest"), "repository")


def tainted_sources(threat: DataFrame, anchor: DataFrame, active: tuple[str, ...] = ("suspected", "confirmed")) -> DataFrame:
    """source_version_id, n_threats, worst (greatest severity as text): every source that an active observation names, and every source of which a named one is derived."""
    bad = threat.filter(c("status").isin(*active) & c("source_version").isNotNull()).groupBy(c("source_version").alias("s")).agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    pairs = anchor.filter("derived_source_version_id is not null and source_version_id is not null").select(c("derived_source_version_id").alias("s"), c("source_version_id").alias("original")).distinct()
    derived = bad.join(pairs, "s").select(c("original").alias("s"), "n", "worst")
    return bad.unionByName(derived).groupBy(c("s").alias("source_version_id")).agg(F.sum("n").alias("n_threats"), F.max("worst").alias("worst"))


