"""Joins over chains of derivation: from originals to derived texts, their structure, proposals and runs; lookups that must be unique.

Tables: text_derivation (id, original_source_version_id, derived_source_version_id), structural_derivation (id, text_derivation_id),
anchors with structural_derivation_id. Null keys join nothing; repeated rows count once where a result is a set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def original_of(rows: DataFrame, derivation: DataFrame, derived: str = "source_version_id") -> DataFrame:
    """rows whose column `derived` names a derived source, with original_source_version_id; others are left out."""
    pairs = derivation.select(c("derived_source_version_id").alias(derived), "original_source_version_id").distinct()
    return rows.join(pairs, derived)


def anchors_of(anchor: DataFrame, structural: DataFrame, derivation: DataFrame, originals: DataFrame) -> DataFrame:
    """Anchors of the derivations of the chosen originals (column source_version_id), with original and derived source."""
    chosen = derivation.join(originals.select(c("source_version_id").alias("original_source_version_id")).distinct(), "original_source_version_id", "left_semi")
    path = structural.select(c("id").alias("structural_derivation_id"), "text_derivation_id").join(
        chosen.select(c("id").alias("text_derivation_id"), "original_source_version_id", "derived_source_version_id"), "text_derivation_id"
    )
    return anchor.join(path, "structural_derivation_id")


def scoped(snapshot: DataFrame, derivation: DataFrame, library: DataFrame) -> DataFrame:
    """Repository snapshots (source_version_id) whose source is derived from one of the library's originals (source_version_id)."""
    own = derivation.join(library.select(c("source_version_id").alias("original_source_version_id")), "original_source_version_id", "left_semi")
    return snapshot.join(own.select(c("derived_source_version_id").alias("source_version_id")).distinct(), "source_version_id", "left_semi")


def compatible(proposal: DataFrame, request: DataFrame, snapshot: DataFrame, holds: Column) -> DataFrame:
    """The latest proposal (id, extraction_request_id, source_version_id, recorded_at) per source that has its request (id and more, prefixed
    request_) and an acquired snapshot (source_version_id, repository) and for which `holds`."""
    asked = request.select(*(c(x).alias(f"request_{x}") for x in request.columns))
    both = proposal.join(asked, c("extraction_request_id") == c("request_id")).join(snapshot.select("source_version_id", "repository").distinct(), "source_version_id")
    columns = [x for x in both.columns if x != "source_version_id"]
    best = both.filter(holds).groupBy("source_version_id").agg(F.max_by(F.struct(*columns), F.struct("recorded_at", "id")).alias("p"))
    return best.select("source_version_id", "p.*")


def validation_failures(failure: DataFrame, request: DataFrame, version: str, quarantine_at: int = 2) -> DataFrame:
    """source_version_id, n_failures, quarantined: failures (extraction_request_id, stage) in validating outputs, of requests (id, source_version_id, validator_version) of this version."""
    now = request.filter(c("validator_version") == version).select(c("id").alias("extraction_request_id"), "source_version_id")
    per = failure.filter("stage = 'output_validation'").join(now, "extraction_request_id").groupBy("source_version_id").agg(F.count("*").alias("n_failures"))
    return per.withColumn("quarantined", c("n_failures") >= quarantine_at)


def recorded_through(rows: DataFrame, time: str = "detected_at") -> DataFrame:
    """recorded_through: one row, the latest time; null without rows."""
    return rows.agg(F.max(time).alias("recorded_through"))


def unique(df: DataFrame, column: str, value) -> DataFrame:
    """The one row of a value. Raises ValueError if there is none or more than one."""
    found = df.filter(c(column) == value)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{column} {value!r} is {'unknown' if not n else 'ambiguous'}")
    return found


def in_record_order(df: DataFrame, key: str = "id") -> DataFrame:
    """df in order of key, then of the canonical JSON of the row: the same order however rows were delivered."""
    return df.orderBy(F.asc_nulls_first(key), F.to_json(F.struct(*sorted(df.columns))))


def in_finding_order(findings: DataFrame) -> DataFrame:
    """Audit findings by severity as text, rule and record."""
    return findings.orderBy("severity", "rule", "record_id")


def rederived(derivation: DataFrame, ids: list[str], key: str, text: str, derive: Callable[[DataFrame, str, str], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """derive(rows, key, text) over the named derivations only, without the rows whose key is known already: running it again adds nothing.

    Raises ValueError unless each id is there exactly once.
    """
    own = derivation.filter(c(key).isin(*ids))
    counts = {r[key]: r["count"] for r in own.groupBy(key).count().toLocalIterator()}  # as few as were asked for
    if bad := sorted(i for i in set(ids) if counts.get(i) != 1):
        raise ValueError(f"unknown or ambiguous derivations: {bad}")
    rows = own if known is None else own.join(known.select(key).distinct(), key, "left_anti")
    return derive(rows, key, text)
