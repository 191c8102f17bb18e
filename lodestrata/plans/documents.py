"""Search documents of the engine's record types: what of each record is its title and what its body.

Every function of `DOCUMENTS` takes its relation with the columns named in it; more columns are ignored. Null fields are
left out, so no record is lost by one. Concepts, claims, controversies and gaps are searchable once they are accepted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _join(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *parts)


def _document(df: DataFrame, kind: str, title: Column, body: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("record_type"), c("id").cast("string").alias("record_id"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(body, F.lit("")).alias("body"))


def _accepted(df: DataFrame) -> DataFrame:
    return df.filter("review_state = 'accepted'")


def concept(df: DataFrame) -> DataFrame:
    """id, label, description, synonyms, review_state."""
    return _document(_accepted(df), "concept", c("label"), _join("description", F.array_join("synonyms", " ")))


def claim(df: DataFrame) -> DataFrame:
    """id, subject, predicate, object, asserted_by, stance, epistemic_status, qualifiers, review_state."""
    return _document(_accepted(df), "claim", _join("subject", "predicate"), _join("object", "asserted_by", "stance", "epistemic_status", "qualifiers"))


def evidence(df: DataFrame) -> DataFrame:
    """id, source_id, exact."""
    return _document(df, "evidence", _join(F.lit("Evidence from"), "source_id"), c("exact"))


def controversy(df: DataFrame) -> DataFrame:
    """id, question, description, review_state."""
    return _document(_accepted(df), "controversy", c("question"), c("description"))


def gap(df: DataFrame) -> DataFrame:
    """id, question, kind, rationale, review_state."""
    return _document(_accepted(df), "gap", c("question"), _join("kind", "rationale"))


def source(df: DataFrame) -> DataFrame:
    """id, source_uri, connector_id, media_type, license."""
    return _document(df, "source", c("source_uri"), _join("connector_id", "media_type", "license"))


def source_metadata(df: DataFrame) -> DataFrame:
    """id, title, authors, publisher, original_locator, license, usage_conditions, provenance_note; a missing license is an unknown one."""
    license_ = F.coalesce(c("license"), F.lit("unknown license"))
    return _document(df, "source_metadata", c("title"), _join(F.array_join("authors", " "), "publisher", "original_locator", license_, F.array_join("usage_conditions", " "), "provenance_note"))


def threat(df: DataFrame) -> DataFrame:
    """id, threat_type, status, severity, detector_id."""
    return _document(df, "threat", c("threat_type"), _join("status", "severity", "detector_id"))


def discovery(df: DataFrame) -> DataFrame:
    """id, title, authors, publisher, locator, snippet, metadata."""
    return _document(df, "discovery", c("title"), _join(F.array_join("authors", " "), "publisher", "locator", "snippet", "metadata"))


def resolution(df: DataFrame) -> DataFrame:
    """id, title, doi, oa_status, genre, locations (array of texts)."""
    return _document(df, "resolution", c("title"), _join("doi", "oa_status", "genre", F.array_join("locations", " ")))


def document(df: DataFrame) -> DataFrame:
    """id, title, source_id, text; a document without a title is named after its source."""
    return _document(df, "document", F.coalesce(c("title"), _join(F.lit("Untrusted derived text from"), "source_id")), c("text"))


def anchor(df: DataFrame) -> DataFrame:
    """id, kind, label, ordinal, exact. Documents and pages are no records; of a section the label alone is."""
    own = df.filter(~c("kind").isin("document", "page"))
    title = F.coalesce(c("label"), _join("kind", c("ordinal").cast("string")))
    return _document(own, "anchor", title, F.when(c("kind") == "section", c("label")).otherwise(c("exact")))


def identifier(df: DataFrame) -> DataFrame:
    """id, kind, value, locator."""
    return _document(df, "identifier", _join("kind", "value"), c("locator"))


def reference(df: DataFrame) -> DataFrame:
    """id, relation, kind, value, locator, signal, exact (the text of the anchor it stands in)."""
    return _document(df, "reference", _join("relation", "kind", "value"), _join("locator", "signal", "exact"))


def proposal(df: DataFrame) -> DataFrame:
    """id, provider, model, concepts, claims, controversies, gaps (JSON texts), review_state, validator_version."""
    title = F.concat(F.lit("Proposed ontology extraction by "), c("provider"), F.lit(":"), c("model"))
    return _document(df, "proposal", title, _join("concepts", "claims", "controversies", "gaps", "review_state", "validator_version"))


#: The record types that can be searched.
DOCUMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (concept, claim, evidence, controversy, gap, source, threat, discovery, resolution, document, anchor, identifier, reference, source_metadata, proposal)
}


def corpus(relations: dict[str, DataFrame]) -> DataFrame:
    """record_type, record_id, title, body of all records of the relations, by name of record type. Raises ValueError for another name."""
    if unknown := sorted(set(relations) - set(DOCUMENTS)):
        raise ValueError(f"no such record type: {unknown}")
    parts = [DOCUMENTS[name](df) for name, df in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
