"""Measures and comparison of extraction proposals; slices of a proposal's hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("n_concepts", "n_claims", "n_predicates", "n_broader", "n_evidence", "n_gaps")


def measure(concepts: DataFrame, claims: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per proposal: counts, distinct predicates, share of claims with a signature of their own (1 without claims), claims a concept.

    concepts: proposal_id, concept_id, broader (array); claims: proposal_id, subject, predicate, object, evidence (array); gaps: proposal_id.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    c = concepts.groupBy("proposal_id").agg(F.count("*").alias("n_concepts"), F.sum(F.greatest(size("broader"), F.lit(0))).alias("n_broader"))
    k = claims.groupBy("proposal_id").agg(
        F.count("*").alias("n_claims"), F.count_distinct("predicate").alias("n_predicates"), F.sum(F.greatest(size("evidence"), F.lit(0))).alias("n_evidence"),
        F.count_distinct(F.struct("subject", "predicate", "object")).alias("n_signatures"),
    )
    g = gaps.groupBy("proposal_id").agg(F.count("*").alias("n_gaps"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return (
        c.join(k, "proposal_id", "full_outer").join(g, "proposal_id", "full_outer").select("proposal_id", *(zero(d) for d in (*DIMENSIONS, "n_signatures")))
        .withColumn("unique_ratio", F.when(F.col("n_claims") > 0, F.round(F.col("n_signatures") / F.col("n_claims"), 6)).otherwise(1.0))
        .withColumn("claims_per_concept", F.when(F.col("n_concepts") > 0, F.round(F.col("n_claims") / F.col("n_concepts"), 6)).otherwise(0.0))
    )


def compare(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """baseline_id, candidate_id, n_better, n_worse, verdict. candidate: two dimensions better, one worse at most and the
    ratio no more than `tolerance` lower; baseline: two worse, or the ratio lower than that; else inconclusive. Both sides are single rows."""
    b = baseline.select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns), F.lit(1).alias("_one"))
    c = candidate.withColumn("_one", F.lit(1))
    both = c.join(b, "_one")
    better = sum(((F.col(d) > F.col(f"b_{d}")).cast("int") for d in DIMENSIONS), F.lit(0))
    worse = sum(((F.col(d) < F.col(f"b_{d}")).cast("int") for d in DIMENSIONS), F.lit(0))
    drop = F.col("b_unique_ratio") - F.col("unique_ratio") > tolerance
    verdict = F.when((F.col("n_better") >= 2) & (F.col("n_worse") <= 1) & ~drop, "candidate").when((F.col("n_worse") >= 2) | drop, "baseline").otherwise("inconclusive")
    return both.withColumn("n_better", better).withColumn("n_worse", worse).select(F.col("b_proposal_id").alias("baseline_id"), F.col("proposal_id").alias("candidate_id"), "n_better", "n_worse", verdict.alias("verdict"))


def slice_subtree(concepts: DataFrame, claims: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The concepts below a root (itself included) and the claims about them. concepts: concept_id, broader (array)."""
    from lodestrata.operators.closure import descendants

    edges = concepts.select("concept_id", F.explode("broader").alias("parent_id"))
    kept = descendants(edges, concepts.filter(F.col("concept_id") == root).select(F.col("concept_id").alias("node")), "concept_id", "parent_id")
    ids = kept.select(F.col("node").alias("concept_id"))
    return concepts.join(ids, "concept_id", "left_semi"), claims.join(ids.withColumnRenamed("concept_id", "subject"), "subject", "left_semi")
