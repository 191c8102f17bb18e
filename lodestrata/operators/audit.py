"""Audit rules over claims, evidence, controversies and gaps: every finding is a row.

Inputs: claim (id, subject, predicate, object, qualifiers, stance, review_state), claim_evidence (claim_id, evidence_id),
evidence (id, source_id), threat (source_id, status), controversy (id, ...), controversy_claim (controversy_id, claim_id),
gap (id, status, freshness_deadline), gap_claim (gap_id, claim_id), reference (id, relation). Null ids are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ("suspected", "confirmed")


def _findings(df: DataFrame, rule: str, severity: str, column: str, details=None) -> DataFrame:
    d = F.lit(None).cast("string") if details is None else details
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(column).cast("string").alias("record_id"), d.cast("string").alias("detail"))


def missing_evidence(claim_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with evidence that is not there."""
    gone = claim_evidence.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")
    per = gone.groupBy("claim_id").agg(F.min("evidence_id").alias("first"), F.count_distinct("evidence_id").alias("n"))
    return _findings(per, "claim-evidence-exists", "error", "claim_id", F.concat_ws(" ", "n", "first"))


def tainted_claims(claim: DataFrame, claim_evidence: DataFrame, evidence: DataFrame, threat: DataFrame) -> DataFrame:
    """Accepted claims whose evidence is from a source with an active threat."""
    bad = threat.filter(F.col("status").isin(*ACTIVE)).select("source_id").distinct()
    from_bad = evidence.join(bad, "source_id", "left_semi").select(F.col("id").alias("evidence_id"))
    ids = claim_evidence.join(from_bad, "evidence_id", "left_semi").select(F.col("claim_id").alias("id")).distinct()
    return _findings(claim.filter("review_state = 'accepted'").join(ids, "id", "left_semi"), "accepted-claim-active-source-threat", "error", "id")


def missing_controversy_claims(controversy_claim: DataFrame, claim: DataFrame) -> DataFrame:
    """Controversies with claims that are not there."""
    gone = controversy_claim.join(claim.select(F.col("id").alias("claim_id")), "claim_id", "left_anti")
    return _findings(gone.groupBy("controversy_id").agg(F.count_distinct("claim_id").alias("n")), "controversy-claims-exist", "error", "controversy_id", F.col("n"))


def indistinct_controversies(controversy_claim: DataFrame, claim: DataFrame) -> DataFrame:
    """Controversies whose claims have neither two stances nor two objects."""
    own = controversy_claim.join(claim.select(F.col("id").alias("claim_id"), "stance", F.lower("object").alias("object")), "claim_id")
    per = own.groupBy("controversy_id").agg(F.count_distinct("stance").alias("s"), F.count_distinct("object").alias("o"))
    return _findings(per.filter("s < 2 and o < 2"), "controversy-has-distinct-positions", "warning", "controversy_id")


def opposing_unindexed(claim: DataFrame, controversy_claim: DataFrame) -> DataFrame:
    """Groups of one subject, predicate and qualifiers that hold opposing claims which no controversy has together.

    Two claims oppose if they say the same object and only one supports it (asserts or reports; any other stance does not),
    or if they say different booleans, whatever their stance. A pair is settled if some controversy holds both claims.
    Pairs are counted, not listed: claims of one (object, support) in the same controversies are one class, and a class is
    open if it has more opposing claims than share a controversy with it. The finding's record is the smallest open claim.
    """
    group = ["subject", "predicate", "qualifiers"]
    supports = F.coalesce(F.col("stance").isin("asserts", "reports"), F.lit(False))
    c = claim.filter("review_state = 'accepted'").select(
        F.col("id").alias("claim_id"), "subject", "predicate", F.coalesce("qualifiers", F.lit("")).alias("qualifiers"), F.lower("object").alias("object"), supports.alias("supports")
    )
    held = controversy_claim.groupBy("claim_id").agg(F.array_sort(F.collect_set("controversy_id")).alias("held"))
    c = c.join(held, "claim_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    classes = c.groupBy(*group, "object", "supports", "held").agg(F.count_distinct("claim_id").alias("n"), F.min("claim_id").alias("one"))
    # what a class opposes: its object with the other support, and the other boolean with either
    facing = lambda o, s: F.struct(o.alias("object"), s.alias("supports"))
    other = F.when(F.col("object") == "true", "false").when(F.col("object") == "false", "true")
    against = F.explode(F.filter(F.array(facing(F.col("object"), ~F.col("supports")), facing(other, F.lit(True)), facing(other, F.lit(False))), lambda x: x["object"].isNotNull()))
    mine = classes.select(*group, F.struct("object", "supports", "held").alias("class"), "one", "held", against.alias("a")).select(*group, "class", "one", "held", "a.object", "a.supports")
    sides = [*group, "object", "supports"]
    opposing = mine.join(classes.groupBy(*sides).agg(F.sum("n").alias("n")), sides).groupBy(*group, "class", "one").agg(F.sum("n").alias("n"))
    theirs = classes.select(*sides, F.col("held").alias("theirs"), "n", F.explode("held").alias("k"))
    shared = mine.withColumn("k", F.explode("held")).join(theirs, [*sides, "k"]).select(*group, "class", "object", "supports", "theirs", "n").distinct()
    settled = shared.groupBy(*group, "class").agg(F.sum("n").alias("settled"))
    open_ = opposing.join(settled, [*group, "class"], "left").filter(F.col("n") > F.coalesce("settled", F.lit(0)))
    return _findings(open_.groupBy(*group).agg(F.min("one").alias("id")), "direct-opposing-claims-unindexed", "warning", "id")


def stale_gaps(gap: DataFrame, as_of) -> DataFrame:
    """Unresolved gaps at or past their deadline."""
    return _findings(gap.filter((F.col("status") != "resolved") & (F.col("freshness_deadline") <= as_of)), "gap-freshness-deadline", "warning", "id")


def unproved_resolutions(gap: DataFrame, gap_claim: DataFrame) -> DataFrame:
    """Resolved gaps without a claim."""
    return _findings(gap.filter("status = 'resolved'").join(gap_claim.select(F.col("gap_id").alias("id")), "id", "left_anti"), "resolved-gap-has-resolution-evidence", "warning", "id")


def retractions(reference: DataFrame) -> DataFrame:
    """References that retract."""
    return _findings(reference.filter("relation = 'retracts'"), "explicit-retraction-reference", "warning", "id")


def audit(t: dict[str, DataFrame], as_of) -> DataFrame:
    """All findings; order them by severity (as text), rule and record."""
    parts = [
        missing_evidence(t["claim_evidence"], t["evidence"]),
        tainted_claims(t["claim"], t["claim_evidence"], t["evidence"], t["threat"]),
        missing_controversy_claims(t["controversy_claim"], t["claim"]),
        indistinct_controversies(t["controversy_claim"], t["claim"]),
        opposing_unindexed(t["claim"], t["controversy_claim"]),
        stale_gaps(t["gap"], as_of),
        unproved_resolutions(t["gap"], t["gap_claim"]),
        retractions(t["reference"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """n_errors, n_warnings, n_infos and clean (no errors)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"), n("info").alias("n_infos"), (n("error") == 0).alias("clean"))
