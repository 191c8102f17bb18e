"""Knowledge packs: concepts, evidence, claims, controversies and gaps of a topic, as tables with ids by content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import canonical_json, content_id


def read_pack(text: str) -> dict:
    """A pack of YAML (if a YAML reader is installed) or JSON text."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        return json.loads(text)


def tables(spark: SparkSession, pack: dict) -> dict[str, DataFrame]:
    """concept, evidence, claim, claim_evidence, controversy, controversy_claim, gap, gap_claim of one pack, which its author bounds."""
    ev = {e["key"]: content_id("evidence", {k: e.get(k) for k in ("source_content_sha256", "exact", "start", "end")}) for e in pack.get("evidence", [])}
    cl = {}
    for c in pack.get("claims", []):
        unknown = [k for k in c.get("evidence_keys", []) if k not in ev]
        if unknown:
            raise ValueError(f"claim {c['key']}: unknown evidence {unknown}")
        cl[c["key"]] = content_id("claim", {k: v for k, v in c.items() if k not in ("key", "evidence_keys")} | {"evidence": sorted(ev[k] for k in c.get("evidence_keys", []))})

    def keys_of(item: dict, field: str) -> list[str]:
        unknown = [k for k in item.get(field, []) if k not in cl]
        if unknown:
            raise ValueError(f"unknown claims {unknown}")
        return sorted({cl[k] for k in item.get(field, [])})

    co = [(content_id("controversy", {"q": c["question"], "claims": keys_of(c, "claim_keys")}), c, keys_of(c, "claim_keys")) for c in pack.get("controversies", [])]
    if any(len(k) < 2 for _, _, k in co):
        raise ValueError("a controversy needs two claims at least")
    ga = [(content_id("gap", {"q": g["question"], "kind": g.get("kind"), "topic": g.get("topic_concept_id")}), g, keys_of(g, "related_claim_keys")) for g in pack.get("gaps", [])]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    concepts = [(c["id"], c["label"], c.get("description"), c.get("broader", []), c.get("synonyms", []), c.get("review_state", "proposed")) for c in pack.get("concepts", [])]
    return {
        "concept": make(concepts, "id string, label string, description string, broader array<string>, synonyms array<string>, review_state string"),
        "evidence": make([(ev[e["key"]], e["source_content_sha256"], e["exact"], e.get("start"), e.get("end")) for e in pack.get("evidence", [])], "id string, source_sha256 string, exact string, start long, stop long"),
        "claim": make(
            [(cl[c["key"]], c["subject"], c["predicate"], canonical_json(c["object"]), type(c["object"]).__name__, canonical_json(c.get("qualifiers", {})), c["stance"], c.get("review_state", "accepted")) for c in pack.get("claims", [])],
            "id string, subject string, predicate string, object string, object_type string, qualifiers string, stance string, review_state string",
        ),
        "claim_evidence": make(sorted({(cl[c["key"]], ev[k]) for c in pack.get("claims", []) for k in c.get("evidence_keys", [])}), "claim_id string, evidence_id string"),
        "controversy": make([(i, c["topic_concept_id"], c["question"], c.get("status")) for i, c, _ in co], "id string, topic string, question string, status string"),
        "controversy_claim": make([(i, k) for i, _, ks in co for k in ks], "controversy_id string, claim_id string"),
        "gap": make([(i, g["topic_concept_id"], g["question"], g.get("kind"), g.get("priority", 0), g.get("status", "open")) for i, g, _ in ga], "id string, topic string, question string, kind string, priority int, status string"),
        "gap_claim": make([(i, k) for i, _, ks in ga for k in ks], "gap_id string, claim_id string"),
    }


def check(pack: dict) -> None:
    """Raises ValueError if a concept is defined twice, concepts are their own ancestors, or evidence and claims share keys."""
    ids = [x["id"] for x in pack.get("concepts", [])]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"concepts defined twice: {twice}")
    for section in ("evidence", "claims"):
        keys = [x["key"] for x in pack.get(section, [])]
        if twice := sorted({k for k in keys if keys.count(k) > 1}):
            raise ValueError(f"{section} with one key: {twice}")
    up = {x["id"]: set(x.get("broader", [])) & set(ids) for x in pack.get("concepts", [])}
    while leaves := {k for k, v in up.items() if not v}:
        up = {k: v - leaves for k, v in up.items() if k not in leaves}
    if up:
        raise ValueError(f"concepts above themselves: {sorted(up)}")


def associations(spark: SparkSession, pack: dict) -> DataFrame:
    """topic_concept_id, source_sha256, roles (sorted): evidence for the sources that are quoted, inspected for those that are named so."""
    rows = [(pack["topic_concept_id"], d, "inspected") for d in pack.get("inspect_source_sha256s", [])] + [(pack["topic_concept_id"], e["source_content_sha256"], "evidence") for e in pack.get("evidence", [])]
    df = spark.createDataFrame(rows, "topic_concept_id string, source_sha256 string, role string")
    return df.groupBy("topic_concept_id", "source_sha256").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def poisoned(sources: DataFrame, required: DataFrame) -> DataFrame:
    """source_sha256 and threat_types of the required sources (source_sha256) whose text (sha256, text) holds hostile instructions."""
    from lodestrata.functions.redact import scan

    own = sources.select(F.col("sha256").alias("source_sha256"), "text").join(required.select("source_sha256").distinct(), "source_sha256", "left_semi")
    return scan(own, "source_sha256", "text").groupBy("source_sha256").agg(F.array_sort(F.collect_set("threat_type")).alias("threat_types"))


def import_pack(spark: SparkSession, pack: dict, sources: DataFrame) -> dict[str, DataFrame]:
    """The pack's tables with ranges of its evidence, associations, and threats of the sources it needs; sources: sha256, text.

    Raises ValueError if the pack is not consistent, a source is missing, a quote does not stand in its source, or evidence is
    from a source with hostile instructions. A pack is as large as its author makes it; sources may be any number.
    """
    check(pack)
    t = tables(spark, pack)
    links = associations(spark, pack)
    gone = links.join(sources.select(F.col("sha256").alias("source_sha256")), "source_sha256", "left_anti").select("source_sha256")
    good, bad = grounded(t["evidence"], sources)
    threats = poisoned(sources, links)
    tainted = threats.join(t["evidence"].select("source_sha256"), "source_sha256", "left_semi").select("source_sha256")
    for what, df in (("sources are not there", gone), ("evidence does not stand in its source", bad.select("id")), ("evidence is from sources with suspected threats", tainted)):
        if rows := df.distinct().limit(5).collect():
            raise ValueError(f"{what}: {sorted(r[0] for r in rows)}")
    return t | {"evidence": good, "association": links, "threat": threats}


def import_bundle(spark: SparkSession, bundle: dict, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a bundle: sources pinned by digest with their metadata, and a pack over them.

    bundle: sources (path, sha256, title, license), pack; files: path, content. Raises ValueError if a file is missing or its
    content has another digest, and where import_pack does.
    """
    pins = spark.createDataFrame([(x["path"], x["sha256"], x.get("title"), x.get("license")) for x in bundle["sources"]], "path string, sha256 string, title string, license string")
    both = pins.join(files.select("path", "content"), "path", "left")
    wrong = both.filter(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256"))).select("path")
    if rows := wrong.limit(5).collect():
        raise ValueError(f"files that are not there or differ: {sorted(r[0] for r in rows)}")
    text = both.select("sha256", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    meta = pins.select(F.concat(F.lit("source:sha256:"), "sha256").alias("source_version_id"), "title", "license", F.col("path").alias("original_locator"))
    return import_pack(spark, bundle["pack"], text) | {"source_metadata": meta}


def candidate_bundle(proposal: DataFrame, claims: DataFrame, sources: DataFrame, permissive: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bundles, refused): per proposal (id, source_sha256) its claims (proposal_id, claim) as one JSON text with its digest, if the license (regardless of case) of its source (sha256, license) is one of `permissive`."""
    allowed = F.lower("license").isin(*(x.lower() for x in permissive))
    both = proposal.join(sources.select(F.col("sha256").alias("source_sha256"), "license"), "source_sha256", "left")
    ok = F.coalesce(allowed, F.lit(False))
    listed = claims.groupBy(F.col("proposal_id").alias("id")).agg(F.array_sort(F.collect_list("claim")).alias("claims"))
    out = both.filter(ok).join(listed, "id", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<string>")))
    body = F.to_json(F.struct("claims", "id", "license", "source_sha256"))
    return out.select("id", body.alias("bundle"), F.sha2(body, 256).alias("sha256")), both.filter(~ok).select("id", "license")


def grounded(evidence: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grounded, rejected): evidence (id, source_sha256, exact, start, stop) whose quote stands in the source's text (sha256, text) at its range, or without one exactly once. Offsets are code points."""
    both = evidence.join(sources.select(F.col("sha256").alias("source_sha256"), "text", F.lit(True).alias("_there")), "source_sha256", "left")
    ranged = F.expr("substring(text, cast(start + 1 as int), cast(stop - start as int))") == F.col("exact")
    times = F.when(F.length("exact") > 0, (F.length("text") - F.length(F.replace("text", "exact", F.lit("")))) / F.length("exact"))
    reason = F.when(F.col("_there").isNull(), "no such source").when(F.col("start").isNotNull() & ~F.coalesce(ranged, F.lit(False)), "range differs").when(F.col("start").isNull() & (F.coalesce(times, F.lit(0)) != 1), "not exactly once")
    marked = both.withColumn("reason", reason).withColumn("start", F.coalesce("start", (F.instr("text", F.col("exact")) - 1).cast("long"))).withColumn("stop", F.coalesce("stop", F.col("start") + F.length("exact")))
    return marked.filter("reason is null").select("id", "source_sha256", "exact", "start", "stop"), marked.filter("reason is not null").select("id", "source_sha256", "reason")


def reverified(ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """Ranges (id, sha256, start, stop, exact_sha256) whose text in the source no longer has the recorded digest."""
    both = ranges.join(sources.select("sha256", "text"), "sha256")
    return both.filter(F.sha2(F.expr("substring(text, cast(start + 1 as int), cast(stop - start as int))"), 256) != F.col("exact_sha256")).select("id", "sha256")


def with_vocabulary(concepts: DataFrame, vocabulary: dict[str, list[str]], epoch: str = "1970-01-01 00:00:00") -> DataFrame:
    """concepts (id, label, synonyms, recorded_at) and those only the vocabulary names, labelled by their ids and recorded at the epoch."""
    from lodestrata.functions.text import label_of_id

    spark = concepts.sparkSession
    rows = spark.createDataFrame([(k, sorted(set(v))) for k, v in vocabulary.items()], "id string, synonyms array<string>")
    new = rows.join(concepts.select("id"), "id", "left_anti").select("id", label_of_id(F.col("id")).alias("label"), "synonyms", F.lit(epoch).cast("timestamp").alias("recorded_at"))
    return concepts.select("id", "label", "synonyms", "recorded_at").unionByName(new)


def remapped(df: DataFrame, columns: list[str], prefix: str, proposed: list[str]) -> DataFrame:
    """df with the proposed ids of its columns (text or arrays) under a prefix; other ids stay."""
    ids = F.array(*(F.lit(p) for p in proposed)).cast("array<string>")
    to = lambda v: F.when(F.array_contains(ids, v), F.concat(F.lit(prefix), F.regexp_replace(v, "^concept:", ""))).otherwise(v)
    types = dict(df.dtypes)
    return df.withColumns({c: F.transform(c, to) if types[c].startswith("array") else to(F.col(c)) for c in columns})


def accepted(items: DataFrame, anchors: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, findings) of proposed claims (item_id, subject, anchor_id, exact): the subject must be allowed and the quote stand once in its anchor (anchor_id, text, anchor_start).

    Accepted ones get absolute start and stop and the digest of the quote; findings name every rule that fails.
    """
    both = items.join(anchors.select("anchor_id", "text", "anchor_start"), "anchor_id", "left").join(subjects.select("subject").distinct().withColumn("_known", F.lit(True)), "subject", "left")
    times = F.when(F.length("exact") > 0, (F.length("text") - F.length(F.replace("text", "exact", F.lit("")))) / F.length("exact"))
    failed = F.array_compact(F.array(F.when(F.col("text").isNull(), "unknown anchor"), F.when(F.col("_known").isNull(), "unknown subject"), F.when(F.col("text").isNotNull() & (F.coalesce(times, F.lit(0)) != 1), "quote not exactly once")))
    marked = both.withColumn("failed", failed)
    start = F.col("anchor_start") + F.instr("text", F.col("exact")) - 1
    good = marked.filter(F.size("failed") == 0).select("item_id", "subject", "anchor_id", "exact", start.alias("start"), (start + F.length("exact")).alias("stop"), F.sha2("exact", 256).alias("exact_sha256"))
    return good, marked.filter(F.size("failed") > 0).select("item_id", F.explode("failed").alias("finding"))


def merged_state(states: DataFrame, key: str, sets: list[str], times: list[str]) -> DataFrame:
    """States of a key merged: arrays as sorted sets, times as their latest."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return states.groupBy(key).agg(*(union(c) for c in sets), *(F.max(c).alias(c) for c in times))


def inconsistent(derivations: DataFrame, rows: DataFrame, key: str, listed: str, item: str) -> DataFrame:
    """Derivations (key, listed: array in order) whose list is not that of their rows (key, ordinal, item) in order."""
    own = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", item))), lambda x: x[item]).alias("_own"))
    return derivations.join(own, key, "left").filter(~F.coalesce("_own", F.array().cast("array<string>")).eqNullSafe(F.col(listed))).select(key)
