"""References to records that do not exist.

References and parent keys are partitioned alike, sorted and merged in one linear pass (a sort-merge join, which Spark
keeps co-partitioned); the parent's interval of validity then tells missing, late and deleted apart. All fields of a table
are exploded in one pass, and all fields of all tables are written once, counted and merged together. The references of
the heaviest keys are spread over as many buckets as their count asks for and only the parent rows of those keys are
repeated; as they are the top HOT_KEYS by count, their table has a bound whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import BLANKS, Scratch, norm_id

#: The heaviest keys, at most so many (what is broadcast is bounded by it), are spread if they have more than HOT_ROWS references, so many to a bucket.
HOT_KEYS, HOT_ROWS = 500, 10_000


def id_list(column: str) -> Column:
    """Ids of a text that is a JSON list or ids joined by commas; null, blank or empty lists give an empty array."""
    text = F.trim(F.col(column), F.lit(BLANKS))
    listed = F.from_json(text, "array<string>")
    plain = F.split(F.regexp_replace(text, r'[\[\]"]', ""), ",")
    ids = F.when(text.startswith("["), F.coalesce(listed, plain)).otherwise(plain)
    return F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array()), norm_id), lambda x: x.isNotNull()))


def targets(df: DataFrame, key: str, field: str) -> DataFrame:
    """field_name, ref_key, since, until of each distinct target key of a field (its interval of validity)."""
    t = df.select(norm_id(key).alias("ref_key"), "ingested_at", "retired_at").filter("ref_key is not null")
    return t.groupBy("ref_key").agg(F.min("ingested_at").alias("since"), F.min("retired_at").alias("until")).select(F.lit(field).alias("field_name"), "ref_key", "since", "until")


def references(df: DataFrame, table: str, record: str, fields: dict[str, Column]) -> DataFrame:
    """One row per record, field and referenced key, at the record's earliest ingested_at. fields: an array of ids by name."""
    named = lambda name: lambda x: F.struct(F.lit(name).alias("field_name"), x.alias("ref_key"))
    every = F.flatten(F.array(*(F.transform(refs, named(name)) for name, refs in fields.items())))
    r = df.select(norm_id(record).alias("record_key"), F.explode(every).alias("r"), "ingested_at", "recorded_at").select("record_key", "r.*", "ingested_at", "recorded_at")
    return (
        r.filter("ref_key is not null and record_key is not null")
        .groupBy("field_name", "record_key", "ref_key")
        .agg(F.min("ingested_at").alias("ingested_at"), F.min("recorded_at").alias("recorded_at"))
        .select(F.lit(table).alias("table_name"), "field_name", "record_key", "ref_key", "ingested_at", "recorded_at")
    )


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose target is missing, late or deleted, with `reason`; refs and parents of any number of fields.

    missing: no parent has the key; late: the parent arrived after the referring row; deleted: it was retired at or
    before the referring row's arrival. A null arrival of the referring row is neither late nor deleted; a parent
    without arrival was always there. Ids of null or blank are no references.
    """
    refs = Scratch(refs.sparkSession, "references").table(refs)
    key = ["field_name", "ref_key"]
    heaviest = refs.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(HOT_KEYS)
    hot = F.broadcast(heaviest.filter(F.col("n") > HOT_ROWS).select(*key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts")))
    salted = refs.join(hot, key, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_key"), F.col("salts"))).cast("int")).drop("salts")
    spread = parents.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    merged = salted.join(spread.withColumn("there", F.lit(True)).hint("merge"), [*key, "salt"], "left")
    reason = (
        F.when(F.col("there").isNull(), "missing").when(F.col("since") > F.col("ingested_at"), "late").when(F.col("until") <= F.col("ingested_at"), "deleted")
    )
    return merged.withColumn("reason", reason).filter("reason is not null").drop("salt", "there", "since", "until")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the referring row's recorded_at and reason."""
    return found.groupBy("table_name", "field_name", F.date_format("recorded_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_references"), F.countDistinct("record_key").alias("n_records"))
