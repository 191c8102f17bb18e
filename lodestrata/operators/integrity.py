"""Foreign keys, snapshot drift and stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import table_digest


def violations(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """table, field, value, n_rows of every non-null value of (table, field, parent, parent key) that the parent has not. Values are counted before the join."""
    out = None
    for table, field, parent, parent_key in keys:
        values = tables[table].filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))
        there = tables[parent].select(F.col(parent_key).cast("string").alias("value"))
        bad = values.join(there, "value", "left_anti").select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "value", "n_rows")
        out = bad if out is None else out.unionByName(bad)
    return out


def drift(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (added, missing, changed) of the artifacts that differ."""
    e, a = expected.select(key, F.col(digest).alias("_e"), F.lit(True).alias("_x")), actual.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_y"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "missing").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return e.join(a, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def stamp(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, digest of every table, in order of name."""
    out = None
    for name in sorted(tables):
        one = table_digest(tables[name], name)
        out = one if out is None else out.unionByName(one)
    return out


def verify(tables: dict[str, DataFrame], stamped: DataFrame) -> DataFrame:
    """name, state (missing, unstamped, mutated) and the action it calls for, of the tables that differ from their stamp."""
    state = F.when(F.col("change") == "added", "unstamped").when(F.col("change") == "missing", "missing").otherwise("mutated")
    action = F.when(F.col("state") == "unstamped", "stamp").otherwise("rebuild")
    return drift(stamped, stamp(tables), "name", "digest").withColumn("state", state).withColumn("action", action).drop("change")
