"""Links between identifiers and what names them, and rules matched against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_by_priority(left: DataFrame, right: DataFrame, rules: list[tuple[str, Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, rule: pairs that agree by any rule (name, key of left, key of right), named by the first that holds.

    A disjunction would be planned as a join of all pairs; each rule is an equi-join instead, and a pair found by several keeps the first. A key may be an array, which agrees by any element.
    """
    out = None
    for k, (name, a, b) in enumerate(rules):
        x = _keys(left, left_id, a)
        y = _keys(right, right_id, b)
        part = x.join(y, "_k").select(left_id, right_id, F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("rule")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.groupBy(left_id, right_id).agg(F.min("rule").alias("rule")).select(left_id, right_id, F.col("rule.name").alias("rule"))


def _keys(df: DataFrame, own: str, key: Column) -> DataFrame:
    rows = df.select(own, key.alias("_k"))
    if dict(rows.dtypes)["_k"].startswith("array"):
        rows = rows.select(own, F.explode("_k").alias("_k"))
    return rows.filter("_k is not null").distinct()


def strictest(observations: DataFrame, rules: DataFrame, key: str, on: list[str], strictness: list[str], default: str) -> DataFrame:
    """key, action, rule_ids: of all rules that match an observation of a key, the strictest action and every rule that yields it.

    rules: rule_id, action and for each column of `on` an array of the values it matches (null: any). Without a match the
    default holds, with no rule. `strictness` lists actions from lenient to strict. The rule table is bounded by those who write it, and broadcast.
    """
    combos = rules
    for c in on:
        combos = combos.withColumn(c, F.explode_outer(c))
    seen = observations.select(key, *on).distinct()
    match = None
    for c in on:
        part = F.col(f"r.{c}").isNull() | (F.col(f"o.{c}") == F.col(f"r.{c}"))
        match = part if match is None else match & part
    rank = F.array_position(F.array(*(F.lit(s) for s in strictness)), F.col("r.action")).cast("int")
    hits = seen.alias("o").join(F.broadcast(combos.alias("r")), match).select(F.col(f"o.{key}").alias(key), rank.alias("_rank"), "r.rule_id", "r.action")
    top = hits.groupBy(key).agg(F.max("_rank").alias("_top"))
    chosen = hits.join(top, key).filter("_rank = _top").groupBy(key).agg(F.min("action").alias("action"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    return observations.select(key).distinct().join(chosen, key, "left").select(key, F.coalesce("action", F.lit(default)).alias("action"), F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"))
