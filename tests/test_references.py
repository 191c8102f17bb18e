"""Orphan references against a plain loop."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.operators import references as R

T0 = datetime(2024, 1, 1)
day = lambda n: None if n is None else T0 + timedelta(days=n)


def frames(spark, refs, parents):
    r = spark.createDataFrame([(k, v, day(i), day(0)) for k, v, i in refs], "rec string, fk string, ingested_at timestamp, recorded_at timestamp")
    p = spark.createDataFrame([(k, day(i), day(x)) for k, i, x in parents], "id string, ingested_at timestamp, retired_at timestamp")
    return r, p


def run(spark, refs, parents):
    r, p = frames(spark, refs, parents)
    found = R.orphans(R.references(r, "t", "rec", {"fk": F.array(R.norm_id("fk"))}), R.targets(p, "id", "fk"))
    return {(x["record_key"], x["ref_key"], x["reason"]) for x in found.collect()}


def test_reasons_and_their_precedence(spark):
    refs = [("r1", "here", 5), ("r2", "gone", 5), ("r3", " LATE\t", 5), ("r4", "dead", 5), ("r5", "edge", 5), ("r6", "both", 5), ("r7", None, 5), (None, "gone", 5), ("r8", " ", 5), ("r9", "dead", None)]
    parents = [("here", 1, None), ("late", 6, None), ("dead", 1, 4), ("edge", 1, 5), ("both", 6, 3), ("HERE ", 2, None), (None, 1, None)]
    assert run(spark, refs, parents) == {("r2", "gone", "missing"), ("r3", "late", "late"), ("r4", "dead", "deleted"), ("r5", "edge", "deleted"), ("r6", "both", "late")}


def test_repeats_count_once_at_their_earliest_arrival(spark):
    assert run(spark, [("r", "k", 9), (" R", "K", 3)], [("k", 5, None), ("k", 7, None)]) == {("r", "k", "late")}


def test_empty_tables(spark):
    assert run(spark, [("r", "k", 1)], [("z", 1, None)]) == {("r", "k", "missing")}
    r, p = frames(spark, [("r", "k", 1)], [("k", 1, None)])
    refs = R.references(r.limit(0), "t", "rec", {"fk": F.array(R.norm_id("fk"))})
    assert R.orphans(refs, R.targets(p, "id", "fk")).count() == 0
    refs = R.references(r, "t", "rec", {"fk": F.array(R.norm_id("fk"))})
    assert R.orphans(refs, R.targets(p.limit(0), "id", "fk")).count() == 1
    assert R.report(R.orphans(refs, R.targets(p.limit(0), "id", "fk"))).collect()[0]["month"] == "2024-01"


def test_hot_key_is_salted_without_losing_rows(spark):
    n = 3 * R.HOT_ROWS
    r = spark.range(n).select(F.concat(F.lit("r"), "id").alias("rec"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("fk"), F.lit(T0).alias("ingested_at"), F.lit(T0).alias("recorded_at"), F.lit(1).alias("salt"))
    p = spark.createDataFrame([("hot", day(3), None)], "id string, ingested_at timestamp, retired_at timestamp")
    found = R.orphans(R.references(r, "t", "rec", {"fk": F.array(R.norm_id("fk"))}), R.targets(p, "id", "fk"))
    assert {x["reason"]: x["n"] for x in found.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"late": n // 2, "missing": n // 2}


def test_lists_of_ids(spark):
    rows = [('["A", "b"]',), ("a, B ,a",), (" [ ] ",), ("",), (None,), ("[\n \"x\"\n]",), ("[broken",), ("  ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(R.id_list("v")).collect()]
    assert [sorted(g) for g in got] == [["a", "b"], ["a", "b"], [], [], [], ["x"], ["broken"], []]


def test_fields_of_one_table_are_told_apart(spark):
    r = spark.createDataFrame([("r", "k", ["k", "z", None], T0, T0)], "rec string, a string, b array<string>, ingested_at timestamp, recorded_at timestamp")
    p = spark.createDataFrame([("k", T0, None)], "id string, ingested_at timestamp, retired_at timestamp")
    refs = R.references(r, "t", "rec", {"a": F.array(R.norm_id("a")), "b": F.transform("b", R.norm_id)})
    got = {(x["field_name"], x["ref_key"], x["reason"]) for x in R.orphans(refs, R.targets(p, "id", "a").unionByName(R.targets(p.limit(0), "id", "b"))).collect()}
    assert got == {("b", "k", "missing"), ("b", "z", "missing")}
