"""Hierarchies by peeling against a walk up every chain."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import closure
from lodestrata.operators import hierarchy as H


def walk(pairs):
    up = dict(pairs)
    out = {}
    for x in set(up) | set(up.values()):
        path, y = [x], x
        while y in up and len(path) <= len(up) + 1:
            y = up[y]
            path.append(y)
        out[x] = ("", -1, None) if y in up else (y, len(path) - 1, path[::-1])
    return out


def build(spark, pairs):
    return spark.createDataFrame(pairs, "concept_id string, parent_id string")


def test_random_forest_with_cycles(spark):
    r = random.Random(5)
    pairs = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 120)] + [(f"d{i}", f"d{i - 1}") for i in range(1, 70)]
    pairs += [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("lower", "below"), ("self", "self")]
    t = H.hierarchy(build(spark, pairs))
    got = {row["node"]: (row["root"], row["depth"], row["path"]) for row in t.collect()}
    assert got == walk(pairs)
    sizes = {row["node"]: row["size"] for row in t.collect()}
    assert sizes["d0"] == 70 and sizes["n0"] == 120 and sizes["x"] is None
    heights = {row["node"]: row["height"] for row in t.collect()}
    assert heights["d0"] == 69 and heights["d69"] == 0
    rows = [(row["ancestor"], row["descendant"], row["distance"]) for row in H.descendants(build(spark, pairs)).collect()]
    paths = [p for _, _, p in walk(pairs).values() if p]
    assert sorted(rows) == sorted((p[i], p[-1], len(p) - 1 - i) for p in paths for i in range(len(p) - 1))


def test_spellings_nulls_repeats_and_conflicts(spark):
    rows = [(" A ", "b"), ("a", "B\t"), (None, "q"), ("", "q"), ("c", None), ("e", "b"), ("e", "a"), ("d", " ")]
    got = {r["node"]: (r["root"], r["depth"]) for r in H.hierarchy(build(spark, rows), paths=False).collect()}
    assert got == {"a": ("b", 1), "b": ("b", 0), "q": ("q", 0), "c": ("c", 0), "e": ("b", 2), "d": ("d", 0)}


def test_empty_only_cycles_and_clashing_columns(spark):
    assert H.hierarchy(build(spark, []).filter("concept_id is not null")).count() == 0
    only = H.hierarchy(build(spark, [("a", "b"), ("b", "a")])).collect()
    assert {(r["node"], r["root"], r["depth"]) for r in only} == {("a", "", -1), ("b", "", -1)}
    clash = build(spark, [("a", "b")]).withColumn("node", F.lit("z")).withColumn("root", F.lit(1)).withColumn("up", F.lit(2))
    assert {(r["node"], r["root"]) for r in H.hierarchy(clash).collect()} == {("a", "b"), ("b", "b")}


def test_paths_are_assigned_in_reverse_order_of_peeling(spark):
    # a short branch and a tall one under one root; a way up that leaves its round at different heights
    pairs = [(f"t{i}", f"t{i - 1}") for i in range(1, 40)] + [("s1", "t0"), ("s2", "s1"), ("u1", "t20"), ("u2", "u1"), ("q", "c1"), ("c1", "c2"), ("c2", "c1")] + [(f"q{i}", f"q{i - 1}" if i else "q") for i in range(20)]
    got = {row["node"]: (row["root"], row["depth"], row["path"]) for row in H.hierarchy(build(spark, pairs)).collect()}
    assert got == walk(pairs)
    assert H.descendants(build(spark, pairs).limit(0)).count() == 0 and H.descendants(build(spark, [("a", "b"), ("b", "a")])).count() == 0


def test_one_parent_of_a_third_of_all(spark):
    pairs = [(f"c{i}", "hub") for i in range(3000)] + [("hub", "top")]
    t = H.hierarchy(build(spark, pairs), paths=False)
    row = t.filter("node = 'top'").first()
    assert row["size"] == 3002 and t.filter("depth = 2").count() == 3000


def test_reach_is_safe_against_cycles_and_diamonds(spark):
    e = build(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), (None, "a")])
    start = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["distance"] for r in closure.descendants(e, start, "concept_id", "parent_id").collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["node"] for r in closure.ancestors(e, start, "concept_id", "parent_id").collect()} == {"a", "b", "c", "d"}
    assert closure.descendants(e, start.limit(0), "concept_id", "parent_id").count() == 0


@pytest.mark.parametrize("depth", [1, 15, 16, 17, 33])
def test_depths_around_the_layers_of_a_round(spark, depth):
    pairs = [(f"d{i}", f"d{i - 1}") for i in range(1, depth + 1)]
    got = {r["node"]: (r["root"], r["depth"]) for r in H.hierarchy(build(spark, pairs), paths=False).collect()}
    assert got == {f"d{i}": ("d0", i) for i in range(depth + 1)}
