"""Packings hold every invariant, and fill as well as a plain best fit decreasing."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import packing


def plain(sizes, capacity):
    """Containers that best fit decreasing needs, item by item."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fit:
            r, k = min(fit)
            rooms[k] = r - s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def check(rows, sizes, capacities):
    largest = max(capacities.values())
    per, held, places = defaultdict(list), defaultdict(int), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        if r["container_id"] is not None:
            held[r["container_id"], r["container_name"]] += r["tokens"]
            places[r["container_id"]].append((r["position"], r["position"] + r["tokens"]))
    assert set(per) == set(sizes)
    for doc, n in sizes.items():
        parts = sorted(per[doc], key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in parts) == n
        assert len(parts) == max(1, -(-n // largest))
        assert [r["first_token"] for r in parts] == [k * largest for k in range(len(parts))]
        assert n or parts[0]["container_id"] is None
    assert all(n <= capacities[name] for (_, name), n in held.items())
    assert len({c for c, _ in held}) == len(held)
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return held


@pytest.mark.parametrize("capacities", [{"short": 50}, {"short": 50, "medium": 120, "long": 300}, {"one": 1}])
def test_invariants(spark, capacities):
    r = random.Random(3)
    sizes = {i: r.choice([0, 1, 7, 7, 7, r.randrange(60), r.randrange(400)]) for i in range(600)}
    items = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens int")
    held = check(packing.pack(items, "doc_id", capacities).collect(), sizes, capacities)
    if capacities == {"short": 50}:
        cut = [p for n in sizes.values() for p in [50] * (n // 50) + [n % 50] if p]
        assert len(held) == plain(cut, 50)


def test_joint_capacities_leave_no_more_than_any_alone():
    r = random.Random(9)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[r.randrange(1, 301)] += 1
    joint = packing.best_plan(dict(histogram), [50, 120, 300]).unused
    assert joint <= packing.Plan(dict(histogram), [300]).unused


def test_every_container_is_cut_down_to_its_contents(spark):
    items = spark.createDataFrame([(1, 250), (2, 20), (3, 20)], "doc_id long, tokens int")
    rows = packing.pack(items, "doc_id", {"short": 50, "long": 300}).collect()
    names = defaultdict(set)
    for x in rows:
        names[x["container_id"]].add(x["container_name"])
    assert all(len(n) == 1 for n in names.values())
    assert sum({"short": 50, "long": 300}[next(iter(n))] for n in names.values()) <= 350


def test_empty_tables_zero_sizes_and_no_capacity(spark):
    items = spark.createDataFrame([(1, 0), (2, 5)], "doc_id long, tokens int").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(1))
    assert packing.pack(items.limit(0), "doc_id", {"a": 9}).count() == 0
    assert packing.pack(items.filter("tokens = 0"), "doc_id", {"a": 9}).collect()[0]["container_id"] is None
    assert packing.pack(items, "doc_id", {}).count() == 2


def test_one_size_of_all_items(spark):
    items = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(7).alias("tokens"))
    out = packing.pack(items, "doc_id", {"a": 50})
    assert out.select("container_id", "position").distinct().count() == 30_000 and out.agg(F.max("container_id")).first()[0] == -(-30_000 // 7) - 1
