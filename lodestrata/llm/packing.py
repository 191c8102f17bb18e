"""Filling containers of fixed capacity with items, by variable-capacity best fit over the histogram of sizes.

Sizes are whole numbers up to the largest capacity, so their histogram is bounded whatever the number of items; it alone
comes to the driver. Best fit decreasing runs there on whole runs of alike containers at once: items of one size go to the
open containers with the least room that still takes them; where none does, the permitted capacity of least cost, the
smallest that holds the item, is opened. Of all choices of permitted capacities the one that leaves least unused is
kept, and in the end every container is cut down to the smallest permitted capacity that holds its contents. The result
is a short list of placements by size and rank; items get their rank within their size over (size, bucket) groups of
bounded size, and look up their place in the broadcast list.

Defined results: an item larger than the largest permitted capacity is cut into pieces of that capacity and a rest, no
other item is cut; an item without tokens (null or empty text) takes no space and has no container (null); capacities
that are null or not positive are ignored; without any, every item is without a container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Items of one size and bucket that are ranked in one task, about.
RANKED = 20_000


class Plan:
    """Best fit of a histogram {size: count} into containers of the given capacities."""

    def __init__(self, histogram: dict[int, int], capacities: list[int]):
        self.capacities = sorted(capacities)
        self.placements: list[tuple[int, int, int, int, int, int]] = []  # size, first rank, items, first container, items a container, offset
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # room: (first container, containers, capacity opened)
        self.rooms: list[int] = []
        self.containers = 0
        for size in sorted(histogram, reverse=True):
            self._place(size, histogram[size])
        runs = sorted((first, n, self._fit(cap - room)) for room, held in self.open.items() for first, n, cap in held)
        self.first = np.array([r[0] for r in runs], np.int64)
        self.capacity = np.array([r[2] for r in runs], np.int64)
        self.unused = sum(n * c for _, n, c in runs) - sum(s * n for s, n in histogram.items())

    def _fit(self, content: int) -> int:
        return self.capacities[bisect_left(self.capacities, content)]

    def _keep(self, room: int, first: int, n: int, capacity: int) -> None:
        if n:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n, capacity))

    def _place(self, size: int, count: int) -> None:
        rank = 0
        while count:
            at = bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, n, capacity = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
            else:
                room = capacity = self._fit(size)
                first, n = self.containers, -(-count // (capacity // size))
                self.containers += n
            each = room // size
            full = min(n, count // each)
            rest = count - full * each if full < n else 0  # of one more container, filled in part
            used = full + (rest > 0)
            placed = full * each + rest
            self.placements.append((size, rank, placed, first, each, capacity - room))
            self._keep(room - each * size, first, full, capacity)
            if rest:
                self._keep(room - rest * size, first + full, 1, capacity)
            self._keep(room, first + used, n - used, capacity)
            rank, count = rank + placed, count - placed

    def lookup(self) -> dict[str, np.ndarray]:
        p = np.array(self.placements, np.int64).reshape(-1, 6)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        return {"key": p[:, 0] << 44 | p[:, 1], "rank": p[:, 1], "container": p[:, 3], "each": p[:, 4], "offset": p[:, 5], "first": self.first, "capacity": self.capacity}


def best_plan(histogram: dict[int, int], capacities: list[int]) -> Plan:
    """The plan of least unused space over all choices of capacities that include the largest; fewer capacities break ties."""
    *small, largest = sorted(set(capacities))
    choices = [[*c, largest] for k in range(len(small) + 1) for c in combinations(small, k)]
    return min((Plan(histogram, c) for c in choices), key=lambda p: (p.unused, len(p.capacities)))


def pieces(items: DataFrame, key: str, largest: int) -> DataFrame:
    """key, piece, first_token, size: items whole, or cut if larger than `largest`; those without tokens are left out."""
    n = F.ceil(F.col("tokens") / largest).cast("int")
    return (
        items.filter("tokens > 0")
        .select(key, "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .select(key, "piece", (F.col("piece") * largest).cast("int").alias("first_token"), F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).cast("int").alias("size"))
    )


def pack(items: DataFrame, key: str, capacities: dict[str, int]) -> DataFrame:
    """container_name, container_id, key, piece, first_token, tokens, position of each item or piece. items: key, tokens; must be cheap to read twice."""
    spark = items.sparkSession
    schema = f"container_name string, container_id long, {key} {dict(items.dtypes)[key]}, piece int, first_token int, tokens int, position int"
    none = items.filter("tokens = 0" if capacities else "true").select(
        F.lit(None).cast("string").alias("container_name"), F.lit(None).cast("long").alias("container_id"), key, F.lit(0).alias("piece"), F.lit(0).alias("first_token"), "tokens", F.lit(None).cast("int").alias("position")
    )
    if not capacities:
        return none
    cut = pieces(items, key, max(capacities.values()))
    sizes = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return none
    held = spark.sparkContext.broadcast(best_plan(sizes, list(capacities.values())).lookup())
    names = {c: n for n, c in sorted(capacities.items(), reverse=True)}
    buckets = max(16, sum(sizes.values()) // RANKED)
    parted = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = parted.withColumn("nth", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "piece"))).join(counts, ["size", "bucket"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        names_of = np.array([names[c] for c in sorted(names)], object)
        for b in batches:
            rank = b["rank"].to_numpy(np.int64)
            size = b["size"].to_numpy(np.int64)
            at = np.searchsorted(p["key"], size << 44 | rank, "right") - 1
            nth = rank - p["rank"][at]
            container = p["container"][at] + nth // p["each"][at]
            capacity = p["capacity"][np.searchsorted(p["first"], container, "right") - 1]
            yield pd.DataFrame(
                {
                    "container_name": names_of[np.searchsorted(np.array(sorted(names)), capacity)], "container_id": container, key: b[key], "piece": b["piece"], "first_token": b["first_token"],
                    "tokens": b["size"], "position": (p["offset"][at] + nth % p["each"][at] * size).astype(np.int32),
                }
            )

    return ranked.select(key, "piece", "first_token", "size", (F.col("start") + F.col("nth") - 1).alias("rank")).mapInPandas(place, schema).unionByName(none)
