"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

A round peels the lowest HOPS layers of what is left. Beforehand each node has learned its nearest HOPS ancestors by
doubling, so that within a round it can send to all of them at once: its distance, from which they learn their height,
and its part of the subtree size, combined before the shuffle, so that a parent with very many children is no hot group.
Who hears of no descendant HOPS steps down is peeled, and sends its subtree's size, and its list of descendants where
these are asked for, on to the first ancestor that the round left. What no round can peel lies on a cycle.

Then the rounds are taken in reverse order of peeling: a node's first ancestor outside its own round was peeled later
and so has its root, depth and path already, from which the node gets its own; one whose ancestors all fell in its own
round ends at the last of them, a root; one whose way up ends in what was never peeled is below a cycle. A round's cost
is that of the nodes still waiting, and each writes its state to the shared folder, so plans stay short and a lost
executor costs one round at most. Only counts come to the driver. Layers are peeled HOPS at a time as a round costs a
second or two of scheduling whatever its size.

Defined results: null or blank ids are no nodes; a null or blank parent makes a root; repeated rows count once; a child
with several parents keeps the smallest id; a node that is its own parent is a cycle; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Scratch, norm_id

#: Layers peeled in a round, and ancestors a node knows beforehand; a power of two.
HOPS = 16


def nodes(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """node, parent (null for a root) for each distinct id of either column."""
    e = edges.select(norm_id(child).alias("node"), norm_id(parent).alias("parent"))
    return (
        e.union(e.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
        .filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )


def ancestors(all_nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, parent, up: the nearest HOPS ancestors, nearest first; fewer only where the root is reached. By doubling."""
    state = all_nodes.select("node", "parent", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("up"))
    n = 1
    while n < HOPS:
        more = state.filter(F.size("up") > 0).select(F.col("node").alias("last"), F.col("up").alias("further"))
        state = scratch.table(
            state.withColumn("last", F.when(F.size("up") == n, F.element_at("up", -1)))
            .join(more, "last", "left")
            .select("node", "parent", F.concat("up", F.coalesce("further", F.array().cast("array<string>"))).alias("up"))
        )
        n *= 2
    return state


def peel(tree: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The rounds in order of peeling, and the nodes that no round could peel, i.e. those of cycles.

    A round's columns: node, parent, up, height, size, inside (how many of its ancestors fell in the same round) and far,
    the first that did not (null if all did).
    """
    state, base, rounds = tree.withColumn("acc", F.lit(1).cast("long")), 0, []
    while True:
        sent = state.select(F.posexplode("up").alias("i", "to"), "acc").groupBy(F.col("to").alias("node")).agg(F.max("i").alias("i"), F.sum("acc").alias("s"))
        seen = state.join(sent, "node", "left").withColumn("h", F.coalesce(F.col("i") + 1, F.lit(0)))
        peeled, n, rest, waiting = scratch.split(seen.withColumn("out", F.col("h") < HOPS), "out")
        rest = rest.select("node", "parent", "up", "acc")
        if not n:
            break
        # heights only grow on the way up, so the ancestors in this round are the nearest ones
        same = peeled.select(F.col("node").alias("to"))
        inside = peeled.select("node", F.posexplode("up").alias("i", "to")).join(same, "to", "left_semi").groupBy("node").agg((F.max("i") + 1).alias("inside"))
        one = peeled.join(inside, "node", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
        one = one.select("node", "parent", "up", (F.col("h") + base).alias("height"), (F.col("acc") + F.coalesce("s", F.lit(0))).alias("size"), "inside", F.get("up", F.col("inside")).alias("far"))
        rounds.append(scratch.table(one) if waiting else one)
        if not waiting:
            break
        below = rounds[-1].filter("inside = 0 and far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("size").alias("b"))
        state = rest.join(below, "node", "left").select("node", "parent", "up", (F.col("acc") + F.coalesce("b", F.lit(0))).alias("acc"))
        base += HOPS
    return rounds, rest


def assigned(rounds: list[DataFrame], scratch: Scratch, paths: bool) -> list[DataFrame]:
    """root, depth and path of the rounds' nodes, in reverse order of peeling; below a cycle an empty root, -1 and null."""
    done: list[DataFrame] = []
    none = F.lit(None).cast("array<string>")
    for r, one in enumerate(reversed(rounds)):
        near = F.slice("up", 1, F.col("inside"))
        step = F.concat(F.reverse(near), F.array("node")) if paths else none
        top = F.when(F.col("inside") > 0, F.get("up", F.col("inside") - 1)).otherwise(F.col("node"))
        columns = ["node", "parent", "height", "size"]
        if not done:  # nothing was peeled later: ways that leave the round lead into a cycle
            ends = F.col("far").isNull()
            out = one.select(*columns, F.when(ends, top).otherwise("").alias("root"), F.when(ends, F.col("inside")).otherwise(-1).alias("depth"), F.when(ends, step).alias("path"))
        else:
            later = done[0]
            for d in done[1:]:
                later = later.unionByName(d)
            above = later.select(F.col("node").alias("far"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path").alias("p"))
            known = F.col("r").isNotNull() & (F.col("r") != "")
            out = one.join(above, "far", "left").select(
                *columns, F.when(F.col("far").isNull(), top).when(known, F.col("r")).otherwise("").alias("root"),
                F.when(F.col("far").isNull(), F.col("inside")).when(known, F.col("d") + F.col("inside") + 1).otherwise(-1).alias("depth"),
                F.when(F.col("far").isNull(), step).when(known, F.concat("p", step)).alias("path"),
            )
        done.append(scratch.table(out) if r + 1 < len(rounds) else out)
    return done


def hierarchy(edges: DataFrame, child: str = "concept_id", parent: str = "parent_id", paths: bool = True) -> DataFrame:
    """node, parent, root, depth, height, size of its subtree, and path (root first; only if `paths`).

    Nodes on a cycle or below one have an empty root, depth -1 and a null path; height and size are null on the cycle.
    """
    scratch = Scratch(edges.sparkSession, "hierarchy")
    rounds, cyclic = peel(ancestors(nodes(edges, child, parent), scratch), scratch)
    columns = ["node", "parent", "height", "size", "root", "depth", "path"]
    none = F.lit(None).cast("array<string>")
    out = cyclic.select("node", "parent", F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("size"), F.lit("").alias("root"), F.lit(-1).alias("depth"), none.alias("path"))
    for part in assigned(rounds, scratch, paths):
        out = out.union(part.select(*columns))
    return out if paths else out.drop("path")


def descendants(edges: DataFrame, child: str = "concept_id", parent: str = "parent_id") -> DataFrame:
    """ancestor, descendant, distance of every node that a root is above of; by lists sent upwards from round to round.

    A list is rows (to, descendant, distance). In its round a node adds itself and what was sent to it to the lists of its
    ancestors within the round, and sends both on to the first ancestor outside; nothing is gathered into one row.
    """
    scratch = Scratch(edges.sparkSession, "descendants")
    rounds, _ = peel(ancestors(nodes(edges, child, parent), scratch), scratch)
    sent = edges.sparkSession.createDataFrame([], "to string, descendant string, distance int")
    pairs = sent
    for one in rounds:
        place = one.select("node", "up", "inside", "far")
        arrived = sent.join(place, F.col("to") == F.col("node")).select("node", "up", "inside", "far", "descendant", "distance")
        rest = sent.join(place.select("node"), F.col("to") == F.col("node"), "left_anti")
        lists = place.select("*", F.col("node").alias("descendant"), F.lit(0).alias("distance")).unionByName(arrived)
        lists = scratch.table(lists)
        within = lists.select(F.posexplode(F.slice("up", 1, F.col("inside"))).alias("i", "to"), "descendant", "distance").select("to", "descendant", (F.col("distance") + F.col("i") + 1).alias("distance"))
        own = lists.filter("distance > 0").select(F.col("node").alias("to"), "descendant", "distance")
        pairs = pairs.unionByName(own).unionByName(within)
        sent = scratch.table(rest.unionByName(lists.filter("far is not null").select(F.col("far").alias("to"), "descendant", (F.col("distance") + F.col("inside") + 1).alias("distance"))))
    rooted = None
    for part in assigned(rounds, scratch, False):
        ok = part.filter("depth >= 0").select(F.col("node").alias("descendant"))
        rooted = ok if rooted is None else rooted.unionByName(ok)
    out = pairs if rooted is None else pairs.join(rooted, "descendant", "left_semi")
    return out.select(F.col("to").alias("ancestor"), "descendant", "distance")
