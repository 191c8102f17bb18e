"""Containment of intervals without a join of all pairs of a document.

An interval of length up to 2^l stands in at most two cells of width 2^l, its level; what lies at a point is found by
looking up the one cell of each level that holds the point. So anchors make two rows at most and a point as many rows as
there are levels, and the join is one of equal keys, spread over cells even where one document holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of interval length: 2^4 to 2^40.
LEVELS = tuple(range(4, 41, 2))


def _level(length: Column) -> Column:
    out = F.lit(LEVELS[-1])
    for l in reversed(LEVELS[:-1]):
        out = F.when(length <= (1 << l), l).otherwise(out)
    return out


def covering(refs: DataFrame, anchors: DataFrame, document: str, order: list[Column], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Each row of refs (document, ref_id, start, stop) with the anchor (anchor_id, a_start, a_stop and more) first in `order` of those that hold it all, as struct `anchor`; null if none."""
    a = anchors.filter("a_stop >= a_start").withColumn("_l", _level(F.col("a_stop") - F.col("a_start")))
    width = F.pow(F.lit(2.0), F.col("_l")).cast("long")
    a = a.withColumn("_c", F.explode(F.array_distinct(F.array(F.floor(F.col("a_start") / width), F.floor(F.col("a_stop") / width)))))
    cells = F.array(*(F.struct(F.lit(l).alias("l"), F.floor(F.col("start") / (1 << l)).alias("c")) for l in levels))
    r = refs.withColumn("_x", F.explode(cells)).withColumn("_l", F.col("_x.l")).withColumn("_c", F.col("_x.c")).drop("_x")
    inner = [c for c in anchors.columns if c != document]
    hit = r.join(a, [document, "_l", "_c"]).filter("a_start <= start and a_stop >= stop")
    best = hit.groupBy(document, "ref_id").agg(F.min_by(F.struct(*inner), F.struct(*order)).alias("anchor"))
    return refs.join(best, [document, "ref_id"], "left")


#: Positions of a cell in which intervals are joined first.
CELL = 1 << 20


def islands(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Intervals of each key that touch or overlap, joined: keys, first, last, n.

    Intervals that begin in one cell of positions are joined there, and only then those of different cells, which are few
    against them: a key with a third of all rows is spread over its cells.
    """
    here = df.select(*keys, F.col(start).alias("first"), F.col(stop).alias("last"), F.lit(1).cast("long").alias("n"), F.floor(F.col(start) / CELL).alias("_cell"))
    return _joined(_joined(here, [*keys, "_cell"]).drop("_cell"), keys)


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    """One level of islands: keys, first, last, n."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reached.isNull() | (F.col("first") > reached)).cast("int"))
    marked = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_i")
