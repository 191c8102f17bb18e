"""Long exact spans shared between records, and fuzzy passages around them, by collinear chaining.

Seeds. Each window of SPAN characters is represented by the least k-mer hash within it (its minimizer), so two records
that share a stretch of SPAN characters share a seed there. Windows in a row with one minimizer make a run; runs are
grouped by seed, and within it by their content, with the least and greatest source of each group: linear in the
number of runs, combined before the shuffle, whatever the size of a group. Contents of a seed seen in two sources match
as a whole. Where a seed has several contents, one run of each is expanded to its windows, which are grouped alike.

Matches. A stretch seen in another source is joined to one representative occurrence there, the least or the greatest
by source, never to all of them. A record's matches are thus bounded by its own length.

Chains. A record's matches with one partner are chained in order of position: the best predecessor under a linear cost of
gaps comes from a Fenwick tree over the partner's positions, and chains are taken off from the best score downwards
until every match is in one. Chains are the fuzzy passages; aligned, they get an identity. The exact spans are the
matched stretches of the chains, which together cover just the characters in question.

Equality is by hashes of 64 bits within one seed, another 64: unequal contents or windows would have to agree in both.

Defined results: a null source counts as a source of its own; null, empty and short texts have no spans; repeated rows
count once; ids are compared trimmed and in lower case.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.chars import Rolling, codes, pieces
from lodestrata.session import Scratch, norm_id, spread

#: Length of a k-mer; a window of `span` characters holds span - K + 1 of them.
K = 64
#: Cost of a gap between two matches of a chain, per character skipped (of both sides the average), against a gain of 1 per matched character.
GAP = 0.5
#: Characters of the pieces that matches are chained in: what an overlap of two matches may cost a chain at most.
PIECE = 16


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` values in a row, by doubling."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(texts: list[str], span: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with one minimizer: text, start and stop (of window positions in the text), seed and hash of the run's content."""
    code, off = codes(texts)
    hashed = Rolling(code)
    none = {"text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "stop": np.zeros(0, np.int64), "seed": np.zeros(0, np.uint64), "content": np.zeros(0, np.uint64)}
    if len(code) < span:
        return none
    least = sliding_min(hashed.windows(k), span - k + 1)
    n = len(least)
    owner = np.repeat(np.arange(len(texts)), np.diff(off))[:n]
    whole = np.arange(n) + span <= off[owner + 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    ends = np.flatnonzero(whole & ~np.append(whole[1:] & ~first[1:], False)) + 1
    return {"text": owner[start], "start": start - off[owner[start]], "stop": ends - off[owner[start]], "seed": least[start], "content": hashed.of(start, ends + span - 1)}


def _run_table(texts: DataFrame, span: int, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column(2).to_pylist()
            for i, j in pieces(ts):
                r = runs(ts[i:j], span, k)
                at = pa.array(r["text"] + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(r["seed"].view(np.int64)), pa.array(r["content"].view(np.int64)), pa.array(r["start"].astype(np.int32)), pa.array(r["stop"].astype(np.int32))],
                    names=["rec", "src", "seed", "content", "start", "stop"],
                )

    return spread(texts.select("rec", "src", "text")).mapInArrow(work, "rec long, src long, seed long, content long, start int, stop int")


def _window_table(expanded: DataFrame, span: int) -> DataFrame:
    """The windows of runs (seed, content, lo, hi, start, stop, text): hash of each with the run's columns and its offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            start, stop = col["start"].to_numpy(), col["stop"].to_numpy()
            ts = [t[i : j + span - 1] for t, i, j in zip(col["text"].to_pylist(), start, stop)]
            for i, j in pieces(ts):
                code, off = codes(ts[i:j])
                h = Rolling(code).windows(span)
                n = stop[i:j] - start[i:j]
                row = np.repeat(np.arange(j - i), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[off[row] + offset].view(np.int64)), *(col[c].take(at) for c in ("seed", "content", "lo", "hi")), pa.array(offset.astype(np.int32)), pa.array((start[row + i] + offset).astype(np.int32))],
                    names=["window", "seed", "content", "lo", "hi", "offset", "pos"],
                )

    occurrence = "struct<src:bigint,rec:bigint,start:int>"
    return expanded.select("seed", "content", "lo", "hi", "start", "stop", "text").mapInArrow(work, f"window long, seed long, content long, lo {occurrence}, hi {occurrence}, offset int, pos int")


def matches(records: DataFrame, span: int, scratch: Scratch, k: int = K) -> DataFrame:
    """rec, start, length, partner, partner_start: the stretches of each record (rec, src, text; rec unique) that a record of another source has too."""
    table = scratch.table(_run_table(records, span, k))
    occurrence = F.struct("src", "rec", "start")
    contents = scratch.table(table.groupBy("seed", "content").agg(F.min(occurrence).alias("lo"), F.max(occurrence).alias("hi"), F.min(F.struct("rec", "start", "stop")).alias("one")))
    seeds = contents.groupBy("seed").agg(F.count("*").alias("n"), F.min("lo.src").alias("least"), F.max("hi.src").alias("most"), F.count_if(F.col("lo.src") == F.col("hi.src")).alias("open"))
    shared = seeds.filter("least <> most")

    def other(own, lo, hi):
        return F.when(F.col(own) == F.col(f"{lo}.src"), F.col(hi)).otherwise(F.col(lo))

    whole = contents.filter("lo.src <> hi.src").select("seed", "content", "lo", "hi")
    full = table.join(whole, ["seed", "content"]).withColumn("p", other("src", "lo", "hi")).select(
        "rec", "start", (F.col("stop") - F.col("start") + span - 1).alias("length"), F.col("p.rec").alias("partner"), F.col("p.start").alias("partner_start")
    )
    # seeds with several contents, one of them at least in a single source: their windows tell
    torn = contents.join(shared.filter("n > 1 and open > 0").select("seed"), "seed", "left_semi")
    texts = records.select("rec", "text")
    windows = _window_table(torn.select("seed", "content", "lo", "hi", "one.rec", "one.start", "one.stop").join(texts, "rec"), span)
    windows = scratch.table(windows)
    shift = lambda side: F.struct(F.col(f"{side}.src").alias("src"), F.col(f"{side}.rec").alias("rec"), (F.col(f"{side}.start") + F.col("offset")).alias("start"))
    # a window's seed is a function of its content: with it in the key, only windows of one seed could be taken for one another
    grouped = windows.groupBy("seed", "window").agg(F.min(shift("lo")).alias("a"), F.max(shift("hi")).alias("z")).filter("a.src <> z.src")
    found = windows.filter("lo.src = hi.src").join(grouped, ["seed", "window"]).select("seed", "content", F.col("lo.src").alias("src"), "offset", "a", "z").withColumn("p", other("src", "a", "z"))
    # windows in a row on one diagonal are one match
    step = found.select("seed", "content", "offset", F.col("p.rec").alias("partner"), (F.col("p.start") - F.col("offset")).alias("shift"))
    stretches = step.groupBy("seed", "content", "partner", "shift").agg(F.array_sort(F.collect_list("offset")).alias("at"))
    single = table.join(contents.filter("lo.src = hi.src").select("seed", "content"), ["seed", "content"], "left_semi")
    parts = single.join(stretches, ["seed", "content"]).select("rec", "start", "partner", "shift", F.explode(_islands(F.col("at"))).alias("i"))
    partial = parts.select("rec", (F.col("start") + F.col("i.first")).alias("start"), (F.col("i.last") - F.col("i.first") + span).alias("length"), "partner", (F.col("shift") + F.col("i.first")).alias("partner_start"))
    return full.unionByName(partial)


def _islands(at):
    """first, last of each run of consecutive numbers in a sorted array (a run has at most span - K + 1)."""
    grow = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] == x - 1),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), x.alias("last")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("first"), x.alias("last")))))
    return F.aggregate(at, F.array().cast("array<struct<first:int,last:int>>"), grow)


# ---- chaining ----


class Fenwick:
    """Greatest value at positions up to a bound, with updates."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Of positions 0 to i."""
        i, out = i + 1, (-1e18, -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


Match = tuple[int, int, int]


def merged(rows: list[Match]) -> list[Match]:
    """Matches (start, partner start, length) that touch or overlap on one diagonal, joined."""
    out: list[list[int]] = []
    for a, b, n in sorted(rows, key=lambda r: (r[1] - r[0], r[0])):
        if out and b - a == out[-1][1] - out[-1][0] and a <= out[-1][0] + out[-1][2]:
            out[-1][2] = max(out[-1][2], a + n - out[-1][0])
        else:
            out.append([a, b, n])
    return sorted((a, b, n) for a, b, n in out)


def cut(rows: list[Match], size: int) -> list[Match]:
    """Matches in pieces of at most `size` characters, in order of start."""
    return sorted((a + i, b + i, min(size, n - i)) for a, b, n in rows for i in range(0, n, size))


def chain(rows: list[Match], gap: float = GAP, piece: int = PIECE) -> list[tuple[float, list[Match]]]:
    """Chains of matches (start, partner start, length), best first.

    Matches are cut into pieces of `piece` characters, and a chain is of pieces that follow one another without overlap on
    both sides; so where two matches overlap, a chain may leave the one for the other at any piece. A piece gains its
    length, a gap costs `gap` for each character skipped, both sides averaged. As that cost is linear in the ends, the
    best predecessor is the greatest score + gap * (end + partner end) / 2 among the pieces that end before it on both
    sides: those that end in the record are put into a Fenwick tree over their ends in the partner as the sweep passes
    them. The first chain is the best of all; the next are taken off the same tree of predecessors, down to pieces that
    are taken already, so that every piece is in one chain and the whole costs one sweep. In a chain, pieces that touch
    on one diagonal are one match again.
    """
    parts = cut(merged(rows), piece)
    ends = sorted({b + n for _, b, n in parts})
    place = {e: i for i, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, before = [0.0] * len(parts), [-1] * len(parts)
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    done = 0
    for i, (a, b, n) in enumerate(parts):
        while done < len(parts) and sum(parts[by_end[done]][::2]) <= a:
            j = by_end[done]
            x, y, m = parts[j]
            tree.put(place[y + m], (score[j] + gap * (x + m + y + m) / 2, j))
            done += 1
        score[i] = float(n)
        to = bisect_right(ends, b) - 1
        value, j = tree.get(to) if to >= 0 else (-1e18, -1)
        if j >= 0 and value - gap * (a + b) / 2 > 0:
            score[i], before[i] = n + value - gap * (a + b) / 2, j
    taken, chains = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda q: (-score[q], q)):
        if taken[i]:
            continue
        picked, j = [], i
        while j >= 0 and not taken[j]:
            taken[j] = True
            picked.append(parts[j])
            j = before[j]
        earned = score[i] - (score[j] if j >= 0 else 0.0)
        chains.append((earned, merged(picked)))
    return sorted(chains, key=lambda c: -c[0])


def _grouped(found: DataFrame) -> DataFrame:
    """One row per record with its matches, as many as it has runs at most."""
    return found.groupBy("rec").agg(F.collect_list(F.struct("partner", "start", "partner_start", "length")).alias("m"))


def _chains(m) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
    by: dict[int, list[tuple[int, int, int]]] = {}
    for r in m:
        by.setdefault(r["partner"], []).append((r["start"], r["partner_start"], r["length"]))
    for partner in sorted(by):
        for score, links in chain(by[partner]):
            yield partner, score, links


def exact_spans(found: DataFrame) -> DataFrame:
    """rec, span_start, span_end: the longest runs of covered characters, from the exact stretches of all chains."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec, m in zip(b["rec"], b["m"]):
                cover = sorted((a, a + n) for _, _, links in _chains(m) for a, _, n in links)
                start, end = cover[0]
                for a, z in cover[1:]:
                    if a > end:
                        out.append((rec, start, end))
                        start, end = a, z
                    else:
                        end = max(end, z)
                out.append((rec, start, end))
            yield pd.DataFrame(out, columns=["rec", "span_start", "span_end"])

    return _grouped(found).mapInPandas(work, "rec long, span_start long, span_end long")


def chains(found: DataFrame) -> DataFrame:
    """rec, partner, chain (from 0, best first), score, start, stop, partner_start, partner_stop, matched, n_matches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, last = [], None
            for rec, m in zip(b["rec"], b["m"]):
                k = 0
                for partner, score, links in _chains(m):
                    k = k + 1 if (rec, partner) == last else 0
                    last = (rec, partner)
                    (a, x, _), (z, y, n) = links[0], links[-1]
                    out.append((rec, partner, k, score, a, z + n, x, y + n, sum(q for _, _, q in links), len(links)))
            yield pd.DataFrame(out, columns=["rec", "partner", "chain", "score", "start", "stop", "partner_start", "partner_stop", "matched", "n_matches"])

    return _grouped(found).mapInPandas(work, "rec long, partner long, chain int, score double, start long, stop long, partner_start long, partner_stop long, matched long, n_matches int")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two texts, after common ends are cut; the smaller side is one row of numpy."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = (a[:-j], b[:-j]) if j else (a, b)
    if len(a) > len(b):
        a, b = b, a
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.arange(len(x) + 1)
    ramp = np.arange(len(x) + 1)
    for j, c in enumerate(b, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (x != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[j], step]) - ramp) + ramp
    return int(row[-1])


def passages(chained: DataFrame, texts: DataFrame) -> DataFrame:
    """The chains with `identity`, the share of characters that agree in the alignment of both passages; texts: rec, text."""
    a = texts.select("rec", F.col("text").alias("text_a"))
    b = texts.select(F.col("rec").alias("partner"), F.col("text").alias("text_b"))
    part = lambda t, i, j: F.expr(f"substring({t}, cast({i} + 1 as int), cast({j} - {i} as int))")
    both = chained.join(a, "rec").join(b, "partner").withColumn("x", part("text_a", "start", "stop")).withColumn("y", part("text_b", "partner_start", "partner_stop")).drop("text_a", "text_b")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["identity"] = [round(1 - edit_distance(x, y) / max(len(x), len(y), 1), 6) for x, y in zip(p["x"], p["y"])]
            yield p.drop(columns=["x", "y"])

    columns = [f"{n} {t}" for n, t in both.dtypes if n not in ("x", "y")]
    return both.mapInPandas(work, ", ".join(columns) + ", identity double")


def records(rows_: DataFrame, key: str, source: str, text: str, span: int) -> DataFrame:
    """id, rec, src, text of the rows long enough; a repeated row counts once."""
    base = rows_.select(norm_id(key).alias("id"), F.xxhash64(F.coalesce(norm_id(source), F.lit(""))).alias("src"), F.col(text).alias("text"))
    return base.filter(F.col("id").isNotNull() & (F.length("text") >= span)).withColumn("rec", F.xxhash64("id"))
