"""Near-duplicate texts with small edits: DartMinHash signatures, banded joining, exact verification.

Every element of a text's set (its distinct word shingles, or elements with weights) throws hashed darts: in each unit
cell of rank one dart for each unit of its weight, with a rank within the cell and a coordinate of the signature. A
coordinate keeps its earliest dart. As the darts of an element depend on nothing else, two sets agree in a coordinate
with the probability of their (weighted) Jaccard similarity; and as cells are thrown in order of rank only until every
coordinate has a dart, a text costs about K ln K darts however many elements it has, not K for each of them. BANDS of
ROWS coordinates each make the keys on which texts are joined; pairs that meet are verified on their whole shingle sets.

Equal texts are one class in the join, so a group of copies, however large, meets others once. `classes` gives each record
its class, the class's first record and its number of copies, `class_pairs` the pairs of first records: together they hold
every link and every member at any size, in as many rows as there are records and links. `near_duplicates` lists pairs of
records: all of them with `copies=None`; else, where a class has more than `copies` records, each of these is paired with
the class's first, which alone carries the links to other classes; who wants them all joins with `classes`.

Band keys that one text alone has, by far the most, are dropped where they are counted; of the rest, a key's texts are cut
into blocks of HOT, and blocks meet blocks, so that a key that very many texts share is no single task.

Defined results: null ids, null, empty and short texts are no cases; repeated rows count once. Classes are told apart by
MD5, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.chars import Rolling, codes, mix, pieces, words
from lodestrata.session import Scratch, norm_id, spread

#: A pair at the threshold of 0.6 meets in one band at least with probability 0.994, at 0.65 with 0.9996.
BANDS, ROWS = 64, 5
#: Records of one text up to which p4_found lists their pairs one by one (near_duplicates: any number, or None for all).
COPIES = 1000
#: Texts of one band key in a block of the join.
HOT = 2000
#: Bytes of band keys in a task, about.
TASK = 16 << 20

_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]  # fixed odd multipliers


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of `size` consecutive words of each text, in lower case: hashes, where each text's begin (one more entry than texts), and numbers of words."""
    code, off = codes([t.lower() for t in texts])
    start, stop, doc = words(code, off)
    h = Rolling(code).of(start, stop)
    n_words = np.bincount(doc, minlength=len(texts))
    n = max(0, len(h) - size + 1)
    g = np.zeros(n, np.uint64)
    for k in range(size):
        g = mix(g * _ODD[0] + h[k : k + n] * _ODD[1 + k % 4])
    inside = doc[:n] == doc[size - 1 : size - 1 + n]
    g, doc = g[inside], doc[:n][inside]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[first], doc[first]
    return g, np.searchsorted(doc, np.arange(len(texts) + 1)), n_words


def dart_minhash(elements: np.ndarray, begins: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (sets, k) of sets of 64-bit elements laid end to end; an empty set's is all ones.

    weights: of each element, in units; a unit layer of an element throws its own darts, a last part of a layer keeps those that fall into it.
    """
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    part = None
    if weights is not None:
        layers = np.ceil(weights).astype(np.int64)
        nth = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        part = np.minimum(1.0, np.repeat(weights, layers) - nth)
        elements, owner = mix(np.repeat(elements, layers) + nth.astype(np.uint64) * _ODD[2]), np.repeat(owner, layers)
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * k, never, np.uint64)
    left = np.where(np.bincount(owner, minlength=n) > 0, k, 0)  # coordinates without a dart
    base = owner * k
    rank = 0
    while len(elements):
        if rank > 0xFFFF:
            raise ValueError("weights too small: multiply all of them by one factor")
        h = mix(elements + np.uint64((rank + 1) * int(_ODD[3]) % (1 << 64)))
        at = base + ((h & np.uint64(0xFFFF)) * np.uint64(k) >> np.uint64(16)).astype(np.int64)
        fresh = sig[at] == never  # darts of earlier cells come before all of this one
        if part is not None:
            fresh &= (mix(h ^ _ODD[4]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part
        at, key = at[fresh], np.uint64(rank << 48) | (h[fresh] >> np.uint64(16))
        np.minimum.at(sig, at, key)
        left -= np.bincount(np.unique(at) // k, minlength=n)
        rank += 1
        if rank % 4 == 0:
            alive = left[base // k] > 0
            if not alive.all():
                elements, base = elements[alive], base[alive]
                part = part[alive] if part is not None else None
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of 64-bit keys; the band's number is hashed in."""
    s = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[0], (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * _ODD[1] + s[:, :, r])
    return key


def keyed(texts: DataFrame, least_words: int, size: int, bands: int, rows: int) -> DataFrame:
    """key, cls for every band of every text (cls, text) of at least `least_words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # copies within a batch are keyed once: combined before the shuffle
            cls, at = np.unique(np.array(b.column(0).to_pylist(), object), return_index=True)
            ts = b.column(1).take(pa.array(at)).to_pylist()
            for i, j in pieces(ts, 500_000):
                g, begins, n = shingles(ts[i:j], size)
                enough = np.flatnonzero(n >= least_words)
                if not len(enough):
                    continue
                keep = np.repeat(n >= least_words, np.diff(begins))
                begins = np.concatenate([[0], np.cumsum(np.diff(begins)[enough])])
                key = band_keys(dart_minhash(g[keep], begins, bands * rows), bands, rows)
                c = np.repeat(cls[i:j][enough], bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(c, pa.binary())], names=["key", "cls"])

    return spread(texts.select("cls", "text")).mapInArrow(run, "key long, cls binary")


def verified(pairs: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose shingle sets have a Jaccard similarity of at least `least`, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            sims = []
            for i, j in pieces([s + t for s, t in zip(x, y)], 500_000):
                m = j - i
                g, begins, _ = shingles(x[i:j] + y[i:j], size)
                sizes = np.diff(begins)
                pair = np.repeat(np.concatenate([np.arange(m), np.arange(m)]), sizes)
                order = np.lexsort((g, pair))
                g, pair = g[order], pair[order]
                both = np.bincount(pair[1:][(g[1:] == g[:-1]) & (pair[1:] == pair[:-1])], minlength=m)
                sims.append(both / np.maximum(sizes[:m] + sizes[m:] - both, 1))
            sim = np.concatenate(sims) if sims else np.zeros(0)
            keep = sim >= least - 1e-12
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(sim[keep])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def similar_texts(texts: DataFrame, least: float = 0.8, size: int = 5, least_words: int = 1, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a, b (a < b), similarity: the pairs of different texts (cls, text; equal texts share cls and may repeat)."""
    spark = texts.sparkSession
    # as many tasks as the keys' bytes ask for, however few the session's default: an average text has some 250 bytes
    read = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read * bands * 24 // 250 // TASK) if read < 1 << 60 else 0)
    # one shuffle by key serves the removal of repeats and the counts; keys of one text go no further
    keys = keyed(texts, least_words, size, bands, rows).repartition(parts, "key").dropDuplicates(["key", "cls"])
    met = keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    met = Scratch(spark, "bands").table(met)  # few rows, read by both sides
    blocks = F.ceil(F.col("n") / HOT).cast("int")
    a = met.select("key", F.col("cls").alias("a"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    b = met.select("key", F.col("cls").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    pairs = a.join(b, ["key", "block"]).filter("a < b").select("a", "b").distinct()
    one = texts.select("cls", "text").dropDuplicates(["cls"])
    pairs = pairs.join(one.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(one.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return verified(pairs, least, size)


def based(rows_: DataFrame, key: str, text: str, least_words: int = 1) -> DataFrame:
    """id, text, cls of the rows that may be cases. A text of n words has at least 2n - 1 characters; classes are of equal texts."""
    base = rows_.select(norm_id(key).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1))
    return base.withColumn("cls", F.unhex(F.md5("text")))


def classes(base: DataFrame) -> DataFrame:
    """cls, id of each record, with its class's first record and number of records."""
    members = base.groupBy("cls", "id").agg(F.lit(1).alias("_")).select("cls", "id")
    count = members.groupBy("cls").agg(F.count("*").alias("n_copies"), F.min("id").alias("first"))
    return members.join(count, "cls")


def class_pairs(base: DataFrame, least: float = 0.8, size: int = 5, least_words: int = 1) -> DataFrame:
    """a, b (classes), id_a, id_b (their first records, the smaller first), similarity of every two classes that are alike."""
    pairs = Scratch(base.sparkSession, "neardup").table(similar_texts(base, least, size, least_words))
    first = base.groupBy("cls").agg(F.min("id").alias("first"))
    both = pairs.join(first.select(F.col("cls").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("cls").alias("b"), F.col("first").alias("y")), "b")
    return both.filter("x <> y").select("a", "b", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def near_duplicates(rows_: DataFrame, key: str, text: str, least: float = 0.8, size: int = 5, least_words: int = 1, copies: int | None = COPIES) -> DataFrame:
    """id_a, id_b (the smaller first), similarity: pairs of different records of which the texts are at least `least` alike.

    copies: records of one text beyond which they are paired with the first alone; None lists every pair.
    """
    base = based(rows_, key, text, least_words)
    scratch = Scratch(rows_.sparkSession, "neardup")
    pairs = scratch.table(similar_texts(base, least, size, least_words))
    members = classes(base)
    few = F.lit(True) if copies is None else F.col("n_copies") <= copies
    linked = members.filter(few | (F.col("id") == F.col("first"))).select("cls", "id")
    a, b = linked.select(F.col("cls").alias("a"), F.col("id").alias("x")), linked.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.join(a, "a").join(b, "b").select("x", "y", "similarity")
    # equal texts: all pairs of few copies, else each with the first
    several = members.filter("n_copies > 1")
    left = several.filter(few).select("cls", F.col("id").alias("x"))
    many = several.filter(~few & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"), "cls")
    within = left.join(left.withColumnRenamed("x", "y"), "cls").filter("x < y").select("x", "y", "cls").unionByName(many)
    enough = _enough(base.join(several.select("cls").distinct(), "cls", "left_semi").select("cls", "text").dropDuplicates(["cls"]), least_words)
    equal = within.join(enough, "cls", "left_semi").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").filter("id_a < id_b").distinct()


def members(rows_: DataFrame, key: str, text: str, least_words: int = 1) -> DataFrame:
    """id, class_id (the class's first record), n_copies of every record with at least `least_words` words."""
    base = based(rows_, key, text, least_words)
    enough = _enough(base.select("cls", "text").dropDuplicates(["cls"]), least_words)
    return classes(base).join(enough, "cls", "left_semi").select("id", F.col("first").alias("class_id"), "n_copies")


def _enough(texts: DataFrame, least_words: int) -> DataFrame:
    """cls of the texts of at least so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, off = codes([t.lower() for t in b.column(1).to_pylist()])
            n = np.bincount(words(code, off)[2], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(n >= least_words))], names=["cls"])

    return texts.select("cls", "text").mapInArrow(run, "cls binary")
