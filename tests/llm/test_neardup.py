"""Near duplicates against brute force; the signatures' agreement against the true similarity."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import neardup as N


def brute(rows, least, size, words):
    sets = {}
    for k, t in rows:
        if k is None or not k.strip() or t is None:
            continue
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= words:
            sets[k.strip().lower()] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randrange(25, 90))]
        out.append(" ".join(base))
        for _ in range(r.randrange(3)):
            edit = list(base)
            for _ in range(r.randrange(1, 4)):
                i = r.randrange(len(edit))
                r.choice([lambda: edit.pop(i), lambda: edit.insert(i, r.choice(vocabulary)), lambda: edit.__setitem__(i, r.choice(vocabulary))])()
            out.append(r.choice([", ", " ", "\n"]).join(edit).upper())
    return out


def test_pairs_of_edited_texts(spark):
    rows = [(f"A{i}", t) for i, t in enumerate(texts(80, 2))]
    rows += [("copy1", rows[0][1]), (" COPY2 ", rows[0][1]), ("copy2", rows[0][1]), ("null", None), ("empty", ""), (None, rows[0][1]), ("short", "a b c"), ("long", rows[1][1] + " x" * 30000)]
    df = spark.createDataFrame(rows, "anchor_id string, exact_text string").withColumn("cls", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("text", F.lit("t"))
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df, "anchor_id", "exact_text", 0.6, 3, 25).collect()}
    assert got == brute(rows, 0.6, 3, 25)


def test_large_groups_of_copies_are_whole_by_classes_and_by_pairs(spark):
    base = texts(1, 7)[0]
    edited = base + " one more"
    for n in (33, 320):
        rows = [(f"c{i:03d}", base) for i in range(n)] + [("e", edited), ("f", edited), ("g", "a b c")]
        df = spark.createDataFrame(rows, "anchor_id string, exact_text string")
        got = {(r["id"], r["class_id"], r["n_copies"]) for r in N.members(df, "anchor_id", "exact_text", 25).collect()}
        assert got == {(f"c{i:03d}", "c000", n) for i in range(n)} | {("e", "e", 2), ("f", "e", 2)}
        pairs = N.class_pairs(N.based(df, "anchor_id", "exact_text", 25), 0.6, 3, 25).collect()
        assert [(r["id_a"], r["id_b"]) for r in pairs] == [("c000", "e")]
        every = {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df, "anchor_id", "exact_text", 0.6, 3, 25, copies=None).collect()}
        ids = [k for k, t in rows if t != "a b c"]
        assert every == {(a, b) for a in ids for b in ids if a < b}
    few = {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df, "anchor_id", "exact_text", 0.6, 3, 25, copies=32).collect()}
    assert few == {("c000", f"c{i:03d}") for i in range(1, 320)} | {("c000", "e"), ("c000", "f"), ("e", "f")}


def test_hot_keys_meet_in_blocks(spark, monkeypatch):
    rows = [(f"A{i}", t) for i, t in enumerate(texts(30, 5))]
    df = spark.createDataFrame(rows, "anchor_id string, exact_text string")
    want = brute(rows, 0.6, 3, 25)
    monkeypatch.setattr(N, "HOT", 1)
    assert {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df, "anchor_id", "exact_text", 0.6, 3, 25).collect()} == want


def test_weights_too_light_for_darts_are_refused():
    import pytest

    with pytest.raises(ValueError):
        N.dart_minhash(np.array([5], np.uint64), np.array([0, 1]), 64, np.array([1e-5]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "anchor_id string, exact_text string")
    assert N.near_duplicates(df, "anchor_id", "exact_text", 0.6, 3, 25).count() == 0


def test_agreement_estimates_the_similarity():
    r = np.random.default_rng(1)
    for shared, own in ((60, 20), (30, 60), (90, 5)):
        a, b, c = (r.integers(0, 2**63, n).astype(np.uint64) for n in (shared, own, own))
        sets = [np.concatenate([a, b]), np.concatenate([a, c])]
        sig = N.dart_minhash(np.concatenate(sets), np.array([0, shared + own, 2 * (shared + own)]), 2048)
        assert abs((sig[0] == sig[1]).mean() - shared / (shared + 2 * own)) < 0.05
        assert not (sig == np.uint64(0xFFFFFFFFFFFFFFFF)).any()


def test_weights_count_as_mass():
    e = np.arange(1, 11, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = np.full(10, 2.0), np.full(10, 2.0)
    y[:5] = 0.5
    sig = N.dart_minhash(np.concatenate([e, e]), np.array([0, 10, 20]), 4096, np.concatenate([x, y]))
    assert abs((sig[0] == sig[1]).mean() - 12.5 / 20) < 0.05


def test_a_set_of_one_element_and_an_empty_set():
    sig = N.dart_minhash(np.array([5], np.uint64), np.array([0, 0, 1]), 16)
    assert (sig[0] == np.uint64(0xFFFFFFFFFFFFFFFF)).all() and not (sig[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
