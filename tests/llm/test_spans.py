"""Shared spans against a dictionary of all windows; chains against an exhaustive search."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import spans as S
from lodestrata.session import Scratch

SPAN = 40
K = 16


def brute(rows, span):
    of = {}
    for _, s, t in rows:
        for i in range(len(t or "") - span + 1):
            of.setdefault(t[i : i + span], set()).add((s or "").strip().lower())
    out = set()
    for a, s, t in rows:
        cover = [False] * len(t or "")
        for i in range(len(t or "") - span + 1):
            if of[t[i : i + span]] - {(s or "").strip().lower()}:
                cover[i : i + span] = [True] * span
        i = 0
        while i < len(cover):
            if cover[i]:
                j = i
                while j < len(cover) and cover[j]:
                    j += 1
                out.add((a.strip().lower(), i, j))
                i = j
            i += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "anchor_id string, source string, body string").withColumn("rec", F.lit(1)).withColumn("seed", F.lit("clash")).withColumn("text", F.lit(""))
    r = S.records(df, "anchor_id", "source", "body", SPAN)
    m = S.matches(r, SPAN, Scratch(spark, "t"), K)
    ids = r.select("rec", "id").distinct()
    return {(x["id"], x["span_start"], x["span_end"]) for x in S.exact_spans(m).join(ids, "rec").collect()}


def test_copied_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé🙂") for _ in range(r.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(r.randrange(8, 40))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randrange(1, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts += [p[a : r.randrange(a, len(p))], " ".join(word() for _ in range(r.randrange(12)))]
        rows.append((f"A{i}", r.choice(["s1", "s2", " S2", "s3", None]), " ".join(parts)))
    rows += [(" a0", rows[0][1], rows[0][2]), ("n", "s1", None), ("e", "s1", ""), ("x", "s9", passages[0] * 40), ("y", "s8", "z" * 500), ("z", "s7", "z" * 300)]
    assert found(spark, rows) == brute(rows, SPAN)


def test_one_source_alone_shares_nothing(spark):
    t = " ".join(f"word{i}" for i in range(30))
    assert found(spark, [("a", "s", t), ("b", "S ", t)]) == set()
    assert found(spark, [("a", "s", t), ("b", "u", t), ("c", "u", t)]) == {(k, 0, len(t)) for k in "abc"}


def test_empty_table(spark):
    r = S.records(spark.createDataFrame([], "a string, s string, t string"), "a", "s", "t", SPAN)
    assert S.exact_spans(S.matches(r, SPAN, Scratch(spark, "t"), K)).count() == 0


match = st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(3, 15))


def value(c):
    """Score of pieces in a row, None if they overlap on a side."""
    total = float(c[0][2])
    for (x, y, m), (a, b, n) in zip(c, c[1:]):
        if a < x + m or b < y + m:
            return None
        total += n - S.GAP * (a - x - m + b - y - m) / 2
    return total


@settings(max_examples=300, deadline=None)
@given(st.lists(match, min_size=1, max_size=5))
def test_every_piece_is_in_a_chain_and_the_best_chain_is_best(rows):
    parts = S.cut(S.merged(rows), 5)
    chains = S.chain(rows, piece=5)
    cover = lambda ms: sorted({(a + i, b + i) for a, b, n in ms for i in range(n)})
    assert cover(m for _, c in chains for m in c) == cover(S.merged(rows))
    best = [float(p[2]) for p in parts]  # of chains that end in each piece, by trying every predecessor
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            if (v := value([q, p])) is not None:
                best[i] = max(best[i], best[j] + v - q[2])
    assert abs(chains[0][0] - max(best)) < 1e-9
    for earned, c in chains:
        assert value(c) is not None and earned <= value(c) + 1e-9


def test_a_chain_across_overlapping_matches_is_the_best():
    chains = S.chain([(66, 41, 181), (136, 173, 202), (551, 218, 228)])
    assert chains[0][0] >= 228 and value(chains[0][1]) is not None
    parts = S.cut(S.merged([(66, 41, 181), (136, 173, 202), (551, 218, 228)]), S.PIECE)
    best = [float(p[2]) for p in parts]
    for i, p in enumerate(parts):
        for j in range(len(parts)):
            if (v := value([parts[j], p])) is not None:
                best[i] = max(best[i], best[j] + v - parts[j][2])
    assert abs(chains[0][0] - max(best)) < 1e-9


def test_many_matches_are_chained_in_one_sweep():
    r = random.Random(1)
    rows = [(r.randrange(10**6), r.randrange(10**6), 200) for _ in range(4000)]
    assert sum(n for _, c in S.chain(rows) for _, _, n in c) >= 200


def test_patterned_texts_do_not_hash_alike():
    import numpy as np

    from lodestrata.llm.chars import Rolling

    for n in (256, 1024, 4096):
        bits = np.array([bin(i).count("1") & 1 for i in range(n)])
        both = np.concatenate([bits, 1 - bits]).astype(np.uint32)
        h = Rolling(both)
        assert h.windows(n)[0] != h.windows(n)[n] and h.of(np.array([0]), np.array([n]))[0] != h.of(np.array([n]), np.array([2 * n]))[0]
    x = np.arange(1000, dtype=np.uint32) % 7
    h = Rolling(x)
    a, z = np.array([0, 7, 700, 3, 5]), np.array([100, 107, 800, 103, 5])
    got = h.of(a, z)
    assert got[0] == got[1] == got[2] != got[3] and h.windows(100)[0] == h.windows(100)[7] != h.windows(100)[1] and len(h.windows(1000)) == 1 and len(h.windows(1001)) == 0


def test_merging_on_a_diagonal_and_edit_distance():
    assert S.merged([(0, 10, 5), (5, 15, 5), (20, 30, 5), (0, 0, 3)]) == [(0, 0, 3), (0, 10, 10), (20, 30, 5)]
    assert S.edit_distance("kitten", "sitting") == 3 and S.edit_distance("", "abc") == 3 and S.edit_distance("abc", "abc") == 0


def test_passages_have_an_identity(spark):
    base = " ".join(f"tok{i}" for i in range(60))
    edited = base.replace("tok30", "other")
    rows = [("a", "s1", base), ("b", "s2", edited)]
    r = S.records(spark.createDataFrame(rows, "a string, s string, t string"), "a", "s", "t", SPAN)
    m = S.matches(r, SPAN, Scratch(spark, "t"), K)
    out = S.passages(S.chains(m), r.select("rec", "text")).collect()
    assert len(out) == 2 and all(x["n_matches"] == 2 and 0.95 < x["identity"] < 1 for x in out)


def test_every_anchor_has_a_share(spark, tmp_path):
    import __spark_entry__ as entry

    r = random.Random(5)
    text = "".join(r.choice("abcdefghij ") for _ in range(400))
    rows = [("A", "s", text[:200] + "x" * 200), ("b", "t", text), ("c", "u", "".join(r.choice("klmnop") for _ in range(300))), ("d", "u", "short"), ("e", "u", ""), ("f", "u", None), (None, "u", text), (" a ", "s", text[:200] + "x" * 200)]
    spark.createDataFrame(rows, "anchor_id string, source_version_id string, exact_text string").write.parquet(f"{tmp_path}/library_anchor.parquet")
    got = {x["anchor_id"]: (x["n_chars"], x["covered"], x["n_spans"], x["shared_share"]) for x in entry.queries()["p3_shared"](spark, str(tmp_path)).collect()}
    assert got == {"a": (400, 200, 1, 0.5), "b": (400, 200, 1, 0.5), "c": (300, 0, 0, 0.0), "d": (5, 0, 0, 0.0), "e": (0, 0, 0, 0.0), "f": (0, 0, 0, 0.0)}
