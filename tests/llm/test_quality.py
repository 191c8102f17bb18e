"""Line features, the hidden Markov model, and statistics of documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import quality as Q

PROSE = "The committee found that the river had been higher than in any year before. It was not clear whether the bridge would hold, and they asked for another survey.\nIn the spring of that year the office sent two people to the site, who measured the depth of the water with a rod."
LIST = "- first valve\n- second pump (1990)\n- third rotor;\n- fourth gauge: 3 m\n- fifth seal\n- sixth hinge"
TABLE = "a | b | c\n--- | --- | ---\n1 | x | 3.5\n2 | y | n/a\n3 | z | 9.1\n4 | - | 7.7"
JUNK = "Home | Login | Share | Home | Menu | Menu | Share | Login | Home | Home | Share | Menu\n#####======------####====----\n{\"a\": [0.5, 0.25], \"b\": {\"c\": 1}}, {\"a\": [0.1]}\nvalve valve valve valve valve valve valve valve valve valve valve valve valve"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels, i = [], [], 0
    for n in range(30):
        for kind, t in (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK)):
            i += 1
            docs.append((i, t.replace("valve", f"valve{n}").replace("3", str(n))))
            labels.append((i, kind))
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, PROSE), (1004, LIST + "\n" + LIST + "\nA note."), (1005, PROSE + "\n\n" + TABLE[:20]), (1003, PROSE)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("f", F.lit(1))
    return d, spark.createDataFrame(labels, "doc_id long, text_kind string")


def test_labels_and_shares(tables):
    d, labels = tables
    rows = {r["doc_id"]: r for r in Q.statistics(d, Q.fit(d, labels)).collect()}
    truth = {r["doc_id"]: r["text_kind"] for r in labels.collect()}
    assert np.mean([rows[i]["kind"] == k for i, k in truth.items()]) > 0.95
    assert rows[1003]["prose_share"] > 0.9 and rows[1004]["list_share"] > 0.5 and rows[1005]["prose_share"] > 0.5
    for i in (1000, 1001, 1002):
        assert rows[i]["n_lines"] == 0 and rows[i]["prose_share"] is None and rows[i]["kind"] is None


def test_without_labels_or_rows(spark, tables):
    d, labels = tables
    model = Q.fit(d, labels.limit(0))
    assert Q.statistics(d.limit(0), model).count() == 0
    assert Q.statistics(d, model).count() == d.count()


def test_counts_of_a_known_text():
    out = Q._statistics(np.array([1]), ["The cat sat.\nAnd the dog ran\n"], Q.train([]))
    r = out.iloc[0]
    assert r["n_lines"] == 2 and r["n_words"] == 7 and r["stop_line_share"] == 0.5 and abs(r["mean_word_length"] - 21 / 7) < 1e-9
    assert abs(r["common_word_share"] - 3 / 7) < 1e-9


def test_statistics_count_lines_as_they_stand():
    one = " ".join(["word"] * 576) + "."
    r = Q._statistics(np.array([1, 2]), [one, one + "\nand\r\n\n" + one], Q.train([]))
    assert len(Q.lines([one])["doc"]) > 2
    assert r["n_lines"].tolist() == [1, 3] and r["stop_line_share"].tolist() == [1.0, 2 / 3]


def test_lines_of_long_texts_are_cut_at_blanks_only():
    words = ["word"] * 5000
    x = Q.lines([" ".join(words), "short"])
    assert x["words"].sum() == 5001 and (x["doc"] == 0).sum() > 10 and (x["doc"] == 1).sum() == 1
    one = Q.lines(["x" * 100_000])
    assert len(one["doc"]) == 1 and one["chars"][0] == 100_000


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    m = Q.train([(k, np.stack([r.integers(0, s, 6) for s in Q.FEATURES.values()], 1).astype(np.uint8)) for k in range(4) for _ in range(3)])
    f = np.stack([r.integers(0, s, 9) for s in Q.FEATURES.values()], 1).astype(np.uint8)
    doc = np.array([0] * 4 + [1] + [2] * 4)
    path, s = m.viterbi(f, doc), m.scores(f)
    import itertools

    for a, z in ((0, 4), (4, 5), (5, 9)):
        value = lambda p: m.start[p[0]] + s[a][p[0]] + sum(m.step[p[i - 1], p[i]] + s[a + i][p[i]] for i in range(1, z - a))  # noqa: E731, B023
        best = max(itertools.product(range(4), repeat=z - a), key=value)
        assert abs(value(best) - value(path[a:z].tolist())) < 1e-9
