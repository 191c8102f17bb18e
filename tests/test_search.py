"""BM25 against SQLite's full-text index, and the parts of a search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import documents
from lodestrata.plans import search as S


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    words = ["alpha", "beta", "alphabet", "café", "Việt", "gamma-ray", "water", "board", "waterboard", "the", "x1", "µg", "delta"]
    rows = [(("note", "page")[i % 2], f"r{i:03d}", " ".join(r.choice(words) for _ in range(r.randrange(4))), " ".join(r.choice(words) for _ in range(r.randrange(25)))) for i in range(150)]
    rows += [("note", "empty", "", ""), ("page", "null", None, None)]
    return rows, spark.createDataFrame(rows, "record_type string, record_id string, title string, body string").withColumn("token", F.lit("clash"))


QUESTIONS = ["alpha water", "water-board delta", "cafe viet", "gamma-ray", "beta x1 alphab", "µg"]


@pytest.mark.parametrize("question", QUESTIONS)
@pytest.mark.parametrize("weights", [S.KNOWLEDGE, S.LIBRARY])
def test_scores_equal_those_of_sqlite(spark, corpus, question, weights):
    rows, df = corpus
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(title, body, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    con.executemany("insert into f(rowid, title, body) values (?, ?, ?)", [(i, t or "", b or "") for i, (_, _, t, b) in enumerate(rows)])
    plan = S.compile_question(question, limit=1000)
    want = {rows[i][1]: s for i, s in con.execute(f"select rowid, bm25(f, {weights[0]}, {weights[1]}) from f where f match ?", [plan.expression])}
    got = {r["record_id"]: r["score"] for r in S.ranked(df, plan, weights).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_an_index_gives_the_same_as_a_scan(corpus, tmp_path):
    _, df = corpus
    index = S.Index.build(df, f"{tmp_path}/index")
    for question in ("water-board alpha", "alpha", "zzz"):
        plan = S.compile_question(question, limit=50)
        a = [tuple(r) for r in S.ranked(df, plan).collect()]
        assert a == [tuple(r) for r in S.ranked(index, plan).collect()] and (a or question == "zzz")
        assert a == [tuple(r) for r in S.ranked(S.analysed(df), plan, ready=True).collect()]
    assert index.statistics()[0] == df.count()
    empty = S.Index.build(df.limit(0), f"{tmp_path}/empty")
    assert empty.statistics() == (0, 0) and S.ranked(empty, plan).count() == 0


def test_a_question_reads_only_its_tokens(corpus, tmp_path):
    _, df = corpus
    index = S.Index.build(df, f"{tmp_path}/index")
    plan = S.matches(index.postings(), S.compile_question("alpha water-board"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "StringStartsWith(token,alpha)" in pushed and "EqualTo(token,water)" in pushed and "MapInArrow" not in plan


def test_type_filter_leaves_scores_alone_and_limit_is_probed(corpus):
    _, df = corpus
    everything = {r["record_id"]: r["score"] for r in S.ranked(df, S.compile_question("alpha", limit=1000)).collect()}
    some = S.ranked(df, S.compile_question("alpha", ("note",), limit=5)).collect()
    assert all(everything[r["record_id"]] == r["score"] and r["record_type"] == "note" and r["truncated"] for r in some) and [r["rank"] for r in some] == [1, 2, 3, 4, 5]
    assert not any(r["truncated"] for r in S.ranked(df, S.compile_question("alpha", limit=1000)).collect())


def test_plans():
    p = S.compile_question('" OR threat:* NOT')
    assert p.expression == '"not"* OR "threat"*' and p.phrases == [("not",), ("threat",)]
    for bad in ("", "the of", "?!"):
        with pytest.raises(ValueError):
            S.compile_question(bad)
    with pytest.raises(ValueError):
        S.compile_question("x", limit=0)


@pytest.mark.parametrize("text", ["Việt Nam", "x_y-z", "É́cole", "ｆｕｌｌ", "áb", "नमस्ते दुनिया", "½ x²", "", "naïve\tcafé", "‍x"])
def test_the_short_way_to_tokens_is_equal(text):
    assert S.fast_tokens(text) == S.tokens(text)


def test_empty_corpus_and_no_match(corpus):
    _, df = corpus
    plan = S.compile_question("alpha")
    assert S.ranked(df.limit(0), plan).count() == 0 and S.ranked(df, S.compile_question("zzz")).count() == 0


def test_snippets_and_context(spark, corpus):
    _, df = corpus
    plan = S.compile_question("alphabet", limit=3)
    top = S.ranked(df, plan)
    assert all("[alphabet]" in r["excerpt"] for r in S.snippets(top, df, plan).collect() if "alphabet" not in (r["title"] or ""))
    hits = spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "é🙂" * 50), (3, "c", "z")], "rank int, id string, text string")
    out = S.context(hits, 256).orderBy("rank").collect()
    assert [(r["used"], r["complete"]) for r in out] == [(200, True), (56, False)]
    with pytest.raises(ValueError):
        S.context(hits, 10)


def test_titles_and_bodies(spark):
    a = spark.createDataFrame([("a", "section", "Part", 1, "x y"), ("b", "paragraph", None, 2, "text"), ("c", "page", "p", 3, "z"), ("d", "section", None, 4, "q")], "id string, kind string, label string, ordinal int, exact string").withColumn("extra", F.lit(1))
    assert {(r["record_id"], r["title"], r["body"]) for r in documents.corpus({"anchor": a}).collect()} == {("a", "Part", "Part"), ("b", "paragraph 2", "text"), ("d", "section 4", "")}
    m = spark.createDataFrame([("m", "T", ["A", None], None, "u", None, None, "n")], "id string, title string, authors array<string>, publisher string, original_locator string, license string, usage_conditions array<string>, provenance_note string")
    assert documents.corpus({"source_metadata": m}).first()["body"] == "A u unknown license n"
    with pytest.raises(ValueError):
        documents.corpus({"nothing": a})


def test_corpus_holds_all_record_types(spark):
    from pathlib import Path

    import __spark_entry__ as entry
    from lodestrata.plans import corpus

    if not Path(entry.SMALL).exists():
        pytest.skip("no test tables here")
    got = {r["record_type"]: r["count"] for r in corpus.search_corpus(spark, entry.SMALL).groupBy("record_type").count().collect()}
    assert set(got) == set(documents.DOCUMENTS) and len(got) == 15
    assert got["discovery"] == corpus.hits(spark, entry.SMALL).count() and got["claim"] == corpus.claims(spark, entry.SMALL).filter("review_state = 'accepted'").count()
