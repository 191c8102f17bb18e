"""Reading and linking of names."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import names as N

SAME = [
    ("Jonas Torvik", "Torvik, Jonas"), ("Jonas Torvik", "Torvik J"), ("Jonas A. Torvik", "Torvik JA"), ("Dr Jonas Torvik", "Jonas Torvik, PhD"), ("TORVIK Jonas", "J. Torvik"), ("Jónas Tørvik", "Jonas Torvik"),
    ("Robert Pellamar", "Bob Pellamar"), ("Pellamar R", "Bob Pellamar"), ("Ming-Hua Drenolt", "Drenolt MH"), ("Ming-Hua Drenolt", "M. Drenolt"), ("Katherine Vossel", "Kat. Vossel"), ("Jonas van der Torvik", "van der Torvik J"),
    ("Jonas Torvik", "Jonsa Torvik"), ("Jonas Torvik", "Jonas Trovik"), ("University of Brakeldale", "Brakeldale University"), ("Univ Brakeldale", "University of Brakeldale"),
    ("Brakelford Institute for Dense Valve Research", "Brakelford Inst. Dense Valve Res."), ("The Brakelford Dense Valve Consortium", "Brakelford Dense Valve Consort"), ("Bas R. Pellamar", "Pellamar SR"), ("Gabi Drenolt", "Gabriella Drenolt"),
]
OTHER = [
    ("Jonas Torvik", "Maria Torvik"), ("Torvik J", "Torvik M"), ("Jonas A. Torvik", "Jonas B. Torvik"), ("Jonas Torvik", "Jonas Pellamar"), ("University of Brakeldale", "University of Vossbridge"),
    ("Brakelford Institute for Dense Valve Research", "Brakelford Institute for Sparse Motor Research"), ("Brakeldale University", "Brakeldale J"),
]


def pair(a, b):
    given = frozenset("jonas maria robert bob katherine gabi gabriella bas ming-hua sebastian jonsa".split())
    common = frozenset("university institute consortium research dense valve".split()) | given
    out = []
    for n in (a, b):
        p = N.read(n)
        parts = p["tokens"]
        weights = [3.0 if t in common or s != "full" else 8.0 for t, s in parts]
        at = N.core_of(p | {"core": p["core"] if p["kind"] == "person" else -1}, [t in given for t, _ in parts], weights)
        others = [i for i in range(len(parts)) if i != at]
        out.append({"kind": p["kind"], "core": parts[at][0].replace("-", ""), "weight": weights[at], "rest": [parts[i] for i in others], "weights": [weights[i] for i in others]})
    return out


@pytest.mark.parametrize("a, b", SAME)
def test_variants_agree(a, b):
    assert N.same(*pair(a, b))


@pytest.mark.parametrize("a, b", OTHER)
def test_others_do_not(a, b):
    assert not N.same(*pair(a, b))


def test_rare_tokens_count_more():
    one = lambda core, weight, *rest: {"kind": "person", "core": core, "weight": weight, "rest": [(t, "full") for t, _ in rest], "weights": [w for _, w in rest]}
    base = one("torvik", 9.0, ("jonas", 5.0), ("quill", 5.0))
    assert N.score(base, one("torvik", 9.0, ("jonas", 5.0), ("quill", 5.0))) == 1
    near, rare = one("torvik", 9.0, ("jonas", 5.0), ("bram", 0.5)), one("torvik", 9.0, ("jonas", 5.0), ("bram", 5.0))
    assert N.same(base, near) and not N.same(base, rare)  # a contradiction weighs as much as its token is rare
    assert N.score(one("torvik", 2.0, ("jonas", 3.0)), one("torvic", 2.0, ("jonas", 3.0))) < N.score(base, base)
    assert not N.same(one("torvik", 3.0), one("torvik", 3.0, ("jonas", 5.0)))  # a common surname alone says little
    org = lambda core, *rest: one(core, 8.0, *rest) | {"kind": "organisation"}
    assert N.same(org("brakeldale", ("research", 1.0), ("group", 1.0)), org("brakeldale", ("research", 1.0))) and not N.same(org("brakeldale", ("valve", 6.0)), org("brakeldale"))


def test_names_an_edit_apart_anywhere_have_a_key_in_common():
    assert N.same(*pair("Jonas Torvik", "Konas Torvik"))
    import random

    r = random.Random(3)
    for _ in range(500):
        x = "".join(r.choice("abcde") for _ in range(r.randrange(3, 9)))
        i = r.randrange(len(x))
        y = r.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :], x[:i] + x[i : i + 2][::-1] + x[i + 2 :]])
        if len(y) > 2:
            asks, answers = N.meeting_keys("person", [(x, "full")])[0], N.meeting_keys("person", [(y, "full")])[1]
            assert set(asks) & set(answers)


def test_names_without_letters_and_single_tokens():
    assert N.read("...") is None and N.read("") is None and N.read("Torvik")["tokens"] == [("torvik", "full")]
    assert N.read("Dr") is None or N.read("Dr")["tokens"]


@pytest.mark.parametrize("a, b, n", [("abc", "abc", 0), ("abcd", "abdc", 1), ("abcd", "abd", 1), ("abcd", "axcd", 1), ("abcd", "abcde", 1)])
def test_edits(a, b, n):
    assert N.close(a, b, n) and (n == 0 or not N.close(a, b, n - 1))


def test_links_over_a_table(spark):
    rows = [n for p in SAME for n in p] + [n for p in OTHER for n in p]
    # other forms that tell which tokens are given names
    rows += [f"{s}, {g}" for g in ("Jonas", "Maria", "Robert", "Katherine", "Gabriella", "Ming-Hua") for s in ("Ablesen", "Korvath")]
    df = spark.createDataFrame([(n,) for n in rows] + [(None,), ("",), ("--",), (rows[0],)], "name string").withColumn("core", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {(r["name_a"], r["name_b"]) for r in N.link(df.select("name")).collect()}
    missing = [p for p in SAME if tuple(sorted(p)) not in got]
    assert not missing
    assert not [p for p in OTHER if tuple(sorted(p)) in got]
    assert all(a < b for a, b in got)


def test_first_letters_lone_names_and_classes(spark):
    rows = ["John Smithers", "Kohn Smithers", "J. Smithers", "Smithers, John", "Zorvath", "ZORVATH", "Zorvath, Anna", "Anna Zorvath"] + [f"Ablesen, {g}" for g in ("John", "Anna")] + [f"Korvath, {g}" for g in ("John", "Anna")]
    df = spark.createDataFrame([(n,) for n in rows], "name string")
    got = {(r["name_a"], r["name_b"]) for r in N.link(df).collect()}
    assert ("John Smithers", "Kohn Smithers") in got and ("ZORVATH", "Zorvath") in got and ("Anna Zorvath", "Zorvath, Anna") in got
    per = {r["name"]: (r["class"], r["n_spellings"], r["n_linked"]) for r in N.classes(df).collect()}
    assert per["Smithers, John"][:2] == ("John Smithers", 2) and per["ZORVATH"][:2] == ("ZORVATH", 2) and set(per) == set(rows)
    assert per["John Smithers"][2] >= 2


def test_hundreds_of_spellings_of_one_surname(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    given = [f"{a}{b}{c}mir" for a in letters[:8] for b in "aeiou" for c in letters[:10]]
    df = spark.createDataFrame([(f"Torvik, {g.title()}",) for g in given], "name string")
    near = {(a, b) for a in given for b in given if a < b and N.same(*({"kind": "person", "core": "torvik", "weight": 1.0, "rest": [(g, "full")], "weights": [5.0]} for g in (a, b)))}
    got = {(r["name_a"], r["name_b"]) for r in N.link(df).collect()}
    assert {(f"Torvik, {a.title()}", f"Torvik, {b.title()}") for a, b in near} <= got


def test_empty_table(spark):
    assert N.link(spark.createDataFrame([], "name string")).count() == 0
