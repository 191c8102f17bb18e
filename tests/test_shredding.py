"""Shredding against a plain walk of the nested records, and round trips of the level sequences."""

import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import shredding as S

TYPE = pa.list_(pa.struct([("id", pa.string()), ("deep", pa.struct([("k", pa.string())])), ("kids", pa.list_(pa.struct([("v", pa.string()), ("leaf", pa.list_(pa.struct([("w", pa.string())])))])))]))
text = st.one_of(st.none(), st.text(max_size=2))
leaf = st.one_of(st.none(), st.fixed_dictionaries({"w": text}))
kid = st.one_of(st.none(), st.fixed_dictionaries({"v": text, "leaf": st.one_of(st.none(), st.lists(leaf, max_size=3))}))
item = st.one_of(st.none(), st.fixed_dictionaries({"id": text, "deep": st.one_of(st.none(), st.fixed_dictionaries({"k": text})), "kids": st.one_of(st.none(), st.lists(kid, max_size=3))}))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(item, max_size=4)), max_size=5), st.integers(0, 2))
def test_tables_from_levels(data, skip):
    array = pa.array([None, *data], TYPE)[1:]  # with an offset
    array, data = array[min(skip, len(array)) :], data[min(skip, len(data)) :]
    leaves = {x.path: x for x in S.shred(array, "s")}

    def rows(path, node, names):
        lf = leaves[path]
        t = S.table_at(lf, node)
        return list(zip(t["record"].tolist(), *(t[n].tolist() for n in names), S.column(lf, t["value"]).to_pylist()))

    want = {"item": [], "deep": [], "kid": [], "leaf": []}
    for r, items in enumerate(data):
        for i, x in enumerate(items or []):
            if x is None:
                continue
            want["item"].append((r, i, x["id"]))
            if x["deep"] is not None:
                want["deep"].append((r, i, x["deep"]["k"]))
            for j, y in enumerate(x["kids"] or []):
                if y is None:
                    continue
                want["kid"].append((r, i, j, y["v"]))
                for k, z in enumerate(y["leaf"] or []):
                    if z is not None:
                        want["leaf"].append((r, i, j, k, z["w"]))
    assert rows(("s", "id"), ("s",), ["s"]) == want["item"]
    assert rows(("s", "deep", "k"), ("s", "deep"), ["s"]) == want["deep"]
    assert rows(("s", "kids", "v"), ("s", "kids"), ["s", "s.kids"]) == want["kid"]
    assert rows(("s", "kids", "leaf", "w"), ("s", "kids", "leaf"), ["s", "s.kids", "s.kids.leaf"]) == want["leaf"]


def test_levels_of_a_known_record():
    array = pa.array([[{"a": "x"}, None], [], None], pa.list_(pa.struct([("a", pa.string())])))
    lf = S.shred(array, "s")[0]
    assert lf.rep.tolist() == [0, 1, 0, 0] and lf.deff.tolist() == [4, 2, 1, 0] and lf.index.tolist() == [0, -1, -1, -1]


def test_response_texts(spark):
    full = {"resultList": {"result": [{"id": 7}, None, {"id": "b", "authorString": "X Y."}, "no object"]}}
    texts = [json.dumps(full), json.dumps({"resultList": {"result": {"title": "alone"}}}), json.dumps(full)[:-3], None, "", "[1]", json.dumps({"resultList": None}), json.dumps({"resultList": {"result": "x"}})]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, texts[0], "c")], "response_id long, search string, node string")
    got = sorted((r["response_id"], r["result_pos"], r["node_key"]) for r in S.epmc_nodes(S.distinct_responses(df)).collect())
    assert got == [(0, 0, "7"), (0, 2, "b"), (1, 0, "")]


def test_empty_and_null_responses(spark):
    schema = "response_id long, search struct<meta:struct<count:long>, results:array<struct<id:string, primary_location:struct<source:struct<display_name:string>>, authorships:array<struct<author:struct<id:string>, institutions:array<struct<ror:string>>>>>>>"
    rows = [(1, None), (2, {"meta": None, "results": None}), (3, {"meta": None, "results": []}), (4, {"meta": None, "results": [None, {"id": None, "primary_location": {"source": {"display_name": "v"}}, "authorships": [None, {"author": None, "institutions": [None, {"ror": "r"}]}]}]})]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in S.openalex_nodes(S.distinct_responses(df)).collect())
    assert got == [("openalex", 4, "authorship", 1, 1, -1, ""), ("openalex", 4, "institution", 1, 1, 1, "r"), ("openalex", 4, "result", 1, -1, -1, ""), ("openalex", 4, "venue", 1, -1, -1, "v")]
    assert S.openalex_nodes(S.distinct_responses(df.limit(0))).count() == 0


def test_positions_are_counted_over_null_elements():
    array = pa.array([[None, {"id": "a"}, None, {"id": "b"}]], pa.list_(pa.struct([("id", pa.string())])))
    t = S.table_at(S.shred(array, "s")[0], ("s",))
    assert t["s"].tolist() == [1, 3] and np.array_equal(t["record"], [0, 0])


def test_every_issn_and_response_has_a_row(spark):
    schema = "response_id long, query_text string, fetched_at string, ingested_at string, search struct<meta:struct<count:long, next_cursor:string, cost_usd:double>, results:array<struct<primary_location:struct<source:struct<display_name:string, issn_l:string, issn:array<string>>>>>>"
    venue = lambda *issn: {"primary_location": {"source": {"display_name": "v", "issn_l": "a", "issn": list(issn)}}}
    first = (1, "q", "f", "2", {"meta": {"count": 5, "next_cursor": "n", "cost_usd": 0.5}, "results": [venue("a", None, "b"), None, venue(), {"primary_location": None}, venue("c")]})
    df = spark.createDataFrame([first, (1, "q", "f", "3", first[4]), (2, "z", None, None, None)], schema)
    got = sorted(tuple(r) for r in S.openalex_table(S.distinct_responses(df), "venue_issns").collect())
    assert got == [(1, 0, 0, "a"), (1, 0, 2, "b"), (1, 4, 0, "c")]
    assert sorted(tuple(r) for r in S.responses_table(df, S.META).collect()) == [(1, "q", "f", "2", 5, "n", 0.5), (2, "z", None, None, None, None, None)]


def test_only_the_named_fields_are_read(spark, tmp_path):
    from lodestrata.session import load

    df = spark.createDataFrame([(1, ([("W1", "t", [(("A1", "n"), [("r",)]), None])],))], "response_id long, search struct<results array<struct<id:string,title:string,authorships:array<struct<author:struct<id:string,name:string>,institutions:array<struct<ror:string>>>>>>>")
    df.write.parquet(f"{tmp_path}/openalex_search.parquet")
    got = load(spark, str(tmp_path), "openalex_search", ("response_id", "search.results.id", "search.results.authorships.institutions.ror"))
    assert got.schema.simpleString() == "struct<response_id:bigint,search:struct<results:array<struct<id:string,authorships:array<struct<institutions:array<struct<ror:string>>>>>>>>"
    row = got.first()["search"]["results"][0]
    assert row["id"] == "W1" and row["authorships"][0]["institutions"][0]["ror"] == "r" and row["authorships"][1] is None
