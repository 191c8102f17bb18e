"""Topic and identifier views on small tables, against plain loops over the same rows."""

import pytest

from lodestrata.plans import topics as T


@pytest.fixture(scope="module")
def t(spark):
    df = spark.createDataFrame
    return {
        "members": df([("root",), ("kid",)], "node string"),
        "association": df([("root", "s1", "[]", 1), ("kid", "s2", "[]", 1), ("kid", "s1", "[]", 1), ("other", "s3", "[]", 1), ("kid", None, "[]", 1)], "topic_concept_id string, source_version_id string, roles string, recorded_at int"),
        "source": df([("s1", "https://b", "c", None), ("s2", None, "c", "cc0"), ("s3", "https://a", "c", None)], "source_version_id string, source_uri string, connector_id string, license string"),
        "metadata": df([("m1", "s1", "Title", "P", "u", "n")], "id string, source_version_id string, title string, publisher string, original_locator string, provenance_note string"),
        "threat": df([("t1", "s1", "x", "confirmed", "high", 1), ("t2", "s2", "x", "suspected", "medium", 1), ("t3", "s3", "x", "confirmed", "high", 1), ("t4", "d1", "y", "confirmed", "low", 1), ("t5", None, "y", "confirmed", "low", 1)], "id string, source_version string, threat_type string, status string, severity string, detected_at int"),
        "anchor": df([("a1", "s1", "d1", "paragraph", 1), ("a2", "s3", None, "heading", None), ("a3", "gone", "d1", "paragraph", 2)], "anchor_id string, source_version_id string, derived_source_version_id string, anchor_kind string, page_number int"),
        "reference": df([("r1", "a1", "doi", "10.1/x", "cites", "cites", "l"), ("r2", "a2", "doi", "10.1/x", "mentions", None, "l"), ("r3", "a3", "doi", "10.1/x", "mentions", None, "l"), ("r4", "nope", "doi", "10.1/x", "mentions", None, "l")], "id string, anchor_id string, kind string, value string, relation string, signal string, locator string"),
        "identifier": df([("i1", "doi", "10.1/x", "l"), ("i2", "pmid", "7", "m")], "id string, kind string, value string, locator string"),
        "hits": df([("i1", "h2", "known-id"), ("i1", "h1", "locator"), ("i2", "h1", "known-id")], "identifier_id string, hit_id string, match_rule string"),
        "resolution": df([("o1", "10.1/x"), ("o2", "10.1/y")], "id string, doi string"),
    }


def test_sources_and_threats_in_order(t):
    rows = T.sources(t["members"], t["association"], t["source"], t["metadata"]).collect()
    assert [(r["source_version_id"], r["title"]) for r in rows] == [("s2", None), ("s1", "Title")]
    assert [r["id"] for r in T.threats(t["members"], t["association"], t["source"], t["threat"]).collect()] == ["t2", "t1"]  # medium stands after high as text
    assert T.threats(t["members"].limit(0), t["association"], t["source"], t["threat"]).count() == 0


def test_references_with_provenance_hits_and_resolutions(t):
    traced = T.provenance(t["reference"], t["anchor"], t["source"])
    assert {r["id"] for r in traced.collect()} == {"r1", "r2"}
    found = T.resolution_links(t["identifier"], t["resolution"])
    rows = T.references(t["members"], t["association"], traced, t["identifier"], t["hits"], found).collect()
    assert [(r["id"], r["source_uri"], r["resolved_discovery_hit_ids"], r["resolved_open_access_resolution_ids"]) for r in rows] == [("r1", "https://b", "h1,h2", "o1")]


def test_identifier_view(t):
    traced = T.provenance(t["reference"], t["anchor"], t["source"])
    view = lambda kind, value: T.identifier_view(kind, value, t["identifier"], traced, t["threat"], t["hits"], T.resolution_links(t["identifier"], t["resolution"]))
    assert [tuple(r) for r in view("doi", "10.1/x").collect()] == [
        ("hit", "h1", "locator", None, ""), ("hit", "h2", "known-id", None, ""), ("reference", "r2", "mentions", "https://a", "t3"), ("reference", "r1", "cites", "https://b", "t1,t4"), ("resolution", "o1", "doi", None, ""),
    ]
    with pytest.raises(ValueError):
        view("doi", "10.1/unknown")


def test_controversies_and_gaps_in_order(spark, t):
    k = spark.createDataFrame([("k1", "root", "q2", "open", "accepted"), ("k2", "kid", "q1", "open", "accepted"), ("k3", "kid", "q0", "open", "proposed"), ("k4", "zz", "q0", "open", "accepted")], "id string, topic_concept_id string, question string, status string, review_state string")
    held = spark.createDataFrame([("k1", "c2"), ("k1", "c1"), ("k1", "c1"), (None, "c")], "controversy_id string, claim_id string")
    assert [(r["id"], r["claim_ids"]) for r in T.controversies(t["members"], k, held).collect()] == [("k2", "[]"), ("k1", '["c1","c2"]')]
    g = spark.createDataFrame([("g1", "root", "q", "resolved", 9, "accepted"), ("g2", "kid", "b", "open", 1, "accepted"), ("g3", "kid", "a", "open", 1, "accepted"), ("g4", "kid", "c", "open", 5, "accepted")], "id string, topic_concept_id string, question string, status string, priority int, review_state string")
    got = T.gaps(t["members"], g, spark.createDataFrame([("g1", "c1")], "gap_id string, claim_id string")).collect()
    assert [(r["id"], r["related_claim_ids"]) for r in got] == [("g4", "[]"), ("g3", "[]"), ("g2", "[]"), ("g1", '["c1"]')]


def test_tainted_sources_and_repositories(spark, t):
    got = {r["source_version_id"]: (r["n_threats"], r["worst"]) for r in T.tainted_sources(t["threat"], t["anchor"]).collect()}
    assert got == {"s1": (2, "low"), "s2": (1, "medium"), "s3": (1, "high"), "d1": (1, "low"), "gone": (1, "low")}
    s = spark.createDataFrame([("A/b", "u", 1), ("a/B", "u", 2), ("c", "v", 3), (None, "w", 4)], "repository string, source_uri string, acquired_at int")
    assert [(r["repository"], r["n_sources"], r["n_uris"], r["latest"]) for r in T.ranked_repositories(s).collect()] == [("a/b", 2, 1, 2), ("c", 1, 1, 3)]
