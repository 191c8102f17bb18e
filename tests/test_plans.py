"""Planning, snapshots and the acceptance of proposals."""

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import planning as P
from lodestrata.plans import views
from lodestrata.sources import packs, snapshots


def test_plans():
    syn = {"c1": ["Green  Tea", "tea"], "c2": []}
    p = P.compile_plan("What is the effect of Tea on X?", syn, ["c1"], ["a", "b"], ["b"], 5000, 2)
    assert p.terms == ("effect", "green tea", "tea") and p.limit == 1000 and p.lost == ("limit 5000 cut to 1000",) and p.connectors == ("b",)
    for bad in (dict(concepts=["zz"], connectors=["a"]), dict(concepts=[], connectors=["zz"])):
        with pytest.raises(ValueError):
            P.compile_plan("tea", syn, known_connectors=["a"], limit=1, pages=1, **bad)
    with pytest.raises(ValueError):
        P.compile_plan("the of", syn, ["c2"], ["a"], ["a"], 1, 1)


def test_queue_terms_and_selection(spark):
    gaps = spark.createDataFrame([("q1", 5, "open"), ("q2", 9, "open"), ("q0", 9, "resolved"), ("x", 1, "open")], "question string, priority int, status string")
    assert P.queue(["x", "y"], gaps, 4) == ["x", "y", "q2", "q1"]
    t = spark.createDataFrame([(["A  b", ""], ["a B", "c"]), (None, ["z"])], "e array<string>, c array<string>")
    assert [r[0] for r in t.select(P.merged_terms(F.col("e"), F.col("c"))).collect()] == [["a b", "c"], ["z"]]
    a = spark.createDataFrame([("s", "a1", 2, "paragraph", "tea tea leaf"), ("s", "a2", 1, "heading", "Tea"), ("s", "a3", 0, "paragraph", "none")], "source_id string, anchor_id string, ordinal int, kind string, text string")
    assert [(r["anchor_id"], r["score"]) for r in P.selected(a, ["tea"], ["leaf"], 2).collect()] == [("a2", 5), ("a1", 6)]


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    t = {"p": spark.createDataFrame([("x",)], "id string"), "c": spark.createDataFrame([("1", "x")], "id string, up string")}
    first = snapshots.write(folder, t, [("c", "up", "p", "id")])
    assert snapshots.read(spark, folder, "c").count() == 1 and snapshots.verify(spark, folder, ["p", "c"]).count() == 0
    with pytest.raises(ValueError):
        snapshots.write(folder, t | {"c": spark.createDataFrame([("1", "zz")], "id string, up string")}, [("c", "up", "p", "id")])
    assert snapshots.read(spark, folder, "c").first()["up"] == "x"
    assert snapshots.write(folder, t) == first and snapshots.write(folder, t | {"p": t["p"].union(t["p"])}) != first
    assert {(r["name"], r["state"]) for r in snapshots.verify(spark, folder, ["p"]).collect()} == {("c", "missing")}
    assert snapshots.inventory(spark, {"x": folder}).filter("sha256 is not null").count() > 3


def test_vocabulary_remap_and_acceptance(spark):
    c = spark.createDataFrame([("concept:a", "A", ["x"], None)], "id string, label string, synonyms array<string>, recorded_at timestamp")
    assert {(r["id"], r["label"]) for r in packs.with_vocabulary(c, {"concept:a": ["z"], "concept:green-tea": ["t"]}).collect()} == {("concept:a", "A"), ("concept:green-tea", "green tea")}
    df = spark.createDataFrame([("concept:a", ["concept:a", "concept:b"]), (None, None)], "s string, bs array<string>")
    rows = packs.remapped(df, ["s", "bs"], "concept:me:", ["concept:a"]).collect()
    assert rows[0]["s"] == "concept:me:a" and rows[0]["bs"] == ["concept:me:a", "concept:b"] and rows[1]["s"] is None
    items = spark.createDataFrame([("1", "s", "a", "tea"), ("2", "zz", "a", "nope"), ("3", "s", "q", "x"), ("4", "s", "a", "")], "item_id string, subject string, anchor_id string, exact string")
    anchors = spark.createDataFrame([("a", "🙂 tea leaf", 100)], "anchor_id string, text string, anchor_start long")
    good, bad = packs.accepted(items, anchors, spark.createDataFrame([("s",)], "subject string"))
    assert [(r["item_id"], r["start"], r["stop"]) for r in good.collect()] == [("1", 102, 105)]
    assert {(r["item_id"], r["finding"]) for r in bad.collect()} == {("2", "unknown subject"), ("2", "quote not exactly once"), ("3", "unknown anchor"), ("4", "quote not exactly once")}


def test_state_and_consistency(spark):
    s = spark.createDataFrame([("k", ["b", "a"], 1), ("k", ["b", "c"], 3), ("j", [], 2)], "k string, xs array<string>, t int")
    assert {r["k"]: (r["xs"], r["t"]) for r in packs.merged_state(s, "k", ["xs"], ["t"]).collect()} == {"k": (["a", "b", "c"], 3), "j": ([], 2)}
    d = spark.createDataFrame([("d1", ["x", "y"]), ("d2", ["x"]), ("d3", [])], "d string, ids array<string>")
    rows = spark.createDataFrame([("d1", 2, "y"), ("d1", 1, "x"), ("d2", 1, "z")], "d string, ordinal int, id string")
    assert [r["d"] for r in packs.inconsistent(d, rows, "d", "ids", "id").collect()] == ["d2"]


def test_positions_number_every_row(spark):
    rows = [(f"t{i:04d}", ["low", "high", None, "critical"][i * 7 % 4]) for i in range(1500)]
    got = {r["id"]: r["position"] for r in views.positions(spark.createDataFrame(rows, "id string, severity string"), [F.desc_nulls_last("severity"), F.asc("id")]).collect()}
    rank = {"low": 0, "high": 1, "critical": 2, None: 3}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (rank[r[1]], r[0])), 1)}


def test_topic_threats_are_all_listed(spark, tmp_path):
    import __spark_entry__ as entry

    spark.sql("select 's' source_version_id, null license, 'u' source_uri, 'c' connector_id, timestamp '2024-01-01' acquired_at, timestamp '2024-01-01' ingested_at").write.parquet(f"{tmp_path}/library_source.parquet")
    spark.sql("select concat('t', id) id, if(id < 140, 's', 'unknown') source_version, 'low' severity, 'confirmed' status, timestamp '2024-01-01' detected_at, timestamp '2024-01-01' ingested_at from range(150)").write.parquet(f"{tmp_path}/threat_observation.parquet")
    got = entry.queries()["topic_threats_ordered"](spark, str(tmp_path)).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == sorted(f"t{i}" for i in range(140))
    assert sorted(r["position"] for r in got) == list(range(1, 141))
