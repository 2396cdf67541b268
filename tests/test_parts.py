"""Parts that no query covers: components, fills of a budget, file sources, the graph store and streams, on small rows."""

import json
import random

from pyspark.sql import functions as F

from skein.functions.components import components
from skein.operators.budget import greedy_fill
from skein.operators.graph import dependency_batches
from skein.sources import files
from skein.sources.store import GraphStore
from skein.streaming.folds import append_versions, latest, window_counts


def test_components(spark):
    pick = random.Random(1)
    pairs = [(0, n) for n in range(1, 300)] + [(pick.randrange(400, 700), pick.randrange(400, 700)) for _ in range(200)] + [(900, 900), (None, 3)]
    root = {x: x for p in pairs if None not in p for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {tuple(r) for r in components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {(x, top(x)) for x in root}


def test_greedy_fill(spark):
    pick = random.Random(2)
    for budget in (0, 1, 37, 1000):
        rows = [(n, pick.choice([None, 0, 1, 2, 9, 40, 300])) for n in range(120)]
        want, left = [], budget
        for n, size in rows:
            if size is not None and size <= left:
                want.append(n)
                left -= size
        got = greedy_fill(spark.createDataFrame(rows, "n int, size int"), budget, ["n"])
        assert sorted(r.n for r in got.collect()) == want
    assert greedy_fill(spark.createDataFrame([], "n int, size int"), 5, ["n"]).count() == 0


def test_cycles_have_no_batch(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "from_id string, to_id string")
    assert {tuple(r) for r in dependency_batches(e).collect()} == {("a", 0), ("b", None), ("c", None), ("d", None)}


def test_files(spark, tmp_path):
    for name in ("a.py", "b.RS", "c.xyz", ".hidden/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.walk(spark, str(tmp_path))
    assert {(r.extension, r.language) for r in found.collect()} == {("py", "python"), ("rs", "rust"), ("xyz", None)}
    assert [tuple(r) for r in files.skip_statistics(found).collect()] == [("xyz", 1)]
    assert files.changed_since(found, "2999-01-01").count() == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "kind": "k", "label": None}, {"id": None}], "edges": [{"from_id": "a", "to_id": "b", "kind": "k"}, {"from_id": "a"}]}))
    nodes, edges = files.edge_file(spark, str(tmp_path / "g.json"))
    assert (nodes.count(), edges.count()) == (1, 1)
    (tmp_path / "m.json").write_text('{"run": 1, "metrics": {"x": 1.5, "y": null}}\n{"run": 2, "metrics": {"x": 2}}\n')
    assert {tuple(r) for r in files.metric_runs(spark, str(tmp_path / "m.json")).collect()} == {(1, "x", 1.5), (2, "x", 2.0)}


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    assert store.version() == 0
    nodes = lambda *rows: spark.createDataFrame(rows, "id string, kind string, label string")
    edges = spark.createDataFrame([("a", "k", "b"), ("b", "k", "c")], "from_id string, kind string, to_id string")
    assert store.upsert(nodes(("a", "k", "1"), ("b", "k", "2"), ("c", "k", "3")), edges) == 1
    assert store.upsert(nodes(("a", "k", "9")), edges.limit(0)) == 2
    assert {(r.id, r.label) for r in store.read("nodes").collect()} == {("a", "9"), ("b", "2"), ("c", "3")}
    assert {tuple(r) for r in store.drift(nodes(("a", "k", "9"), ("b", "k", "0"), ("d", "k", "4"))).collect()} == {("b", "update"), ("c", "delete"), ("d", "insert")}
    store.delete_nodes(spark.createDataFrame([("a",)], "id string"))
    assert [tuple(r) for r in store.read("edges").collect()] == [("b", "k", "c")]
    assert (store.compact(), store.version()) == (2, 3)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:10", "x", 2.0), (1, 2, "2024-01-01 00:00:20", "x", 3.0), (2, 1, "2024-01-01 00:02:00", "y", 1.0)], "id int, version int, ts string, event_type string, value double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, version int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    append_versions(stream(), str(tmp_path / "out"), str(tmp_path / "at"), "id", "version").awaitTermination()
    assert {(r.id, r.version) for r in latest(spark.read.parquet(str(tmp_path / "out")), "id", "version").collect()} == {(1, 2), (2, 1)}
    q = window_counts(stream(), "1 minute", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "at2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("counts").collect()} == {("x", 2, 5.0), ("y", 1, 1.0)}
