"""Extraction from sources, communities, scores, digests and checks of changes, on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import digest, ranking, symbols
from skein.operators.communities import _weights, communities, modularity
from skein.sources import code, manifest

PY = '''import os

class Shop:
    """A shop(with) text."""

    @app.get("/items/<id>")
    def item(self, id):
        for x in range(3):
            if x:
                return load(x)
        return os.path.join("a", id)


@bp.route("/all", methods=["GET", "POST"])
async def everything():
    def inner():
        return 1
    return inner()

print("done")
'''
RUST = '''// fn ghost() {}
mod shop {
    #[get("/items")]
    pub async fn list(x: u32) -> u32 { if x > 1 { return helper(x); } "fn no() {" ; 0 }
    struct Item { id: u32 }
}
fn helper(x: u32) -> u32 { loop { println!("{}", x); } }
fn app() { Router::new().route("/add", post(shop::add)); }
'''
TS = '''interface Item { id: number }
class Shop { }
const load = async (id: string) => { return fetchIt(id); };
app.get("/one", auth, load);
'''


def test_python():
    assert code.symbols_of(PY, "python") == [("Shop", "class", 3, 11, None), ("item", "method", 7, 11, "Shop"), ("everything", "function", 15, 18, None), ("inner", "function", 16, 17, "everything")]
    assert [c for c in code.calls_of(PY, "python") if c[1] not in ("get", "route")] == [("item", "range", 8), ("item", "load", 10), ("item", "join", 11), ("everything", "inner", 18), (None, "print", 20)]
    assert code.routes_of(PY, "python") == [("GET", "/items/<id>", "item", 6), ("GET", "/all", "everything", 14), ("POST", "/all", "everything", 14)]
    assert code.complexity_of(PY, "python") == [(1, 1, 4, 2, 6)]
    assert code.symbols_of("def (", "python") == [] and code.complexity_of("def (", "python") == []


def test_braces():
    assert code.symbols_of(RUST, "rust") == [("shop", "module", 2, 6, None), ("list", "function", 4, 4, "shop"), ("Item", "struct", 5, 5, "shop"), ("helper", "function", 7, 7, None), ("app", "function", 8, 8, None)]
    assert code.routes_of(RUST, "rust") == [("GET", "/items", "list", 3), ("POST", "/add", "add", 8)]
    assert ("list", "helper", 4) in code.calls_of(RUST, "rust") and ("helper", "println", 7) in code.calls_of(RUST, "rust")
    assert code.complexity_of(RUST, "rust") == [(1, 1, 1, 3, 3)]
    assert [s[:2] for s in code.symbols_of(TS, "typescript")] == [("Item", "interface"), ("Shop", "class"), ("load", "function")]
    assert code.routes_of(TS, "typescript") == [("GET", "/one", "load", 4)]


def test_outline_and_contracts():
    text = "# A\n\ntext\n## B\n- x\n- y\n\n```py\n# no heading\n```\n# C #\n"
    assert code.outline_of(text, "markdown") == [("A", "heading", 1, 1, 10, None), ("B", "heading", 2, 4, 10, "A"), ("list", "list", 0, 5, 6, "B"), ("py", "fence", 0, 8, 10, "B"), ("C", "heading", 1, 11, 12, None)]
    doc = '{"paths": {"/a": {"get": {"operationId": "readA"}, "parameters": []}}, "components": {"schemas": {"P": {"properties": {"x": {}}}}}, "channels": {"c": {}}}'
    assert code.contract_of(doc, "json") == [("operation", "GET /a", "readA"), ("channel", "c", None), ("schema", "P", None), ("property", "x", "P")]
    assert code.contract_of("[1", "json") == [] and code.contract_of("[1]", "json") == []


def test_extraction_of_files(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("b.rs", "rust", RUST), ("n", None, "x"), ("e.py", "python", None), ("z.py", "python", "")], "path string, language string, content string")
    assert {r.path for r in code.symbols(files).collect()} == {"a.py", "b.rs"}
    assert code.calls(files).filter("path = 'a.py' and caller is null").count() >= 1
    assert code.complexity(files).count() == 2 and code.routes(files).count() == 5
    assert code.outline(files.limit(0)).count() == 0 and code.contracts(files).count() == 0


def test_communities(spark):
    rows = []
    for g in range(5):
        rows += [(f"{g}:{a}", f"{g}:{b}") for a in range(6) for b in range(6) if a != b] + [(f"{g}:0", f"{(g + 1) % 5}:1"), (f"{g}:2", f"{g}:2")]
    edges = spark.createDataFrame(rows, "from_id string, to_id string")
    found = communities(edges)
    got = {r.node: r.community for r in found.collect()}
    assert len(set(got.values())) == 5 and all(got[f"{g}:{a}"] == got[f"{g}:0"] for g in range(5) for a in range(6))
    pairs = {tuple(sorted(p)) for p in rows if p[0] != p[1]}
    want = sum((got[a] == got[b]) / len(pairs) for a, b in pairs)
    for c in set(got.values()):
        want -= (sum((got[a] == c) + (got[b] == c) for a, b in pairs) / (2 * len(pairs))) ** 2
    assert modularity(_weights(edges), found.withColumnRenamed("community", "c")) == pytest.approx(want)
    assert communities(edges.limit(0)).count() == 0


def test_bonuses(spark):
    rows = spark.createDataFrame([("finding", None, 0.5, 1000), ("note", False, None, 940), ("memory_projection", True, 1.0, 890), ("file", True, 2.0, 770), ("file", None, 1.0, None), ("memory_x", None, -1.0, 2000), ("calls", None, None, 600)], "kind string, own boolean, conf double, at long")
    got = rows.select(ranking.memory_bonus(F.col("kind"), F.col("own"), F.col("conf")), ranking.recency_bonus(F.col("at"), 1000, 60)).collect()
    assert [tuple(r) for r in got] == [(27, 24), (9, 12), (0, 12), (27, 6), (0, 0), (18, 24), (0, 0)]
    kinds = ["semantic_relation", "related_concept", "mentions", "calls", "my_community_of", "semantic_x", "contains", "other", None]
    scores = spark.createDataFrame([(k,) for k in kinds], "k string").select(ranking.edge_kind_score(F.col("k"))).collect()
    assert [r[0] for r in scores] == [34, 28, 22, 20, 20, 24, 12, 8, 8]


def test_seeded_limits(spark):
    nodes = spark.createDataFrame([(f"n{k}", "k", None) for k in range(10)], "id string, kind string, label string")
    edges = spark.createDataFrame([("n0", f"n{k}", "calls" if k < 4 else "x") for k in range(1, 10)] + [("n1", "gone", "calls")], "from_id string, to_id string, kind string")
    run = lambda *a, **k: [r.id for r in ranking.seeded_neighborhood(nodes, edges, ["n0", "n0"], *a, **k).collect()]
    assert run(2) == [f"n{k}" for k in range(10)]
    assert run(2, 3) == ["n0", "n1", "n2"] and run(1, per_node=2) == ["n0", "n1", "n2"] and run(1, cap=1) == ["n0", "n1"] and run(0) == ["n0"]


def test_confident_entities(spark):
    rows = spark.createDataFrame([("a", "Red Fox", 1, 0.5, True), ("b", "fox", 3, 0.3, False), ("c", "owl", 9, 0.9, False), ("d", None, 9, 0.5, True)], "node_id string, label string, degree int, confidence double, derived boolean")
    assert [r.node_id for r in ranking.confident_entities(rows, ["the_fox"]).collect()] == ["b", "a", "c", "d"]
    assert [r.node_id for r in ranking.confident_entities(rows, [], 0.4).collect()] == ["c"]


def test_ranks(spark):
    s = spark.createDataFrame([("a.rs", 1, "f", 1.0, True, True, 5, 1, True), ("tests/a.rs", 2, "g", 2.0, None, None, None, None, None)], "file string, line int, name string, score double, exact boolean, has_span boolean, summaries int, neighbors int, is_definition boolean")
    t = spark.createDataFrame([("b.rs", 3, 200.0, "High", True, None), ("b_test.rs", 4, None, None, None, None)], "file string, line int, score double, confidence string, has_handle boolean, has_symbol boolean")
    assert [(r.file, r["rank"]) for r in symbols.merged_ranking(s, t, 9).collect()] == [("a.rs", 148.0), ("tests/a.rs", 72.0), ("b.rs", 53.0), ("b_test.rs", -12.0)]


def test_impact(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    tests = make([("t1",), ("t2",), ("t3",)], "path string")
    got = symbols.impact(tests, make([("t1",), ("src",)], "path string"), make([("Load",), (None,)], "name string"), make([("t1", "load"), ("t2", "LOAD"), ("t2", "x")], "path string, callee string"), make([("t2", "load")], "path string, handler string"), make([("src", "load")], "path string, token string"))
    assert [tuple(r) for r in got.collect()] == [("t1", ["calls", "changed"], 1), ("t2", ["calls", "route"], 1)]


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("s", "s")], "from_id string, to_id string")
    assert {r.id for r in symbols.on_cycles(e).collect()} == {"b", "c", "s"}
    assert symbols.on_cycles(e.filter("from_id = 'a'")).isEmpty() and symbols.on_cycles(e.limit(0)).isEmpty()


def test_templates(spark):
    lines = {
        "[1778646072] snap_len=4616 file=/x/y took (45.2s), 10%": "[<ts>] snap_len=<n> file=<path> took (<n>), <n>",
        "Compiling serde v1.0.2 now": "Compiling <name> <ver> now",
        "Updating to  from v1.0.2": "Updating to from <ver>",
        "at deadbeef1 1234567 main.rs: 1.2.3 1.2": "at <hash> <n> <path>: <ver> <n>",
        '"" = k= ()': '"" = k= ()',
        "a1 b-2 +3ms -4,000": "a1 b-2 <n> <n>",
    }
    rows = spark.createDataFrame([(k,) for k in lines], "line string").select("line", digest.template(F.col("line")).alias("t")).collect()
    assert {r.line: r.t for r in rows} == lines


def test_anchors_and_failures(spark):
    told = {'File "a b.py", line 3, in f': ("a b.py", 3, None), "error at (src/x.rs:10:5)": ("src/x.rs", 10, 5), "x.py:7: boom": ("x.py", 7, None), "time 10:20 nothing": (None, None, None)}
    rows = spark.createDataFrame([(k,) for k in told], "line string").select("line", digest.anchor(F.col("line")).alias("a")).collect()
    assert {r.line: tuple(r.a) for r in rows} == told
    out = ["running 2 tests", "---- a::one stdout ----", "", "note", "error: bad", "src/x.rs:1:2", "---- a::two stdout ----", "error: bad", "src/x.rs:1:2", "failures:", "error: after", "___ test_three ___", "x.py:4: no", "=== short test summary info ==="]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(out)], "doc_id int, line_no int, line string")
    got = {(r.path, r.line, r.column, r.message, tuple(r.tests), r.occurrences) for r in digest.failures(lines).collect()}
    assert got == {("src/x.rs", 1, 2, "error: bad", ("a::one", "a::two"), 2), ("x.py", 4, None, "x.py:4: no", ("test_three",), 1)}


def test_gates(spark):
    names = {"p95_latency": "lower", "pass_rate": "higher", "Recall": "higher", "width": "unknown", "error_score": "lower"}
    rows = spark.createDataFrame([(k,) for k in names], "m string").select("m", digest.metric_direction(F.col("m")).alias("d")).collect()
    assert {r.m: r.d for r in rows} == names
    pick = random.Random(3)
    ms = {(64, "real"): 100, (64, "deep"): 50, (128, "real"): 105, (128, "deep"): 50, (256, "real"): 150, (256, "deep"): 50, (512, "real"): 90}
    samples = [(c, w, m + pick.random(), 10) for (c, w), m in ms.items() for _ in range(3)]
    got = digest.hop_cap_gate(spark.createDataFrame(samples, "cap int, workload string, ms double, rows int"))
    assert {tuple(r) for r in got.collect()} == {(128, "promote"), (256, "blocked"), (512, "insufficient")}


def test_manifest(spark):
    text = """# Decisions
| ID | Status | Date | Decision | Source | Anchors | Supersedes | Related |
|---|:---|---|---|---|---|---|---|
| D1 | superseded | 2024-01-02 | old | - | a.rs, b.rs | - | |
| D2 | accepted | 2024-02-03 | new | x.md | - | D1 | D9 |
| D3 | proposed | 2024-13-03 | - | | | D2 | |
| D4 | superseded | 2024-01-01 | lost | | | D4 | |
| few | cells |
"""
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(text.split("\n"))] + [(2, 0, "| D1 | x |")], "doc_id int, line_no int, line string")
    rows = manifest.decisions(lines)
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {"D1", "D2", "D3", "D4"} and got["D1"].anchors == ["a.rs", "b.rs"] and got["D1"].supersedes == [] and got["D1"].source is None
    assert got["D2"].supersedes == ["D1"] and got["D2"].line_no == 4
    assert {tuple(r) for r in manifest.faults(rows).collect()} == {("D2", "missing"), ("D3", "bad_date"), ("D3", "no_decision"), ("D3", "may_not_supersede"), ("D3", "target_not_superseded"), ("D4", "cycle")}
    assert manifest.faults(rows.filter("id = 'x'")).count() == 0


def test_components_match_brute_force(spark):
    import random

    from skein.operators import graph

    for seed in range(4):
        rng = random.Random(seed)
        nodes = [f"n{k:02d}" for k in range(30)]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range((15, 30, 45, 60)[seed])} | {("n00", "n00")}
        reach = {a: {a} for a in nodes}
        for _ in nodes:
            for a, b in edges:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        ids = {x for e in edges for x in e}
        want = {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids}
        rows = spark.createDataFrame([*edges, (None, "n01")], "from_id string, to_id string")
        assert {r.id: r.component for r in graph.component_members(rows).collect()} == want
    assert graph.strongly_connected(rows.limit(0)).count() == 0


def test_delta_tells_nulls_apart(spark):
    from skein.operators import graph

    old = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, None, None), (4, "a", "b")], "id int, p string, q string")
    new = spark.createDataFrame([(1, "x", None), (2, "a", None), (3, "y", None), (5, None, None)], "id int, p string, q string")
    assert {r.id: r.change for r in graph.delta(old, new, "id", ["p", "q"]).collect()} == {1: "update", 3: "update", 4: "delete", 5: "insert"}


def test_overlap_pairs_match_brute_force(spark):
    import itertools
    import random

    from skein.operators import search

    rng = random.Random(3)
    sets = {k: {0} | {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for k in range(40)}
    rows = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s] * 2 + [(None, 1), (1, None)], "owner int, member int")
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
        got = {(r.a, r.b): r.jaccard for r in search.overlap_pairs(rows, least).collect()}
        assert got == {k: v for k, v in want.items() if v >= least}


def test_latest_takes_the_greatest_hash(spark):
    from pyspark.sql import functions as F

    from skein.streaming import folds

    rows = spark.createDataFrame([(1, 1, x) for x in "abcdef"], "k int, v int, x string")
    want = rows.orderBy(F.xxhash64("k", "v", "x").desc()).first()
    assert folds.latest(rows, "k", "v").collect() == [want]


def _shuffled(df):
    """The rows that each shuffle of a query wrote when it ran."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(p.plan())
        if kind == "ShuffleExchangeExec":
            found.append(p.metrics().get("shuffleRecordsWritten").get().value())
        left += [p.children().apply(k) for k in range(p.children().size())]
    return found


CLAIMED = [(f"t{t}", s, m) for s, k in (("file", 40), ("config", 3), ("symbol", 30), ("test", 50), ("other", 2)) for m in range(9) for t in range(60) if (t * 7 + m * 11 + k) % 61 < k] + [("t1", "file", None), (None, "file", 1), ("t2", None, 1)]


def test_conflicts_shuffle_no_pairs(spark):
    import itertools

    got = symbols.conflicts(spark.createDataFrame(CLAIMED * 2, "target string, surface string, member int"))
    by = {}
    for t, s, m in CLAIMED:
        if t and s and m is not None:
            by.setdefault(t, set()).add((s, m))
    want = {}
    for a, b in itertools.combinations(sorted(by), 2):
        n = [sum(s == k for s, _ in by[a] & by[b]) for k in ("file", "config", "symbol", "test")]
        if by[a] & by[b]:
            want[a, b] = (*n, 100 * n[0] + 100 * n[1] + 40 * n[2] + 10 * n[3], "fail_closed" if n[0] or n[1] else "high" if n[2] else "medium" if n[3] else "low")
    assert {(r.a, r.b): tuple(r)[2:] for r in got.collect()} == want
    assert max(_shuffled(got)) <= 2 * len(CLAIMED)


@pytest.mark.parametrize("coded", [1_000_000, 1])
def test_schedule_shuffles_no_pairs(spark, monkeypatch, coded):
    monkeypatch.setattr(symbols, "CODED", coded)
    claims = spark.createDataFrame(CLAIMED, "target string, surface string, member int")
    ranks = {f"t{t}": t % 5 for t in range(70)}
    out = symbols.schedule(spark.createDataFrame([*ranks.items()], "target string, rank int"), claims)
    by = {}
    for t, s, m in CLAIMED:
        if t and s in ("file", "config", "symbol") and m is not None:
            by.setdefault(t, set()).add((s, m))
    met = {(a, b) for a in by for b in by if a != b and by[a] & by[b]}
    first = lambda a, b: (ranks[a], a) < (ranks[b], b)
    want = {t: (sorted(b for a, b in met if a == t and first(a, b)), sorted(b for a, b in met if a == t and first(b, a))) for t in ranks}
    assert {r.target: (r.blocks, r.blocked_by) for r in out.collect()} == want
    assert all(r.parallel_safe == (want[r.target] == ([], [])) for r in out.collect())
    if coded > 1:
        assert max(_shuffled(out)) <= 2 * len(CLAIMED)


@pytest.mark.parametrize("hot", [200_000, 0])
def test_overlap_pairs_drop_chance_meetings_before_a_shuffle(spark, monkeypatch, hot):
    import itertools

    from skein.operators import search

    monkeypatch.setattr(search, "HOT", hot)
    rng = random.Random(5)
    sets = {k: {rng.randrange(40) for _ in range(6)} for k in range(400)} | {500: {0}, 501: {0}, 502: {0, 1}, 503: set(range(90)), 504: set(range(9, 94))}
    rows = spark.createDataFrame([(k, m) for k, s in sets.items() for m in sorted(s)], "owner int, member int")
    got = search.overlap_pairs(rows, 0.5)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.5}
    assert max(_shuffled(got)) <= 2 * rows.count()


def test_closure_writes_known_pairs_once(spark, monkeypatch):
    from skein.operators import graph

    written, durable = [], graph.durable

    def counted(df):
        out = durable(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "durable", counted)
    edges = [(f"s{a}", f"p{b}") for a in range(20) for b in range(20)] + [(f"p{b}", f"b{b % 3}") for b in range(20)]
    got = graph.closure(spark.createDataFrame([*edges, (None, "s1")], "from_id string, to_id string"))
    want = set(edges) | {(f"s{a}", f"b{b}") for a in range(20) for b in range(3)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(written) < 1.5 * len(want)
    rng = random.Random(1)
    cyclic = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(20)]
    want = set(cyclic)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert sorted(map(tuple, graph.closure(spark.createDataFrame(cyclic, "from_id int, to_id int")).collect())) == sorted(want)


def test_health_with_equal_keys(spark, monkeypatch):
    from skein.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "a"), ("d", "c"), (None, "a")], "from_id string, to_id string")
    want = sorted(map(tuple, graph.health(edges).collect()))
    assert len(want) == 4
    monkeypatch.setattr(F, "xxhash64", lambda c: F.length(c).cast("long"))
    assert sorted(map(tuple, graph.health(edges).collect())) == want


def test_ranked_joins_many_nodes_in_one_join(spark, monkeypatch):
    from skein.operators import graph

    monkeypatch.setattr(graph, "BROADCAST", 3)
    monkeypatch.setattr(graph, "TASK", 10)
    one = spark.createDataFrame([(f"n{k}", f"n{k * k % 40}") for k in range(40)], "from_id string, to_id string")
    edges = one.unionAll(one.select(F.concat(F.lit("x"), "from_id"), "to_id"))
    found = spark.createDataFrame([(f"n{k}", "k", "l", k % 3) for k in range(30)] + [("alone", "k", "l", 0)], "id string, kind string, label string, hops int")
    want = {r.id: r.d for r in edges.select(F.col("from_id").alias("id")).unionAll(edges.select("to_id")).groupBy("id").agg(F.count("id").alias("d")).collect()}
    out = graph.ranked(found, edges, 31)
    assert {r.id: r.degree for r in out.collect()} == {r.id: want.get(r.id, 0) for r in found.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("LeftSemi") == 0 and "REPARTITION_BY_NUM" in plan


def test_vocabulary_shuffles_counts_only(spark):
    from skein.operators import search

    words = ["one", "Two", "three", "été", "x1"]
    texts = [(k, " ".join(words[(k + j) % 5 if k % 3 else 0] for j in range(k % 7))) for k in range(300)]
    for rows in (texts, texts + [(7, "one, TWO-one"), (None, "one"), (None, "one two"), (5, None), (900, None)]):
        want = {}
        for k, text in rows:
            for w in (text or "").lower().replace(",", " ").replace("-", " ").split():
                want.setdefault(w, []).append(k)
        got = search.vocabulary(spark.createDataFrame(rows, "doc_id int, text string").coalesce(2))
        assert {tuple(r) for r in got.select("token", "n_docs", "n").collect()} == {(w, len(set(x)), len(x)) for w, x in want.items()}
        if rows is texts:
            assert max(_shuffled(got)) <= 2 * len(words)
