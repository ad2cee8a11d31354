"""Stores that grow batch by batch, and graph methods in rounds, on hand-made rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import communities as C
from cairn.operators import dense_index as D
from cairn.operators import graph as G
from cairn.operators.keyword_index import KeywordIndex
from cairn.operators.retrieval import dense_search, keyword_fallback, sparse_search
from cairn.sources.tables import Stages
from cairn.streaming import ingest as I

CHUNK = "tenant_id string, id long, content string, file string"


def hits(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_follows_its_batches(spark):
    stages = Stages(spark)
    index = KeywordIndex(spark, stages.path("index"), buckets=4)
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta_x"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    queries = spark.createDataFrame([(t, i * 2 + (t == "b"), f"{words[i]} {words[(i + 1) % 6]}", None if i % 2 else ["f1"]) for t in "ab" for i in range(6)], "tenant_id string, query_id long, text string, files array<string>")
    now = {}
    for batch in range(1, 6):
        changed = [(t, rng.randrange(15), text() if rng.random() < 0.9 else None, f"f{rng.randrange(3)}") for t in "ab" for _ in range(6)]
        changed = list({(t, i): (t, i, c, f) for t, i, c, f in changed}.values())
        removed = [(rng.choice("ab"), rng.randrange(15)) for _ in range(4)]
        assert index.update(batch, spark.createDataFrame(changed, CHUNK), spark.createDataFrame(removed, "tenant_id string, id long"))
        for key in removed:
            now.pop(key, None)
        now.update({(t, i): (c or "", f) for t, i, c, f in changed})
        if batch == 3:
            index.merge()
            assert len(index.store.done()) == 1
        for t in "ab":
            chunks = spark.createDataFrame([(i, c, f) for (x, i), (c, f) in now.items() if x == t], "id long, content string, file string")
            own = queries.where(F.col("tenant_id") == t)
            assert hits(index.search(own, 3)) == hits(sparse_search(own, chunks, 3))
    before = hits(index.search(queries, 5))
    assert not index.update(5, spark.createDataFrame([("a", 1, "alpha beta", "f")], CHUNK))
    assert hits(index.search(queries, 5)) == before
    assert "content" not in index.search(queries, 5)._jdf.queryExecution().optimizedPlan().toString()


def test_index_writes_changed_chunks_only(spark):
    index = KeywordIndex(spark, Stages(spark).path("index"))
    rows = [("t", i, f"word{i} common", "f") for i in range(20)]
    index.update(1, spark.createDataFrame(rows, CHUNK))
    rows[3] = ("t", 3, "other words", "f")
    index.update(2, spark.createDataFrame(rows, CHUNK))
    assert spark.read.parquet(f"{index.store.path}/chunks/v=4").count() == 1
    assert spark.read.parquet(f"{index.store.path}/postings/v=4").count() == 2
    # a batch that stopped before its mark is not seen, and is written anew
    index.store.drop(4)
    assert index.chunks().where("id = 3").first()["v"] == 2
    assert index.update(2, spark.createDataFrame(rows, CHUNK)) and index.chunks().where("id = 3").first()["v"] == 4


NODE = "id string, name string, owner string"


def plain_extract(spark, state):
    """Nodes and edges as (id, owner) and links say for each (path, head)."""

    def extract(files):
        asked = [(r["path"], r["head"]) for r in files.collect()]
        nodes = [(i, i.upper(), o) for f in asked for i, o, _ in state[f]]
        edges = [(i, d, "IMPORTS") for f in asked for i, _, to in state[f] for d in to]
        return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, relation string")

    return extract


def test_store_merges_batches_and_passes_over_replays(spark):
    store = I.CodeStore(spark, Stages(spark).path("graph"), NODE, keep_old=("owner",))
    state = {
        ("a", "1"): [("a", "ann", ["b", "c"]), ("a::f", None, ["b"])], ("b", "1"): [("b", "bob", ["a::f"])], ("c", "1"): [("c", None, ["missing"])],
        ("a", "2"): [("a", None, ["c"])], ("b", "3"): [("b", "eve", ["a", "c"])],
    }
    extract = plain_extract(spark, state)
    files = lambda *rows: spark.createDataFrame(rows, "path string, action string, head string")
    graph = lambda: (sorted((r["id"], r["owner"]) for r in store.nodes().collect()), sorted((r["src"], r["dst"]) for r in store.edges().collect()))
    assert store.apply(0, files(("a", "changed", "1"), ("b", "changed", "1"), ("c", "changed", "1")), extract)
    assert graph() == ([("a", "ann"), ("a::f", None), ("b", "bob"), ("c", None)], [("a", "b"), ("a", "c"), ("a::f", "b"), ("b", "a::f")])
    assert store.apply(1, files(("a", "changed", "2")), extract)
    two = ([("a", "ann"), ("b", "bob"), ("c", None)], [("a", "c")])  # a::f went with all that touched it, the owner stays
    assert graph() == two
    assert not store.apply(1, files(("b", "removed", "9")), extract) and graph() == two
    assert store.apply(2, files(("c", "removed", "2")), extract) and graph() == ([("a", "ann"), ("b", "bob")], [])
    store.merge()
    assert graph() == ([("a", "ann"), ("b", "bob")], []) and store.store.done() == [5]
    assert store.apply(3, files(("b", "changed", "3")), extract) and graph() == ([("a", "ann"), ("b", "eve")], [("b", "a")])


PUSH = "repo string, ref string, before string, after string, ts timestamp, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"


def test_pushes_reach_the_store_once(spark, tmp_path):
    stages = Stages(spark)
    store = I.CodeStore(spark, stages.path("graph"), NODE)

    def extract(files):
        return files.select(F.col("path").alias("id"), F.col("head").alias("name"), F.lit("o").alias("owner")), files.select(F.col("path").alias("src"), F.lit("a").alias("dst"), F.lit("IMPORTS").alias("relation")).where("src <> 'a'")

    def push(name, *rows):
        spark.createDataFrame([("r", ref, before, after, ts, [(a, m, r)]) for ref, before, after, ts, a, m, r in rows], spark.createDataFrame([], PUSH.replace("ts timestamp", "ts string")).schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(PUSH).json(str(tmp_path / "in"))
        I.ingest(stream, store, extract, stages.path("checkpoint"), listing=lambda head: spark.createDataFrame([("x",), ("a",)], "path string")).awaitTermination()
        return sorted((r["id"], r["name"]) for r in store.nodes().collect()), sorted((r["src"], r["dst"]) for r in store.edges().collect())

    main = "refs/heads/main"
    push("1", (main, "p", "h1", "2024-01-01T00:00:00", ["a", "b", "c"], [], []), (main, "p", "h2", "2024-01-01T01:00:00", [], ["b"], ["c"]), ("refs/heads/dev", "p", "h9", "2024-01-01T02:00:00", ["z"], [], ["a"]))
    assert run() == ([("a", "h1"), ("b", "h2")], [("b", "a")])
    push("2", (main, "p", "h2", "2024-01-01T01:00:00", ["again"], [], []), (main, "h2", "h3", "2024-01-01T03:00:00", ["d"], ["a"], ["b"]))
    assert run() == ([("a", "h3"), ("d", "h3")], [("d", "a")])
    push("3", (main, "0000", "h4", "2024-01-01T04:00:00", ["q"], [], []))  # no previous head: all files there are
    assert run() == ([("a", "h4"), ("x", "h4")], [("x", "a")])
    assert run() == ([("a", "h4"), ("x", "h4")], [("x", "a")])


def graph_of(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, i, "api" if k % 3 else "ui") for k, i in enumerate(ids)], "id string, name string, layer string")
    return nodes, spark.createDataFrame([(a, b, "DEPENDS_ON") for a, b in pairs], "src string, dst string, relation string")


def plain_modularity(pairs, label):
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    m, degree = len(links), Counter(x for p in links for x in p)
    inside = sum(len({label[x] for x in p}) == 1 for p in links) / m
    total = Counter()
    for x, d in degree.items():
        total[label[x]] += d
    return inside - sum((t / (2 * m)) ** 2 for t in total.values())


def test_louvain_finds_planted_groups(spark):
    rng = random.Random(4)
    pairs = [(f"g{g}n{i:02d}", f"g{g}n{j:02d}") for g in range(5) for i in range(12) for j in range(12) if i < j and rng.random() < 0.5]
    pairs += [(f"g{g}n{rng.randrange(12):02d}", f"g{(g + 1) % 5}n{rng.randrange(12):02d}") for g in range(5) for _ in range(3)]
    nodes, edges = graph_of(spark, pairs)
    stages = Stages(spark)
    label = {r["id"]: r["label"] for r in C.louvain(nodes, edges, stages).collect()}
    spread = {r["id"]: r["community"] for r in G.communities(nodes, edges, stages).collect()}
    found = spark.createDataFrame(list(label.items()), "id string, label string")
    assert abs(C.modularity(nodes, edges, found) - plain_modularity(pairs, label)) < 1e-9
    assert plain_modularity(pairs, label) >= plain_modularity(pairs, spread) and plain_modularity(pairs, label) > 0.55
    report = C.community_report(nodes, C.merged_communities(nodes, found)).collect()
    assert sum(r["n"] for r in report) == 60 and {r["dominant_layer"] for r in report} == {"api"} and all(len(r["label"]) <= 40 for r in report)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_is_no_worse_than_labels_that_spread(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)]
    nodes, edges = graph_of(spark, pairs)
    stages = Stages(spark)
    label = {r["id"]: r["label"] for r in C.louvain(nodes, edges, stages).collect()}
    spread = {r["id"]: r["community"] for r in G.communities(nodes, edges, stages, most=60).collect()}
    assert plain_modularity(pairs, label) >= plain_modularity(pairs, spread) > -1


def test_small_graphs_are_grouped_by_layer(spark):
    nodes = spark.createDataFrame([("a/x", "a/x", "api"), ("b", "b", None), ("c", None, "ui")], "id string, name string, layer string")
    groups = C.merged_communities(nodes, nodes.select("id", F.col("id").alias("label")))
    out = {r["label"]: (r["dominant_layer"], r["color"]) for r in C.community_report(nodes, groups).collect()}
    assert out == {"x": ("api", "#6366f1"), "b": ("other", "#475569"), "c": ("ui", "#f59e0b")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_and_short_cycles(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(n + 12)})
    _, edges = graph_of(spark, pairs)
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def walk(a):
        seen, front = {}, {a}
        for hop in range(1, n + 1):
            front = {y for x in front for y in after.get(x, ()) if y not in seen}
            seen.update(dict.fromkeys(front, hop))
        return seen

    reach = {a: walk(a) for a in {x for p in pairs for x in p}}
    want = {a: min(x for x in reach if x == a or (x in reach[a] and a in reach[x])) for a in reach if any(b != a and b in reach[a] and a in reach[b] for b in reach)}
    assert {r["id"]: r["component"] for r in C.strong_components(edges, Stages(spark)).collect()} == want
    changed = spark.createDataFrame([(1, a) for a in reach], "pr_id long, file string")
    proper = [(a, b) for a, b in pairs if a != b]
    after = {}
    for a, b in proper:
        after.setdefault(a, set()).add(b)
    back = {a: walk(a).get(a) for a in reach}
    for most in (2, 3, 6):
        out = {r["file"]: r["length"] for r in G.files_on_cycles(changed, edges, most).collect()}
        assert out == {a: k for a, k in back.items() if k and k <= most}


def found_share(found, exact):
    want = {(r["query_id"], r["id"]) for r in exact.collect()}
    rows = found.collect()
    assert len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)
    return len(want & {(r["query_id"], r["id"]) for r in rows}) / len(want)


@pytest.mark.parametrize("spread", [0.15, None])
def test_indexed_search_finds_what_the_exact_one_finds(spark, sf, spread):
    """Of clustered vectors, in tiles of few rows, and of the table's vectors, which have no clusters."""
    if spread:
        rng = np.random.default_rng(3)
        x = rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)] + spread * rng.standard_normal((3000, 24))
        chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    else:
        chunks = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [0.0, 0.0]), (-4, [1.0])], "id long, embedding array<double>")
    chunks = chunks.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(odd)
    queries = chunks.where("id % 20 = 0 or id < 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = D.dense_search_indexed(queries, chunks, 10, Stages(spark), tile=200 if spread else 4096)
    exact = dense_search(queries, chunks, 10)
    assert found_share(found, exact) >= 0.9
    both = {(r["query_id"], r["id"]): r["score"] for r in exact.collect()}
    assert all(abs(r["score"] - both[r["query_id"], r["id"]]) < 1e-8 for r in found.collect() if (r["query_id"], r["id"]) in both)


def test_clustered_vectors_need_few_probes():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 4000)] + 0.1 * rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert D.probes_needed(x, 10, 4, 8, 0.95) <= 1 < D.probes_needed(rng.standard_normal((4000, 32)), 10, 4, 8, 0.95)


def test_fallback_keeps_the_shortest_of_each_token(spark):
    rng = random.Random(6)
    chunks = [(i, " ".join(rng.choice(["abc", "xabcy", "zz", "q"]) for _ in range(rng.randrange(1, 9))), f"f{i % 3}") for i in range(60)]
    queries = [(q, text, files) for q, (text, files) in enumerate([("abc", None), ("abc", ["f1"]), ("abc zz", []), ("zz", ["f1", "f2"]), ("nothing", None), ("?", None)])]
    c = spark.createDataFrame(chunks, "id long, content string, file string")
    q = spark.createDataFrame(queries, "query_id long, text string, files array<string>")
    none = spark.createDataFrame([(2,)], "query_id long")
    want = []
    for n, text, files in queries:
        term = text.split()[0]
        held = sorted((len(t), i) for i, t, f in chunks if any(term in w and len(w) > 1 for w in t.split()) and (not files or f in files)) if n != 2 and term != "?" else []
        want += [(n, i, k + 1) for k, (_, i) in enumerate(held[:4])]
    for stages in (None, Stages(spark)):
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in keyword_fallback(q, c, none, 4, stages).collect()) == sorted(want)


def test_what_is_nearby_through_names_and_functions(spark):
    from cairn.operators import risk as K

    edges = [("a/pay.py", "b/x.py", "DEPENDS_ON"), ("c/y.py", "a/pay.py", "COVERS"), ("a/pay.py", "a/pay.py::f", "CONTAINS"), ("a/pay.py::f", "d/z.py::g", "CALLS"), ("d/z.py", "d/z.py::g", "CONTAINS"), ("e/pay.py.bak", "b/x.py", "CALLS")]
    edges = spark.createDataFrame(edges, "src string, dst string, relation string")
    ids = ["a/pay.py", "b/x.py", "c/y.py", "d/z.py", "e/pay.py.bak", "a/pay.py::f", "d/z.py::g"]
    nodes = spark.createDataFrame([(i, "file", False) for i in ids], "id string, type string, infrastructure boolean")
    ask = lambda *rows: {(r["request_id"], r["id"]): (r["kind"], r["hop"]) for r in K.nearby(spark.createDataFrame(rows, "request_id int, id string"), nodes, edges).collect()}
    one = {"b/x.py": ("fallback", 1), "c/y.py": ("fallback_indirect", 2), "a/pay.py": ("fallback_indirect", 2)}  # its function resembles, too
    assert ask((1, "pay.py"), (2, "nothing.py"), (3, "a/pay")) == {**{(1, k): v for k, v in one.items()}, **{(3, k): v for k, v in one.items()}, (3, "d/z.py"): ("fallback_indirect", 2)}
    assert ask((4, "b/x.py::deep")) == {(4, "a/pay.py"): ("fallback", 1), (4, "e/pay.py.bak"): ("fallback_indirect", 1)}
    out = K.affected_by(spark.createDataFrame([(1, "pay.py"), (2, "a/pay.py")], "request_id int, id string"), nodes, edges)
    kinds = {(r["request_id"], r["id"]): r["kind"] for r in out.collect()}
    assert kinds[1, "b/x.py"] == "fallback" and kinds[2, "b/x.py"] == "dependency" and (2, "c/y.py") not in kinds
