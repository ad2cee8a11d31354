"""What the findings of round 4 found wrong."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import insight, retrieval
from cairn.operators import risk as R
from cairn.plans import QUERIES, fixtures
from cairn.sources.tables import Stages
from tests.oracle import connect, rows

FILES = [f"{d}/{n}{i}.py" for d in ("a", "a/b", "a/b/c", "a.b", "d") for n in ("f", "test_g") for i in range(4)]
LONE = [f"e/l{i}.py" for i in range(6)]  # without links


def code(spark, seed):
    """Nodes and edges of a made-up code base, and requests of one to five sources."""
    rnd = random.Random(seed)
    ids = [*FILES, "bare.py", *[f"{f}::s" for f in FILES[::3]]]
    nodes = [(i, "function" if "::" in i else "file", i in ("d/f0.py", "a/b/f1.py"), rnd.choice([0.2, 0.6, 0.8]), rnd.choice([0, 0, 2])) for i in [*ids, *LONE]]
    kinds = ["DEPENDS_ON", "CALLS", "IMPORTS", "MAYBE_CALLS", "MAYBE_DEPENDS", "COVERS"]
    edges = {(rnd.choice(ids), rnd.choice(ids), rnd.choice(kinds)) for _ in range(70)} | {(f, f"{f}::t", "CONTAINS") for f in FILES[::4]} | {(f"{f}::t", rnd.choice(FILES), "CALLS") for f in FILES[::4]}
    asked = {(r, rnd.choice(ids)) for r in range(14) for _ in range(r % 5 + 1)} | {(14, LONE[2]), (14, LONE[0])}
    schema = "id string, type string, infrastructure boolean, churn double, incidents int"
    return nodes, edges, asked, (spark.createDataFrame(sorted(asked), "request_id int, id string"), spark.createDataFrame(nodes, schema), spark.createDataFrame(sorted(edges), "src string, dst string, relation string"))


def plain(nodes, edges, asked, mode, limit, more):
    """{request: {id: (kind, hop)}} of ``affected_by`` in plain Python, without what is nearby."""
    out = {}
    files, infra = [n[0] for n in nodes if n[1] == "file"], {n[0] for n in nodes if n[2]}
    held = {(i, i.split("::")[0]) for i, *_ in nodes if "::" in i} | {(d, s) for s, d, k in edges if k == "CONTAINS"}
    use = {(s, d) for s, d, k in edges if k in R.USES}
    also = {(s, d) for s, d, k in edges if k in R.USES + R.MAYBE}
    lifted = {(f, d) for g, f in ((d, s) for s, d, k in edges if k == "CONTAINS") for s, d in use if s == g} | {(s, f) for g, f in ((d, s) for s, d, k in edges if k == "CONTAINS") for s, d in use if d == g}
    lifted = {(s, d) for s, d in lifted if s != d}
    for r in {r for r, _ in asked}:
        own = {i for q, i in asked if q == r and i not in infra}
        start = own | {s for s, f in held if f in own}
        classes = [({s for s, d in also if d in start}, "direct", 1), ({d for s, d in use if s in start}, "dependency", 1), ({s for s, d in lifted if d in start}, "indirect", 2), ({d for s, d in lifted if s in start}, "indirect", 2)]
        classes.append(({f for f in files for o in own if "/" in o and f.startswith(o.rsplit("/", 1)[0] + "/")}, "sibling", 1))
        classes = [({i for i in x if "::" not in i} - own, kind, hop) for x, kind, hop in classes]
        if mode == "cascade":
            classes = [c for c in classes if c[0]][:1]
        best = {}
        for c, (x, kind, hop) in enumerate(classes):
            for i in x:
                best[i] = min(best.get(i, (9,)), (hop, c, kind))
        found = {i: (kind, hop) for hop, kind, i in sorted((h, k, i) for i, (h, _, k) in best.items())[:limit]}
        pure = {d: 2 for s, d in lifted if s in start} | {d: 1 for s, d in also if s in start}
        pure = sorted((h, i) for i, h in pure.items() if "::" not in i and i not in own and i not in found)[:more]
        out[r] = found | {i: ("dependency", h) for h, i in pure}
    return out


@pytest.mark.parametrize("mode,limit", [("union", 4), ("cascade", 4), ("union", 12)])
def test_siblings_stay_spans_and_equal_a_plain_search(spark, mode, limit):
    """requests of many sources, in folders larger than the limit and in nested ones."""
    nodes, edges, asked, tables = code(spark, limit)
    want = plain(nodes, edges, asked, mode, limit, 3)
    found, spans, members = R.hits_of(*tables, mode, limit, 3)
    spans = Stages(spark).keep(spans)
    got = {}
    near = R.siblings_in(spans, members).withColumns({"kind": F.lit("sibling"), "hop": F.lit(1)}).collect()
    for r in [*found.collect(), *near]:
        assert r.id not in got.setdefault(r.request_id, {})
        got[r.request_id][r.id] = (r.kind, r.hop)
    lost = {r for r, x in want.items() if not x}
    assert {r: x for r, x in got.items() if r not in lost} == {r: x for r, x in want.items() if x}
    # a row for a folder, however many files of it are hit
    at = [(r.request_id, r.folder) for r in spans.collect()]
    assert len(at) == len(set(at)) and spans.agg(F.sum("n")).first()[0] == len(near)


def test_reviews_count_siblings_and_do_not_list_them(spark):
    """the same reviews from spans as from a row for each affected file."""
    nodes, edges, asked, (sources, ns, es) = code(spark, 5)
    found, spans, members = (x.withColumnRenamed("request_id", "pr_id") for x in R.hits_of(sources, ns, es, limit=20, stages=Stages(spark)))
    pr = sources.selectExpr("request_id AS pr_id", "id AS file")
    none = lambda schema: spark.createDataFrame([], schema)
    risks = ns.selectExpr("id AS file", "10 AS risk", "'o' AS owner", "0.1D AS bus_risk", "incidents")
    rest = (none("pr_id int, file string"), none("src string, dst string, violation_rule string"), none("pr_id int, person string, confidence double"))
    whole, files = R.infrastructure_of(sources, ns).withColumnRenamed("request_id", "pr_id"), ns.where("type = 'file'").select("id")
    assert whole.count() and spans.join(whole, "pr_id").count() and spans.count()
    expand = spans.withColumnRenamed("pr_id", "request_id")
    listed = found.select("pr_id", "id").unionByName(R.siblings_in(expand, members).selectExpr("request_id AS pr_id", "id"))
    for w in ((None, None), (whole, files)):
        assert sorted(R.pr_review(pr, risks, found, *rest, *w, (spans, members)).collect()) == sorted(R.pr_review(pr, risks, listed, *rest, *w).collect())


def test_definitions_send_no_symbols_to_the_driver(spark, sf):
    """keys are met once, merged; before, all symbols were broadcast three times."""
    symbols = [(f"p{i % 5}.py::{n}", n, "function" if i % 3 else "class") for i, n in enumerate("abcabdabe")] + [("a", None, None), ("z/y", "y", "function"), ("q::e", "other", None)]
    asked = [(i, s) for i, s in enumerate(["a", "b", "e", "p1.py::b", "y", "z/y", "gone", None, "other", "p0.py"])]
    found = insight.find_definition(spark.createDataFrame(asked, "request_id long, symbol string"), spark.createDataFrame(symbols, "id string, name string, type string"))
    for df in (found, QUERIES["C17_find_definition"](spark, sf)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for q, s in asked:
        met = sorted((t != "function", i) for i, n, t in symbols if s is not None and (s in (i, n) or i.endswith(f"::{s}")))
        if met:
            want[q] = met[0][1]
    assert {r.request_id: r.id for r in found.collect()} == want


def test_what_siblings_and_infrastructure_hit_is_not_written_out(spark):
    """edges, questions and categories from spans as from a row for each affected file."""
    nodes, edges, _, (_, ns, es) = code(spark, 3)
    keep = Stages(spark).keep
    ns = keep(ns.selectExpr("*", "incidents > 0 AS sensitive", "churn > 0.7 AS api_route"))
    asked = keep(spark.createDataFrame(list(enumerate([*FILES[:6], "d/f0.py", "a/b/f1.py", LONE[1]])), "request_id int, id string"))
    hits, spans, members = map(keep, R.scored_hits(asked, ns, es, ns.where("incidents = 0").select("id")))
    near = R.siblings_in(spans, members).selectExpr("request_id", "id", "'sibling' AS kind", "1 AS hop", "score", "contribution")
    all_ = R.hits_everything(asked, ns).selectExpr("request_id", "id", "'everything' AS kind", "1 AS hop", "100 AS score", "100.0D AS contribution")
    listed = keep(hits.unionByName(near).unionByName(all_))
    whole, files, siblings = R.infrastructure_of(asked, ns), ns.where("type = 'file'").select("id"), (spans, members)
    assert whole.count() == 2 and spans.count() > 5
    same = lambda a, b: sorted(a.collect()) == sorted(b.collect()) != []
    assert same(R.blast_edges(hits, es, whole, files, siblings), R.blast_edges(listed, es))
    assert same(R.impact_categories(hits, ns, whole, siblings), R.impact_categories(listed, ns))
    q = asked.selectExpr("request_id", "id AS question")
    for k in (2, 40):
        assert same(R.impact_context(q, hits, k, whole, files, siblings), R.impact_context(q, listed, k))


def test_authors_are_counted_by_numbers(spark, sf):
    """no name of a file is dealt out with each of its commits; the rows are those of the view's text."""
    fx = fixtures.Fixtures(spark, sf)
    text = fixtures.with_views("SELECT * FROM fx_authors")
    want = connect(sf).sql(text).df()
    assert rows(fx.authors.toPandas()) == rows(want) and len(want)
    plan = fx.authors._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash" in plan and "hashpartitioning(file#" not in plan and "hashpartitioning(id#" not in plan


def test_graph_search_makes_lines_of_links_that_are_asked_for_only(spark):
    """edges meet the files that are asked for before they become lines; who worked on what is dealt out once, by id."""
    df = spark.createDataFrame
    nodes = df([(f, "file", "Ann", "Bob", n) for n, f in enumerate(FILES)], "id string, type string, top_owner string, last_author string, commit_count long")
    edges = df([(a, b, "CALLS") for a, b in zip(FILES, FILES[3:])] + [(FILES[0], FILES[3], "IMPORTS")], "src string, dst string, relation string")
    routed = df([(1, "semantic", None, [FILES[5]]), (2, "person", "bo", None), (3, "call_flow", None, [])], "query_id long, intent string, person string, files array<string>")
    anchors = df([(3, FILES[0], 1), (3, FILES[9], 2)], "query_id long, file string, place int")
    found = retrieval.graph_search(routed, anchors, nodes, edges, df([(FILES[2], "bobby")], "node string, author string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") > 2 and "RepartitionByExpression [id" in plan
    got = {(r.query_id, r.key): r.content.split("\n") for r in found.collect()}
    lines = lambda *fs: sorted({f"{a} --[{k}]--> {b}" for a, b, k in [tuple(r) for r in edges.collect()] if {a, b} & set(fs)})
    assert got[1, FILES[5]] == got[1, f"graph:{FILES[5]}"] == lines(FILES[5])
    assert got[3, f"graph:{FILES[0]}"] == got[3, f"graph:{FILES[9]}"] == lines(FILES[0], FILES[9])
    assert got[2, "person:bo"] == sorted(f"LAST_AUTHOR {f}" for f in FILES)


def test_several_sources_in_a_large_folder_take_no_places_of_siblings(spark):
    """a folder was cut to limit + 1 files before all of its sources left."""
    nodes = spark.createDataFrame([(f"a/f{i}.py", "file", False) for i in range(9)], "id string, type string, infrastructure boolean")
    asked = spark.createDataFrame([(1, f"a/f{i}.py") for i in range(3)], "request_id int, id string")
    found = R.affected_by(asked, nodes, spark.createDataFrame([], "src string, dst string, relation string"), limit=4)
    assert sorted(r.id for r in found.collect()) == [f"a/f{i}.py" for i in range(3, 7)]
