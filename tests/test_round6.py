"""What the findings of round 3 that were settled last found wrong."""

import pytest

from cairn.llm import simhash
from cairn.operators import graph, retrieval, text
from cairn.plans import QUERIES, fixtures


def test_near_duplicates_by_fingerprint(spark, sf):
    """texts that share most of their shingles, repeats included, have near fingerprints and few equal shingles."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = ["x y z " * 100 + " ".join(f"{t}{i}" for i in range(6)) for t in "abc"] + ["one two three", "one two four", None]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bits = [simhash.fingerprint(t) for t in texts[:3]]
    assert all(bin(bits[0] ^ b).count("1") <= 3 for b in bits)
    assert sorted(r["doc_id"] for r in pipeline.one_of_each(spark, table, sf).collect()) == [0, 3, 4, 5]
    alone = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table, width=3, radius=3).collect()}
    both = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(table, radius=3, fp_width=3, similarity=0.8).collect()}
    assert {i: c for i, (_, c) in both.items()} == alone == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert [both[i][0] & (1 << 64) - 1 for i in range(3)] == bits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_siblings_are_not_dealt_out_again(spark):
    """what is found, sources times files, is in no shuffle; nested folders and two sources of one folder included."""
    ids = ["a/x.py", "a/y.py", "a/b/x.py", "a/b/y.py", "a/b/c/x.py", "ab/x.py", "top.py", "d/x.py"]
    nodes = spark.createDataFrame([(i, "file") for i in [*ids, "a/x.py"]], "id string, type string")
    asked = [(1, "a/x.py"), (1, "a/b/x.py"), (2, "a/b/x.py"), (3, "a/b/x.py"), (3, "a/b/y.py"), (None, "a/b/c/x.py"), (None, "a/y.py"), (4, "d/x.py"), (5, "top.py")]
    found = graph.siblings_of(spark.createDataFrame([*asked, asked[0]], "request_id long, id string"), nodes)
    want = {(r, i) for r, s in asked for i in ids if "/" in s and i != s and i.startswith(s.rsplit("/", 1)[0] + "/")}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    above = plan(found).split("Join", 1)[0]  # the last join is printed first
    assert "Exchange" not in above and "Aggregate" not in above


def test_chunks_of_documents_leave_a_few_at_a_time(spark):
    """a task holds one batch of sections and the chunks of a few of them."""
    rows = [(f"{i}.md", "before\n# One\n" + f"line {i}\n" * (400 * (i % 3)) + "## Two\n\n") for i in range(200)] + [("none.md", None), ("blank.md", " \n")]
    found = text.chunk_markdown(spark.createDataFrame(rows, "path string, content string"), 500)
    want = set()
    for p, c in rows[:-2]:
        for section, (title, body) in enumerate([("Introduction", "before"), ("One", "# One\n" + c.split("# One\n")[1].split("## Two")[0].strip()), ("Two", "## Two")]):
            want |= {(p, section, n, h, b) for n, (h, b) in enumerate(text.heading_windows(p, title, body.strip(), 500, 250))}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "MapInArrow" in plan(found)


def test_graph_search_needs_no_vectors(spark, sf, monkeypatch):
    """chunks are not turned to vectors where only the graph is asked."""
    monkeypatch.setattr(retrieval, "embed_chunks", lambda *a: pytest.fail("vectors were made"))
    assert QUERIES["R8_graph_search"](spark, sf).count() > 0


def test_imports_meet_files_without_a_row_per_ending(spark):
    """an import is one row; a file is found under each base that one of the endings leads from."""
    ends = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".go", "/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    files = [f"m{n}{e}" for n in range(len(ends)) for e in ends[n:]]
    imports = [("x/f.py", m, "IMPORTS") for m in [*(f"m{n}" for n in range(len(ends))), "./../m3", "m2.index", "m9/index", "m0.py", "none"]]
    frame = spark.createDataFrame([*imports, imports[0]], "path string, module string, relation string")
    found = text.resolve_imports(frame, spark.createDataFrame([(f,) for f in files], "path string"))
    base = {"./../m3": "m3", "m2.index": "m2/index", "m0.py": "m0/py"}
    first = {m: next((base.get(m, m) + e for e in ends if base.get(m, m) + e in files), None) for _, m, _ in imports}
    assert sorted((r["module"], r["target"]) for r in found.collect()) == sorted((m, t) for m, t in first.items() if t)
    assert "posexplode" not in plan(found)


def test_source_files_are_dealt_to_tasks(spark, sf):
    """lines are read once, by more tasks than read the small table of parts."""
    p = plan(QUERIES["K1_imports"](spark, sf))
    assert p.count("Scan parquet") == 1 and "REPARTITION_BY_COL" in p


def test_many_files_are_not_broadcast(spark, sf, monkeypatch):
    """file names are larger than their table, so that many of them went through the driver for every join."""
    monkeypatch.setattr(fixtures, "BROADCAST_ROWS", 10)
    fx = fixtures.Fixtures(spark, sf)
    want = sorted(map(tuple, fx.commit_files.collect()))
    assert "BroadcastHashJoin" in plan(fx.commit_files)
    fx = fixtures.Fixtures(spark, sf)
    fx.merge_files()
    assert "BroadcastHashJoin" not in plan(fx.commit_files) and sorted(map(tuple, fx.commit_files.collect())) == want
