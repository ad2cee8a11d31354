"""Hand-computed rows for rules that the driver tables do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import graph as G
from cairn.operators import retrieval as R
from cairn.operators import risk as K
from cairn.operators import text as T
from cairn.sources import tables as S


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_paths(spark):
    rows = [("src/test_a.py",), ("a/b_test.go",), ("x/__tests__/y.ts",), ("web/a.spec.ts",), ("tests/util.py",), ("lib/Contest.py",), ("A/FooTest.java",)]
    assert values(spark, rows, "p string", X.is_test_file(F.col("p"))) == [True, True, True, True, True, False, True]
    rows = [("a/Dockerfile.dev",), ("pkg/package.json",), ("x/tests/a.py",), ("x/api/a.py",), ("x/pages/a.tsx",), ("x/server/a.py",), ("a.py",)]
    assert values(spark, rows, "p string", X.node_role(F.col("p"))) == ["infrastructure", "infrastructure", "test", "api", "frontend", "backend", "code"]
    assert values(spark, [("a.TSX",), ("Makefile",), ("x/.env",), ("a.b.py",)], "p string", X.detect_language(F.col("p"))) == ["tsx", "unknown", "unknown", "python"]
    assert values(spark, [("./a\\b",)], "p string", X.normalize_path(F.col("p"))) == ["a/b"]
    assert values(spark, [("user password = 1",), ("total amount",), ("x",)], "p string", F.concat_ws(",", X.sensitivity_tags(F.col("p")))) == ["AUTH", "FINANCE", ""]


def test_layer(spark):
    rows = [("API", "x", "n", "file"), (None, None, None, "file"), (None, "a/b/models/user.py", "user.py", "file"), (None, "ui/kit", "kit", "folder"), (None, "z.py", "z.py", "file"), ("kernel", "api/x.py", "n", "file"), ("Utility", "api/x.py", "n", "file"), (None, "apiary", "n", "folder"), (" Data ", "x", "n", "file"), (None, "src\\utils\\a.py", "n", "file")]
    out = values(spark, rows, "l string, id string, n string, t string", X.infer_layer(F.col("l"), F.col("id"), F.col("n"), F.col("t")))
    assert out == ["api", "other", "data", "ui", "other", "other", "util", "other", "data", "util"]


def test_risk_score(spark):
    rows = [("lib/x.py", "direct", 1, 0.0, False, 0), ("lib/x.py", "sibling", 1, 0.6, False, 0), ("auth/core.h", "indirect", 2, 0.8, True, 3), ("q/x.py", "direct", 1, 0.0, False, 1)]
    s = "id string, k string, h int, c double, u boolean, i int"
    out = values(spark, rows, s, K.risk_score(*[F.col(c) for c in ("id", "k", "h", "c", "u", "i")]))
    assert out == [45, 27, 100, 76]  # 25*1.8; 17*1.2*1.3 = 26.52; capped; 45*(1+ln 2) = 76.19


def test_routing(spark):
    asked = ["What is Ada working on", "blast radius of x", "where is foo_bar defined", "trace the request", "overview of layers", "what is this", "hello"]
    out = R.route_query(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")).orderBy("query_id").collect()
    assert [r["intent"] for r in out] == ["person", "impact", "symbol_lookup", "call_flow", "architecture", "semantic", "semantic"]
    assert out[0]["k"] == 25 and out[-1]["graph_weight"] == 0.8


def test_fusion_ignores_channel_order(spark):
    ranked = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "x"), (1, "a", 2, "y")], "query_id int, channel string, rank int, key string")
    w = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5)], "query_id int, channel string, weight double")
    one, two = (sorted(map(tuple, R.rrf(r, w).collect())) for r in (ranked, ranked.orderBy(F.desc("channel"))))
    assert one == two and one[0][2] == round(1 / 61 + 0.5 / 62, 6)


def test_impact_grows_with_hops(spark):
    e = spark.createDataFrame([("b", "a", "DEPENDS_ON"), ("c", "b", "DEPENDS_ON"), ("a", "c", "DEPENDS_ON")], "src string, dst string, relation string")
    seed = spark.createDataFrame([(1, "a")], "request_id int, id string")
    n = [G.impact_subgraph(seed, e, h).count() for h in (1, 2, 3)]
    assert n == [1, 2, 3]
    files = spark.createDataFrame([("a", False), ("b", False), ("c", False)], "id string, is_test_file boolean")
    assert [r["path"] for r in G.cycles(files, e).collect()] == ["a > c > b"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", "L"), ("b", "y", None)], "id string, v string, layer string")
    new = spark.createDataFrame([("a", "z", None), ("c", "w", "M")], "id string, v string, layer string")
    once = S.upsert(old, new, ["id"], keep_old=("layer",))
    twice = S.upsert(once, new, ["id"], keep_old=("layer",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "z", "L"), ("b", "y", None), ("c", "w", "M")]


def test_symbols_of_languages(spark):
    files = spark.createDataFrame([("a.ts", "export class A {\n  run(x) {\n  }\n}\nimport x from './b'"), ("b.go", "func (a A) Do(x int) {\n}\nif (x) {"), ("c.rs", "pub fn go() {}\nuse a::b;")], "path string, content string")
    assert sorted(r["id"] for r in T.extract_symbols(files).collect()) == ["a.ts::A", "a.ts::A::run", "b.go::Do", "c.rs::go"]
    assert sorted((r["path"], r["module"]) for r in T.extract_imports(files).collect()) == [("a.ts", "./b"), ("c.rs", "a::b")]


def test_sources(spark, tmp_path):
    for name, text in {"a/x.py": "1", "node_modules/y.py": "2", ".hid/z.py": "3", ".github/w.yml": "4", "b/pic.png": "5", "Dockerfile": "6"}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert sorted(r["path"] for r in S.read_source_files(spark, str(tmp_path / "src")).collect()) == [".github/w.yml", "Dockerfile", "a/x.py"]
    (tmp_path / "c.json").write_text(json.dumps([{"hash": "1", "author": "a", "date": "2024-01-01T00:00:00", "files": ["x"], "branch": "m", "msg": "m"}, {"hash": "2", "author": "b", "date": "2024-02-01T00:00:00", "files": [], "branch": "m", "msg": "m"}]))
    assert [r["hash"] for r in S.read_commits(spark, str(tmp_path / "c.json")).collect()] == ["2", "1"]
    index = {"documents": [{"relative_path": "f.py", "occurrences": [{"symbol": "p/f().", "range": [4, 0]}, {"symbol": "p/g().", "range": [9, 0]}], "symbols": [{"symbol": "p/f().", "relationships": [{"symbol": "p/g().", "type": ""}]}]}]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    symbols, relations = S.read_symbol_index(spark, str(tmp_path / "i.json"))
    assert sorted((r["name"], r["line"]) for r in symbols.collect()) == [("f", 5), ("g", 10)]
    nodes = spark.createDataFrame([("f.py", "f.py", "file")], "id string, name string, type string")
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    n, e = S.merge_symbols(nodes, edges, symbols, relations)
    assert n.count() == 3 and [tuple(r) for r in e.collect()] == [("f.py::f", "f.py::g", "REFERENCES")]
    S.append_telemetry(nodes, str(tmp_path / "t"))
    S.append_telemetry(nodes, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    for tenant in ("a", "b"):
        S.write_by_tenant(nodes.withColumn("tenant_id", F.lit(tenant)), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


@pytest.mark.parametrize("size,overlap", [(10, 2), (50, 0), (7, 6)])
def test_split_covers_the_text(size, overlap):
    text = "one two three\nfour five six seven\n\neight nine" * 3
    parts = T.split_text(text, size, overlap)
    assert all(0 < len(p) <= size for p in parts) and "".join(parts[:1]) == text[: len(parts[0])]
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - overlap - 1))
        assert 0 <= found <= at
        at = max(at, found + len(p))
    assert at == len(text)


def test_markdown_sections_and_windows(spark):
    """Headings begin sections, in any level; long sections are cut in windows that overlap by half and say their part."""
    long = "\n".join(f"line {i} of a long section" for i in range(400))
    text = f"intro\r\n# One\n{long}\n### Two\nend\n####### not a heading\n#also not"
    out = T.chunk_markdown(spark.createDataFrame([("a.md", text), ("b.md", ""), ("c.md", "#  Only ")], "path string, content string"), 2000).collect()
    of = lambda path, section: [r for r in sorted(out, key=lambda r: r["part"]) if (r["path"], r["section"]) == (path, section)]
    assert [r["content"] for r in of("a.md", 0)] == ["File: a.md\nDoc: Introduction\n\nintro"]
    assert [r["content"] for r in of("a.md", 2)] == ["File: a.md\nDoc: Two\n\n### Two\nend\n####### not a heading\n#also not"]
    assert [(r["heading"], r["content"]) for r in of("c.md", 1)] == [("Only", "File: c.md\nDoc: Only\n\n#  Only")]
    parts = of("a.md", 1)
    assert [r["heading"] for r in parts] == [f"One (part {i + 1})" for i in range(len(parts))] and {r["path"] for r in out} == {"a.md", "c.md"}
    body, at = f"# One\n{long}", 0
    for i, r in enumerate(parts):
        head = f"File: a.md\nDoc: One\n (part {i + 1})\n"
        assert r["content"].startswith(head)
        piece = r["content"][len(head) :]
        found = body.index(piece, max(0, at - 1010))
        assert found <= at and len(piece) <= 2000
        if i + 1 < len(parts):
            assert body[found + len(piece)] == "\n"  # cut at a line's end
        at = found + len(piece)
    assert at == len(body)


def plain_split(text, size, overlap, separators):
    """The same rule, said another way: first all pieces in order, cut as far as need be, then one pass that joins them."""
    sep = next((s for s in separators if not s or s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    pieces = [c for c in text] if not sep else [p for p in [text.split(sep)[0]] + [sep + x for x in text.split(sep)[1:]] if p]
    out, group = [], []

    def join():
        while group:
            n = 1
            while n < len(group) and sum(map(len, group[: n + 1])) <= size:
                n += 1
            chunk = "".join(group[:n]).strip()
            out.extend([chunk] if chunk else [])
            if n == len(group):
                group.clear()
                return
            keep = n
            while keep > 0 and sum(map(len, group[keep - 1 : n])) <= overlap and sum(map(len, group[keep - 1 : n + 1])) <= size:
                keep -= 1
            del group[:keep]

    for p in pieces:
        if len(p) >= size and rest:
            join()
            out += plain_split(p, size, overlap, rest)
        else:
            group.append(p)
    join()
    return out


def test_recursive_split_equals_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    out = {}
    for r in T.chunk_fallback(docs).orderBy("path", "part").collect():
        out.setdefault(r["path"], []).append(r["content"])
    want = {r["path"]: plain_split(r["content"], 1000, 100, ["\n\n", "\n", " ", ""]) for r in docs.collect() if (r["content"] or "").strip(" ")}
    assert out == {p: [f"File: {p}\n{c}" for c in cs] for p, cs in want.items() if cs}


def test_source_is_cut_at_its_structure(spark):
    body = "\n".join(f"    x{i} = compute(value_{i}, {i})" for i in range(20))
    code = "import os\n" + "".join(f"\ndef f{k}(value):\n{body}" for k in range(4)) + f"\nclass A:\n{body}"
    out = [r["content"] for r in T.chunk_fallback(spark.createDataFrame([("m/a.py", code), ("m/b.txt", "y" * 2500), ("m/c.py", " ")], "path string, content string"), 1000, 100).orderBy("path", "part").collect()]
    mine = [c.removeprefix("File: m/a.py\n") for c in out if c.startswith("File: m/a.py\n")]
    assert all(len(c) <= 1000 for c in mine) and [c.split("\n")[0] for c in mine] == ["import os", "def f1(value):", "def f2(value):", "def f3(value):", "class A:"]  # the first function fits beside the import
    assert mine == [c for c in plain_split(code, 1000, 100, T.SEPARATORS["python"] + T.LAST_SEPARATORS)]
    assert [len(c) - len("File: m/b.txt\n") for c in out if c.startswith("File: m/b.txt\n")] == [1000, 1000, 700]


def test_aliases_of_each_repository(spark):
    files = [(1, "tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*", "x/*"], "@lib/*": ["libs/*"], "none": []}}}'), (1, "src/u.ts", ""), (1, "libs/v/index.ts", ""), (2, "go.mod", "module h.io/m\n"), (2, "pkg/w.go", ""), (2, "src/u.ts", ""), (3, "tsconfig.json", "{ broken"), (3, "sub/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}')]
    files = spark.createDataFrame(files, "repo int, path string, content string")
    table = T.config_aliases(files)
    assert sorted(tuple(r) for r in table.collect()) == [(1, "@", "src"), (1, "@lib", "libs"), (2, "h.io/m", "")]
    imports = [(1, "a/b.ts", "@/u"), (1, "a/b.ts", "@lib/v"), (1, "a/b.ts", "@lib/none"), (2, "a.go", "h.io/m/pkg/w"), (2, "a/b.ts", "@/u"), (2, "a/b.ts", "../src/u"), (2, "a/b.ts", "../gone"), (3, "x/y.py", "p.q"), (3, "A.java", "java.util.List"), (2, "a.go", "fmt")]
    imports = spark.createDataFrame([(*r, "IMPORTS") for r in imports], "repo int, path string, module string, relation string")
    got = {(r["repo"], r["module"]): r["target"] for r in T.resolve_imports(imports, files, (), table, fallback=True).collect()}
    assert got == {(1, "@/u"): "src/u.ts", (1, "@lib/v"): "libs/v/index.ts", (1, "@lib/none"): "@lib/none.js", (2, "h.io/m/pkg/w"): "pkg/w.go", (2, "@/u"): "@/u.js", (2, "../src/u"): "src/u.ts", (2, "../gone"): "gone.js", (3, "p.q"): "p/q.py", (3, "java.util.List"): "java/util/List.java"}
    assert T.resolve_imports(imports, files, (), table).count() == 4


def test_structure_in_all_languages(spark):
    files = [
        ("a.py", "class A:\n    async def f(self):\n        pass\ndef g():\n    pass"), ("a.js", "export class B {\n}\nexport function h(x) {\n}"), ("a.ts", "export abstract class C {\n}\nfunction k<T>(x) {\n}"),
        ("A.java", "public final class D {\n  private static int m(int x) {\n  }\n}"), ("a.cpp", "struct E {\n};\nint n(int x) {\n}"), ("a.go", "type F struct {\n}\nfunc (r *F) p() {\n}"), ("a.rs", "pub struct G;\npub fn q() {\n}"), ("a.rb", "class H\n  def self.r\n  end\nend"),
    ]
    out = T.extract_symbols(spark.createDataFrame(files, "path string, content string")).collect()
    names = {p: [(r["name"], r["type"], r["end_line"]) for r in sorted(out, key=lambda r: r["start_line"]) if r["path"] == p] for p, _ in files}
    assert names["a.py"] == [("A", "class", 3), ("f", "function", 3), ("g", "function", 5)]
    assert [n[:2] for p in ("a.js", "a.ts", "A.java", "a.cpp", "a.go", "a.rs", "a.rb") for n in names[p]] == [(x, k) for pair in ("Bh", "Ck", "Dm", "En", "Fp", "Gq", "Hr") for x, k in zip(pair, ("class", "function"), strict=True)]


def test_no_rows_are_cut(spark):
    """More rules, persons and queries than former bounds took."""
    from cairn.operators import insight as I

    rules = spark.range(2000).selectExpr("concat('l', id) AS layer", "'x' AS banned")
    nodes = spark.createDataFrame([("a", "l1999"), ("b", "x")], "id string, layer string")
    assert I.architecture_violations(spark.createDataFrame([("a", "b", "DEPENDS_ON")], "src string, dst string, relation string"), nodes, rules).count() == 1
    queries = spark.range(3000).selectExpr("id AS query_id", "concat('word', id) AS text")
    chunks = spark.range(3000).selectExpr("id", "concat('some word', id, ' here') AS content")
    none = spark.createDataFrame([], "query_id long")
    assert R.keyword_fallback(queries, chunks, none, 1).count() == 3000
    people = spark.range(12_000).selectExpr("concat('person-', id) AS person")
    files = spark.range(12_000).selectExpr("concat('f', id) AS id", "concat('Person-', id) AS top_owner", "CAST(NULL AS STRING) AS last_author", "1 AS commit_count")
    owned = spark.createDataFrame([], "node string, author string")
    assert I.person_work(people, files, owned, 1).select("person").distinct().count() == 12_000


def test_containment_is_exact(spark):
    from cairn.operators.matching import contained

    texts, terms = ["alpha beta", "be", "b", "", "αβγδ", "a.b*c"], ["a", "be", "ta", "beta", "βγ", "zzz", "", ".b*", "alpha beta"]
    out = contained(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted(map(tuple, out)) == sorted((t, x) for t in terms for x in texts if t and t in x)
