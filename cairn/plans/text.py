"""Queries on source text and streams. Source files, manifests and documents are derived from the driver tables."""

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import text as T
from cairn.plans.registry import query
from cairn.plans.risk import PR_RISK, pr_risk, reviewed
from cairn.sources import tables as S
from cairn.streaming import ingest as I
from cairn.streaming import jobs as J

# a Python file for every part; {m} is the file's own module, so its import resolves
LINES = [
    "'import os'", "'from ' || m || ' import *'", "'class C' || k || ':'", "'    def run(self):'", "'        self.stop()'", "'        helper_' || k || '(1)'",
    "'    def stop(self):'", "'        importlib.import_module(\"plug.p' || k || '\")'", "'def helper_' || k || '(x):'", "'    return open(\"/v1/items/' || k || '\")'",
]
BODY = " || chr(10) || ".join(LINES)
SRC = f"SELECT id AS path, {BODY} AS content, k, m FROM (SELECT id, CAST(file_key AS STRING) AS k, replace(regexp_replace(id, '\\\\.py$', ''), '/', '.') AS m FROM {{fx_files}})"
SRC_SQL = SRC.replace("{fx_files}", "fx_files").replace("\\\\.py", "\\.py")


def sources(fx):
    return fx.spark.sql(SRC, fx_files=dealt(fx))


def dealt(fx):
    """Files dealt to tasks before texts are made of them, as ``part`` is small and read by few."""
    return fx.files.select("file_key", "id").repartition("file_key")


@query("K1_extract_structure", f"""
WITH s AS ({SRC_SQL})
SELECT path, path || '::C' || k AS id, 'class' AS type, path AS scope, 3 AS start_line, 8 AS end_line FROM s
UNION ALL SELECT path, path || '::C' || k || '::run', 'function', path || '::C' || k, 4, 6 FROM s
UNION ALL SELECT path, path || '::C' || k || '::stop', 'function', path || '::C' || k, 7, 8 FROM s
UNION ALL SELECT path, path || '::helper_' || k, 'function', path, 9, 10 FROM s""")
def _(fx):
    return T.extract_symbols(sources(fx)).select("path", "id", "type", "scope", "start_line", "end_line")


@query("K1_structure_edges", f"""
WITH s AS ({SRC_SQL}) SELECT path AS src, path || '::C' || k AS dst, 'DEFINES' AS relation FROM s UNION ALL SELECT path || '::C' || k, path || '::C' || k || '::run', 'CONTAINS' FROM s
UNION ALL SELECT path || '::C' || k, path || '::C' || k || '::stop', 'CONTAINS' FROM s UNION ALL SELECT path, path || '::helper_' || k, 'CONTAINS' FROM s""")
def _(fx):
    return T.structure_edges(T.extract_symbols(sources(fx)))


@query("K1_imports", f"""
WITH s AS ({SRC_SQL}) SELECT path, 'os' AS module, 'IMPORTS' AS relation FROM s UNION ALL SELECT path, m, 'MAYBE_IMPORTS' FROM s UNION ALL SELECT path, 'plug.p' || k, 'MAYBE_DEPENDS' FROM s""")
def _(fx):
    return T.extract_imports(sources(fx))


# imports of a file: its own module, itself by two steps up, by an alias and by a sibling's name, and one that is no file
@query("C10_resolve_imports", """
WITH f AS (SELECT id AS path, regexp_replace(regexp_replace(id, '^.*/', ''), '\\.py$', '') AS stem, split_part(id, '/', 1) AS a, split_part(id, '/', 2) AS b FROM fx_files)
SELECT path, module, 'IMPORTS' AS relation, path AS target FROM (SELECT path, unnest([a || '.' || b || '.' || stem, '../../' || a || '/' || b || '/' || stem, '@' || a || '/' || b || '/' || stem || '.py', './' || stem, '../' || b || '/./' || stem]) AS module FROM f)""")
def _(fx):
    parts, stem = F.split("path", "/"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "")
    f = dealt(fx).select(F.col("id").alias("path")).withColumns({"stem": stem, "a": parts[0], "b": parts[1]})
    forms = ["{a}.{b}.{stem}", "../../{a}/{b}/{stem}", "@{a}/{b}/{stem}.py", "./{stem}", "../{b}/./{stem}", "../../../../{a}/{b}/{stem}", "{a}/{b}/no_{stem}", "os"]
    filled = [F.replace(F.replace(F.replace(F.lit(x), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")), F.lit("{stem}"), F.col("stem")) for x in forms]
    imports = f.select("path", F.explode(F.array(*filled)).alias("module"), F.lit("IMPORTS").alias("relation"))
    return T.resolve_imports(imports, f.select("path"), (("@", ""),))


# four repositories, each with aliases of its own for the same imports, in tsconfig.json or go.mod; what is no file falls back
@query("C10_config_aliases", """
WITH f AS (SELECT file_key % 4 AS repo, id AS path, replace(id, '.py', '.ts') AS ts, split_part(id, '/', 1) AS a, split_part(id, '/', 2) AS b, regexp_replace(regexp_replace(id, '^.*/', ''), '\\.py$', '') AS stem FROM fx_files)
SELECT repo, ts AS path, module, 'IMPORTS' AS relation, CASE WHEN k = 0 AND repo IN (0, 3) OR k = 1 AND repo <> 2 OR k = 2 AND repo = 3 THEN ts WHEN k = 4 THEN a || '/' || b || '/none_' || stem || '.js' ELSE module || '.js' END AS target
FROM (SELECT *, unnest(['@/' || a || '/' || b || '/' || stem, '@' || a || '/' || b || '/' || stem, 'x.io/mod/' || a || '/' || b || '/' || stem, 'lib/' || stem, './none_' || stem]) AS module, unnest(range(5)) AS k FROM f)""")
def _(fx):
    parts, stem = F.split("path", "/"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.ts$", "")
    f = fx.files.select((F.col("file_key") % 4).alias("repo"), F.regexp_replace("id", r"\.py$", ".ts").alias("path")).withColumns({"stem": stem, "a": parts[0], "b": parts[1]})
    forms = ["@/{a}/{b}/{stem}", "@{a}/{b}/{stem}", "x.io/mod/{a}/{b}/{stem}", "lib/{stem}", "./none_{stem}"]
    filled = [F.replace(F.replace(F.replace(F.lit(x), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")), F.lit("{stem}"), F.col("stem")) for x in forms]
    imports = f.select("repo", "path", F.explode(F.array(*filled)).alias("module"), F.lit("IMPORTS").alias("relation"))
    # an alias for everything; one that leads nowhere, with one for each top folder beside it; none; and a module's name
    folders = F.array_join(F.transform(F.array_sort(F.collect_set("a")), lambda x: F.concat(F.lit('"@'), x, F.lit('/*": ["./'), x, F.lit('/*"]'))), ", ")
    config = f.groupBy("repo").agg(folders.alias("folders")).withColumn("paths", F.when(F.col("repo") == 1, F.concat(F.lit('"@/*": ["./nowhere/*"], '), "folders")).when(F.col("repo") == 2, F.lit("")).otherwise(F.lit('"@/*": ["./*", "other/*"]')))
    config = config.select("repo", F.lit("tsconfig.json").alias("path"), F.concat(F.lit('{"compilerOptions": {"paths": {'), "paths", F.lit("}}}")).alias("content"))
    module = f.where("repo = 3").select("repo", F.lit("go.mod").alias("path"), F.lit("module x.io/mod\n\ngo 1.22").alias("content")).distinct()
    return T.resolve_imports(imports, f.select("repo", "path"), (), T.config_aliases(config.unionByName(module)), fallback=True)


@query("K2_call_edges", f"WITH s AS ({SRC_SQL}) SELECT path || '::C' || k || '::run' AS src, path || '::C' || k || '::stop' AS dst FROM s UNION ALL SELECT path || '::C' || k || '::run', path || '::helper_' || k FROM s")
def _(fx):
    s = sources(fx)
    return T.call_edges(s, T.extract_symbols(s))


# every text as a document with a heading before and after it; its own headings begin sections, too
@query("K3_chunk_markdown")
def _(fx):
    d = fx.documents.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## End\nlast")).alias("content"))
    return T.chunk_markdown(d)


@query("K4_chunk_code", f"""
WITH s AS ({SRC_SQL}) SELECT path, path || '::helper_' || k AS symbol_id, 'function' AS chunk_type, 0 AS part, 'File: ' || path || chr(10) || 'Function: helper_' || k || chr(10) || 'def helper_' || k || '(x):' || chr(10) || '    return open("/v1/items/' || k || '")' AS content FROM s
UNION ALL SELECT path, NULL, 'module', 0, 'File: ' || path || chr(10) || 'import os' || chr(10) || 'from ' || m || ' import *' FROM s
UNION ALL SELECT path, path || '::C' || k, 'class', 0, 'File: ' || path || chr(10) || 'Class: C' || k || chr(10) || array_to_string(string_split(content, chr(10))[3:8], chr(10)) FROM s
UNION ALL SELECT path, path || '::C' || k || '::run', 'function', 0, 'File: ' || path || chr(10) || 'Function: run' || chr(10) || array_to_string(string_split(content, chr(10))[4:6], chr(10)) FROM s
UNION ALL SELECT path, path || '::C' || k || '::stop', 'function', 0, 'File: ' || path || chr(10) || 'Function: stop' || chr(10) || array_to_string(string_split(content, chr(10))[7:8], chr(10)) FROM s""")
def _(fx):
    s = sources(fx)
    return T.chunk_code(s, T.extract_symbols(s))


@query("K6_chunk_fallback")
def _(fx):
    return T.chunk_fallback(fx.documents.select(F.col("doc_id").cast("string").alias("path"), "text").withColumnRenamed("text", "content"))


MANIFESTS = {
    "package.json": """'{"dependencies": {"a' || k || '": "1"}, "devDependencies": {"jest": "2"}}'""",
    "package-lock.json": """'{"packages": {"": {"dependencies": {"l' || k || '": "1"}}, "node_modules/z": {"dependencies": {"deep": "1"}}}}'""",
    "requirements.txt": "'# x' || chr(10) || 'Flask==2.0' || chr(10) || 'p' || k || '>=1' || chr(10) || '-r y'",
    "pyproject.toml": "'[tool.poetry.dependencies]' || chr(10) || 'python = \"3\"' || chr(10) || 'q' || k || ' = \"1\"' || chr(10) || '[project]' || chr(10) || 'dependencies = [' || chr(10) || '  \"numpy>1\",' || chr(10) || ']'",
    "go.mod": "'module m' || chr(10) || 'require (' || chr(10) || '  g.io/x' || k || ' v1.0' || chr(10) || ')' || chr(10) || 'require g.io/y v2.0'",
    "Dockerfile": "'FROM img:' || k || ' AS b' || chr(10) || 'FROM scratch'",
    "compose.yml": "'services:' || chr(10) || '  web:' || chr(10) || '    image: nginx:' || k || chr(10) || '    depends_on:' || chr(10) || '      - db' || chr(10) || '  db:' || chr(10) || '    image: pg' || chr(10) || 'volumes:' || chr(10) || '  data:'",
    "schema.prisma": "'model User {' || chr(10) || '  id Int' || chr(10) || '  posts Post[]' || chr(10) || '}' || chr(10) || 'model Post {' || chr(10) || '  id Int' || chr(10) || '}'",
    "main.tf": "'resource \"aws_s3\" \"b' || k || '\" {}'",
    "k8s.yaml": "'kind: Service' || chr(10) || 'metadata:' || chr(10) || '  name: s' || k || chr(10) || '---' || chr(10) || 'kind: Pod' || chr(10) || 'metadata:' || chr(10) || '  name: p' || chr(10) || '  namespace: n' || chr(10) || 'spec:' || chr(10) || '  - image: i:' || k",
}
NODES = {
    "package.json": ["'[npm]:a' || k", "'[npm]:jest'"], "package-lock.json": ["'[npm]:l' || k"], "requirements.txt": ["'[pip]:flask'", "'[pip]:p' || k"], "pyproject.toml": ["'[pip]:q' || k", "'[pip]:numpy'"],
    "go.mod": ["'[go]:g.io/x' || k", "'[go]:g.io/y'"], "Dockerfile": ["'[docker]:img:' || k"], "compose.yml": ["'[service]:web'", "'[docker]:nginx:' || k", "'[service]:db'", "'[docker]:pg'"],
    "schema.prisma": ["'[prisma]:User'", "'[prisma]:Post'"], "main.tf": ["'[tf]:aws_s3.b' || k"], "k8s.yaml": ["'[k8s]:default/Service/s' || k", "'[k8s]:n/Pod/p'", "'[docker]:i:' || k"],
}
MAN = " UNION ALL ".join(f"SELECT 'c' || k || '/{n}' AS path, {body.replace('{', '{{').replace('}', '}}')} AS content FROM (SELECT CAST(s_suppkey AS STRING) AS k FROM {{supplier}})" for n, body in MANIFESTS.items())


def manifests(fx):
    return fx.spark.sql(MAN, supplier=fx.supplier)


def _nodes(*names):
    return " UNION ALL ".join(f"SELECT 'c' || s_suppkey || '/{n}' AS path, {x} AS node FROM (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)" for n in names for x in NODES[n])


@query("K8_dependencies", _nodes(*NODES))
def _(fx):
    return T.dependencies(manifests(fx))


@query("K8_dependency_edges", f"""SELECT path AS src, node AS dst, CASE WHEN regexp_matches(node, '^\\[(service|prisma|tf|k8s)\\]') THEN 'DEFINES' ELSE 'DEPENDS_ON' END AS relation FROM ({_nodes(*NODES)})
UNION ALL SELECT '[service]:web', '[service]:db', 'DEPENDS_ON' UNION ALL SELECT '[prisma]:User', '[prisma]:Post', 'RELATES_TO'""")
def _(fx):
    return T.dependency_edges(manifests(fx))


for _id, _name, _f in [
    ("K8a_lock", "package-lock.json", T.lock_dependencies),
    ("K8a_npm", "package.json", T.npm_dependencies), ("K8b_pip", "requirements.txt", T.pip_dependencies), ("K8c_pyproject", "pyproject.toml", T.pyproject_dependencies), ("K8d_go", "go.mod", T.go_dependencies),
    ("K8e_docker", "Dockerfile", T.docker_dependencies), ("K8f_compose", "compose.yml", T.compose_dependencies), ("K8h_terraform", "main.tf", T.terraform_resources), ("K8h_k8s", "k8s.yaml", T.k8s_objects),
]:
    query(_id, _nodes(_name))(lambda fx, f=_f: f(manifests(fx)))


@query("K8g_prisma", "SELECT 'c' || s_suppkey || '/schema.prisma' AS path, '[prisma]:User' AS node, '[prisma]:Post' AS target FROM supplier UNION ALL SELECT 'c' || s_suppkey || '/schema.prisma', '[prisma]:Post', NULL FROM supplier")
def _(fx):
    return T.prisma_models(manifests(fx))


@query("K5_chunk_manifest", "SELECT 'c' || s_suppkey || '/Dockerfile' AS path, 'manifest' AS chunk_type, 0 AS part, 'Manifest: c' || s_suppkey || '/Dockerfile' || chr(10) || 'FROM img:' || s_suppkey || ' AS b' || chr(10) || 'FROM scratch' AS content FROM supplier")
def _(fx):
    return T.chunk_plain(manifests(fx).where(F.col("path").endswith("/Dockerfile")), "manifest").drop("symbol_id")


@query("K7_chunk_all", "SELECT 'manifest' AS chunk_type, count(*)*9 + 0 AS n FROM supplier UNION ALL SELECT 'function', count(*)*3 FROM part UNION ALL SELECT 'class', count(*) FROM part UNION ALL SELECT 'module', count(*) FROM part")
def _(fx):
    rows = sources(fx).select("path", "content").unionByName(manifests(fx).where(~F.col("path").endswith("k8s.yaml")))
    return T.chunk_all(rows).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query("X5_http_call_edges", f"WITH s AS ({SRC_SQL}) SELECT path, '/v1/items/{{id}}' AS endpoint FROM s")
def _(fx):
    e = fx.nation.limit(1).select(F.lit("/v1/items/{id}").alias("path"))
    return T.http_call_edges(sources(fx), e)


@query("A5_upsert_nodes", """
SELECT id, CASE WHEN file_key % 3 = 0 THEN 'new' WHEN file_key % 2 = 0 THEN 'old' END AS owner, CASE WHEN file_key % 3 = 0 AND file_key % 5 = 0 THEN 'L' WHEN file_key % 2 = 0 THEN 'was' END AS layer,
 CASE WHEN file_key % 3 = 0 AND file_key % 7 = 0 THEN 'r' WHEN file_key % 2 = 0 THEN 'repo' END AS repo FROM fx_files WHERE file_key % 2 = 0 OR file_key % 3 = 0""")
def _(fx):
    k = F.col("file_key")
    old = fx.files.where(k % 2 == 0).select("id", F.lit("old").alias("owner"), F.lit("was").alias("layer"), F.lit("repo").alias("repo"))
    new = fx.files.where(k % 3 == 0).select("id", F.lit("new").alias("owner"), F.when(k % 5 == 0, "L").alias("layer"), F.when(k % 7 == 0, "r").otherwise("").alias("repo"))
    return S.upsert(old, new, ["id"], keep_old=("layer",), empty_is_missing=("repo",))


@query("A6_upsert_edges", """
SELECT src, dst, relation FROM fx_edges WHERE relation <> 'CALLS'
UNION SELECT src, dst, 'DEPENDS_ON' FROM fx_edges WHERE relation = 'CALLS'""")
def _(fx):
    batch = fx.edges.where("relation = 'CALLS'").withColumn("relation", F.lit("IMPORTS"))
    stray = batch.withColumn("dst", F.concat("dst", F.lit("?")))
    return S.upsert_edges(fx.nodes, fx.edges.where("relation <> 'CALLS'"), batch.unionByName(stray))


def written(fx, rows, key, document, name: str) -> str:
    """Rows of the driver tables as JSON documents in the shared folder, one a file, of a thousand rows each."""
    path = fx.stages.path(name)
    rows.groupBy(F.floor(key / 1000).alias("chunk")).agg(F.to_json(document).alias("value")).write.partitionBy("chunk").text(path)
    return path


@query("A3_read_commits", "SELECT CAST(hash AS VARCHAR) AS hash, msg, author, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS at, branch FROM fx_commits")
def _(fx):
    rows = fx.commits.select(F.col("hash").cast("string").alias("hash"), "msg", "author", F.col("date").cast("timestamp").alias("date"), F.array(F.lit("a.py")).alias("files"), "branch")
    at = written(fx, rows, F.col("hash").cast("long"), F.collect_list(F.struct(*rows.columns)), "commits")
    return S.read_commits(fx.spark, at).select("hash", "msg", "author", F.col("date").cast("long").alias("at"), "branch")


def symbol_index(fx):
    """An index of a symbol a file, each referring to that of the file with half its key."""
    symbol = lambda k: F.concat(F.lit("scip py "), k.cast("string"), F.lit("/f"), k.cast("string"), F.lit("()."))
    k = F.col("file_key")
    occurrence = F.array(F.struct(symbol(k).alias("symbol"), F.array((k % 90).cast("int"), F.lit(4)).alias("range")))
    related = F.array(F.struct(symbol(F.floor(k / 2)).alias("symbol"), F.lit("").alias("type")))
    doc = F.struct(F.col("id").alias("relative_path"), occurrence.alias("occurrences"), F.array(F.struct(symbol(k).alias("symbol"), related.alias("relationships"))).alias("symbols"))
    return S.read_symbol_index(fx.spark, written(fx, fx.files, k, F.struct(F.collect_list(doc).alias("documents")), "scip"))


@query("A10_read_symbol_index", "SELECT id AS file, 'f' || file_key AS name, CAST(file_key % 90 + 1 AS INT) AS line FROM fx_files")
def _(fx):
    return symbol_index(fx)[0].select("file", "name", "line")


@query("A11_merge_symbols", "SELECT id, name, type, layer, 0 AS start_line FROM fx_nodes UNION ALL SELECT id || '::f' || file_key, 'f' || file_key, 'function', NULL, CAST(file_key % 90 + 1 AS INT) FROM fx_files")
def _(fx):
    return S.merge_symbols(fx.nodes, fx.edges, *symbol_index(fx))[0].select("id", "name", "type", "layer", F.coalesce("start_line", F.lit(0)).alias("start_line"))


@query("A11_symbol_edges", "SELECT a.id || '::f' || a.file_key AS src, b.id || '::f' || b.file_key AS dst, 'REFERENCES' AS relation FROM fx_files a JOIN fx_files b ON b.file_key = a.file_key // 2")
def _(fx):
    return S.merge_symbols(fx.nodes, fx.edges, *symbol_index(fx))[1].where("relation = 'REFERENCES'")


@query("A12_append_telemetry", "SELECT event_id, event_type, k AS batch FROM events, range(2) r(k)")
def _(fx):
    path = fx.stages.path("telemetry")
    for k in range(2):
        S.append_telemetry(fx.events.select("event_id", "event_type", F.lit(k).cast("long").alias("batch")), path)
    return fx.spark.read.schema("event_id long, event_type string, batch long").json(path)


@query("A7_wipe_tenant", "SELECT id FROM fx_files WHERE file_key % 4 <> 1")
def _(fx):
    rows = fx.files.withColumn("tenant_id", (F.col("file_key") % 4).cast("string"))
    return S.wipe_tenant(rows, "1").select("id")


@query("A8_set_repo_slug", "SELECT id, CASE WHEN type = 'file' THEN 'acme/shop' END AS repo_full_name FROM fx_nodes")
def _(fx):
    return S.set_repo_slug(fx.nodes, "acme/shop").select("id", "repo_full_name")


@query("A9_clean_chunks", "SELECT doc_id AS id, length(text) AS chars, 't1' AS tenant_id FROM documents")
def _(fx):
    rows = fx.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("\u0000"), "text").alias("content"))
    return S.clean_chunks(rows, "t1", F.current_timestamp()).select("id", F.length("content").cast("long").alias("chars"), "tenant_id")


@query("A13_query_history", """
SELECT CAST(conv_id % 10 AS VARCHAR) AS tenant_id, conv_id*1000 + turn AS ts, left(text, 500) AS answer FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id*1000 + turn DESC, role) <= 100""")
def _(fx):
    rows = fx.conversations.select((F.col("conv_id") % 10).cast("string").alias("tenant_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.col("role").alias("query"), F.col("text").alias("answer"))
    return S.query_history(rows).select("tenant_id", "ts", "answer")


@query("A14_openapi_endpoints", "SELECT 'n0/openapi.json' AS file, upper(m) AS method, '/v' || c AS path FROM (SELECT count(*) AS c FROM nation), (VALUES ('get'), ('post')) t(m)")
def _(fx):
    body = F.concat(F.lit('{"paths": {"/v'), F.col("c").cast("string"), F.lit('": {"get": {}, "post": {"x": 1}, "parameters": {}}}}'))
    f = fx.nation.agg(F.count("*").alias("c")).select(F.explode(F.array(F.lit("n0/openapi.json"), F.lit("n0/other.json"))).alias("path"), body.alias("content"))
    return S.read_openapi_endpoints(f)


def stream(fx, name):
    """A driver table as a stream of files."""
    table = getattr(fx, name)
    path = f"{fx.sf_dir}/{name}.parquet"
    fs = fx.spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs.getFileSystem(fx.spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    at = path if folder else f"{fx.sf_dir}/{name}*.parquet"
    return fx.spark.readStream.schema(table.schema).parquet(at)


def ts(c="ts"):
    return F.col(c).cast("timestamp").alias("ts")


@query("T1_push_changes", """
SELECT o_custkey % 50 AS repo, CAST(o_orderkey AS VARCHAR) AS head, CASE WHEN o_orderkey % 5 = 0 THEN 'full' ELSE 'delta' END AS mode, 2 AS n FROM orders WHERE o_orderstatus = 'F'""")
def _(fx):
    key = F.col("o_orderkey").cast("string")
    commit = F.struct(F.array(F.concat(F.lit("a"), key)).alias("added"), F.array(F.concat(F.lit("b"), key)).alias("modified"), F.array(F.concat(F.lit("a"), key)).alias("removed"))
    ref = F.concat(F.lit("refs/heads/"), F.when(F.col("o_orderstatus") == "F", "main").otherwise("dev"))
    before = F.when(F.col("o_orderkey") % 5 == 0, "0000").otherwise("abc")
    p = stream(fx, "orders").select((F.col("o_custkey") % 50).alias("repo"), ref.alias("ref"), before.alias("before"), key.alias("after"), ts("o_orderdate"), F.array(commit, commit).alias("commits"))
    return J.drain(J.push_changes(p), fx.stages).select("repo", "head", "mode", F.size("files").alias("n"))


# pushes to main: each commit changes its files, and removes some
PUSHED = """acts AS (SELECT f.id AS path, CASE WHEN (f.file_key + c.hash) % 13 = 0 THEN 'removed' ELSE 'changed' END AS action, CAST(c.hash AS VARCHAR) AS head
 FROM (SELECT DISTINCT l_orderkey AS hash, l_partkey AS file_key FROM lineitem) c JOIN fx_files f USING (file_key) JOIN orders ON o_orderkey = c.hash WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY o_orderdate DESC, CAST(c.hash AS VARCHAR) DESC, action DESC) = 1)"""


def pushed(fx):
    """The store after all pushes to main, each merged in its micro-batch, and each batch given again."""
    dealt = fx.lineitem.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file_key")).distinct().join(fx.files.select("file_key", "id"), "file_key")
    goes = (F.col("file_key") + F.col("hash")) % 13 == 0
    commits = dealt.groupBy("hash").agg(F.collect_list(F.when(~goes, F.col("id"))).alias("modified"), F.collect_list(F.when(goes, F.col("id"))).alias("removed"))  # lines of an order
    commit = F.struct(F.array().cast("array<string>").alias("added"), "modified", "removed")
    ref = F.concat(F.lit("refs/heads/"), F.when(F.col("o_orderstatus") == "F", "main").otherwise("dev"))
    head = F.col("o_orderkey").cast("string")
    pushes = stream(fx, "orders").join(fx.stages.keep(commits), F.col("o_orderkey") == F.col("hash")).select(F.lit(1).alias("repo"), ref.alias("ref"), F.lit("abc").alias("before"), head.alias("after"), ts("o_orderdate"), F.array(commit).alias("commits"))
    edges = fx.written("edges")

    def extract(files):
        nodes = files.select(F.col("path").alias("id"), X.basename(F.col("path")).alias("name"), F.lit("file").alias("type"), "head")
        return nodes, edges.join(files.select(F.col("path").alias("src")), "src", "left_semi")

    store = I.CodeStore(fx.spark, fx.stages.path("graph"), "id string, name string, type string, head string")
    I.ingest(pushes, store, extract, fx.stages.path("graph-checkpoint")).awaitTermination()
    for v in store.store.done():  # a replay changes nothing
        store.apply(v // 2, fx.files.limit(0).select(F.col("id").alias("path"), F.lit("removed").alias("action"), F.lit("x").alias("head")), extract)
    return store


@query("T1_ingest_nodes", f"WITH {PUSHED} SELECT path AS id, regexp_replace(path, '^.*/', '') AS name, 'file' AS type, head FROM acts WHERE action = 'changed'")
def _(fx):
    return pushed(fx).nodes()


@query("T1_ingest_edges", f"WITH {PUSHED} SELECT DISTINCT src, dst, relation FROM fx_edges WHERE src IN (SELECT path FROM acts WHERE action = 'changed') AND dst IN (SELECT path FROM acts WHERE action = 'changed')")
def _(fx):
    return pushed(fx).edges()


@query("T2_pr_events", PR_RISK + """ SELECT pr_id, 'opened' AS action, score, CASE level WHEN 'CRITICAL' THEN 'failure' WHEN 'HIGH' THEN 'neutral' ELSE 'success' END AS conclusion
FROM risk JOIN orders ON o_orderkey = pr_id WHERE o_orderpriority = '1-URGENT'""")
def _(fx):
    e = stream(fx, "orders").select(F.col("o_orderkey").alias("pr_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "opened").otherwise("closed").alias("action"))
    review = lambda prs: pr_risk(reviewed(fx, prs)).select("pr_id", "score", "level")
    return J.drain(e, fx.stages, each=lambda df: J.pr_events(df, review)).drop("batch_id")


@query("T3_incidents_7d", """
WITH e AS (SELECT user_id % 20 AS file, date_trunc('day', ts) AS d FROM events WHERE event_type = 'error')
SELECT file, CAST(d - INTERVAL 1 DAY * k AS TIMESTAMP) AS start, count(*) AS n FROM e, range(7) r(k) GROUP BY 1, 2""")
def _(fx):
    e = stream(fx, "events").where("event_type = 'error'").select((F.col("user_id") % 20).alias("file"), ts())
    out = J.latest(J.drain(J.incidents_7d(e), fx.stages, "update"), ["file", "start", "end"])
    return out.select("file", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("T4_telemetry_rollup", """
SELECT event_type AS intent, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS queries, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
 round(avg(CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE 0e0 END), 9) AS pass_rate FROM events GROUP BY 1, 2""")
def _(fx):
    e = stream(fx, "events").select(ts(), F.col("event_type").alias("intent"), F.col("value").alias("latency_ms"), (F.col("user_id") % 2 == 0).alias("passed"))
    out = J.latest(J.drain(J.telemetry_rollup(e, "1 hour"), fx.stages, "update"), ["intent", "start"])
    return out.withColumn("pass_rate", F.round("pass_rate", 9)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("T5_rate_limit_report", """
SELECT event_id, key, in_window FROM (SELECT event_id, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 2""")
def _(fx):
    return J.rate_limit_report(fx.events.select("event_id", F.col("user_id").alias("key"), "ts"), 2, 3600)


@query("T5_rate_limit_admission", """
WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t_at, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)) / 1e6, event_id) AS nth FROM events),
a AS (SELECT key, event_id, nth, true AS ok, t_at AS p1, CAST(NULL AS DOUBLE) AS p2 FROM e WHERE nth = 1
 UNION ALL SELECT key, event_id, nth, ok, CASE WHEN ok THEN t_at ELSE p1 END, CASE WHEN ok THEN p1 ELSE p2 END FROM (SELECT e.key, e.event_id, e.nth, e.t_at, a.p1, a.p2, coalesce(a.p2 <= e.t_at - 3600, true) AS ok FROM a JOIN e ON e.key = a.key AND e.nth = a.nth + 1))
SELECT key, event_id, ok FROM a""")
def _(fx):
    e = stream(fx, "events").select("event_id", F.col("user_id").alias("key"), ts())
    return J.drain(J.admitted(e, 2, 3600, "3650 days"), fx.stages).drop("batch_id")
