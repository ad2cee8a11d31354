"""Queries on joins and traversals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import communities as C
from cairn.operators import graph as G
from cairn.plans.registry import query
from cairn.sources import tables as S

# requests: the files whose key is divisible by 20
REQ = "SELECT file_key AS request_id, id FROM fx_files WHERE file_key % 20 = 0"
DEP = "(SELECT src, dst FROM fx_edges WHERE relation = 'DEPENDS_ON')"


def requests(fx, every=20):
    return fx.files.where(F.col("file_key") % every == 0).select(F.col("file_key").alias("request_id"), "id")


@query("C1_resolve_node_ids", f"SELECT request_id, id FROM ({REQ})")
def _(fx):
    r = requests(fx).select("request_id", F.replace("id", F.lit("/"), F.lit("\\")).alias("path"))
    return G.resolve_node_ids(r, fx.files)


@query("C2_match_source", f"""
WITH r AS (SELECT request_id, CASE request_id % 4 WHEN 0 THEN id WHEN 2 THEN replace(id, '/', chr(92)) WHEN 1 THEN regexp_replace(id, '/[^/]*$', '') ELSE 'x/y/' || regexp_replace(id, '^.*/', '') END AS path
 FROM (SELECT file_key AS request_id, id FROM fx_files WHERE file_key % 15 = 0)),
m AS (SELECT request_id, f.id, CASE WHEN f.id = path THEN 1 WHEN f.id = replace(path, chr(92), '/') THEN 2 WHEN starts_with(f.id, path || '/') THEN 3 ELSE 4 END AS tier
 FROM r JOIN fx_files f ON f.id = path OR f.id = replace(path, chr(92), '/') OR starts_with(f.id, path || '/') OR regexp_replace(f.id, '^.*/', '') = regexp_replace(path, '^.*/', ''))
SELECT request_id, id, CAST(tier AS INT) AS tier FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, id) = 1""")
def _(fx):
    k = F.col("request_id") % 4
    path = F.when(k == 0, F.col("id")).when(k == 2, F.replace("id", F.lit("/"), F.lit("\\"))).when(k == 1, F.regexp_replace("id", "/[^/]*$", "")).otherwise(F.concat(F.lit("x/y/"), X.basename(F.col("id"))))
    return G.match_source(requests(fx, 15).select("request_id", path.alias("path")), fx.files)


@query("C3_mark_untested", "SELECT id FROM fx_files f WHERE NOT is_test_file AND NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.dst = f.id AND relation = 'COVERS')")
def _(fx):
    return G.mark_untested(fx.nodes, fx.edges).select("id")


@query("C4_dead_code", """
SELECT id, last_modified FROM (SELECT id, (SELECT max(date) FROM fx_touches t WHERE t.file = f.id) AS last_modified FROM fx_files f
 WHERE NOT regexp_matches(lower(id), 'test|spec|__main__') AND NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.dst = f.id AND relation IN ('CALLS', 'DEPENDS_ON')))
ORDER BY last_modified DESC NULLS LAST, id LIMIT 100""")
def _(fx):
    last = fx.touches.groupBy(F.col("file").alias("id")).agg(F.max("date").alias("last_modified"))
    symbols = fx.files.select("id", X.basename(F.col("id")).alias("name"), F.lit("function").alias("type")).join(last, "id", "left")
    return G.find_dead_code(symbols, fx.edges).select("id", "last_modified")


@query("C5_orphans", """
SELECT id FROM fx_files f WHERE NOT regexp_matches(id, '(main\\.py|__main__\\.py|page\\.tsx|page\\.ts)$|__pycache__|node_modules')
 AND NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.dst = f.id AND relation = 'DEPENDS_ON') ORDER BY id LIMIT 50""")
def _(fx):
    return G.find_orphans(fx.nodes, fx.edges).select("id").orderBy("id").limit(50)


@query("C6_covering_tests", f"""
SELECT DISTINCT request_id, src AS test FROM ({REQ}) JOIN fx_edges ON id = dst AND relation = 'COVERS'
JOIN (SELECT id AS t FROM fx_files WHERE is_test_file OR regexp_matches(lower(id), 'test|spec')) ON src = t""")
def _(fx):
    return G.covering_tests(requests(fx), fx.edges, fx.nodes)


@query("C7_induced_edges", """
WITH m AS (SELECT file_key % 10 AS request_id, id FROM fx_files)
SELECT DISTINCT a.request_id, src, dst, relation FROM fx_edges JOIN m a ON src = a.id JOIN m b ON dst = b.id AND a.request_id = b.request_id""")
def _(fx):
    return G.induced_edges(fx.files.select((F.col("file_key") % 10).alias("request_id"), "id"), fx.edges)


# beside the tests that are there, every ninth file has one of each form in another folder
@query("C11_test_covers", """
WITH n AS (SELECT id, regexp_replace(id, '^.*/', '') AS name, file_key FROM fx_files),
every AS (SELECT id, name FROM n UNION ALL SELECT 'spec/test_' || name, 'test_' || name FROM n WHERE file_key % 9 = 0 UNION ALL SELECT 'spec/' || replace(name, '.py', '_test.py'), replace(name, '.py', '_test.py') FROM n WHERE file_key % 9 = 0),
t AS (SELECT id, CASE WHEN starts_with(name, 'test_') THEN substr(name, 6) WHEN name LIKE '%\\_test.py' ESCAPE '\\' THEN replace(name, '_test.py', '.py') END AS name FROM every)
SELECT t.id AS src, e.id AS dst FROM t JOIN every e ON e.name = t.name""")
def _(fx):
    from cairn.operators.text import test_covers

    name, some = X.basename(F.col("id")), fx.files.where("file_key % 9 = 0")
    more = some.select(F.explode(F.array(F.concat(F.lit("spec/test_"), name), F.concat(F.lit("spec/"), F.regexp_replace(name, r"\.py$", "_test.py")))).alias("path"))
    return test_covers(fx.files.select(F.col("id").alias("path")).unionByName(more))


RULES = [("api", "data"), ("ui", "data"), ("ui", "service"), ("util", "api"), ("data", "ui")]


def rules(fx):
    return fx.spark.createDataFrame(RULES, "layer string, banned string")


RULE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RULES) + ") r(layer, banned)"


@query("C12_architecture_violations", f"""
SELECT e.src, e.dst, a.layer || '→' || b.layer AS violation_rule FROM fx_edges e JOIN fx_nodes a ON e.src = a.id JOIN fx_nodes b ON e.dst = b.id
JOIN {RULE_SQL} ON r.layer = a.layer AND r.banned = b.layer WHERE relation = 'DEPENDS_ON'""")
def _(fx):
    from cairn.operators.insight import architecture_violations

    return architecture_violations(fx.edges, fx.nodes, rules(fx))


@query("C13_layer_assign", """
SELECT id, CASE WHEN starts_with(id, 'api/') THEN 'edge' WHEN regexp_matches(id, '(^|/)services/') THEN 'core' WHEN regexp_matches(id, '(^|.*/)[^/]*core_.*$') THEN 'kernel' WHEN starts_with(id, 'utils/') THEN 'tools' ELSE NULL END AS layer FROM fx_files""")
def _(fx):
    from cairn.operators.insight import layer_assign

    r = [(1, "edge", ["api/**"]), (2, "core", ["services/**"]), (3, "kernel", ["*core_*"]), (4, "tools", ["utils/**"])]
    return layer_assign(fx.files, r).select("id", "layer")


@query("C14_same_directory", """
SELECT a.id, b.id AS sibling FROM fx_files a JOIN fx_files b ON regexp_replace(a.id, '/[^/]*$', '') = regexp_replace(b.id, '/[^/]*$', '') AND a.id <> b.id WHERE a.file_key % 20 = 0""")
def _(fx):
    # files hold all that is asked of nodes; a file asks under its own name
    found = G.siblings_of(requests(fx).select(F.col("id").alias("request_id"), "id"), fx.files.select("id", F.lit("file").alias("type")))
    return found.select(F.col("request_id").alias("id"), F.col("id").alias("sibling"))


@query("C15_infer_edges", """
WITH m AS (SELECT file_key % 397 AS request_id, id, regexp_replace(id, '/[^/]*$', '') AS folder, regexp_replace(regexp_replace(id, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM fx_files),
x AS (SELECT DISTINCT a.request_id FROM fx_edges JOIN m a ON src = a.id JOIN m b ON dst = b.id AND a.request_id = b.request_id),
l AS (SELECT * FROM m WHERE request_id NOT IN (SELECT request_id FROM x)),
p AS (SELECT a.request_id, a.id AS a, b.id AS b, CASE WHEN a.stem <> b.stem AND length(a.stem) > 3 AND length(b.stem) > 3 AND (contains(a.stem, b.stem) OR contains(b.stem, a.stem)) THEN 'RELATED' WHEN a.stem = b.stem THEN 'PAIRED' WHEN a.folder = b.folder THEN 'SIBLING' END AS kind
 FROM l a JOIN l b ON a.request_id = b.request_id AND a.id < b.id) SELECT * FROM p WHERE kind IS NOT NULL""")
def _(fx):
    return G.infer_edges(fx.files.select((F.col("file_key") % 397).alias("request_id"), "id"), fx.edges)


@query("C16_team_topology", """
SELECT a.author AS a, b.author AS b, count(*) AS weight FROM fx_authors a JOIN fx_authors b ON a.file = b.file AND a.author < b.author
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def _(fx):
    return G.team_topology(fx.touches.select(F.col("file").alias("node"), "author"))


SYMBOLS = "SELECT id || '::f' || k AS id, 'f' || k AS name, CASE WHEN k = 0 THEN 'class' ELSE 'function' END AS type, id AS file FROM fx_files, range(3) r(k)"


def symbols(fx):
    k = fx.files.select(F.col("id").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    name = F.concat(F.lit("f"), F.col("k").cast("string"))
    return k.select(F.concat("file", F.lit("::"), name).alias("id"), name.alias("name"), F.when(F.col("k") == 0, "class").otherwise("function").alias("type"), "file")


@query("C17_find_definition", f"""
WITH s AS ({SYMBOLS}), q AS (SELECT file_key AS request_id, id || '::f1' AS symbol FROM fx_files WHERE file_key % 20 = 0 UNION ALL SELECT -1, 'f2' UNION ALL SELECT -2, 'f0')
SELECT request_id, id FROM (SELECT request_id, s.id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN type = 'function' THEN 0 ELSE 1 END, s.id) AS nth
 FROM q JOIN s ON s.id = symbol OR s.name = symbol OR ends_with(s.id, '::' || symbol)) WHERE nth = 1""")
def _(fx):
    from cairn.operators.insight import find_definition

    q = requests(fx).select("request_id", F.concat("id", F.lit("::f1")).alias("symbol")).unionByName(fx.spark.createDataFrame([(-1, "f2"), (-2, "f0")], "request_id long, symbol string"))
    return find_definition(q, symbols(fx))


@query("C18_find_references", f"""
SELECT DISTINCT request_id, src FROM ({REQ}) JOIN fx_edges ON dst = id AND relation IN ('REFERENCES', 'CALLS', 'IMPORTS')
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY src) <= 50""")
def _(fx):
    from cairn.operators.insight import find_references

    return find_references(requests(fx).withColumnRenamed("id", "symbol"), fx.nodes, fx.edges, 50)


@query("C19_attach_incidents", """
WITH i AS (SELECT regexp_replace(id, '^[^/]*/', '') AS path, CAST(file_key % 7 AS INT) AS n FROM fx_files WHERE file_key % 11 = 0)
SELECT f.id, sum(n) AS prod_incidents_7d FROM fx_files f JOIN i ON f.id = path OR ends_with(f.id, '/' || path) GROUP BY 1""")
def _(fx):
    from cairn.operators.insight import attach_incidents

    i = fx.files.where("file_key % 11 = 0").select(F.regexp_replace("id", "^[^/]*/", "").alias("file_path"), (F.col("file_key") % 7).cast("int").alias("count_7d"))
    return attach_incidents(fx.nodes, i).where("hit").select("id", F.col("prod_incidents_7d"))


@query("C20_nodes_by_name", """
WITH s AS (SELECT id || '::f' || k AS id, 'f' || k AS name FROM fx_files, range(3) r(k) UNION ALL SELECT id, regexp_replace(id, '^.*/', '') FROM fx_files),
q AS (SELECT file_key AS query_id, regexp_replace(id, '^.*/', '') AS term FROM fx_files WHERE file_key % 20 = 0 UNION ALL SELECT -1, 'f2' UNION ALL SELECT -2, 'core_'),
m AS (SELECT query_id, s.id, CASE WHEN s.name = term THEN 1 WHEN s.id = term THEN 2 WHEN ends_with(s.id, '::' || term) THEN 3 WHEN contains(s.id, '::' || term || '::') THEN 4 WHEN contains(lower(s.name), lower(term)) THEN 5 ELSE 6 END AS tier
 FROM q JOIN s ON contains(lower(s.id), lower(term)) OR contains(lower(s.name), lower(term)))
SELECT query_id, id, CAST(tier AS INT) AS tier FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, id) <= 100""")
def _(fx):
    from cairn.operators.insight import nodes_by_name

    all_ = symbols(fx).select("id", "name").unionByName(fx.files.select("id", X.basename(F.col("id")).alias("name")))
    q = fx.files.where("file_key % 20 = 0").select(F.col("file_key").alias("query_id"), X.basename(F.col("id")).alias("term")).unionByName(fx.spark.createDataFrame([(-1, "f2"), (-2, "core_")], "query_id long, term string"))
    return nodes_by_name(q, all_)


@query("C21_workspace_peers", """
WITH w AS (SELECT c_nationkey AS workspace_id, c_mktsegment AS repo FROM customer GROUP BY ALL)
SELECT a.workspace_id, a.repo, count(b.repo) AS n_peers, coalesce(string_agg(b.repo, ',' ORDER BY b.repo), '') AS peers
FROM w a LEFT JOIN w b ON a.workspace_id = b.workspace_id AND a.repo <> b.repo GROUP BY 1, 2""")
def _(fx):
    from cairn.operators.insight import workspace_peers

    w = fx.customer.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_mktsegment").alias("repo")).distinct()
    out = workspace_peers(w)
    return out.select("workspace_id", "repo", F.size("peers").cast("long").alias("n_peers"), F.array_join("peers", ",").alias("peers"))


@query("C22_functions_to_files", """
WITH e AS (SELECT src || '::f' AS src, dst, relation FROM fx_edges UNION ALL SELECT id, id || '::f', 'CONTAINS' FROM fx_files),
h AS (SELECT src AS file, dst AS fn FROM e WHERE relation = 'CONTAINS'), o AS (SELECT * FROM e WHERE relation <> 'CONTAINS')
SELECT DISTINCT src, dst FROM (SELECT file AS src, dst FROM h JOIN o ON fn = o.src UNION ALL SELECT o.src, file FROM h JOIN o ON fn = o.dst) WHERE src <> dst""")
def _(fx):
    f = F.concat(F.col("src"), F.lit("::f"))
    own = fx.files.select(F.col("id").alias("src"), F.concat("id", F.lit("::f")).alias("dst"), F.lit("CONTAINS").alias("relation"))
    return G.functions_to_files(fx.edges.select(f.alias("src"), "dst", "relation").unionByName(own))


@query("C23_commit_touch", "SELECT hash, id FROM fx_commit_files JOIN fx_nodes ON file = id")
def _(fx):
    from cairn.operators.insight import commit_touch

    return commit_touch(fx.nodes, fx.commit_files)


@query("C24_workspace_links", """
SELECT * FROM (SELECT c_nationkey AS workspace_id, c_mktsegment AS src, lead(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dst
FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) WHERE dst IS NOT NULL""")
def _(fx):
    from cairn.operators.insight import workspace_links

    w = fx.customer.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_mktsegment").alias("repo"), F.col("c_mktsegment").alias("sort_order")).distinct()
    return workspace_links(w)


@query("C25_link_endpoints", """
SELECT DISTINCT 'acme/shop' AS src, 'acme/shop::' || upper(event_type) || ':/v1/' || CAST(user_id % 50 AS STRING) AS dst, 'EXPOSES' AS relation FROM events
ORDER BY 2 LIMIT 80""")
def _(fx):
    from cairn.operators.insight import link_endpoints

    e = fx.events.select(F.upper("event_type").alias("method"), F.concat(F.lit("/v1/"), (F.col("user_id") % 50).cast("string")).alias("path"))
    return link_endpoints(e, "acme/shop")


@query("E10_neighbours", """
SELECT src AS id, dst AS neighbour, relation FROM fx_edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, relation) <= 3""")
def _(fx):
    return G.neighbours(fx.nodes, fx.edges, 3)


@query("E11_graph_page", """
SELECT p.id AS src, e.dst, e.relation FROM (SELECT id FROM fx_files ORDER BY id LIMIT 500) p LEFT JOIN fx_edges e ON e.src = p.id""")
def _(fx):
    return G.graph_page(fx.nodes, fx.edges, 500)


@query("F1_dependents_union", f"""
SELECT DISTINCT request_id, src AS dependent FROM ({REQ}) JOIN {DEP} e ON e.dst = id
UNION SELECT request_id, e2.src FROM ({REQ}) JOIN {DEP} e ON e.dst = id JOIN {DEP} e2 ON e2.dst = e.src""")
def _(fx):
    dep = fx.edges.where("relation = 'DEPENDS_ON'").select("src", "dst")
    one = requests(fx).join(dep, F.col("id") == F.col("dst")).select("request_id", F.col("src").alias("dependent"))
    two = one.join(dep, F.col("dependent") == F.col("dst")).select("request_id", F.col("src").alias("dependent"))
    return one.unionByName(two).distinct()


@query("F2_pr_affected_union", f"""
WITH pr AS (SELECT hash AS pr_id, file FROM fx_commit_files WHERE hash % 20 = 0 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file) <= 20)
SELECT DISTINCT pr_id, e.src AS affected FROM pr JOIN {DEP} e ON e.dst = file
UNION SELECT pr_id, e2.src FROM pr JOIN {DEP} e ON e.dst = file JOIN {DEP} e2 ON e2.dst = e.src""")
def _(fx):
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("file"))
    pr = fx.commit_files.where("hash % 20 = 0").withColumn("nth", nth).where("nth <= 20").select(F.col("hash").alias("request_id"), F.col("file").alias("id"))
    dep = G.reversed_edges(fx.edges.where("relation = 'DEPENDS_ON'").select("src", "dst"))
    one = G._step(pr, dep)
    return one.unionByName(G._step(one, dep)).distinct().select(F.col("request_id").alias("pr_id"), F.col("id").alias("affected"))


@query("F3_distinct_in_order", """
SELECT hash % 1000 AS k, array_to_string(list(author ORDER BY f), ',') AS authors FROM (SELECT hash % 1000 AS hash, author, min(hash) AS f FROM fx_commits GROUP BY 1, 2) GROUP BY 1""")
def _(fx):
    ordered = F.sort_array(F.collect_list(F.struct("hash", "author")))
    out = fx.commits.groupBy((F.col("hash") % 1000).alias("k")).agg(ordered.alias("o"))
    return out.select("k", F.array_join(F.array_distinct(F.transform("o", lambda x: x["author"])), ",").alias("authors"))


@query("F4_seed_union", f"""
WITH a AS (SELECT request_id, src AS id, 1 AS p, 'direct' AS origin FROM ({REQ}) r JOIN {DEP} e ON e.dst = r.id),
b AS (SELECT request_id, dst, 2, 'dependency' FROM ({REQ}) r JOIN {DEP} e ON e.src = r.id), c AS (SELECT request_id, id, 3, 'self' FROM ({REQ}))
SELECT request_id, id, arg_min(origin, p) AS origin FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2""")
def _(fx):
    from cairn.operators.insight import first_source

    dep = fx.edges.where("relation = 'DEPENDS_ON'").select("src", "dst")
    r = requests(fx)
    return first_source([("direct", G._step(r, G.reversed_edges(dep))), ("dependency", G._step(r, dep)), ("self", r)])


@query("G1_impact_subgraph", f"""
WITH one AS (SELECT request_id, src, dst FROM ({REQ}) r JOIN {DEP} e ON e.dst = r.id)
SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT one.request_id, e.src, e.dst FROM one JOIN {DEP} e ON e.dst = one.src)""")
def _(fx):
    return G.impact_subgraph(requests(fx), fx.edges)


BOTH = "SELECT src, dst FROM fx_edges WHERE relation <> 'MAYBE_CALLS' UNION SELECT dst, src FROM fx_edges WHERE relation <> 'MAYBE_CALLS'"


@query("G5_expand_subgraph", f"""
WITH b AS ({BOTH}), h0 AS (SELECT request_id, id, 0 AS hop FROM ({REQ})),
h1 AS (SELECT DISTINCT request_id, dst AS id, 1 AS hop FROM h0 JOIN b ON src = id),
h2 AS (SELECT DISTINCT request_id, dst AS id, 2 AS hop FROM h1 JOIN b ON src = id),
m AS (SELECT request_id, id, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2)
SELECT request_id, id, CAST(hop AS INT) AS hop FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY hop, id) <= 60""")
def _(fx):
    return G.expand_subgraph(requests(fx), fx.nodes, fx.edges, 2, 60)


@query("G7_cycles", f"""
WITH n AS (SELECT id FROM fx_files WHERE NOT is_test_file), e AS (SELECT DISTINCT src, dst FROM {DEP} WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 2 AS length, a.src || ' > ' || a.dst AS path FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT 3, a.src || ' > ' || a.dst || ' > ' || b.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst""")
def _(fx):
    return G.cycles(fx.files, fx.written("edges"))


@query("G8_files_on_cycles", f"""
WITH e AS (SELECT DISTINCT src, dst FROM {DEP}), pr AS (SELECT hash AS pr_id, file FROM fx_commit_files WHERE hash % 20 = 0),
w1 AS (SELECT DISTINCT file AS s, dst AS t FROM (SELECT DISTINCT file FROM pr) JOIN e ON src = file), {", ".join(f"w{i} AS (SELECT DISTINCT s, dst AS t FROM w{i - 1} JOIN e ON src = t)" for i in range(2, 7))},
c AS (SELECT s, min(l) AS l FROM ({" UNION ALL ".join(f"SELECT s, {i} AS l FROM w{i} WHERE s = t" for i in range(2, 7))}) GROUP BY 1)
SELECT DISTINCT pr_id, file, CAST(l AS INT) AS length FROM pr JOIN c ON file = s""")
def _(fx):
    pr = fx.commit_files.where("hash % 20 = 0").select(F.col("hash").alias("pr_id"), "file")
    return G.files_on_cycles(pr, fx.written("edges"), 6, fx.stages)


@query("G7_strong_components", f"""
WITH e AS (SELECT DISTINCT src, dst FROM {DEP} WHERE src <> dst), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
two AS (SELECT a.src AS id, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
SELECT id, least(id, min(other)) AS component FROM two GROUP BY id""")
def _(fx):
    return C.strong_components(fx.written("edges").where("relation = 'DEPENDS_ON'"), fx.stages)


@query("G9_shortest_path", f"""
WITH b AS (SELECT src, dst FROM fx_edges UNION SELECT dst, src FROM fx_edges), q AS (SELECT file_key AS pair_id, id AS a FROM fx_files WHERE file_key % 20 = 0),
z AS (SELECT pair_id, a, (SELECT id FROM fx_files WHERE file_key = pair_id + 7) AS b FROM q),
p1 AS (SELECT pair_id, z.b, dst AS t, [a, dst] AS path FROM z JOIN b ON src = a),
p2 AS (SELECT pair_id, p1.b, dst AS t, min(list_append(path, dst)) AS path FROM p1 JOIN b ON src = t GROUP BY 1, 2, 3),
p3 AS (SELECT pair_id, p2.b, dst AS t, min(list_append(path, dst)) AS path FROM p2 JOIN b ON src = t WHERE dst = p2.b GROUP BY 1, 2, 3),
u AS (SELECT pair_id, 1 AS hops, path FROM p1 WHERE t = b UNION ALL SELECT pair_id, 2, path FROM p2 WHERE t = b UNION ALL SELECT pair_id, 3, path FROM p3 WHERE t = b)
SELECT pair_id, CAST(hops AS INT) AS hops, array_to_string(path, ' > ') AS path FROM u QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY hops) = 1""")
def _(fx):
    q = requests(fx).select(F.col("request_id").alias("pair_id"), F.col("id").alias("a"))
    b = fx.files.select((F.col("file_key") - 7).alias("pair_id"), F.col("id").alias("b"))
    return G.shortest_path(q.join(b, "pair_id", "left"), fx.edges, 3)


@query("G10_ego_network", f"""
WITH b AS (SELECT src, dst FROM fx_edges UNION SELECT dst, src FROM fx_edges)
SELECT request_id, id FROM ({REQ}) UNION SELECT request_id, dst FROM ({REQ}) JOIN b ON src = id""")
def _(fx):
    return G.ego_network(requests(fx), fx.edges)


# five rounds, written out
ROUNDS = " ".join(
    f"v{i} AS (SELECT dst AS id, label FROM b JOIN l{i - 1} l ON l.id = src UNION ALL SELECT id, label FROM l{i - 1}), l{i} AS (SELECT id, label FROM (SELECT id, label, count(*) AS n FROM v{i} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1),"
    for i in range(1, 6)
)


@query("G11_communities", f"""
WITH b AS (SELECT src, dst FROM {DEP} WHERE src <> dst UNION SELECT dst, src FROM {DEP} WHERE src <> dst), l0 AS (SELECT id, id AS label FROM fx_files), {ROUNDS}
rk AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS nth FROM l5 GROUP BY 1)
SELECT id, CASE WHEN nth <= 6 AND n > 1 THEN l5.label ELSE (SELECT label FROM rk WHERE nth = 1) END AS community FROM l5 JOIN rk USING (label)""")
def _(fx):
    return G.communities(fx.nodes, fx.edges.where("relation = 'DEPENDS_ON'"), S.Stages(fx.spark))


def louvain_sql(levels: int = 3, rounds: int = 6) -> str:
    """Labels of every level (lb0: none) and their modularity, on the fixed rounds of ``communities.louvain``."""
    out = [
        "li AS (SELECT DISTINCT src AS a, dst AS b, 1::HUGEINT AS w FROM (SELECT src, dst FROM fx_edges WHERE relation = 'DEPENDS_ON' UNION ALL SELECT dst, src FROM fx_edges WHERE relation = 'DEPENDS_ON') WHERE a <> b)",
        "mm AS (SELECT sum(w) AS m FROM li)", "lb0 AS (SELECT DISTINCT id, id AS label FROM fx_nodes)", "g0 AS (SELECT * FROM li)",
    ]
    for i in range(levels):
        out.append(f"n{i}_0 AS (SELECT a AS v, sum(w) AS k, a AS c FROM g{i} GROUP BY a)")
        for t in range(rounds):
            now, p = f"n{i}_{t}", f"x{i}_{t}"
            out += [
                f"{p}t AS (SELECT c, sum(k) AS total FROM {now} GROUP BY c)", f"{p}f AS (SELECT * FROM {now} WHERE CAST('0x' || left(md5(v || ':{i * rounds + t}'), 1) AS INT) % 2 = 0)",
                f"{p}w AS (SELECT v, c, sum(w) AS w FROM (SELECT g.a AS v, n.c, g.w FROM g{i} g JOIN {p}f f ON f.v = g.a JOIN {now} n ON n.v = g.b WHERE g.a <> g.b UNION ALL SELECT v, c, 0 FROM {p}f) GROUP BY v, c)",
                f"{p}b AS (SELECT y.v, y.c FROM {p}w y JOIN {p}f f ON f.v = y.v JOIN {p}t t ON t.c = y.c, mm QUALIFY row_number() OVER (PARTITION BY y.v ORDER BY m * y.w - f.k * (t.total - CASE WHEN y.c = f.c THEN f.k ELSE 0 END) DESC, y.c) = 1)",
                f"n{i}_{t + 1} AS (SELECT n.v, n.k, coalesce(b.c, n.c) AS c FROM {now} n LEFT JOIN {p}b b ON b.v = n.v)",
            ]
        last = f"n{i}_{rounds}"
        out.append(f"lb{i + 1} AS (SELECT id, coalesce(c, label) AS label FROM lb{i} LEFT JOIN {last} ON v = label)")
        out.append(f"g{i + 1} AS (SELECT x.c AS a, y.c AS b, sum(w) AS w FROM g{i} JOIN {last} x ON x.v = a JOIN {last} y ON y.v = b GROUP BY 1, 2)")
    out.append("deg AS (SELECT a AS id, sum(w) AS k FROM li GROUP BY a)")
    score = " UNION ALL ".join(f"SELECT {i} AS level, (SELECT m FROM mm) * (SELECT count(*) FROM li JOIN lb{i} x ON x.id = a JOIN lb{i} y ON y.id = b WHERE x.label = y.label) - (SELECT sum(t * t) FROM (SELECT sum(k) AS t FROM deg JOIN lb{i} USING (id) GROUP BY label)) AS q" for i in range(levels + 1))
    out.append(f"best AS (SELECT level FROM ({score}) ORDER BY q DESC, level LIMIT 1)")
    out.append("lv AS (" + " UNION ALL ".join(f"SELECT id, label FROM lb{i} WHERE {i} = (SELECT level FROM best)" for i in range(levels + 1)) + ")")
    out.append("rk AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS nth FROM lv GROUP BY 1)")
    out.append("cm AS (SELECT id, CAST(CASE WHEN nth < 6 AND n > 1 THEN nth ELSE 0 END AS INT) AS community FROM lv JOIN rk USING (label))")
    return "WITH " + ",\n".join(out)


LOUVAIN = louvain_sql()


def louvain(fx):
    nodes = fx.written("outline")  # what nodes are, without their history
    return C.merged_communities(nodes, C.louvain(nodes, fx.written("edges").where("relation = 'DEPENDS_ON'"), fx.stages))


@query("G11_louvain", f"{LOUVAIN} SELECT id, community FROM cm")
def _(fx):
    return louvain(fx)


LAYER_PLACE = "CASE layer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(X.LAYER_COLOURS)) + " ELSE 6 END"


@query("G11_community_report", f"""{LOUVAIN}, named AS (SELECT community, string_agg(name, ', ' ORDER BY id) AS label FROM (SELECT community, id, name FROM cm JOIN fx_nodes USING (id) QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 3) GROUP BY 1),
lay AS (SELECT community, layer, count(*) AS c FROM cm JOIN fx_nodes USING (id) GROUP BY 1, 2), tot AS (SELECT community, CAST(sum(c) AS BIGINT) AS n FROM lay GROUP BY 1),
top AS (SELECT community, layer FROM lay QUALIFY row_number() OVER (PARTITION BY community ORDER BY c DESC, {LAYER_PLACE}) = 1)
SELECT community, n, CASE WHEN length(label) > 40 THEN left(label, 38) || '…' ELSE label END AS label, layer AS dominant_layer, CASE layer {" ".join(f"WHEN '{x}' THEN '{c}'" for x, c in X.LAYER_COLOURS.items())} END AS color FROM tot JOIN named USING (community) JOIN top USING (community)""")
def _(fx):
    found = fx.stages.keep(louvain(fx))
    return C.community_report(fx.written("outline"), found)
