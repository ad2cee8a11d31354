"""Queries on health, leadership, teams, users and activity."""

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import graph as G
from cairn.operators import history as H
from cairn.operators import insight as I
from cairn.plans.graph import RULE_SQL, rules
from cairn.plans.registry import query

DEGREE = """(SELECT id, count(DISTINCT CASE WHEN k = 1 THEN o END) AS fan_in, count(DISTINCT CASE WHEN k = 0 THEN o END) AS fan_out
 FROM (SELECT dst AS id, src AS o, 1 AS k FROM fx_edges WHERE relation = 'DEPENDS_ON' UNION ALL SELECT src, dst, 0 FROM fx_edges WHERE relation = 'DEPENDS_ON') GROUP BY id)"""
NOBODY = "(top_owner IS NULL OR top_owner IN ('', 'None', 'Unknown'))"


@query("D7_recommend_experts", f"""
WITH e AS (SELECT request_id, author AS person, file, n AS weight, row_number() OVER (PARTITION BY request_id, author ORDER BY n DESC, file) AS nth
 FROM (SELECT file_key % 30 AS request_id, id FROM fx_files WHERE file_key % 4 = 0) r JOIN fx_authors ON file = r.id)
SELECT request_id, person, max(weight) AS weight, string_agg(file, ',' ORDER BY nth) AS files FROM e WHERE nth <= 3 GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY max(weight) DESC, person) <= 5""")
def _(fx):
    experts = H.author_counts(fx.touches).select(F.col("author").alias("person"), "file", F.col("n").alias("weight"))
    r = fx.files.where("file_key % 4 = 0").select((F.col("file_key") % 30).alias("request_id"), "id")
    return I.recommend_experts(r, experts)


@query("D8_god_objects", f"SELECT id, fan_in, fan_out FROM {DEGREE} WHERE fan_in + fan_out > 8 ORDER BY fan_in + fan_out DESC, id LIMIT 10")
def _(fx):
    gods = I.god_objects(fx.nodes, fx.edges, 8).select("id", "fan_in", "fan_out")
    return gods.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(10)


@query("D9_health_summary", f"""
WITH n AS (SELECT id FROM fx_files WHERE NOT is_test_file), e AS (SELECT DISTINCT src, dst FROM fx_edges WHERE relation = 'DEPENDS_ON' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
c AS (SELECT count(*) AS cycles FROM (SELECT 1 FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
 UNION ALL SELECT 1 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst)),
g AS (SELECT count(*) AS god_objects FROM {DEGREE} WHERE fan_in + fan_out > 8),
o AS (SELECT count(*) AS orphans FROM fx_files f WHERE NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.dst = f.id AND relation = 'DEPENDS_ON')),
t AS (SELECT count(*) AS total_files, round(avg(bus_risk), 6) AS mean_bus_risk FROM fx_nodes)
SELECT total_files, mean_bus_risk, cycles, god_objects, orphans, greatest(0, 100 - 10*least(cycles, 100) - 5*least(god_objects, 100) - least(orphans, 100)) AS score, cycles + god_objects AS critical
FROM t, c, g, o""")
def _(fx):
    nodes, edges = fx.written("nodes"), fx.written("edges")
    return I.health_summary(nodes, G.cycles(nodes, edges), I.god_objects(nodes, edges, 8), G.find_orphans(nodes, edges))


@query("D10_leadership_surface", f"SELECT count(*) AS files, count(*) FILTER (WHERE {NOBODY}) AS unowned, floor((20000*count(*) FILTER (WHERE {NOBODY}) + count(*)) / (2*count(*))) / 100 AS unowned_percent FROM fx_nodes")
def _(fx):
    return I.leadership_surface(fx.nodes)


@query("D11_top_risk_files", """
WITH d AS (SELECT dst, count(DISTINCT src) AS fan FROM fx_edges WHERE relation IN ('DEPENDS_ON', 'IMPORTS', 'CALLS') GROUP BY 1)
SELECT id, coalesce(fan, 0) AS fan_in, CAST(floor(least(1e2, bus_risk*50 + coalesce(fan, 0)*2 + incidents*3)) AS INT) AS score
FROM fx_nodes LEFT JOIN d ON id = dst ORDER BY bus_risk*(10 + coalesce(fan, 0))*(1 + incidents) DESC, id LIMIT 12""")
def _(fx):
    return I.top_risk_files(fx.written("nodes"), fx.written("edges"))


@query("D12_violations_and_incidents", f"""
SELECT (SELECT count(*) FROM fx_edges e JOIN fx_nodes a ON e.src = a.id JOIN fx_nodes b ON e.dst = b.id JOIN {RULE_SQL} ON r.layer = a.layer AND r.banned = b.layer WHERE relation = 'DEPENDS_ON') AS violations,
 (SELECT CAST(sum(incidents) AS BIGINT) FROM fx_nodes) AS incidents""")
def _(fx):
    v = I.architecture_violations(fx.edges, fx.nodes, rules(fx)).agg(F.count("*").alias("violations"))
    return v.crossJoin(fx.nodes.agg(F.sum("incidents").alias("incidents")))  # one row each


@query("D13_ownership_heatmap", f"""
SELECT split_part(id, '/', 1) AS zone, count(*) AS files, count(DISTINCT CASE WHEN {NOBODY} THEN NULL ELSE top_owner END) AS owners,
 floor((2000*(count(*) - count(DISTINCT CASE WHEN {NOBODY} THEN NULL ELSE top_owner END)) + count(*)) / (2*count(*))) / 1000 AS concentration,
 count(*) >= 5 AND count(DISTINCT CASE WHEN {NOBODY} THEN NULL ELSE top_owner END) <= 1 AS alert
FROM fx_nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24""")
def _(fx):
    return I.ownership_heatmap(fx.nodes)


@query("D17_what_if_leaves", """
WITH m AS (SELECT top_owner AS person, id AS file, bus_risk FROM fx_nodes WHERE top_owner IN (SELECT n_name FROM nation)
 QUALIFY row_number() OVER (PARTITION BY top_owner ORDER BY bus_risk DESC, id) <= 80),
o AS (SELECT m.person, m.file, a.author, row_number() OVER (PARTITION BY m.person, m.file ORDER BY a.author) AS nth FROM m JOIN fx_authors a ON a.file = m.file AND a.author <> m.person)
SELECT m.person, m.file, m.bus_risk, coalesce(string_agg(o.author, ',' ORDER BY o.nth), '') AS others FROM m LEFT JOIN o ON o.person = m.person AND o.file = m.file AND o.nth <= 4 GROUP BY 1, 2, 3""")
def _(fx):
    persons = fx.nation.select(F.col("n_name").alias("person"))
    return I.what_if_leaves(fx.nodes, fx.touches.select(F.col("file").alias("node"), "author").distinct(), persons)


@query("D18_person_work", """
WITH p AS (SELECT * FROM (VALUES ('nation_1'), ('Nation_7'), ('xyz')) v(person)),
r AS (SELECT id, top_owner AS name, 1 AS role FROM fx_nodes UNION ALL SELECT id, last_author, 2 FROM fx_nodes UNION ALL SELECT file, author, 3 FROM fx_authors),
b AS (SELECT person, r.id, min(role) AS role FROM r JOIN p ON contains(lower(name), lower(person)) GROUP BY 1, 2)
SELECT person, b.id, CASE role WHEN 1 THEN 'OWNER' WHEN 2 THEN 'LAST_AUTHOR' ELSE 'COLLABORATOR' END AS role FROM b JOIN fx_nodes n ON n.id = b.id
QUALIFY row_number() OVER (PARTITION BY person ORDER BY commit_count DESC, b.id) <= 50""")
def _(fx):
    persons = fx.spark.createDataFrame([("nation_1",), ("Nation_7",), ("xyz",)], "person string")
    return I.person_work(persons, fx.nodes, fx.touches.select(F.col("file").alias("node"), "author").distinct())


@query("D19_layer_pairs", """
SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS n, least(1e0, count(*) / 10) AS weight FROM fx_edges JOIN fx_nodes a ON src = a.id JOIN fx_nodes b ON dst = b.id
WHERE relation IN ('DEPENDS_ON', 'IMPORTS', 'DEFINES') AND a.layer <> b.layer GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 24""")
def _(fx):
    return I.layer_overview(fx.nodes, fx.edges)[1]


@query("D19_layer_overview", """
WITH n AS (SELECT layer, name, row_number() OVER (PARTITION BY layer ORDER BY length(name), name) AS nth FROM fx_nodes)
SELECT layer, count(*) AS files, string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth <= 3) AS names, least(8 + 5e-1*count(*), 4e1) AS val FROM n GROUP BY 1""")
def _(fx):
    return I.layer_overview(fx.nodes, fx.edges)[0]


@query("D20_layer_members", "SELECT layer, id FROM fx_nodes")
def _(fx):
    return I.layer_members(fx.nodes)


@query("D21_relation_histogram", "SELECT relation, count(*) AS n FROM fx_edges GROUP BY 1")
def _(fx):
    return fx.edges.groupBy("relation").agg(F.count("*").alias("n"))


@query("D22_chunk_stats", "SELECT lang AS chunk_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(fx):
    return fx.documents.groupBy(F.col("lang").alias("chunk_type")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("D22_chunks_by_extension", """
SELECT extension, chunks FROM (SELECT regexp_extract(url, '\\.([a-z0-9]+)$', 1) AS extension, count(*) AS chunks FROM pages GROUP BY 1) ORDER BY chunks DESC, extension LIMIT 5""")
def _(fx):
    return I.chunks_by_extension(fx.pages.select(F.col("url").alias("path")))


@query("D23_suggest_reviewers", """
WITH pr AS (SELECT hash AS pr_id, file FROM fx_commit_files WHERE hash % 20 = 0),
w AS (SELECT pr_id, author AS person, CAST(n AS DOUBLE) AS s FROM pr JOIN fx_authors a ON a.file = pr.file QUALIFY row_number() OVER (PARTITION BY pr_id, pr.file ORDER BY n DESC, author) <= 8),
r AS (SELECT pr_id, top_owner AS person, CAST(incidents*10 AS DOUBLE) AS s FROM pr JOIN fx_nodes ON id = pr.file WHERE top_owner IS NOT NULL),
t AS (SELECT pr_id, person, sum(s) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM r) GROUP BY 1, 2)
SELECT pr_id, person, score, least(1e2, floor(score + 5e-1)) / 100 AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY score DESC, person) <= 5""")
def _(fx):
    experts = H.author_counts(fx.touches).select(F.col("author").alias("person"), "file", F.col("n").alias("weight"))
    risks = fx.nodes.select(F.col("id").alias("file"), F.col("top_owner").alias("owner"), (F.col("incidents") * 10).alias("risk"))
    return I.suggest_reviewers(fx.commit_files.where("hash % 20 = 0").select(F.col("hash").alias("pr_id"), "file"), experts, risks)


@query("D24_folder_rollup", """
WITH s AS (SELECT id || '::f' || k AS id, id AS file FROM fx_files, range(2) r(k) WHERE file_key % 5 = 0)
SELECT 'root' AS parent, split_part(id, '/', 1) AS child, 'folder' AS kind, count(*) AS n_children FROM fx_files GROUP BY 2
UNION ALL SELECT split_part(f.id, '/', 1), f.id, 'file', (SELECT count(*) FROM s WHERE s.file = f.id) FROM fx_files f
UNION ALL SELECT file, id, 'symbol', 0 FROM s""")
def _(fx):
    k = fx.files.where("file_key % 5 = 0").select("id", F.explode(F.array(F.lit("::f0"), F.lit("::f1"))).alias("f"))
    symbols = k.select(F.concat("id", "f").alias("id"), F.lit("function").alias("type"))
    stray = fx.spark.createDataFrame([("nowhere.py::g", "function")], "id string, type string")
    return I.folder_rollup(fx.files.select("id", F.lit("file").alias("type")).unionByName(symbols).unionByName(stray))


USERS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) END AS last_login,
 TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 DAY * (c_custkey % 365) AS updated_at, c_custkey % 7 <> 0 AS is_active FROM customer"""


def users(fx):
    last = fx.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("l"))
    rows = fx.customer.select(F.col("c_custkey").alias("id")).join(last, "id", "left")
    at = F.to_timestamp(F.lit("1998-01-01 00:00:00")) + F.make_dt_interval(F.col("id").cast("int") % 365)
    return rows.select("id", F.when(F.col("id") % 4 != 0, F.col("l")).alias("last_login"), at.alias("updated_at"), (F.col("id") % 7 != 0).alias("is_active"))


NOW = "(SELECT max(o_orderdate) AS as_of FROM orders)"


@query("D25_active_users", f"""
SELECT id, last_login, updated_at, is_active FROM ({USERS}), {NOW} WHERE last_login >= as_of - INTERVAL 30 DAY OR (last_login IS NULL AND updated_at >= as_of - INTERVAL 30 DAY)""")
def _(fx):
    return I.active_users(users(fx), fx.as_of)


@query("D25_inactive_users", f"""
SELECT id, last_login, updated_at, is_active FROM ({USERS}), {NOW} WHERE is_active AND (last_login IS NULL OR last_login < as_of - INTERVAL 30 DAY) AND updated_at < as_of - INTERVAL 30 DAY""")
def _(fx):
    return I.inactive_users(users(fx), fx.as_of)


@query("D25_count_active_users", f"""
SELECT count(*) AS n FROM ({USERS}), {NOW} WHERE is_active AND (last_login >= as_of - INTERVAL 90 DAY OR (last_login IS NULL AND updated_at >= as_of - INTERVAL 90 DAY))""")
def _(fx):
    return I.count_active_users(users(fx), fx.as_of, 90)


@query("D25_users_in_range", f"""
SELECT 'login' AS by, id, last_login, updated_at FROM ({USERS}) WHERE is_active AND (last_login BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-30' OR (last_login IS NULL AND updated_at BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-30'))
UNION ALL SELECT 'update', id, last_login, updated_at FROM ({USERS}) WHERE updated_at BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31'""")
def _(fx):
    at = lambda d: F.to_timestamp(F.lit(d))
    login = I.users_in_range(users(fx), at("1998-03-01"), at("1998-06-30")).withColumn("by", F.lit("login"))
    update = I.users_in_range(users(fx), at("1998-03-01"), at("1998-03-31"), False, False).withColumn("by", F.lit("update"))
    return login.unionByName(update).select("by", "id", "last_login", "updated_at")


@query("D25_completed_profiles", f"SELECT id, is_active FROM ({USERS}) JOIN customer ON c_custkey = id WHERE is_active AND c_acctbal > 0")
def _(fx):
    done = fx.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("profile_completed"))
    return I.completed_profiles(users(fx).join(done, "id")).select("id", "is_active")


@query("D26_contribution_grid", """
WITH m AS (SELECT CAST(max(ts) AS DATE) AS as_of FROM events),
c AS (SELECT CAST(unnest(generate_series(CAST(as_of - 363 AS TIMESTAMP), CAST(as_of AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM m),
e AS (SELECT CAST(ts AS DATE) AS day, least(4, count(*) FILTER (WHERE event_type = 'click')) AS click, least(4, count(*) FILTER (WHERE event_type = 'view')) AS view,
 least(4, count(*) FILTER (WHERE event_type = 'purchase')) AS purchase, least(4, count(*) FILTER (WHERE event_type = 'signup')) AS signup FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, coalesce(click, 0) AS click, coalesce(view, 0) AS view, coalesce(purchase, 0) AS purchase, coalesce(signup, 0) AS signup,
 coalesce(click, 0) + coalesce(view, 0) + coalesce(purchase, 0) + coalesce(signup, 0) AS total FROM c LEFT JOIN e USING (day)""")
def _(fx):
    return I.contribution_grid(fx.events, fx.events.agg(F.max("ts").alias("as_of")), ("click", "view", "purchase", "signup")).withColumn("day", F.col("day").cast("string"))


@query("D27_repo_stats", "SELECT p_brand AS language, count(*) AS repos, CAST(sum(p_size) AS BIGINT) AS stars, CAST(sum(p_size % 7) AS BIGINT) AS forks FROM part GROUP BY 1")
def _(fx):
    return fx.part.groupBy(F.col("p_brand").alias("language")).agg(F.count("*").alias("repos"), F.sum("p_size").alias("stars"), F.sum(F.col("p_size") % 7).alias("forks"))


@query("D28_contribution_by_prefix", """
SELECT regexp_extract(replace(p_name, ' ', '-'), '^([^-_]*)', 1) AS prefix, CAST(sum(greatest(1, p_size // 2)) AS BIGINT) AS commits, count(*)*10 AS files FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(fx):
    return I.contribution_by_prefix(fx.part.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), F.col("p_size").alias("stars")))


@query("D29_architecture_snapshot", f"""
WITH v AS (SELECT a.layer AS tenant_id, count(*) AS n FROM fx_edges e JOIN fx_nodes a ON e.src = a.id JOIN fx_nodes b ON e.dst = b.id JOIN {RULE_SQL} ON r.layer = a.layer AND r.banned = b.layer WHERE relation = 'DEPENDS_ON' GROUP BY 1)
SELECT 'api' AS tenant_id, '2024-01-01' AS week_start, coalesce((SELECT n FROM v WHERE tenant_id = 'api'), 5) AS violation_count
UNION ALL SELECT tenant_id, '2024-01-01', n FROM v WHERE tenant_id <> 'api' UNION ALL SELECT 'old', '2023-12-25', 3""")
def _(fx):
    from cairn.sources.tables import upsert

    v = I.architecture_violations(fx.edges, fx.nodes, rules(fx)).join(fx.nodes.select(F.col("id").alias("src"), "layer"), "src")
    new = v.groupBy(F.col("layer").alias("tenant_id")).agg(F.count("*").alias("violation_count")).withColumn("week_start", F.lit("2024-01-01"))
    old = fx.spark.createDataFrame([("api", "2024-01-01", 5), ("old", "2023-12-25", 3)], "tenant_id string, week_start string, violation_count long")
    return upsert(old, new.select("tenant_id", "week_start", "violation_count"), ["tenant_id", "week_start"])


@query("D30_weekly_digest", f"""
WITH t AS (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY bus_risk*(1 + incidents) DESC, id) AS nth, incidents, top_owner FROM fx_nodes)
SELECT layer AS tenant_id, count(*) FILTER (WHERE {NOBODY}) AS unowned, CAST(sum(incidents) AS BIGINT) AS incidents, count(*) AS files, string_agg(id, ',' ORDER BY nth) FILTER (WHERE nth <= 10) AS top_files FROM t GROUP BY 1""")
def _(fx):
    out = I.weekly_digest(fx.nodes.withColumnRenamed("layer", "tenant_id"))
    return out.withColumn("top_files", F.array_join("top_files", ","))


@query("E6_project_overview", """
SELECT src AS id, dst AS neighbour, relation FROM fx_edges WHERE src IN (SELECT id FROM fx_files ORDER BY id LIMIT 80) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst, relation) <= 5""")
def _(fx):
    return G.neighbours(fx.nodes.select("id").orderBy("id").limit(80), fx.edges, 5)


@query("E9_embedding_profile", """
WITH c AS (SELECT CASE WHEN file_key % 5 = 0 THEN 32 ELSE len(embedding) END AS dim, id AS file, vec_id // 3 AS created_at FROM embeddings JOIN fx_files ON file_key = vec_id // 2),
f AS (SELECT dim, file, max(created_at) AS last FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dim ORDER BY max(created_at) DESC, file) <= 5)
SELECT CAST(dim AS BIGINT) AS dim, n, dim <> 64 AS mismatch, newest FROM (SELECT dim, count(*) AS n FROM c GROUP BY 1) JOIN (SELECT dim, string_agg(file, ',' ORDER BY last DESC, file) AS newest FROM f GROUP BY 1) USING (dim)""")
def _(fx):
    short = F.when(F.col("file_key") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    c = fx.embeddings.join(fx.files, F.col("file_key") == F.floor(F.col("vec_id") / 2)).select(short.alias("embedding"), F.col("id").alias("file"), F.floor(F.col("vec_id") / 3).alias("created_at"))
    return I.embedding_profile(c, 64).withColumn("newest", F.array_join("newest", ","))


@query("B13_risk_band_filter", """
WITH b AS (SELECT id FROM fx_nodes WHERE bus_risk*100 < 40) SELECT src, dst, relation FROM fx_edges WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)""")
def _(fx):
    band = fx.nodes.where(X.risk_filter_band(F.col("bus_risk") * 100) == "low").select("id")
    return fx.edges.join(band.withColumnRenamed("id", "src"), "src", "left_semi").join(band.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query("X4_recompute_architecture", f"""
SELECT a.layer || '→' || b.layer AS violation_rule, count(*) AS n FROM fx_edges e JOIN fx_nodes a ON e.src = a.id JOIN fx_nodes b ON e.dst = b.id
JOIN {RULE_SQL} ON r.layer = a.layer AND r.banned = b.layer WHERE relation = 'DEPENDS_ON' GROUP BY 1""")
def _(fx):
    r = [(1, "api", ["api/**"]), (2, "service", ["services/**"]), (3, "data", ["models/**"]), (4, "ui", ["components/**"]), (5, "util", ["utils/**"]), (6, "other", ["*"])]
    nodes = I.layer_assign(fx.files.select("id"), r)
    return I.architecture_violations(fx.edges, nodes, rules(fx)).groupBy("violation_rule").agg(F.count("*").alias("n"))
