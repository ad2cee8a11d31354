"""Queries on history and ownership."""

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import history as H
from cairn.plans.registry import query

AS_OF = "(SELECT max(o_orderdate) AS as_of FROM orders)"


@query("A2_files_by_extension", "SELECT '.py' AS ext, count(*) AS n FROM fx_files")
def _(fx):
    return fx.files.groupBy(X.extension(F.col("id")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(10)


@query("A4_commit_files", "SELECT c.hash, f.file, c.author, c.date, c.branch FROM fx_commits c JOIN fx_commit_files f ON c.hash = f.hash")
def _(fx):
    files = fx.commit_files.groupBy("hash").agg(F.collect_list("file").alias("files"))
    # two branches carry the same commit; the second is dropped
    rows = fx.commits.join(files, "hash")
    return H.commit_files(rows.unionByName(rows.withColumn("branch", F.lit("zz"))), ("F", "O", "P"))


@query("D1_file_commit_stats", f"""
SELECT file, count(DISTINCT hash) AS commit_count, count(DISTINCT author) AS n_authors, count(DISTINCT branch) AS n_branches,
 CAST(count(*) FILTER (WHERE date >= CAST(CAST(as_of AS DATE) - 180 AS TIMESTAMP)) AS BIGINT) AS recent,
 min(date) AS created_at, max(date) AS last_modified, arg_max(author, (date, hash)) AS last_author
FROM fx_touches, {AS_OF} GROUP BY file""")
def _(fx):
    return H.file_commit_stats(fx.touches, fx.as_of)


@query("D2_bus_factor", "SELECT file, floor((200*n + total) / (2*total)) / 100 AS bus_risk_score, author AS top_owner FROM fx_authors WHERE nth = 1")
def _(fx):
    return H.bus_factor(fx.touches)


@query("D3_volatility", f"""
SELECT file, least(100, 5*count(*) FILTER (WHERE date >= CAST(CAST(as_of AS DATE) - 180 AS TIMESTAMP))) / 100 AS volatility_score
FROM fx_touches, {AS_OF} GROUP BY file""")
def _(fx):
    return H.file_commit_stats(fx.touches, fx.as_of).select("file", H.volatility(F.col("recent")).alias("volatility_score"))


@query("D4_churn", f"""
WITH s AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE date >= CAST(CAST(as_of AS DATE) - 180 AS TIMESTAMP)) AS recent
 FROM fx_touches, {AS_OF} GROUP BY file)
SELECT file, CASE WHEN total >= 50 THEN least(1000, 700 + 15*recent) / 1000 ELSE least(1000, 35*recent + 6*total) / 1000 END AS churn_score FROM s""")
def _(fx):
    return H.file_commit_stats(fx.touches, fx.as_of).select("file", H.churn(F.col("recent"), F.col("commit_count")).alias("churn_score"))


@query("D5_expert_edges", "SELECT top_owner AS person, id AS file, commit_count AS weight FROM fx_nodes WHERE top_owner IS NOT NULL AND top_owner NOT IN ('', 'None', 'Unknown')")
def _(fx):
    return H.expert_edges(fx.nodes)


@query("D6_feature_map", """
WITH named AS (SELECT hash, CASE WHEN regexp_matches(msg, '^(feat|feature|fix|chore|refactor)(\\([^)]*\\))?: ')
  THEN trim(regexp_replace(msg, '^[a-z]+(\\([^)]*\\))?:', '')) ELSE left(msg, 120) END AS f FROM fx_commits)
SELECT lower(f) AS feature_id, file, min(f) AS feature_name FROM named JOIN fx_commit_files USING (hash) GROUP BY 1, 2""")
def _(fx):
    return H.feature_map(fx.commits, fx.commit_files)


@query("D14_bus_factor_trend", f"""
WITH p AS (SELECT date_trunc('month', date) AS bucket, author, count(*) AS n FROM fx_commits, {AS_OF}
 WHERE date >= CAST(CAST(as_of AS DATE) - 56 AS TIMESTAMP) GROUP BY ALL)
SELECT CAST(bucket AS TIMESTAMP) AS bucket, CAST(sum(n) AS BIGINT) AS commits, floor((2000*max(n) + sum(n)) / (2*sum(n))) / 1000 AS top_share
FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def _(fx):
    return H.bus_factor_trend(fx.commits, fx.as_of)


@query("D15_throughput", f"""
SELECT CAST(date_trunc('week', date) AS TIMESTAMP) AS bucket, count(*) AS commits FROM fx_commits, {AS_OF}
WHERE date >= CAST(CAST(as_of AS DATE) - 56 AS TIMESTAMP) GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
def _(fx):
    return H.throughput(fx.commits, fx.as_of, grain="week")


@query("D16_active_zones", f"""
SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS zone, count(*) AS touches,
 CASE WHEN count(*) > 10 THEN 'High' ELSE 'Normal' END AS activity
FROM fx_touches, {AS_OF} WHERE date >= CAST(CAST(as_of AS DATE) - 30 AS TIMESTAMP)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(fx):
    return H.active_zones(fx.touches, fx.as_of)


BLAME = """
SELECT DISTINCT f.id AS file, CAST(l_suppkey % 40 + 1 AS INT) AS line_no, n_name AS author, lower(replace(n_name, ' ', '.')) || '@x.org' AS email
FROM (SELECT l_partkey, l_suppkey, max(l_orderkey) AS l_orderkey FROM {lineitem} GROUP BY 1, 2)
JOIN {fx_files} f ON l_partkey = f.file_key JOIN {nation} ON l_orderkey % 25 = n_nationkey"""


def _blame(fx):
    return fx.spark.sql(BLAME, lineitem=fx.lineitem, fx_files=fx.files, nation=fx.nation)


BLAME_SQL = BLAME.replace("{", "").replace("}", "")


@query("C8_function_ownership", f"""
WITH b AS ({BLAME_SQL}),
s AS (SELECT id AS file, 'f' || k AS symbol, CAST(k*8 + 1 AS INT) AS start_line, CAST(k*8 + 8 AS INT) AS end_line FROM fx_files, range(6) r(k)),
r AS (SELECT s.*, b.line_no, b.author, b.email FROM s LEFT JOIN b ON s.file = b.file AND line_no BETWEEN start_line AND end_line),
t AS (SELECT file, symbol, start_line, end_line, count(line_no) AS lines, count(DISTINCT author) AS n_authors FROM r GROUP BY 1, 2, 3, 4),
a AS (SELECT file, symbol, author, count(line_no) AS n, row_number() OVER (PARTITION BY file, symbol ORDER BY count(line_no) DESC, author) AS nth FROM r GROUP BY file, symbol, author),
e AS (SELECT file, symbol, email, count(line_no) AS n, row_number() OVER (PARTITION BY file, symbol ORDER BY count(line_no) DESC, email) AS nth FROM r GROUP BY file, symbol, email)
SELECT t.file, t.symbol, start_line, end_line, lines, coalesce(a.author, 'Unknown') AS last_author, coalesce(e.email, 'unknown@unknown.com') AS owner_email,
 CASE WHEN lines > 0 THEN floor((2000*e.n + lines) / (2*lines)) / 1000 ELSE 0e0 END AS owner_confidence, n_authors
FROM t JOIN a ON t.file = a.file AND t.symbol = a.symbol AND a.nth = 1 JOIN e ON t.file = e.file AND t.symbol = e.symbol AND e.nth = 1""")
def _(fx):
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    s = fx.files.select(F.col("id").alias("file"), k.alias("k"))
    s = s.select("file", F.concat(F.lit("f"), F.col("k").cast("string")).alias("symbol"), (F.col("k") * 8 + 1).alias("start_line"), (F.col("k") * 8 + 8).alias("end_line"))
    return H.line_owners(s, _blame(fx))


@query("C9_file_owner", f"""
WITH b AS ({BLAME_SQL}), e AS (SELECT file, email, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, email) AS nth, sum(count(*)) OVER (PARTITION BY file) AS lines FROM b GROUP BY file, email)
SELECT file, CAST(lines AS BIGINT) AS lines, email AS owner_email, floor((2000*n + lines) / (2*lines)) / 1000 AS owner_confidence FROM e WHERE nth = 1""")
def _(fx):
    return H.file_owner(_blame(fx))
