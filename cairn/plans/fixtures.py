"""Views that present the driver tables as files, commits, dependencies, nodes and chunks of a code base.

One text serves Spark SQL and DuckDB; {name} stands for a table or an earlier view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.matching import BROADCAST_ROWS
from cairn.sources.tables import Stages

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_files": """
SELECT p_partkey AS file_key,
 concat(CASE p_type WHEN 'STANDARD' THEN 'api' WHEN 'ECONOMY' THEN 'services' WHEN 'MEDIUM' THEN 'models'
                    WHEN 'LARGE' THEN 'components' WHEN 'SMALL' THEN 'utils' ELSE 'tests' END, '/',
  lower(replace(p_brand,'#','')), '/',
  CASE WHEN p_type = 'PROMO' THEN 'test_' ELSE '' END,
  CASE p_size % 10 WHEN 0 THEN 'auth_' WHEN 1 THEN 'schema_' WHEN 2 THEN 'core_' WHEN 3 THEN 'route_' ELSE '' END,
  replace(p_name,' ','_'), '_', CAST(p_partkey AS STRING), '.py') AS id,
 CASE WHEN p_type = 'PROMO' THEN true ELSE false END AS is_test_file,
 p_size AS size_class
FROM {part}""",
    "fx_commits": """
SELECT o_orderkey AS hash, n_name AS author, o_orderdate AS date,
 concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: ' WHEN '2-HIGH' THEN 'feat(core): '
        WHEN '3-MEDIUM' THEN 'refactor: ' ELSE '' END, 'update ', lower(c_mktsegment)) AS msg,
 o_orderstatus AS branch
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_commit_files": """
SELECT DISTINCT l_orderkey AS hash, f.id AS file FROM {lineitem} JOIN {fx_files} f ON l_partkey = f.file_key""",
    "fx_edges": """
SELECT DISTINCT s.id AS src, t.id AS dst,
  CASE WHEN s.is_test_file THEN 'COVERS' WHEN e.ln <= 2 THEN 'DEPENDS_ON'
       WHEN e.ln = 3 THEN 'CALLS' ELSE 'MAYBE_CALLS' END AS relation
FROM (SELECT l_partkey AS s_key, (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % n AS t_key, l_linenumber AS ln
      FROM {lineitem} CROSS JOIN (SELECT count(*) AS n FROM {part}) c
      WHERE l_returnflag = 'R' AND l_linenumber <= 4) e
JOIN {fx_files} s ON e.s_key = s.file_key JOIN {fx_files} t ON e.t_key = t.file_key
WHERE e.s_key <> e.t_key""",
    "fx_touches": """
SELECT cf.file, c.hash, c.author, c.date, c.branch FROM {fx_commit_files} cf JOIN {fx_commits} c ON cf.hash = c.hash""",
    "fx_authors": """
SELECT file, author, count(*) AS n, max(date) AS last,
  row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, max(date) DESC, author) AS nth,
  row_number() OVER (PARTITION BY file ORDER BY max(date) DESC, author) AS nth_last,
  sum(count(*)) OVER (PARTITION BY file) AS total
FROM {fx_touches} GROUP BY file, author""",
    "fx_outline": """
SELECT id, regexp_replace(id, '^.*/', '') AS name,
  CASE split_part(id, '/', 1) WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'models' THEN 'data'
       WHEN 'components' THEN 'ui' WHEN 'utils' THEN 'util' ELSE 'other' END AS layer
FROM {fx_files}""",
    "fx_nodes": """
SELECT f.id, regexp_replace(f.id, '^.*/', '') AS name, 'file' AS type, f.is_test_file,
  CASE split_part(f.id, '/', 1) WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'models' THEN 'data'
       WHEN 'components' THEN 'ui' WHEN 'utils' THEN 'util' ELSE 'other' END AS layer,
  CASE WHEN f.size_class = 7 THEN NULL ELSE a.author END AS top_owner,
  l.author AS last_author, coalesce(a.total, 0) AS commit_count,
  coalesce(a.n * 1e0 / a.total, 0e0) AS bus_risk,
  CASE WHEN coalesce(a.total, 0) >= 50 THEN 9e-1 WHEN coalesce(a.total, 0) > 0 THEN (a.total % 20) / 20e0 ELSE 0e0 END AS churn,
  CASE WHEN f.size_class % 9 = 0 THEN f.size_class % 4 ELSE 0 END AS incidents,
  CASE WHEN f.size_class % 10 = 3 THEN true ELSE false END AS api_route,
  CASE WHEN f.size_class = 50 THEN true ELSE false END AS infrastructure,
  CASE WHEN f.size_class % 10 = 0 THEN true ELSE false END AS sensitive
FROM {fx_files} f
LEFT JOIN (SELECT * FROM {fx_authors} WHERE nth = 1) a ON a.file = f.id
LEFT JOIN (SELECT * FROM {fx_authors} WHERE nth_last = 1) l ON l.file = f.id""",
}
#: split_part and regexp_replace read alike in both engines for the patterns above.


def with_views(sql: str) -> str:
    """DuckDB text in which the views are common table expressions. ``sql`` may bring its own WITH."""
    needed, todo = set(), re.findall(r"\bfx_\w+", sql)
    while todo:
        v = todo.pop()
        if v in VIEWS and v not in needed:
            needed.add(v)
            todo += re.findall(r"\{(fx_\w+)\}", VIEWS[v])
    head = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in VIEWS if v in needed]
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\s", sql)
    rest = sql[own.end() :] if own else sql
    if not head:
        return sql
    return "WITH RECURSIVE " + ",\n".join(head) + (",\n" if own else "\n") + rest


class Fixtures:
    """Driver tables and views of one folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._views = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        view = f"fx_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._views:
            text = VIEWS[view]
            used = {x: getattr(self, x.removeprefix("fx_")) for x in set(re.findall(r"\{(\w+)\}", text))}
            self._views[view] = self.spark.sql(text, **used)
        return self._views[view]

    @property
    def authors(self) -> DataFrame:
        """``fx_authors`` by numbers of commits and files: names of files come last, not with each of their commits."""
        if "fx_authors" not in self._views:
            key = "l_partkey"
            touched = self.lineitem.select("l_orderkey", key).where("l_orderkey is not null and l_partkey is not null").repartition("l_orderkey").distinct()
            rows = touched.join(self.commits.select("hash", "author", "date").hint("merge"), F.col("l_orderkey") == F.col("hash")).select(key, "author", "date")
            rows = rows.repartition(key).groupBy(key, "author").agg(F.count("*").alias("n"), F.max("date").alias("last"))
            of = Window.partitionBy(key)
            nth = F.row_number().over(of.orderBy(F.desc("n"), F.desc("last"), "author"))
            rows = rows.select("*", nth.alias("nth"), F.row_number().over(of.orderBy(F.desc("last"), "author")).alias("nth_last"), F.sum("n").over(of).alias("total"))
            names = self.files.select("file_key", F.col("id").alias("file")).repartition("file_key").distinct()
            rows = rows.join(names.hint("merge"), F.col(key) == F.col("file_key"))
            self._views["fx_authors"] = rows.select("file", "author", "n", "last", "nth", "nth_last", "total")
        return self._views["fx_authors"]

    @cached_property
    def stages(self) -> Stages:
        return Stages(self.spark)

    def written(self, name: str) -> DataFrame:
        """A view that is computed once and read by all that the query does with it."""
        if f"written {name}" not in self._views:
            self._views[f"written {name}"] = self._views[f"fx_{name}"] = self.stages.keep(getattr(self, name))
        return self._views[f"fx_{name}"]

    def merge_files(self) -> None:
        """Has many files merged with what they meet: Spark takes their names for smaller and broadcasts them every time."""
        if self.part.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            self._views["fx_files"] = self.files.hint("merge")

    @cached_property
    def as_of(self):
        """The end of history, as a one-row frame (as_of)."""
        return self.orders.selectExpr("max(o_orderdate) AS as_of")
