"""Pushes into the stored graph: micro-batches merged as versions, so that a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import upsert, upsert_edges
from cairn.sources.versions import Versions

EDGES = "src string, dst string, relation string, alive boolean"
#: (path, head) of changed files -> their nodes (id, ...) and edges (src, dst, relation).
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class CodeStore:
    """Nodes and edges of a repository below a folder, as what each batch changed in them.

    Of a node or an edge the row of the last batch counts; rows that say so take it away. So a batch writes no more
    than it changes, whatever the size of the graph. ``columns`` is the schema of the nodes, with ``id``; a node
    belongs to the file before ``::`` in its id. ``keep_old`` are columns that a null does not overwrite.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, keep_old: tuple[str, ...] = ()):
        self.spark, self.columns, self.keep_old, self.store = spark, columns, keep_old, Versions(spark, path)

    def _newest(self, table: str, schema: str, keys: list[str]) -> DataFrame:
        rows = self.store.read(table, schema)
        values = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "v").alias("x"))
        return newest.select(*keys, "x.*").where("alive").drop("alive", "v")

    def nodes(self) -> DataFrame:
        return self._newest("nodes", f"{self.columns}, alive boolean", ["id"])

    def edges(self) -> DataFrame:
        return self._newest("edges", EDGES, ["src", "dst", "relation"])

    def apply(self, batch: int, files: DataFrame, extract: Extract) -> bool:
        """Merges files (path, action, head), action ``changed`` or ``removed``. False if the batch is there already.

        Changed files are extracted; their nodes are merged by id (A5), nodes that they no longer have go. Edges that
        leave a file of the batch are replaced by what was extracted, as far as both ends are nodes then (A6); those
        that touch a node which went go with it. Batches come in ascending order.
        """
        if self.store.holds(batch):
            return False
        v = 2 * batch
        found, links = extract(files.where("action = 'changed'").select("path", "head"))
        for name, df in (("files", files.select("path").distinct()), ("found", found), ("links", links.select("src", "dst", "relation"))):
            self.store.put(v, name, df)
        own = {name: self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{name}/v={v}") for name, df in (("files", files.select("path")), ("found", found), ("links", links.select("src", "dst", "relation")))}
        paths, found, links = own["files"], own["found"], own["links"]
        file_of = lambda c: F.substring_index(c, "::", 1)

        now, old = self.nodes(), self.edges()
        before = now.join(found.select("id").distinct(), "id", "left_semi")
        merged = upsert(before, found.select(*before.columns), ["id"], self.keep_old).withColumn("alive", F.lit(True))
        gone = now.join(paths, file_of("id") == F.col("path"), "left_semi").join(found.select("id"), "id", "left_anti")
        self.store.put(v, "nodes", merged.unionByName(gone.withColumn("alive", F.lit(False))))

        gone = gone.select("id")
        after = now.select("id").join(gone, "id", "left_anti").unionByName(found.select("id")).distinct()
        fresh = upsert_edges(after, links.limit(0), links)
        leave = old.join(paths, file_of("src") == F.col("path"), "left_semi")
        cut = old.join(gone, F.col("dst") == F.col("id"), "left_semi")
        dead = leave.unionByName(cut).distinct().join(fresh, ["src", "dst", "relation"], "left_anti")
        self.store.put(v, "edges", fresh.withColumn("alive", F.lit(True)).unionByName(dead.withColumn("alive", F.lit(False))))
        self.store.finish(v)
        for name in own:
            self.store.drop_table(v, name)
        return True

    def merge(self) -> None:
        """All batches as one: what is passed over, and what went, is dropped."""
        done = self.store.done()
        if len(done) < 2:
            return
        into = done[-1] // 2 * 2 + 1
        for table, rows in (("nodes", self.nodes()), ("edges", self.edges())):
            self.store.put(into, table, rows.withColumn("alive", F.lit(True)))
        self.store.finish(into)
        for v in done:
            self.store.drop(v, "nodes", "edges")


def file_actions(pushes: DataFrame) -> DataFrame:
    """(path, action, head): the last word on each file in pushes (after, ts, commits).

    Later pushes win, of one time the greater head; in a push later commits; in a commit removals.
    """
    c = pushes.select("ts", "after", F.posexplode("commits").alias("n", "c"))

    def said(kind: str, order: int, action: str):
        return F.transform(F.coalesce(F.col(f"c.{kind}"), F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), F.lit(order).alias("order"), F.lit(action).alias("action")))

    each = F.explode(F.concat(said("added", 0, "changed"), said("modified", 0, "changed"), said("removed", 1, "removed"))).alias("x")
    rows = c.select("ts", "after", "n", each)
    last = F.max_by(F.struct(F.col("x.action").alias("action"), F.col("after").alias("head")), F.struct("ts", "after", "n", "x.order"))
    return rows.groupBy(F.col("x.path").alias("path")).agg(last.alias("last")).select("path", "last.*")


def ingest(pushes: DataFrame, store: CodeStore, extract: Extract, checkpoint: str, listing: Callable[[str], DataFrame] | None = None, branch: str = "main", most: int = 200, delay: str = "1 day"):
    """Starts the merge of a stream of pushes (repo, ref, before, after, ts, commits) of one repository into ``store``.

    Pushes to the branch count once a head. A push without a previous head, without files, or with more than ``most`` of
    them takes its batch whole: ``listing`` of the newest head (path) says which files there are, all others go. The
    batch's number is the version, so a batch that Spark replays is passed over, and one that stopped on its way is done
    again. Runs over what is available and returns the query.
    """
    kept = pushes.where(F.col("ref") == f"refs/heads/{branch}").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo", "after"])

    def put(df: DataFrame, batch: int) -> None:
        if store.store.holds(batch):
            return
        store.store.put(2 * batch, "pushes", df)
        df = store.spark.read.schema(df.schema).parquet(f"{store.store.path}/pushes/v={2 * batch}")
        n = F.size(F.array_distinct(F.flatten(F.transform("commits", lambda c: F.concat(c["added"], c["modified"], c["removed"])))))
        whole = F.coalesce(F.col("before"), F.lit("")).rlike("^0*$") | (n == 0) | (n > most)
        files = file_actions(df)
        if listing is not None and df.where(whole).limit(1).count():
            head = df.agg(F.max_by("after", F.struct("ts", "after"))).first()[0]
            there = listing(head).select("path").distinct()
            files = there.select("path", F.lit("changed").alias("action"), F.lit(head).alias("head"))
            stored = store.nodes().select(F.substring_index("id", "::", 1).alias("path")).distinct()
            files = files.unionByName(stored.join(there, "path", "left_anti").select("path", F.lit("removed").alias("action"), F.lit(head).alias("head")))
        store.apply(batch, files, extract)
        store.store.drop_table(2 * batch, "pushes")

    return kept.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
