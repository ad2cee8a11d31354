"""Merkle manifest of a dataset: digests rolled up over the digits of ranks, and a proof for every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Workspace, ascii_lower

#: Children of a node, and levels that are nested in one row: a block holds FAN ** LEVELS nodes at most.
FAN, LEVELS = 8, 3


def encoded(*values: Column) -> Column:
    """Values one after another: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_digest(*values: Column) -> Column:
    return F.sha2(encoded(*values), 256)


def ranked(rows: DataFrame, tree: str, order: list[Column], work: Workspace, name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in the rows' ``tree`` and its number of rows ``n``.

    Rows are dealt in ranges over tree and order, however many a tree has, sorted and numbered where they lie. What
    is added to a number comes from counts per tree and partition: one row for each partition, and for each tree.
    Equal rows are told apart by where they were read.
    """
    by = [F.col(tree).asc_nulls_first(), *order, F.col("__read")]
    rows = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__read")
    rows = work.save(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), f"sorted-{name}")
    here = rows.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("count"))
    over = Window.partitionBy(tree)
    before = F.coalesce(F.sum("count").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = here.select(F.col(tree).alias("__tree"), F.col("part").alias("__part"), "first", before.alias("before"), F.sum("count").over(over).alias("n"))
    met = rows.join(here, (F.col("part") == F.col("__part")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return met.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("__tree", "__part", "first", "before", "at", "part")


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with FAN ** h >= n. Counted on the base-FAN digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, FAN))).cast("int")


def _blocks(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes (tree, height, index, digest, kept) of ``level`` -> blocks LEVELS above, with their nodes nested in ``kids``.

    The digits of a node's place in its block are grouped away one after another, the last first, and each child becomes
    a struct in its parent's array. Above a tree's height a node is its only child's equal. One shuffle, by block: groups
    by more digits lie in the same partition already.
    """
    digits = [f"d{k}" for k in range(LEVELS)]
    tree = ["tree", "height", "block"]
    place = [F.pmod(F.floor(F.col("index") / FAN**k), F.lit(FAN)).cast("int").alias(d) for k, d in enumerate(digits)]
    rows = nodes.select("tree", "height", F.floor(F.col("index") / FAN**LEVELS).alias("block"), *place, F.struct("digest", "kept").alias("node"))
    rows = rows.repartition(*tree)
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(digit, "node")))
        rows = rows.groupBy(*tree, *digits[k + 1 :]).agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
        below = F.col("kids.digest")
        digest = F.when(F.lit(level + k) < F.col("height"), F.sha2(F.array_join(below, ""), 256)).otherwise(below[0])
        rows = rows.select(*tree, *digits[k + 1 :], F.struct(digest.alias("digest"), "kids").alias("node"))
    return rows.select("tree", "height", F.col("block").alias("index"), "node.digest", "node.kids")


def _leaves(kids: Column, level: int, k: int, above: Column) -> Column:
    """The nodes nested below ``kids``, each with its siblings (left, right) level by level, and those ``above`` after."""

    def sides(i: Column) -> Column:
        digests = kids["digest"]
        beside = F.struct(F.array_join(F.slice(digests, 1, i), "").alias("left"), F.array_join(F.slice(digests, i + 2, FAN), "").alias("right"))
        return F.concat(F.when(F.lit(level + k) < F.col("height"), F.array(beside)).otherwise(F.array()), above)

    if k == 0:
        return F.transform(kids, lambda x, i: F.struct(x["kept"].alias("kept"), sides(i).alias("path")))
    return F.flatten(F.transform(kids, lambda x, i: _leaves(x["kids"], level, k - 1, sides(i))))


def _proofs(nodes: DataFrame, height: int, work: Workspace, name: str, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tree, kept, path, top) for every node (tree, height, index, digest, kept): the siblings on its way up, and what
    ``above`` says of its tree: it takes (tree, digest) of the trees' roots and gives (tree, path, top) for each.

    Blocks are rolled up round by round until each tree is one block; their paths then come down round by round. A
    block meets the path above it in a group of two rows, and hands it on to the nodes nested in it by an explode.
    """
    rounds = []
    while True:
        level = LEVELS * len(rounds)
        rounds.append(work.save(_blocks(nodes, level), f"{name}-{level}"))
        if level + LEVELS >= height:
            break
        nodes = rounds[-1].select("tree", "height", "index", "digest", F.lit(None).cast("int").alias("kept"))
    paths = above(rounds[-1].select("tree", "digest")).withColumn("index", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        both = rounds[k].select("tree", "index", "height", "kids").unionByName(paths.select("tree", "index", "path", "top"), allowMissingColumns=True)
        both = both.groupBy("tree", "index").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "kids", "path", "top")])
        found = both.select("tree", "index", "top", F.posexplode(_leaves(F.col("kids"), LEVELS * k, LEVELS - 1, F.col("path"))).alias("at", "x"))
        paths = found.select("tree", (F.col("index") * FAN**LEVELS + F.col("at")).alias("index"), "x.path", "x.kept", "top")
        if k:
            paths = work.save(paths, f"{name}-paths-{k}")
    return paths.select("tree", "kept", "path", "top")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), presented: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, presented, path, subroot, root.

    leaf is the SHA-256 of the ``fields``, each by ``encoded``. Leaves of one group ascend by id (null first; of several
    by digest) and are rolled up in eights to subroot; subroots, by group (null first, then by bytes), likewise to root.
    Any last run may be short, a single node that remains is not hashed again. path holds the siblings (left, right:
    digests one after another) of each level from the leaf through the subroot to the root; both are empty where a run has
    one node. ``presented`` gives columns to put in place of fields in the digest of the same name, for ``verified``.

    Ranks come from sorted ranges, so a group of any share of the rows is spread over all tasks; blocks hold at most
    512 nodes. No text is shuffled, only digests. Equal rows have equal leaves side by side. An empty table gives no
    rows; columns beside ``fields``, the id and the group are ignored.
    """
    work = Workspace(docs.sparkSession, "manifest")
    own = [F.col(c) for c in fields]
    seen = [(presented or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(F.col(group_col).alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*own).alias("digest"), leaf_digest(*seen).alias("presented"))
    leaves = ranked(work.save(leaves, "leaves"), "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], work, "leaves")
    kept = F.struct("doc_id", F.col("digest").alias("leaf"), "presented").alias("kept")
    leaves = work.save(leaves.select("tree", _height(F.col("n")).alias("height"), F.col("rank").alias("index"), "digest", kept), "ranked")

    def top(subroots: DataFrame) -> DataFrame:
        subroots = work.save(subroots.withColumn("all", F.lit(0)), "subroots")
        rows = ranked(subroots, "all", [F.col("tree").asc_nulls_first()], work, "subroots")
        rows = work.save(rows.select(F.col("all").alias("tree"), _height(F.col("n")).alias("height"), F.col("rank").alias("index"), "digest", F.struct("tree", "digest").alias("kept")), "ranked-subroots")
        told = _proofs(rows, _most(rows), work, "top", lambda root: root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("top")))
        return told.select(F.col("kept.tree").alias("tree"), "path", F.struct(F.col("kept.digest").alias("subroot"), F.col("top").alias("root")).alias("top"))

    return _proofs(leaves, _most(leaves), work, "blocks", top).select("kept.*", "path", "top.*")


def _most(rows: DataFrame) -> int:
    return rows.agg(F.max("height")).first()[0] or 0


def verified(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with proof_sha256 (of all siblings one after another), folded_root and verified.

    folded_root is what the presented leaf and the siblings give, level by level; verified says whether it is the root.
    """
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("presented"), lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))
    rows = rows.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def describe(docs: DataFrame) -> DataFrame:
    """Digest rows of the manifest of documents, verified after every third document lost the capitals of its text."""
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, presented={"text": F.when(third, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    return verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
