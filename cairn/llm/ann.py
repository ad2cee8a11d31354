"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Workspace


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, and not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix: after it, every run of dimensions is a fair sample of a distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def train_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of ``lists`` cells by k-means over the (bounded) sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        empty = np.bincount(home, minlength=len(centres)) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """The fewest nearest lists that hold a ``recall`` share of the k true neighbours of some sampled vectors.

    Neighbours are sought in the sample. In the whole table they are closer, so what it needs is less rather than more.
    """
    home = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
    q = sample[:: max(1, len(sample) // asked)][:asked]
    near = q @ sample.T
    near[np.arange(len(q)), (np.arange(len(q)) * max(1, len(sample) // asked))] = -np.inf  # itself
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    places = np.sort(np.take_along_axis(place, home[true], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def adaptive_scan(queries: np.ndarray, limits: np.ndarray, rows: np.ndarray, k: int, step: int, epsilon: float, turn: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query positions, row positions, squared distances): for each query the k nearest rows that the tests let through.

    ``limits`` holds the squared distance that each query already has k rows within (infinite: none yet); it falls to
    the k-th distance found as rows are taken, ``turn`` at a time. Dimensions come in blocks of ``step`` columns. With
    d of D seen, a row is abandoned for a query when its partial distance is over limit * d / D * (1 + epsilon /
    sqrt(d))^2: the hypothesis that its distance is within the limit is rejected. What survives all blocks has its
    exact distance.
    """
    dim, head = rows.shape[1], slice(0, step)
    best_q, best_r, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    limits = limits.copy()
    first_q = (queries[:, head] ** 2).sum(1)[:, None]
    for start in range(0, len(rows), turn):
        part = rows[start : start + turn]
        first = first_q + (part[:, head] ** 2).sum(1)[None, :] - 2 * queries[:, head] @ part[:, head].T
        seen = min(step, dim)
        at_q, at_r = np.nonzero(first <= _bound(limits, seen, dim, epsilon)[:, None])
        partial = first[at_q, at_r]
        while seen < dim and len(at_q):
            cut = slice(seen, seen + step)
            partial = partial + ((queries[at_q, cut] - part[at_r, cut]) ** 2).sum(axis=1)
            seen = min(dim, seen + step)
            keep = partial <= _bound(limits, seen, dim, epsilon)[at_q]
            at_q, at_r, partial = at_q[keep], at_r[keep], partial[keep]
        best_q, best_r, best_d = np.concatenate([best_q, at_q]), np.concatenate([best_r, at_r + start]), np.concatenate([best_d, partial])
        order = np.lexsort((best_r, best_d, best_q))
        best_q, best_r, best_d = best_q[order], best_r[order], best_d[order]
        nth = np.arange(len(best_q)) - np.searchsorted(best_q, best_q, side="left")
        last = nth == k - 1
        limits[best_q[last]] = np.minimum(limits[best_q[last]], best_d[last])
        best_q, best_r, best_d = best_q[nth < k], best_r[nth < k], best_d[nth < k]
    return best_q, best_r, best_d


def _bound(limit: np.ndarray, seen: int, dim: int, epsilon: float) -> np.ndarray:
    if seen == dim:
        return limit * (1 + 1e-9)
    return limit * seen / dim * (1 + epsilon / math.sqrt(seen)) ** 2


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 16_384,
    max_lists: int = 2048,
    recall: float = 0.97,
    least_probes: int = 16,
    first_share: float = 0.05,
    step: int = 16,
    epsilon: float = 2.1,
    block_rows: int = 4096,
    block_queries: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every row of ``vectors`` that ``queries`` marks.

    Nearness is the cosine, computed in double precision from the original vectors; ties go to the smaller id; rows of
    the query's own id are no candidates. Vectors that are null, empty, zero or not finite take no part, and only
    vectors of one length are compared with each other. A table without usable vectors gives no rows; repeated rows
    count once; rows that share an id but not the vector each ask, and are found, by themselves, and as many more
    entries are kept for a query as an asking id has further vectors at most; other columns are ignored.

    Equal vectors are one entry that stands for its k+1 smallest ids, which is all that any query can return of them,
    so a group of copies of any size costs as much as one. Entries are rotated, scaled to unit length and dealt to
    inverted lists; list centres come from at most ``sample_rows`` entries in the order of a hash, there are about the
    square root of the number of entries of them, ``max_lists`` at most, and they alone are broadcast. Distinct query
    vectors go to as many nearest lists as hold a ``recall`` share of true neighbours in that sample (``least_probes``
    at least): few where vectors are clustered, over half of the lists where they have no structure at all.

    A list's entries and the queries sent to it are each cut in blocks, of about ``block_rows`` and ``block_queries``;
    a task scans one block of entries for one of queries by ``adaptive_scan``, so no list is gathered and a vector is
    sent once for each block that it meets. The nearest ``first_share`` of the probed lists come first; their k+1-th
    distance is the limit that candidates in all others start from. The best k+1 entries of a query are expanded to ids.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # equal vectors: one entry with a number of its own and its k+1 smallest ids
    key = F.xxhash64("v")
    nth = F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))
    firsts = rows.select(key.alias("key"), "v", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = firsts.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = work.save(entries.select(F.monotonically_increasing_id().alias("entry"), F.size("v").alias("dim"), "key", "v", "ids"), "entries")
    asking = rows.where("asks").select(key.alias("key"), "v", F.col("id").alias("query_id")).distinct()
    asking = work.save(asking.join(entries.select("key", "v", "entry", "dim"), ["key", "v"]).select("query_id", "entry", "dim"), "asking")

    # an id's own vectors may be the nearest of all, so as many more entries are looked for as one id has at most
    own = work.save(rows.where("asks").select(F.col("id").alias("query_id")).distinct().join(rows.select("id", key.alias("key"), "v").distinct(), F.col("query_id") == F.col("id")).groupBy("query_id").count(), "own")
    more = (own.agg(F.max("count")).first()[0] or 1) - 1

    found = None
    for r in entries.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row per vector length
        part = f"dim = {r['dim']}"
        one = _search(entries.where(part), asking.where(part), r["dim"], r["n"], work, k + more, sample_rows, max_lists, recall, least_probes, first_share, step, epsilon, block_rows, block_queries)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double")

    # exact cosines of what was found, then the ids that the entries stand for
    q, c = entries.select(F.col("entry").alias("asked"), F.col("v").alias("qv")), entries.select("entry", F.col("v").alias("cv"), "ids")
    pairs = found.join(q, "asked").join(c, "entry").withColumns({"qv": _scaled(F.col("qv")), "cv": _scaled(F.col("cv"))})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("qv"), F.col("cv")) / (F.sqrt(dot(F.col("qv"), F.col("qv"))) * F.sqrt(dot(F.col("cv"), F.col("cv"))))
    pairs = work.save(pairs.select("asked", score.alias("score"), "ids"), "pairs")
    merged = pairs.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k+1 entries at most, where ids have one vector
    hits = asking.join(merged, asking.entry == merged.asked).select("query_id", "asked", F.explode("found").alias("f"))
    hits = hits.select("query_id", "asked", "f.score", F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scaled(v: Column) -> Column:
    """A vector times a power of two (which rounds nothing) that brings its largest component near 1."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    factor = F.pow(F.lit(2.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double")))
    return F.transform(v, lambda x: x * factor)


def _search(entries: DataFrame, asking: DataFrame, dim: int, n: int, work: Workspace, k: int, sample_rows: int, max_lists: int, recall: float, least_probes: int, first_share: float, step: int, epsilon: float, block_rows: int, block_queries: int) -> DataFrame:
    """(asked, entry): the k+1 nearest entries found for every asking one, among ``entries`` of one length."""
    spark = entries.sparkSession
    save = lambda df, name: work.save(df, f"{name}-{dim}")
    sample = entries.select("v").orderBy(F.xxhash64("v"), "entry").limit(sample_rows).toPandas()["v"]
    turn = rotation(dim)
    sample = _unit(np.array(sample.tolist())) @ turn
    centres = train_lists(sample, max(1, min(max_lists, math.isqrt(n))))
    probes = min(len(centres), max(least_probes, probes_needed(sample, centres, k, recall)))
    sent = spark.sparkContext.broadcast((turn, centres))

    def deal(take: int):
        def run(batches):
            turn, centres = sent.value
            for b in batches:
                x = _unit(np.array(b["v"].tolist())) @ turn
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :take]
                yield pd.DataFrame({"entry": np.repeat(b["entry"].to_numpy(), take), "list": near.ravel().astype(np.int32), "nth": np.tile(np.arange(take, dtype=np.int32), len(b)), "x": [r for r in x for _ in range(take)]})

        return run

    dealt = "entry long, list int, nth int, x array<double>"
    indexed = save(entries.select("entry", "v").mapInPandas(deal(1), dealt), "lists").drop("nth")
    asked = asking.select("entry").distinct().join(entries, "entry").select("entry", "v").mapInPandas(deal(probes), dealt)
    asked = save(asked, "asked")

    def blocks_of(df: DataFrame, size: int, name: str) -> DataFrame:
        """(list, ``name``): blocks per list, a row per list, max_lists at most."""
        return F.broadcast(save(df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name)), name))

    numbers = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    block = lambda name: F.pmod(F.xxhash64("entry"), F.col(name)).cast("int")
    row_blocks = blocks_of(indexed, block_rows, "row_blocks")

    def scan(key, q, x):
        at_q, at_r, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(q) and len(x):
            x = x.sort_values("entry", ignore_index=True)
            at_q, at_r, d = adaptive_scan(np.array(q["x"].tolist()), q["d"].to_numpy(), np.array(x["x"].tolist()), k + 1, step, epsilon)
        return pd.DataFrame({"asked": q["entry"].to_numpy()[at_q], "entry": x["entry"].to_numpy()[at_r], "d": d}).astype({"asked": "int64", "entry": "int64", "d": "float64"})

    def probe(which: DataFrame, limits: Column, name: str) -> DataFrame:
        query_blocks = blocks_of(which, block_queries, f"query_blocks_{name}").withColumnRenamed(f"query_blocks_{name}", "query_blocks")
        to = which.withColumn("d", limits).join(query_blocks, "list").join(row_blocks, "list")
        to = to.select("entry", "x", "d", "list", block("query_blocks").alias("query_block"), F.explode(numbers("row_blocks")).alias("row_block"))
        of = indexed.join(row_blocks, "list").join(query_blocks, "list")
        of = of.select("entry", "x", "list", block("row_blocks").alias("row_block"), F.explode(numbers("query_blocks")).alias("query_block"))
        tile = ["list", "row_block", "query_block"]
        return to.groupBy(*tile).cogroup(of.groupBy(*tile)).applyInPandas(scan, "asked long, entry long, d double")

    first = max(1, math.ceil(first_share * probes))
    best = F.row_number().over(Window.partitionBy("asked").orderBy("d", "entry"))
    near = save(probe(asked.where(F.col("nth") < first), F.lit(math.inf), "first").withColumn("nth", best).where(F.col("nth") <= k + 1), "near")
    limits = near.where(F.col("nth") == k + 1).select(F.col("asked").alias("of"), F.col("d").alias("limit"))
    rest = asked.where(F.col("nth") >= first).join(limits, F.col("entry") == F.col("of"), "left")
    found = near.drop("nth").unionByName(probe(rest, F.coalesce("limit", F.lit(math.inf)), "rest"))
    return save(found.withColumn("nth", best).where(F.col("nth") <= k + 1).select("asked", "entry"), "found")
