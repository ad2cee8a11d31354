"""Dense search among buckets of random projections; ``retrieval.dense_search`` is the exact one."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.retrieval import top_k
from cairn.sources.tables import Stages

#: Chunks that a bucket holds on average.
BUCKET = 512
#: Vectors to which the number of probes is fitted, and those among them that ask.
SAMPLE, ASKING = 4_096, 128


@lru_cache(maxsize=8)
def _planes(length: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng((5, length)).standard_normal((length, tables * bits))


def _codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The signs of each row's projections in each table, as one number."""
    signs = (x @ _planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def probes_needed(x: np.ndarray, k: int, tables: int, bits: int, recall: float) -> int:
    """The fewest flipped signs a table at which ``recall`` of the true neighbours in a sample share a bucket."""
    asking = x[:ASKING]
    score = asking @ x.T
    score[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    codes = _codes(x, tables, bits)
    apart = np.bitwise_count(codes[: len(asking), None, :] ^ codes[near]).min(axis=2)
    return next((f for f in range(bits) if (apart <= f).mean() >= recall), bits)


def dense_search_indexed(queries: DataFrame, chunks: DataFrame, k: int, stages: Stages, tables: int = 4, recall: float = 0.95, tile: int = 4_096) -> DataFrame:
    """(query_id, id, score, rank): the nearest chunks (id, embedding) found for queries (query_id, vector).

    Chunks are dealt to a bucket of each table, by the signs of random projections; buckets keep their size as the
    chunks grow. A query looks in its bucket and in those some signs away, as many as find a ``recall`` share of the
    true neighbours in a sample of SAMPLE chunks: few where vectors are clustered, most buckets where they have no
    structure. Queries and chunks meet in tiles of at most about ``tile`` chunks of a bucket and a block of queries, and
    only the ``k`` best of a query leave a tile, with the exact cosine. No query goes to the driver. Vectors that are
    null, empty or zero never match, nor do vectors of different length. Ids are whole numbers.
    """
    sound = lambda c: (F.size(c) > 0) & F.exists(c, lambda x: x != 0)
    c = chunks.select("id", F.col("embedding").cast("array<double>").alias("x")).where(sound("x")).withColumn("length", F.size("x"))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("x")).where(sound("x")).withColumn("length", F.size("x"))
    n = c.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, n / BUCKET)))))
    sample = c.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x", "length").toPandas()
    flips = max((probes_needed(_unit(s["x"]), k, tables, bits, recall) for _, s in sample.groupby("length") if len(s) > k), default=bits)
    masks = np.array([sum(1 << b for b in at) for f in range(flips + 1) for at in combinations(range(bits), f)], np.int64)

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        for _, part in vectors.groupby(vectors.map(len)):
            out.loc[part.index] = pd.Series(list(_codes(_unit(part), tables, bits)), index=part.index)
        return out

    c = stages.keep(c.select("id", "x", "length", F.posexplode(codes("x")).alias("table", "code")))
    key = ["length", "table", "code"]
    sizes = c.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # a row per bucket
    probes = F.transform(F.array(*[F.lit(int(m)) for m in masks]), lambda m: F.col("base").bitwiseXOR(m))
    q = q.select("query_id", "x", "length", F.posexplode(codes("x")).alias("table", "base"))
    q = q.select("query_id", "x", "length", "table", F.explode(probes).alias("code"))
    # a bucket is cut in parts, and its queries in as many blocks as make tiles of this size
    asked = q.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    met = stages.keep(sizes.join(asked, key))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    q = q.join(met, key).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", numbers("parts"))
    c = c.join(met, key).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", numbers("blocks"))

    def best(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        ids = c["id"].to_numpy()
        score = np.round(_unit(q["x"]) @ _unit(c["x"]).T, 9)
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        rows = np.arange(len(q))[:, None]
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), order.shape[1]), "id": ids[order].ravel(), "score": score[rows, order].ravel()})

    tiles = [*key, "part", "block"]
    found = q.select(*tiles, "query_id", "x").groupBy(*tiles).cogroup(c.select(*tiles, "id", "x").groupBy(*tiles)).applyInPandas(best, "query_id long, id long, score double")
    # several tables find the same pair
    return top_k(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k, F.desc("score"), F.col("id"))
