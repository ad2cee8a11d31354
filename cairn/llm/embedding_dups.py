"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cairn.llm.common import Workspace
from cairn.llm.components import connected_components

#: A pair at the very threshold shares a bucket in no table with this probability; a closer one with less.
MISS = 1e-5
#: Unrelated vectors that a bucket holds on average, and the fewest signs a bucket is made of.
BUCKET, LEAST_BITS = 256, 4
SEED = 12


def table_shape(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(signs per bucket, tables) for ``n`` vectors that are compared with one another.

    Buckets keep their average size as n grows, so signs grow with its logarithm, and tables with a small power of n
    (0.18 at a cosine of 0.93), as two vectors at the threshold agree in a sign with probability 1 - angle / pi.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) / BUCKET)))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


@lru_cache(maxsize=8)
def _hyperplanes(length: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng((SEED, length)).standard_normal((length, tables * bits))


def unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision; scaled first, so that no square overflows."""
    x = np.stack(vectors.to_list()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The signs against each table's hyperplanes as one number per row and table."""
    signs = (x @ _hyperplanes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _parts(link: np.ndarray) -> np.ndarray:
    """The first member of the component of each row of a symmetric table of links."""
    first = np.arange(len(link))
    while True:
        least = np.minimum(first, np.where(link, first, len(link)).min(axis=1))
        least = least[least]
        if (least == first).all():
            return first
        first = least


def _tile(rows: pd.DataFrame, table: int, bits: int, tables: int, threshold: float) -> pd.DataFrame:
    """What one tile of a bucket adds: (node, other, n): n links of a node if other is -1, else a link.

    A tile holds all pairs between its sides, or those of its one side. A pair that an earlier table brings together
    is left to it, so every pair counts once. Of the links come those of a spanning star per component.
    """
    x, side = unit(rows["vec"]), rows["side"].to_numpy()
    weight, nodes = rows["copies"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side
    codes = bucket_codes(x, bits, tables)[:, :table]
    for a in np.flatnonzero(link.any(axis=1)):
        near = np.flatnonzero(link[a])
        link[a, near[(codes[near] == codes[a]).any(axis=1)]] = False
    n, first = link @ weight, _parts(link)
    hit, moved = np.flatnonzero(n), np.flatnonzero(first != np.arange(len(first)))
    return pd.DataFrame({"node": np.concatenate([nodes[hit], nodes[moved]]), "other": np.concatenate([np.full(len(hit), -1), nodes[first[moved]]]), "n": np.concatenate([n[hit], np.zeros(len(moved), np.int64)])})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", group_col: str = "label", vector_col: str = "embedding", threshold: float = 0.93, tile: int = 1024) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows of one group link if the cosine of their vectors, in double precision, is ``threshold`` or more (above 0). Equal
    vectors are one node with a count. Each node falls in a bucket for every table: the signs of its products with
    random hyperplanes (``table_shape``). Members of a bucket are compared exactly, in tiles of about ``tile`` rows a side
    where a bucket holds more, and a pair counts in the first table that brings it together; so crowds of near copies
    are cut over many tasks, and counts and stars leave a task, never pairs. n_links counts the other rows linked
    directly; component_id is the smallest id reachable, itself included; kept is true where that is the row's own id.

    Pairs below the threshold never link. A pair at the threshold is missed with probability ``MISS``, a closer one with
    less. Rows with a null group, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; vectors of different lengths neither. Rows that share an id are rows of their own; rows without an id count
    as links, and name a component only if none of it has an id. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(vectors.sparkSession, "embedding-dups")
    kind = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(group_col).alias("grp"), F.col(vector_col).cast(kind).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    nodes = rows.where(F.col("grp").isNotNull() & sound).groupBy("grp", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = work.save(nodes.withColumns({"node": F.monotonically_increasing_id(), "length": F.size("vec")}), "nodes")
    most = nodes.groupBy("grp", "length").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_shape(most, threshold)

    @F.pandas_udf("array<long>")
    def codes(vecs: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vecs), dtype=object)
        for _, of_length in vecs.groupby(vecs.map(len)):
            out.loc[of_length.index] = pd.Series(list(bucket_codes(unit(of_length), bits, tables)), index=of_length.index)
        return out

    key = ["grp", "length", "table", "code"]
    coded = work.save(nodes.select("grp", "length", "node", "copies", "vec", codes("vec").alias("codes")), "codes")
    dealt = coded.select("grp", "length", "node", "copies", "vec", F.posexplode("codes").alias("table", "code"))
    crowds = work.save(dealt.groupBy(*key).count().where(F.col("count") > tile), "crowds")
    dealt = dealt.join(crowds.withColumn("chunks", F.ceil(F.col("count") / tile).cast("int")).drop("count"), key, "left")
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "table"), chunks).cast("int"))
    # a chunk meets every chunk, itself included, in one tile
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select(*key, "node", "copies", "vec", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), (F.col("own") > F.col("met")).cast("int").alias("side"))

    def compare(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return pd.DataFrame({"node": [], "other": [], "n": []}, dtype=np.int64)
        return _tile(rows, int(group[2]), bits, tables, threshold)

    found = work.save(dealt.groupBy(*key, "a", "b").applyInPandas(compare, "node long, other long, n long"), "found")
    counts = found.where("other = -1").groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")), work)
    nodes = nodes.join(counts, "node", "left").join(parts, "node", "left")
    nodes = nodes.select("grp", "vec", "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    nodes = work.save(nodes, "members")
    least = nodes.groupBy("part").agg(F.min("first_id").alias("component_id"))
    told = nodes.join(least, "part").select("grp", "vec", "n_links", "component_id")
    out = rows.join(told, ["grp", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
