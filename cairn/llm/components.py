"""Connected components by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(a, b) links of long node ids -> (node, component): the smallest node that each node reaches.

    Alternates large-star and small-star steps, each of which aggregates a minimum per node before it joins, until
    every edge points at its component's smallest node. The number of rounds grows with the logarithm of the
    diameter; each round is a table in the shared folder. Only a convergence flag reaches the driver. Self-links and
    nulls are ignored; no links give no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = work.save(links, "links-0")
    k = 0
    while True:
        # large star: the neighbours above a node move to the smallest node around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its neighbours below it move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m")
        k += 1
        then = work.save(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), f"links-{k}")
        same = [now, then]
        one, two = (x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in same)
        if one == two:
            return then.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if k > 1:
            work.drop(f"links-{k - 2}")
        now = then
