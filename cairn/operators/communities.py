"""Communities by modularity (Louvain), strong components, both in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import LAYER_COLOURS, basename
from cairn.operators.graph import reversed_edges
from cairn.sources.tables import Stages

#: Products of degrees may pass the range of a long.
EXACT = "decimal(19,0)"


def simple_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected links between ``nodes`` in both directions, each pair once, no loops, of weight 1."""
    e = edges.select("src", "dst").where("src <> dst")
    e = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.unionByName(reversed_edges(e)).distinct().select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("w"))


def _turn(v: Column, turn: int) -> Column:
    """Whether it is a node's turn: a half of all nodes, another one each time, so that no two swap places for ever."""
    return F.conv(F.substring(F.md5(F.concat(v, F.lit(f":{turn}"))), 1, 1), 16, 10).cast("int") % 2 == 0


def _numbered(nodes: DataFrame, turns: int) -> DataFrame:
    """(id, n, turns): a number for every distinct id, in the order of ids once written, and a bit for each of its turns."""
    if turns > 62:
        raise ValueError("a node has 62 turns at most")
    bits = F.lit(0).cast("long")
    for t in range(turns):
        bits = bits + F.when(_turn(F.col("id"), t), F.lit(1 << t).cast("long")).otherwise(0)
    return nodes.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("n"), bits.alias("turns"))


def _numbered_links(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w, turns): the links of ``simple_links`` between numbers, with the turns of a."""
    e = edges.select("src", "dst").where("src <> dst")
    e = e.join(names.select(F.col("id").alias("src"), F.col("n").alias("a"), F.col("turns").alias("x")), "src").drop("src")
    e = e.join(names.select(F.col("id").alias("dst"), F.col("n").alias("b"), F.col("turns").alias("y")), "dst")
    both = e.select("a", "b", F.col("x").alias("turns")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("turns")))
    return both.distinct().select("a", "b", F.lit(1).cast("long").alias("w"), "turns")


def _moved(now: DataFrame, links: DataFrame, turn: int, two_m: int) -> DataFrame:
    """(v, k, c, turns) after the nodes whose turn it is chose the community around them that adds most to the modularity.

    With the node taken out of its own, a community adds 2m * links into it - degree * its degrees. Whole numbers
    decide; ties go to the smallest label.
    """
    total = now.groupBy("c").agg(F.sum("k").alias("total"))
    turns = F.col("turns").bitwiseAND(F.lit(1 << turn).cast("long")) != 0
    free = now.where(turns)
    near = links.where(turns & (F.col("a") != F.col("b"))).select("a", "b", "w").join(now.select(F.col("v").alias("b"), "c"), "b")
    around = near.groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
    own = free.select("v", "c", F.lit(0).cast("long").alias("w"))  # it may always stay
    around = around.unionByName(own).groupBy("v", "c").agg(F.sum("w").alias("w"))
    rows = around.join(free.select("v", "k", F.col("c").alias("was")), "v").join(total, "c")
    others = F.col("total") - F.when(F.col("c") == F.col("was"), F.col("k")).otherwise(0)
    gain = F.lit(two_m).cast(EXACT) * F.col("w").cast(EXACT) - F.col("k").cast(EXACT) * others.cast(EXACT)
    best = rows.groupBy("v").agg(F.min(F.struct((-gain).alias("loss"), "c")).alias("best"))
    return now.join(best, "v", "left").select("v", "k", F.coalesce("best.c", "c").alias("c"), "turns")


def _quality(links: DataFrame, labels: DataFrame, two_m: int):
    """The modularity of ``labels`` (id, label) times (2m)^2, a whole number."""
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).join(labels, "id")
    squares = degree.groupBy("label").agg(F.sum("k").cast(EXACT).alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s")).first()[0] or 0
    inside = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    return two_m * (inside.where("x = y").agg(F.sum("w")).first()[0] or 0) - int(squares)


def modularity(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``labels`` (id, label) over the undirected simple graph; 0 without links."""
    links = simple_links(nodes, edges)
    two_m = links.count()
    return _quality(links, labels, two_m) / two_m**2 if two_m else 0.0


def louvain(nodes: DataFrame, edges: DataFrame, stages: Stages, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(id, label): communities of the undirected simple graph by the Louvain method, in rounds for all nodes at once.

    On each level half of the nodes move at a time (by a hash of name and round), ``rounds`` rounds, to the community
    that adds most to the modularity; then communities become the nodes of the next level, their links added up. The level whose
    labels have the highest modularity on the first graph is returned, no level at all being one of them. Every round
    is written to the shared folder; a whole number per level reaches the driver. A community's label is one of its ids.
    Rounds work on numbers in the order of the ids, which stand for them in ties, so no name is dealt out again.
    """
    names = stages.keep(_numbered(nodes, levels * rounds))
    first = links = stages.keep(_numbered_links(names, edges))
    two_m = first.agg(F.sum("w")).first()[0] or 0
    labels = names.select(F.col("n").alias("id"), F.col("n").alias("label"))
    best, most = labels, _quality(first, labels, two_m)
    for level in range(levels):
        now = stages.keep(links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"), F.max("turns").alias("turns")).select("v", "k", F.col("v").alias("c"), "turns"))
        for turn in range(rounds):
            now = stages.keep(_moved(now, links, level * rounds + turn, two_m))
        to = now.select(F.col("v").alias("label"), "c")
        labels = stages.keep(labels.join(to, "label", "left").select("id", F.coalesce("c", "label").alias("label")))
        quality = _quality(first, labels, two_m)
        if quality > most:
            best, most = labels, quality
        ends = links.join(to.select(F.col("label").alias("a"), F.col("c").alias("x")), "a").join(to.select(F.col("label").alias("b"), F.col("c").alias("y")), "b")
        ends = ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
        links = stages.keep(ends.join(names.select(F.col("n").alias("a"), "turns"), "a").select("a", "b", "w", "turns"))
    best = best.join(names.select(F.col("n").alias("id"), F.col("id").alias("name")), "id").select("name", "label")
    return best.join(names.select(F.col("n").alias("label"), F.col("id").alias("of")), "label").select(F.col("name").alias("id"), F.col("of").alias("label"))


def merged_communities(nodes: DataFrame, labels: DataFrame, most: int = 6) -> DataFrame:
    """(id, community): numbers from 0 by size, then label; groups past ``most`` and single nodes join the largest.

    A graph of three nodes or fewer is grouped by layer. ``nodes`` is (id, layer).
    """
    few = nodes.select("id").limit(4).count() <= 3
    if few:
        layer = F.coalesce("layer", F.lit("other"))
        labels = nodes.select("id", F.when(layer.isin(*LAYER_COLOURS), layer).otherwise("other").alias("label"))
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    rank = size.orderBy(F.desc("n"), "label").limit(most)
    rank = rank.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)  # ``most`` rows
    kept = rank.where("n > 1 or nth = 0" if not few else "true").select("label", "nth")
    return labels.join(F.broadcast(kept), "label", "left").select("id", F.coalesce("nth", F.lit(0)).alias("community"))


def community_report(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, n, label, dominant_layer, color): three names by id, cut at 40 characters; the most frequent layer.

    Layers as frequent follow their fixed order. ``nodes`` is (id, name, layer). Of a task only three names of a community
    and one row of a layer in it meet others.
    """
    rows = communities.join(nodes.select("id", basename(F.coalesce("name", "id")).alias("name"), F.coalesce("layer", F.lit("other")).alias("layer")), "id")
    nth = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    names = rows.withColumn("nth", nth).where("nth <= 3")  # three of each leave a task, so no community is gathered
    listed = names.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ", ").alias("label"))
    label = F.when(F.length("label") > 40, F.concat(F.substring("label", 1, 38), F.lit("…"))).otherwise(F.col("label"))
    place = F.coalesce(*[F.when(F.col("layer") == x, i) for i, x in enumerate(LAYER_COLOURS)], F.lit(len(LAYER_COLOURS)))
    layers = rows.groupBy("community", "layer").agg(F.count("*").alias("n"))
    top = layers.groupBy("community").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("n"), place.alias("place"), "layer")).alias("top"))
    color = F.coalesce(*[F.when(F.col("top.layer") == x, F.lit(c)) for x, c in LAYER_COLOURS.items()], F.lit(LAYER_COLOURS["other"]))
    return top.join(listed, "community").select("community", "n", label.alias("label"), F.col("top.layer").alias("dominant_layer"), color.alias("color"))


def trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (src, dst) without those that no cycle uses: one end is entered by nothing, or left by nothing."""
    e = edges
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return e


def _spread(start: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """(id, x) after the greatest x (or null) of ``start`` that reaches a node along ``edges`` came to it.

    Only nodes that changed send on what they have, so a round costs what it moves.
    """
    now = stages.keep(start.withColumn("new", F.col("x").isNotNull()))
    while now.where("new").limit(1).count():
        sent = now.where("new").join(edges, now.id == edges.src).groupBy(F.col("dst").alias("id")).agg(F.max("x").alias("y"))
        better = F.col("y").isNotNull() & (F.col("x").isNull() | (F.col("y") > F.col("x")))
        now = stages.keep(now.join(sent, "id", "left").select("id", F.when(better, F.col("y")).otherwise(F.col("x")).alias("x"), better.alias("new")))
    return now.select("id", "x")


def strong_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(id, component): nodes of strong components of two nodes or more, under the component's smallest id.

    Edges that no cycle uses are trimmed. Then every node takes the greatest id that reaches it (its colour), and from
    the node that bears its own colour's name the nodes of that colour which reach it are found backwards: they are one
    component. They leave with all edges between colours, and the rest goes round again.
    """
    left = stages.keep(trimmed(edges.select("src", "dst").where("src <> dst").distinct()))
    found = None
    while left.limit(1).count():
        ids = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = _spread(ids.withColumn("x", F.col("id")), left, stages).withColumnRenamed("x", "colour")
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), "colour"), "dst")
        inside = stages.keep(inside.where("c = colour").select("src", "dst"))
        marks = colour.select("id", F.when(F.col("id") == F.col("colour"), F.lit(1)).alias("x"))
        back = stages.keep(_spread(marks, reversed_edges(inside), stages).where("x = 1").join(colour, "id").select("id", "colour"))
        found = back if found is None else found.unionByName(back)
        gone = back.select("id")
        rest = inside.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = stages.keep(trimmed(rest))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    named = found.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return found.join(named, "colour").select("id", "component")
