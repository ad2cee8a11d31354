"""Joins and traversals over ``nodes`` (id, ...) and ``edges`` (src, dst, relation). src depends on dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import basename, dirname, path_variants
from cairn.sources.tables import Stages

DEPENDS = "DEPENDS_ON"


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def resolve_node_ids(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, id): nodes whose id is any slash variant of a candidate path."""
    paths = candidates.select("request_id", F.explode(path_variants(F.col("path"))).alias("id"))
    return paths.join(nodes.select("id"), "id").select("request_id", "id").distinct()


def match_source(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best node per request (request_id, path): exact, then slash variants, then prefix, then same file name.

    A node id starts with the path if the path is one of the id's ancestor folders, so a prefix is an equi-join.
    """
    ids = nodes.select("id")
    r = requests.select("request_id", "path")
    exact = r.join(ids, r.path == ids.id).select("request_id", "id", F.lit(1).alias("tier"))
    forms = r.select("request_id", F.explode(path_variants(F.col("path"))).alias("id")).join(ids, "id").select("request_id", "id", F.lit(2).alias("tier"))
    parts = F.split("id", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    # only the smallest id of a folder or of a name can be chosen
    under = ids.select("id", F.explode(folders).alias("folder")).groupBy("folder").agg(F.min("id").alias("id"))
    prefix = r.withColumn("folder", F.rtrim(F.col("path"), F.lit("/"))).join(under, "folder").select("request_id", "id", F.lit(3).alias("tier"))
    named = r.withColumn("file", basename(F.col("path"))).join(ids.groupBy(basename(F.col("id")).alias("file")).agg(F.min("id").alias("id")), "file").select("request_id", "id", F.lit(4).alias("tier"))
    every = exact.unionByName(forms).unionByName(prefix).unionByName(named)
    return every.groupBy("request_id").agg(F.min(F.struct("tier", "id")).alias("m")).select("request_id", "m.id", "m.tier")


def mark_untested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that are no tests and that no COVERS edge enters."""
    covered = edges.where("relation = 'COVERS'").select(F.col("dst").alias("id"))
    return nodes.where("type = 'file' and not coalesce(is_test_file, false)").join(covered, "id", "left_anti")


def find_dead_code(symbols: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """Functions and classes that nothing calls or depends on, newest first."""
    used = edges.where(F.col("relation").isin("CALLS", DEPENDS)).select(F.col("dst").alias("id"))
    free = symbols.where(F.col("type").isin("function", "class") & ~F.lower("name").isin("main", "__init__", "handler", "index", "app", "router") & ~F.lower("id").rlike("test|spec|__main__"))
    return free.join(used, "id", "left_anti").orderBy(F.desc_nulls_last("last_modified"), "id").limit(limit)


def find_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no file depends on, entry points and generated ones left out."""
    used = edges.where(f"relation = '{DEPENDS}'").select(F.col("dst").alias("id"))
    free = nodes.where("type = 'file'").where(~F.col("id").rlike(r"(main\.py|__main__\.py|page\.tsx|page\.ts)$|__pycache__|node_modules"))
    return free.join(used, "id", "left_anti")


def covering_tests(affected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, test): test files with a COVERS edge into the request's affected nodes."""
    tests = nodes.where(F.coalesce("is_test_file", F.lit(False)) | F.lower("id").rlike("test|spec")).select(F.col("id").alias("test"))
    rows = affected.join(edges.where("relation = 'COVERS'"), affected.id == edges.dst).select("request_id", F.col("src").alias("test"))
    return rows.join(tests, "test", "left_semi").distinct()


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, src, dst, relation): edges with both ends among the members (request_id, id)."""
    a = members.select("request_id", F.col("id").alias("src"))
    b = members.select("request_id", F.col("id").alias("dst"))
    return edges.join(a, "src").join(b, ["request_id", "dst"]).select("request_id", "src", "dst", "relation").distinct()


def _below(folders: DataFrame, nodes: DataFrame) -> DataFrame:
    """(folder, id): files anywhere below each of the distinct ``folders`` (folder)."""
    parts = F.split("id", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    below = nodes.where("type = 'file'").select("id", parts.alias("p")).where("size(p) > 1").select("id", F.explode(above).alias("folder"))
    return below.join(folders, "folder", "left_semi").distinct()


def first_below(folders: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(folder, id, nth): the first ``most`` files anywhere below each of the distinct ``folders`` (folder), numbered by id."""
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("id"))
    return _below(folders, nodes).withColumn("nth", nth).where(F.col("nth") <= most)


def siblings_of(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, id): files anywhere below the folder of each source (request_id, id), itself left out."""
    s = sources.select("request_id", F.col("id").alias("source"), dirname(F.col("id")).alias("folder")).where("folder <> ''")
    return _all_below(s, _below(s.select("folder").distinct(), nodes))


#: Parts that a folder's files are dealt to, so that a large one is not met in one task.
FOLDER_PARTS = 16


def _all_below(sources: DataFrame, below: DataFrame) -> DataFrame:
    """(request_id, id) of ``sources`` (request_id, source, folder) and distinct ``below`` (id, folder), each once.

    What is found is sources times files, so it is not dealt out again to be made distinct: a request asks for a
    folder once, and not for one below another of its own. Of two sources in a folder each is the other's sibling.
    """
    s = sources.groupBy("request_id", "folder").agg(F.min("source").alias("source"), F.max("source").alias("last"))
    parts = F.split("folder", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n))))
    inner = s.select(F.col("request_id").alias("r"), F.col("folder").alias("inner"), F.explode(above).alias("outer"))
    inner = inner.join(s, F.col("r").eqNullSafe(F.col("request_id")) & (F.col("outer") == F.col("folder"))).select("r", "inner").distinct()
    s = s.join(inner, F.col("r").eqNullSafe(F.col("request_id")) & (F.col("inner") == F.col("folder")), "left_anti")
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FOLDER_PARTS - 1))))
    below = below.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(FOLDER_PARTS)).cast("int"))
    return s.join(below, ["folder", "part"]).where("id <> source or source <> last").select("request_id", "id")


def functions_to_files(edges: DataFrame) -> DataFrame:
    """(src, dst): files lifted from CONTAINS: file -> function -> x, and x -> function in a file."""
    held = edges.where("relation = 'CONTAINS'").select(F.col("src").alias("file"), F.col("dst").alias("fn"))
    other = edges.where("relation <> 'CONTAINS'")
    out = held.join(other, held.fn == other.src).select(F.col("file").alias("src"), "dst")
    into = held.join(other, held.fn == other.dst).select("src", F.col("file").alias("dst"))
    return out.unionByName(into).where("src <> dst").distinct()


def infer_edges(affected: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, a, b, kind) for requests whose affected nodes have no explicit edge among them.

    SIBLING: same folder; PAIRED: same stem; RELATED: one stem contains the other, both longer than three characters.
    RELATED wins over PAIRED, PAIRED over SIBLING; a < b.
    """
    explicit = induced_edges(affected, edges).select("request_id").distinct()
    stem = F.regexp_replace(basename(F.col("id")), r"\.[^.]*$", "")
    rows = affected.join(explicit, "request_id", "left_anti").select("request_id", "id", dirname(F.col("id")).alias("folder"), stem.alias("stem"))
    a, b = rows.alias("a"), rows.alias("b")
    less = F.col("a.id") < F.col("b.id")
    same = F.col("a.request_id") == F.col("b.request_id")
    pick = [F.col("a.request_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")]
    sib = a.join(b, same & (F.col("a.folder") == F.col("b.folder")) & less).select(*pick, F.lit(1).alias("k"))
    pair = a.join(b, same & (F.col("a.stem") == F.col("b.stem")) & less).select(*pick, F.lit(2).alias("k"))
    # a stem inside another shares all its runs of three characters: the rarest of them among the request's stems looks it up
    stems = rows.where("length(stem) > 3").select("request_id", "stem").distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("stem") - 2), lambda i: F.substring("stem", i, F.lit(3))))
    grams = stems.select("request_id", "stem", F.explode(runs).alias("gram"))
    df = grams.groupBy("request_id", "gram").agg(F.count("*").alias("df"))
    rarest = grams.join(df, ["request_id", "gram"]).groupBy("request_id", "stem").agg(F.min(F.struct("df", "gram")).alias("key"))
    held = rarest.select("request_id", F.col("stem").alias("part"), F.col("key.gram").alias("gram")).join(grams, ["request_id", "gram"])
    held = held.where(F.contains("stem", "part") & (F.col("stem") != F.col("part"))).select("request_id", "part", "stem")
    whole = rows.select("request_id", F.col("id").alias("x"), "stem")
    inner = rows.select("request_id", F.col("id").alias("y"), F.col("stem").alias("part"))
    rel = held.join(whole, ["request_id", "stem"]).join(inner, ["request_id", "part"])
    rel = rel.select("request_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(3).alias("k"))
    best = sib.unionByName(pair).unionByName(rel).groupBy("request_id", "a", "b").agg(F.max("k").alias("k"))
    return best.select("request_id", "a", "b", F.when(F.col("k") == 3, "RELATED").when(F.col("k") == 2, "PAIRED").otherwise("SIBLING").alias("kind"))


def team_topology(ownership: DataFrame, k: int = 100) -> DataFrame:
    """(a, b, weight): pairs of authors by the number of nodes they share; ``ownership`` is (node, author)."""
    o = ownership.select("node", "author").distinct()
    pairs = o.withColumnRenamed("author", "a").join(o.withColumnRenamed("author", "b"), "node").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(k)


def neighbours(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """(id, neighbour, relation): outgoing neighbours of each node, ``limit`` a node."""
    rows = nodes.select("id").join(edges, F.col("id") == F.col("src")).select("id", F.col("dst").alias("neighbour"), "relation").distinct()
    nth = F.row_number().over(Window.partitionBy("id").orderBy("neighbour", "relation"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def graph_page(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, relation) leaving the first ``n`` nodes by id; null dst for nodes without edges."""
    page = nodes.select("id").orderBy("id").limit(n)
    return page.join(edges, page.id == edges.src, "left").select(F.col("id").alias("src"), "dst", "relation")


def _step(front: DataFrame, links: DataFrame) -> DataFrame:
    return front.join(links, front.id == links.src).select("request_id", F.col("dst").alias("id"))


def reach(seeds: DataFrame, links: DataFrame, hops: int, stages: Stages | None = None) -> DataFrame:
    """(request_id, id, hop): breadth-first over ``links`` (src, dst) from ``seeds`` (request_id, id) at hop 0.

    A level is joined, then what is known already leaves by an anti join. With ``stages`` every level is written to
    the shared folder, so the plan does not grow; without, it is one lazy plan, for few hops.
    """
    links = links.select("src", "dst").distinct()
    known = seeds.select("request_id", "id").distinct().withColumn("hop", F.lit(0))
    front = known
    for hop in range(1, hops + 1):
        new = _step(front, links).distinct().join(known.select("request_id", "id"), ["request_id", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if stages:
            new = stages.keep(new)
        known, front = known.unionByName(new), new
    return known


def impact_subgraph(targets: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(request_id, src, dst): dependency links on the way into each target, up to ``max_hops``."""
    dep = edges.where(f"relation = '{DEPENDS}'")
    met = reach(targets, reversed_edges(dep), max_hops).where(f"hop < {max_hops}")
    return met.join(dep, met.id == dep.dst).select("request_id", "src", "dst").distinct()


def expand_subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int = 100, relations: tuple[str, ...] = (DEPENDS, "CALLS", "CONTAINS", "DEFINES", "COVERS"), include_functions: bool = False, most_seeds: int | None = None) -> DataFrame:
    """(request_id, id, hop): undirected search from seeds, cut to ``max_nodes`` per request, nearest first.

    Depth is held to 1..4 and ``max_nodes`` to 10..300. Functions are passed over unless asked for; with ``most_seeds``
    a request starts from that many of its seeds, by id.
    """
    depth, max_nodes = min(4, max(1, depth)), min(300, max(10, max_nodes))
    kinds = ["file", "folder", "module", "class", *(["function"] if include_functions else [])]
    some = edges.where(F.col("relation").isin(*relations)).select("src", "dst")
    allowed = nodes.where(F.col("type").isin(*kinds)).select(F.col("id").alias("dst"))
    links = some.unionByName(reversed_edges(some)).join(allowed, "dst", "left_semi")
    if most_seeds is not None:
        first = F.row_number().over(Window.partitionBy("request_id").orderBy("id"))
        seeds = seeds.select("request_id", "id").distinct().withColumn("nth", first).where(F.col("nth") <= most_seeds).drop("nth")
    found = reach(seeds, links, depth)
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("hop", "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= max_nodes).drop("nth")


def cycles(nodes: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(length, path): each DEPENDS_ON cycle of 2..max_depth non-test files once, from its smallest id."""
    files = nodes.where("not coalesce(is_test_file, false)").select("id")
    e = edges.where(f"relation = '{DEPENDS}' and src <> dst").select("src", "dst").distinct()
    e = e.join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi")
    # an edge that no cycle uses has an end which nothing enters, or which nothing leaves
    for _ in range(2):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    back = e.where("src > dst").select(F.col("src").alias("last"), F.col("dst").alias("first"))
    found = None
    for length in range(2, max_depth + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.select("path", last.alias("last"), first.alias("first")).join(back, ["last", "first"], "left_semi").select(F.lit(length).alias("length"), "path")
        found = closed if found is None else found.unionByName(closed)
        if length < max_depth:
            paths = paths.join(e, last == e.src).where((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found.withColumn("path", F.array_join("path", " > "))


def files_on_cycles(pr_files: DataFrame, edges: DataFrame, max_len: int = 6, stages: Stages | None = None) -> DataFrame:
    """(pr_id, file, length) of changed files that lie on a dependency cycle: the shortest walk back to themselves.

    A file looks half the length ahead and half of it back; the nearest node met on both sides closes its shortest
    cycle. Edges that no cycle uses are trimmed first. With ``stages`` walks are dealt out as numbers, not as names.
    """
    e = edges.where(F.col("relation").isin(DEPENDS, "IMPORTS") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    for _ in range(2):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    asked = pr_files.select(F.col("file").alias("id")).distinct()
    if stages:
        e = stages.keep(e)
        names = stages.keep(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("n")))
        e = e.join(names.select(F.col("id").alias("src"), F.col("n").alias("a")).hint("merge"), "src").join(names.select(F.col("id").alias("dst"), F.col("n").alias("b")).hint("merge"), "dst")
        e = stages.keep(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        asked = asked.join(names.hint("merge"), "id").select(F.col("n").alias("id"))
    seeds = asked.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("request_id"), "id")
    ahead = reach(seeds, e, (max_len + 1) // 2, stages).where("hop > 0")
    behind = reach(seeds, reversed_edges(e), max_len // 2, stages).where("hop > 0").withColumnRenamed("hop", "back")
    length = (F.col("hop") + F.col("back")).alias("length")
    back = ahead.join(behind, ["request_id", "id"]).groupBy("request_id").agg(F.min(length).alias("length"))
    if stages:
        back = back.join(names.withColumnRenamed("id", "request_name"), F.col("request_id") == F.col("n")).select(F.col("request_name").alias("request_id"), "length")
    return pr_files.join(back, pr_files.file == back.request_id).select("pr_id", "file", "length").distinct()


def shortest_path(pairs: DataFrame, edges: DataFrame, max_hops: int = 6, stages: Stages | None = None) -> DataFrame:
    """(pair_id, hops, path): an undirected shortest path for each (pair_id, a, b), the smallest ids where many."""
    links = edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).where("src <> dst").distinct()
    front = pairs.select("pair_id", "b", F.col("a").alias("id"), F.array("a").alias("path"))
    known = front.select("pair_id", "id")
    done = front.where("id = b").select("pair_id", "path")
    for _ in range(max_hops):
        new = front.join(links, front.id == links.src).select("pair_id", "b", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        new = new.join(known, ["pair_id", "id"], "left_anti").join(done.select("pair_id"), "pair_id", "left_anti")
        new = new.groupBy("pair_id", "b", "id").agg(F.min("path").alias("path"))
        if stages:
            new = stages.keep(new)
        known = known.unionByName(new.select("pair_id", "id"))
        done, front = done.unionByName(new.where("id = b").select("pair_id", "path")), new.where("id <> b")
    return done.select("pair_id", (F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"))


def ego_network(centres: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, id): each centre and its neighbours in either direction."""
    both = edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst")))
    return centres.select("request_id", "id").unionByName(_step(centres, both)).distinct()


def communities(nodes: DataFrame, edges: DataFrame, stages: Stages, rounds: int = 5, most: int = 6) -> DataFrame:
    """(id, community): synchronous label propagation, then small groups join the largest.

    A node takes the most frequent label around it, its own counting once, ties to the smallest. Groups ranked past
    ``most`` by size, and single nodes, join the largest group. Not Louvain: results differ from it.
    """
    links = edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).where("src <> dst").distinct()
    now = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = links.join(now, links.src == now.id).select(F.col("dst").alias("id"), "label").unionByName(now)
        counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        now = stages.keep(counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("id", "m.label"))
    size = now.groupBy("label").agg(F.count("*").alias("n"))
    rank = size.orderBy(F.desc("n"), "label").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    top = rank.where("rank = 1").select(F.col("label").alias("largest"))
    out = now.join(F.broadcast(rank.where("n > 1").select("label", "rank")), "label", "left").join(F.broadcast(top))
    return out.select("id", F.when(F.col("rank").isNull(), F.col("largest")).otherwise(F.col("label")).alias("community"))
