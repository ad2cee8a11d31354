"""Insight over nodes and edges: lookups, architecture rules, health, leadership, teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.matching import contained, small

NOBODY = ("", "None", "Unknown")


def architecture_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, violation_rule): dependencies from a layer to one that ``rules`` (layer, banned) forbids it."""
    layers = nodes.select("id", "layer")
    dep = edges.where("relation = 'DEPENDS_ON'")
    rows = dep.join(layers.select(F.col("id").alias("src"), F.col("layer").alias("layer")), "src").join(layers.select(F.col("id").alias("dst"), F.col("layer").alias("banned")), "dst")
    return rows.join(small(rules.select("layer", "banned").distinct()), ["layer", "banned"]).select("src", "dst", F.concat("layer", F.lit("→"), "banned").alias("violation_rule"))


def _glob(pattern: str) -> str:
    """A glob as a regular expression; a star crosses slashes, and the pattern may start at any folder."""
    import re

    if pattern.endswith("/**"):
        return "(^|/)" + re.escape(pattern[:-3]) + "/"
    return "^(.*/)?" + re.escape(pattern).replace(r"\*\*", ".*").replace(r"\*", ".*").replace(r"\?", ".") + "$"


def layer_assign(files: DataFrame, rules: list[tuple[int, str, list[str]]]) -> DataFrame:
    """Files with the layer of the first rule (ord, name, globs) that matches; null where none does."""
    out = F.lit(None).cast("string")
    for _, name, globs in sorted(rules, reverse=True):
        match = F.lit(False)
        for g in globs:
            match = match | F.col("id").rlike(_glob(g))
        out = F.when(match, name).otherwise(out)
    return files.withColumn("layer", out)


def find_definition(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, id): the node of a symbol by id, name or ``::`` suffix; functions first, then the smallest id.

    Only the best node of a name or suffix can be chosen, so these are few rows a key before requests meet them. Keys
    are exploded names, which Spark takes for smaller than they are: they are merged, not broadcast.
    """
    last = F.when(F.contains("id", F.lit("::")), F.element_at(F.split("id", "::"), -1))
    keys = symbols.select(F.explode(F.array_distinct(F.array_compact(F.array("id", "name", last)))).alias("symbol"), F.struct(F.when(F.col("type") == "function", 0).otherwise(1).alias("k"), "id").alias("m"))
    best = keys.groupBy("symbol").agg(F.min("m").alias("m"))
    return requests.join(best.hint("merge"), "symbol").groupBy("request_id").agg(F.min("m").alias("m")).select("request_id", "m.id")


def find_references(requests: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """(request_id, src): where REFERENCES, CALLS or IMPORTS edges into a symbol (its id or name) come from."""
    used = edges.where(F.col("relation").isin("REFERENCES", "CALLS", "IMPORTS")).select("src", "dst")
    by_id = requests.select("request_id", F.col("symbol").alias("dst"))
    by_name = requests.join(nodes.select("id", "name"), F.col("symbol") == F.col("name")).select("request_id", F.col("id").alias("dst"))
    rows = by_id.unionByName(by_name).distinct().join(used, "dst").select("request_id", "src").distinct()
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("src"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def suffixes(path):
    """All ``/``-aligned suffixes of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, n, F.size(parts) - n + 1)))


def attach_incidents(nodes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Nodes with prod_incidents_7d summed over incidents whose path is the id or ends it, and ``hit``."""
    ends = nodes.select("id", F.explode(suffixes(F.col("id"))).alias("file_path"))
    n = ends.join(incidents, "file_path").groupBy("id").agg(F.sum("count_7d").alias("n"))
    return nodes.join(n, "id", "left").select(nodes["*"], F.coalesce("n", F.lit(0)).alias("prod_incidents_7d"), F.col("n").isNotNull().alias("hit"))


def nodes_by_name(queries: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, id, tier) for queries (query_id, term): nodes in six tiers, the best of each node.

    Name, id, ``::x`` suffix, ``::x::``, name contains, id contains. Any number of terms: containment is an equi-join
    on runs of characters.
    """
    asked = queries.select("query_id", "term", F.lower("term").alias("low")).distinct()
    names = nodes.select("id", "name", F.explode(F.array(F.lower("id"), F.lower("name"))).alias("text"))
    pairs = contained(asked.select(F.col("low").alias("term")), names).withColumnRenamed("term", "low")
    rows = names.join(pairs.hint("merge"), "text").join(asked.hint("merge"), "low").select("query_id", "term", "low", "id", "name").distinct()
    term = F.col("term")
    tier = F.when(F.col("name") == term, 1).when(F.col("id") == term, 2).when(F.endswith(F.col("id"), F.concat(F.lit("::"), term)), 3).when(F.contains(F.col("id"), F.concat(F.lit("::"), term, F.lit("::"))), 4).when(F.contains(F.lower("name"), F.col("low")), 5).otherwise(6)
    rows = rows.groupBy("query_id", "id").agg(F.min(tier).alias("tier"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def workspace_peers(repos: DataFrame) -> DataFrame:
    """(workspace_id, repo, peers): the other repositories of each workspace."""
    b = repos.select("workspace_id", F.col("repo").alias("peer"))
    rows = repos.join(b, "workspace_id", "left").groupBy("workspace_id", "repo").agg(F.sort_array(F.collect_set(F.when(F.col("peer") != F.col("repo"), F.col("peer")))).alias("peers"))
    return rows


def workspace_links(repos: DataFrame) -> DataFrame:
    nxt = F.lead("repo").over(Window.partitionBy("workspace_id").orderBy("sort_order"))
    return repos.withColumn("dst", nxt).where("dst is not null").select("workspace_id", F.col("repo").alias("src"), "dst")


def link_endpoints(endpoints: DataFrame, slug: str, limit: int = 80) -> DataFrame:
    rows = endpoints.select(F.concat(F.lit(f"{slug}::"), "method", F.lit(":"), "path").alias("dst")).distinct().orderBy("dst").limit(limit)
    return rows.select(F.lit(slug).alias("src"), "dst", F.lit("EXPOSES").alias("relation"))


def commit_touch(nodes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(hash, id): nodes of a commit's files; a symbol's id starts with its file."""
    n = nodes.select("id", F.substring_index("id", "::", 1).alias("file"))
    return n.join(commit_files, "file").select("hash", "id").distinct()


def first_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(request_id, id, origin): union of seed sets, the first set that has a seed wins."""
    rows = None
    for i, (name, df) in enumerate(sources):
        one = df.select("request_id", "id", F.struct(F.lit(i).alias("i"), F.lit(name).alias("origin")).alias("o"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("request_id", "id").agg(F.min("o").alias("o")).select("request_id", "id", "o.origin")


def recommend_experts(affected: DataFrame, experts: DataFrame, k: int = 5) -> DataFrame:
    """(request_id, person, weight, files): the heaviest experts of the affected files, with up to three files."""
    rows = affected.join(experts, affected.id == experts.file).select("request_id", "person", "file", "weight")
    nth = Window.partitionBy("request_id", "person").orderBy(F.desc("weight"), "file")
    top = rows.withColumn("nth", F.row_number().over(nth)).where("nth <= 3").groupBy("request_id", "person").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("nth", "file"))).alias("f"))
    top = top.select("request_id", "person", "weight", F.array_join(F.transform("f", lambda x: x["file"]), ",").alias("files"))
    best = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("weight"), "person"))
    return top.withColumn("nth", best).where(F.col("nth") <= k).drop("nth")


def degree(edges: DataFrame, relations: tuple[str, ...] = ("DEPENDS_ON",)) -> DataFrame:
    """(id, fan_in, fan_out) in distinct neighbours; each side is aggregated before they meet."""
    e = edges.where(F.col("relation").isin(*relations)).select("src", "dst").distinct()
    rows = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return rows.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def god_objects(nodes: DataFrame, edges: DataFrame, threshold: int = 20) -> DataFrame:
    """Files whose fan-in and fan-out together are over ``threshold``."""
    return nodes.where("type = 'file'").join(degree(edges), "id").where(F.col("fan_in") + F.col("fan_out") > threshold)


def health_summary(nodes: DataFrame, cycles: DataFrame, gods: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: score 0..100, counts (each capped at 100 in the score), total files, mean bus risk."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    files = nodes.where("type = 'file'").agg(F.count("*").alias("total_files"), F.round(F.avg("bus_risk"), 6).alias("mean_bus_risk"))
    rows = files.crossJoin(one(cycles, "cycles")).crossJoin(one(gods, "god_objects")).crossJoin(one(orphans, "orphans"))  # one-row frames
    cap = lambda c: F.least(F.col(c), F.lit(100))
    score = F.greatest(F.lit(0), 100 - 10 * cap("cycles") - 5 * cap("god_objects") - cap("orphans"))
    return rows.withColumn("score", score).withColumn("critical", F.col("cycles") + F.col("god_objects"))


def leadership_surface(nodes: DataFrame) -> DataFrame:
    unowned = F.col("top_owner").isNull() | F.col("top_owner").isin(*NOBODY)
    n, total = F.count_if(unowned), F.count("*")
    return nodes.where("type = 'file'").agg(total.alias("files"), n.alias("unowned"), (F.floor((20000 * n + total) / (2 * total)) / 100).alias("unowned_percent"))


def top_risk_files(nodes: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """(id, fan_in, score): files by bus risk, fan-in and incidents."""
    d = degree(edges, ("DEPENDS_ON", "IMPORTS", "CALLS")).select("id", "fan_in")
    rows = nodes.where("type = 'file'").join(d, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    key = F.col("bus_risk") * (10 + F.col("fan_in")) * (1 + F.col("incidents"))
    score = F.floor(F.least(F.lit(100.0), F.col("bus_risk") * 50 + F.col("fan_in") * 2 + F.col("incidents") * 3)).cast("int")
    return rows.select("id", "fan_in", score.alias("score"), key.alias("key")).orderBy(F.desc("key"), "id").limit(k).drop("key")


def ownership_heatmap(nodes: DataFrame, k: int = 24) -> DataFrame:
    """(zone, files, owners, concentration, alert) by first folder."""
    owner = F.when(F.col("top_owner").isNotNull() & ~F.col("top_owner").isin(*NOBODY), F.col("top_owner"))
    rows = nodes.where("type = 'file'").groupBy(F.split("id", "/")[0].alias("zone")).agg(F.count("*").alias("files"), F.count_distinct(owner).alias("owners"))
    share = F.floor((2000 * (F.col("files") - F.col("owners")) + F.col("files")) / (2 * F.col("files"))).cast("double") / 1000
    return rows.withColumns({"concentration": share, "alert": (F.col("files") >= 5) & (F.col("owners") <= 1)}).orderBy(F.desc("files"), "zone").limit(k)


def what_if_leaves(nodes: DataFrame, ownership: DataFrame, persons: DataFrame, limit: int = 80) -> DataFrame:
    """(person, file, bus_risk, others): each person's files by bus risk with up to four other collaborators."""
    mine = nodes.join(persons, nodes.top_owner == persons.person).select("person", F.col("id").alias("file"), "bus_risk")
    nth = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("bus_risk"), "file"))
    mine = mine.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")
    others = mine.join(ownership.withColumnRenamed("node", "file"), "file").where("author <> person").groupBy("person", "file").agg(F.array_join(F.slice(F.sort_array(F.collect_set("author")), 1, 4), ",").alias("others"))
    return mine.join(others, ["person", "file"], "left").withColumn("others", F.coalesce("others", F.lit("")))


def person_work(persons: DataFrame, nodes: DataFrame, ownership: DataFrame, limit: int = 50) -> DataFrame:
    """(person, id, role): files by the role in which a person's name, as part of another or whole, appears in them.

    Each person is matched to distinct author names first, by containment, and then joined by name.
    """
    names = nodes.select(F.col("top_owner").alias("name")).union(nodes.select("last_author")).union(ownership.select("author")).where("name is not null").distinct()
    names, asked = names.withColumn("text", F.lower("name")), persons.select("person", F.lower("person").alias("term")).distinct()
    match = contained(asked, names).join(names, "text").join(asked, "term").select("person", "name").distinct()
    rows = nodes.select("id", F.col("top_owner").alias("name"), F.lit(1).alias("role")).unionByName(nodes.select("id", F.col("last_author").alias("name"), F.lit(2).alias("role"))).unionByName(ownership.select(F.col("node").alias("id"), F.col("author").alias("name"), F.lit(3).alias("role")))
    # dealt out once, by id, for both steps
    best = rows.join(small(match), "name").select("person", "id", "role").repartition("id").groupBy("person", "id").agg(F.min("role").alias("role")).join(nodes.select("id", "commit_count").hint("merge"), "id")
    nth = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("commit_count"), "id"))
    best = best.withColumn("nth", nth).where(F.col("nth") <= limit)
    return best.select("person", "id", F.when(F.col("role") == 1, "OWNER").when(F.col("role") == 2, "LAST_AUTHOR").otherwise("COLLABORATOR").alias("role"))


def layer_overview(nodes: DataFrame, edges: DataFrame, k: int = 24) -> tuple[DataFrame, DataFrame]:
    """Layers (layer, files, names, val) and layer pairs (src_layer, dst_layer, n, weight)."""
    files = nodes.where("type = 'file'")
    nth = F.row_number().over(Window.partitionBy("layer").orderBy(F.length("name"), "name"))
    first = files.select("layer", "name").withColumn("nth", nth).where("nth <= 3")  # cut before the shuffle, too
    first = first.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("nth", "name"))).alias("n"))
    named = files.groupBy("layer").agg(F.count("*").alias("files")).join(first, "layer")
    layers = named.select("layer", "files", F.array_join(F.transform("n", lambda x: x["name"]), ",").alias("names"), F.least(8 + 0.5 * F.col("files"), F.lit(40.0)).alias("val"))
    l = files.select("id", "layer")
    e = edges.where(F.col("relation").isin("DEPENDS_ON", "IMPORTS", "DEFINES"))
    pairs = e.join(l.select(F.col("id").alias("src"), F.col("layer").alias("src_layer")), "src").join(l.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer")), "dst").where("src_layer <> dst_layer")
    pairs = pairs.groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n")).withColumn("weight", F.least(F.lit(1.0), F.col("n") / 10))
    return layers, pairs.orderBy(F.desc("n"), "src_layer", "dst_layer").limit(k)


def layer_members(nodes: DataFrame) -> DataFrame:
    """(layer, id): members as rows, as a layer may hold most of a code base."""
    return nodes.select("layer", "id").distinct()


def chunks_by_extension(chunks: DataFrame, k: int = 5) -> DataFrame:
    """(extension, chunks): the ``k`` endings of chunk paths that have the most chunks."""
    ending = F.regexp_extract("path", r"\.([a-z0-9]+)$", 1)
    return chunks.groupBy(ending.alias("extension")).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "extension").limit(k)


def suggest_reviewers(pr_files: DataFrame, experts: DataFrame, risks: DataFrame, k: int = 5) -> DataFrame:
    """(pr_id, person, score, confidence): expert weights (the eight heaviest a file) plus risk scores of owned files."""
    # a file's experts are cut once, not for each pull request
    nth = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("weight"), "person"))
    known = experts.join(pr_files.select("file").distinct(), "file", "left_semi").withColumn("nth", nth).where("nth <= 8")
    one = pr_files.join(known.hint("merge"), "file").select("pr_id", "person", F.col("weight").cast("double").alias("s"))
    two = pr_files.join(risks, "file").select("pr_id", F.col("owner").alias("person"), F.col("risk").cast("double").alias("s")).where("person is not null")
    rows = one.unionByName(two).groupBy("pr_id", "person").agg(F.sum("s").alias("score"))
    best = F.row_number().over(Window.partitionBy("pr_id").orderBy(F.desc("score"), "person"))
    out = rows.withColumn("nth", best).where(F.col("nth") <= k).drop("nth")
    return out.withColumn("confidence", F.least(F.lit(100.0), F.floor(F.col("score") + 0.5)) / 100)


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """(parent, child, kind, n_children): root, first folder, file, symbol; symbols without a file are dropped."""
    files = nodes.where("type = 'file'").select("id", F.split("id", "/")[0].alias("folder"))
    symbols = nodes.where("type <> 'file'").select("id", F.substring_index("id", "::", 1).alias("file"))
    held = symbols.join(files.select(F.col("id").alias("file")), "file", "left_semi")
    per_file = held.groupBy("file").agg(F.count("*").alias("n_children"))
    a = files.groupBy("folder").agg(F.count("*").alias("n_children")).select(F.lit("root").alias("parent"), F.col("folder").alias("child"), F.lit("folder").alias("kind"), "n_children")
    b = files.join(per_file, files.id == per_file.file, "left").select(F.col("folder").alias("parent"), F.col("id").alias("child"), F.lit("file").alias("kind"), F.coalesce("n_children", F.lit(0)).alias("n_children"))
    c = held.select(F.col("file").alias("parent"), F.col("id").alias("child"), F.lit("symbol").alias("kind"), F.lit(0).cast("long").alias("n_children"))
    return a.unionByName(b).unionByName(c)


def seen(as_of, days: int):
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    return (F.col("last_login") >= cut) | (F.col("last_login").isNull() & (F.col("updated_at") >= cut))


def active_users(users: DataFrame, as_of: DataFrame, days: int = 30, use_last_login: bool = True, only_active: bool = False) -> DataFrame:
    """Users who logged in, or without a login were updated, in the last ``days``; newest login first.

    Without ``use_last_login`` their last update counts alone; with ``only_active`` closed accounts are left out.
    """
    rows = users.join(F.broadcast(as_of.limit(1))).where("is_active" if only_active else "true")
    cut = F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")
    rows = rows.where(seen(F.col("as_of"), days) if use_last_login else F.col("updated_at") >= cut).drop("as_of")
    return rows.orderBy(*([F.desc_nulls_last("last_login")] if use_last_login else []), F.desc_nulls_last("updated_at"), "id")


def count_active_users(users: DataFrame, as_of: DataFrame, days: int = 30, use_last_login: bool = True, only_active: bool = True) -> DataFrame:
    """One row: the number of active users."""
    return active_users(users, as_of, days, use_last_login, only_active).agg(F.count("*").alias("n"))


def users_in_range(users: DataFrame, start, end, use_last_login: bool = True, only_active: bool = True) -> DataFrame:
    """Users whose last login (their last update where there is none, or in its place) lies between two times, both included."""
    login, update = F.col("last_login").between(start, end), F.col("updated_at").between(start, end)
    rows = users.where("is_active" if only_active else "true").where(login | (F.col("last_login").isNull() & update) if use_last_login else update)
    return rows.orderBy(*([F.desc_nulls_last("last_login")] if use_last_login else []), F.desc_nulls_last("updated_at"), "id")


def completed_profiles(users: DataFrame, only_active: bool = True) -> DataFrame:
    """Users who completed their profile, of active accounts only where asked for."""
    return users.where("profile_completed").where("is_active" if only_active else "true")


def embedding_profile(chunks: DataFrame, expected: int, newest: int = 5) -> DataFrame:
    """(dim, n, mismatch, newest): chunks (embedding, file, created_at) by the length of their vectors, with the files of
    the newest ones; chunks without a vector have length 0."""
    rows = chunks.select(F.coalesce(F.nullif(F.size("embedding"), F.lit(-1)), F.lit(0)).cast("long").alias("dim"), "file", "created_at")
    files = rows.groupBy("dim", "file").agg(F.max("created_at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("at"), "file"))
    last = files.withColumn("nth", nth).where(F.col("nth") <= newest).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("nth", "file"))).alias("x"))
    n = rows.groupBy("dim").agg(F.count("*").alias("n"))
    return n.join(last, "dim").select("dim", "n", (F.col("dim") != expected).alias("mismatch"), F.col("x.file").alias("newest"))


def weekly_digest(nodes: DataFrame, keep: int = 10) -> DataFrame:
    """(tenant_id, unowned, incidents, files, top_files): three figures of each tenant and its files of the highest risk.

    Only the files kept are brought together; ties go to the smaller id.
    """
    unowned = F.count_if(F.col("top_owner").isNull() | F.col("top_owner").isin("", "None", "Unknown"))
    sums = nodes.groupBy("tenant_id").agg(unowned.alias("unowned"), F.sum("incidents").alias("incidents"), F.count("*").alias("files"))
    nth = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc(F.col("bus_risk") * (1 + F.col("incidents"))), "id"))
    top = nodes.withColumn("nth", nth).where(F.col("nth") <= keep).groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("t"))
    return sums.join(top.withColumnRenamed("tenant_id", "of"), F.col("tenant_id").eqNullSafe(F.col("of"))).select(*sums.columns, F.col("t.id").alias("top_files"))


def inactive_users(users: DataFrame, as_of: DataFrame, days: int = 30) -> DataFrame:
    cut = F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")
    rows = users.join(F.broadcast(as_of.limit(1))).where("is_active").where((F.col("last_login").isNull() | (F.col("last_login") < cut)) & (F.col("updated_at") < cut))
    return rows.drop("as_of")


def contribution_grid(events: DataFrame, as_of: DataFrame, types: tuple[str, ...], days: int = 364) -> DataFrame:
    """(day, one column a type, total): daily counts, each clipped at four, over a full calendar."""
    calendar = as_of.limit(1).select(F.explode(F.sequence(F.date_sub(F.col("as_of").cast("date"), days - 1), F.col("as_of").cast("date"))).alias("day"))
    counts = events.groupBy(F.col("ts").cast("date").alias("day")).agg(*[F.least(F.lit(4), F.count_if(F.col("event_type") == t)).alias(t) for t in types])
    rows = calendar.join(counts, "day", "left").na.fill(0, list(types))
    total = F.lit(0)
    for t in types:
        total = total + F.col(t)
    return rows.withColumn("total", total)


def contribution_by_prefix(repos: DataFrame, k: int = 10) -> DataFrame:
    """(prefix, commits, files): repositories grouped by the name before the first - or _."""
    rows = repos.groupBy(F.regexp_extract("name", "^([^-_]*)", 1).alias("prefix"))
    out = rows.agg(F.sum(F.greatest(F.lit(1), F.floor(F.col("stars") / 2))).alias("commits"), (F.count("*") * 10).alias("files"))
    return out.orderBy(F.desc("commits"), "prefix").limit(k)
