"""Routing, dense and keyword retrieval, rank fusion, citation checks. Requests come as tables of queries."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import distance_score, sanitize_query
from cairn.operators.insight import nodes_by_name, person_work
from cairn.operators.matching import BROADCAST_ROWS, contained, small
from cairn.sources.tables import Stages

# Keywords of the intents, in the order in which they are tried.
IMPACT = ["blast radius", "what breaks", "impact if", "affected by", "downstream", "upstream impact", "if we change", "if we remove", "ripple effect"]
LOOKUP = ["where is", "defined", "find reference", "go to"]
CALL_FLOW = ["call flow", "call chain", "calls", "called by", "trace", "path from", "flow through", "execution path", "data flow"]
ARCHITECTURE = ["architecture", "architect", "structure", "design", "system", "component", "module", "dependency", "relationship", "overview", "explain the", "how does", "path to", "selected node", "layers"]
GENERAL = ["what is", "what does", "about this", "repo about", "repository about", "explain this", "describe this", "this project", "project about", "codebase about", "about the project"]
PERSON = [
    r"what (?:is|does|are) (.+?) (?:working on|doing|contributing)",
    r"who is (.+?)(?:\?|$|\s)",
    r"(.+?) (?:is|are) (?:working on|doing|contributing)",
    r"show (?:me )?(?:what|work) (.+?) (?:is|are) (?:working on|doing)",
]
SYMBOL = [r"(?i)\bwhere is (\w+) defined\b", r"(?i)\bfind (\w+)\b", r"(?i)\blocate (\w+)\b", r"(?i)\bdefinition of (\w+)\b"]
#: intent -> (k, graph, sparse, dense weight)
WEIGHTS = {
    "person": (25, 1.2, 0.5, 0.5), "impact": (25, 1.5, 0.6, 0.6), "symbol_lookup": (20, 1.3, 1.2, 0.8),
    "call_flow": (30, 1.4, 0.8, 0.9), "architecture": (30, 1.2, 0.7, 1.0), "semantic_general": (40, 0.9, 1.0, 1.0),
}
# Words that a query's word stands for, too.
SYNONYMS = {
    "payment": ["stripe", "billing", "checkout", "charge", "invoice", "subscription", "transaction", "cart", "order", "price", "webhook"],
    "auth": ["authentication", "authorization", "jwt", "token", "oauth", "session", "login", "password", "credential", "cookie", "middleware"],
    "authentication": ["jwt", "token", "oauth", "session", "login", "password", "credential", "cookie"],
    "authorization": ["permission", "role", "acl", "policy", "guard", "access"],
    "workflow": ["pipeline", "flow", "process", "handler", "middleware", "task", "job", "queue", "worker", "scheduler"],
    "database": ["model", "schema", "migration", "orm", "query", "repository", "dao", "entity", "table"],
    "api": ["route", "endpoint", "controller", "router", "handler", "request", "response", "rest", "graphql"],
    "user": ["account", "profile", "member", "customer", "identity", "signup", "register"],
    "notification": ["email", "sms", "push", "alert", "event", "webhook", "message"],
    "upload": ["storage", "file", "s3", "blob", "image", "media", "asset"],
    "search": ["index", "query", "elasticsearch", "filter", "fuzzy", "ranking"],
    "cache": ["redis", "memcache", "ttl", "invalidate", "store"],
    "test": ["spec", "unit", "integration", "fixture", "mock", "assert"],
    "config": ["setting", "environment", "env", "configuration", "constant"],
    "error": ["exception", "handler", "logging", "monitoring", "sentry"],
}
CITATIONS = [
    r"`([^`]+\.(?:py|ts|tsx|js|jsx|go|java|rs|rb|md|yaml|yml|json|txt))(?::(\d+(?:-\d+)?))?`",
    r"\b([\w./\\-]+\.(?:py|ts|tsx|js|jsx|go|java|rs|rb|md)):(\d+)\b",
    r"\(([\w./\\-]+\.(?:py|ts|tsx|js|jsx|go|java|rs|rb|md))\)",
]
CLAIMED = r"\b([A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]{3,})\b"
STOP = ["the", "this", "that", "when", "where", "what", "how", "file", "class", "function", "module", "import", "return", "true", "false", "none", "null"]


def extract_person(text: Column) -> Column:
    """The name asked about, or null: more than two characters and not starting with ``the``."""
    low = F.lower(text)
    names = [F.trim(F.regexp_extract(low, p, 1)) for p in PERSON]
    return F.coalesce(*[F.when((F.length(n) > 2) & ~F.startswith(n, F.lit("the ")), n) for n in names])


def extract_symbols(text: Column) -> Column:
    """Quoted strings, symbols asked for, then snake_case words; each once ignoring case, in order of discovery."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), lambda s: F.trim(s))
    found = [F.filter(quoted, lambda s: F.length(s) > 2)]
    found += [F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: F.length(s) > 2) for p in SYMBOL]
    found += [F.filter(F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*(?:_[a-zA-Z0-9_]+)+)\b"), F.lit(1)), lambda s: F.length(s) > 5)]
    every = F.filter(F.concat(*found), lambda s: ~F.lower(s).isin("the", "selected", "node", "path", "to"))
    low = F.transform(every, lambda s: F.lower(s))
    return F.filter(every, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def _any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def route_query(queries: DataFrame, k: int = 10) -> DataFrame:
    """queries (query_id, text) with intent, k and the weights of the graph, sparse and dense channels."""
    t = F.col("text")
    intent = (
        F.when(extract_person(t).isNotNull(), "person")
        .when(_any(t, IMPACT), "impact")
        .when((F.size(extract_symbols(t)) > 0) | _any(t, LOOKUP), "symbol_lookup")
        .when(_any(t, CALL_FLOW), "call_flow")
        .when(_any(t, ARCHITECTURE), "architecture")
        .when(_any(t, GENERAL), "semantic_general")
        .otherwise("semantic")
    )
    out = queries.withColumn("route", intent)
    pick = lambda i, default: F.coalesce(*[F.when(F.col("route") == n, F.lit(w[i])) for n, w in WEIGHTS.items()], F.lit(default))
    out = out.withColumns({"k": F.greatest(F.lit(k), pick(0, k)), "graph_weight": pick(1, 0.8), "sparse_weight": pick(2, 1.0), "dense_weight": pick(3, 1.0)})
    return out.withColumn("intent", F.regexp_replace("route", "_general$", "")).drop("route")


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), lambda t: F.length(t) >= 2)


def expand_tokens(text: Column) -> Column:
    """Synonyms of a query's tokens that it does not hold already, in table order."""
    table = F.create_map(*[x for key, found in SYNONYMS.items() for x in (F.lit(key), F.array(*map(F.lit, found)))])
    held = tokens(text)
    new = F.flatten(F.transform(F.filter(held, lambda t: F.map_contains_key(table, t)), lambda t: F.element_at(table, t)))
    return F.array_except(F.array_distinct(new), held)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Rows with ``rank`` 1..k within each query_id."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)


def dense_search(queries: DataFrame, chunks: DataFrame, k: int, block: int = 50_000, part: int = 1 << 16) -> DataFrame:
    """(query_id, id, score, rank): exact cosine search of chunks (id, embedding) for queries (query_id, vector).

    Every query meets every chunk: queries are dealt to blocks of about ``block``, chunks to parts of about ``part``, and
    of a block and a part that meet in a task the ``k`` best of each query leave it. So what is shuffled grows with the
    chunks times the blocks, and no query goes to the driver. Vectors of different length, null or zero never match. Ids
    are whole numbers.
    """
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("x")).where("size(x) > 0")
    c = chunks.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    blocks, parts = (max(1, -(-df.count() // most)) for df, most in ((q, block), (c, part)))
    own = ["length", "block", "part"]
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.size("x").alias("length"), dealt("query_id", blocks).alias("block"), "query_id", "x").withColumn("part", every(parts))
    c = c.select(F.size("embedding").alias("length"), dealt("id", parts).alias("part"), "id", "embedding").withColumn("block", every(blocks))

    def near(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            sent = SimpleNamespace(value={int(key[0]): (asked["query_id"].to_numpy(), _unit(np.array(asked["x"].tolist())))})
            found = list(_best(sent, k)([held]))
        return found[0] if found else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    met = q.groupBy(*own).cogroup(c.groupBy(*own)).applyInPandas(near, "query_id long, id long, score double")
    return top_k(met, k, F.desc("score"), F.col("id"))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


#: Scores that a task holds at once.
TILE = 1 << 22


def _best(sent, k: int):
    """For batches of chunks, the ``k`` nearest of each query of ``sent.value``, which holds the ids and unit vectors of
    queries by their length; ties of the rounded score to the smaller id."""

    def run(batches):
        best: dict[int, tuple] = {}  # by length: place of the query, id and rounded score, in order
        for b in batches:
            for n, (ids, vectors) in sent.value.items():
                at = b["embedding"].map(lambda x, n=n: x is not None and len(x) == n).to_numpy(bool)
                if not at.any():
                    continue
                own, unit = b["id"].to_numpy()[at], _unit(np.array(b["embedding"][at].tolist()))
                found = list(_nearest(vectors, unit, own, k))
                found = [np.concatenate(x) for x in zip(*([best[n]] if n in best else []), *found, strict=True)]
                if found:
                    best[n] = _first(*found, k) if n in best else tuple(found)
        for n, (place, known, held) in best.items():
            yield pd.DataFrame({"query_id": sent.value[n][0][place], "id": known, "score": held})

    return run


def _first(place: np.ndarray, known: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each place, ties to the smaller id, in order."""
    order = np.lexsort((known, -held, place))
    place, known, held = place[order], known[order], held[order]
    keep = np.arange(len(place)) - np.searchsorted(place, place, side="left") < k
    return place[keep], known[keep], held[keep]


def _nearest(vectors: np.ndarray, unit: np.ndarray, own: np.ndarray, k: int):
    """Yields (place of the query, id, score rounded to nine digits): the ``k`` nearest rows of ``unit`` of each of ``vectors``.

    A tile of queries is scored against all rows in single precision. A share of the rows gives a bound for each query,
    what reaches it gives a closer one, and what reaches that, but for the error of single precision, is scored in double.
    """
    asked, rows = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (vectors, unit))
    q, c, n = vectors[asked].astype(np.float32), np.ascontiguousarray(unit[rows].T.astype(np.float32)), len(rows)
    slack = np.float32(2 * (vectors.shape[1] + 4) * 2.0**-24 + 2e-9)  # of two rounded dot products of unit vectors, and of nine digits
    step, some = max(1, TILE // max(1, n)), min(n, max(4 * k, n // 16))
    for start in range(0, len(q) if n else 0, step):
        score = q[start : start + step] @ c
        if n > k:
            last = np.partition(score[:, :some], some - k, axis=1)[:, some - k]
            i, j = np.nonzero(score >= (last - slack)[:, None])
            rough = score[i, j]
            order = np.lexsort((-rough, i))
            i, j, rough = i[order], j[order], rough[order]
            last = rough[np.searchsorted(i, np.arange(len(score))) + k - 1]
            near = rough >= (last - slack)[i]
            i, j = i[near], j[near]
        else:
            i, j = np.divmod(np.arange(score.size), n)
        exact = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            few = slice(at, at + (1 << 16))
            exact[few] = np.einsum("ij,ij->i", vectors[asked[start + i[few]]], unit[rows[j[few]]])
        yield _first(asked[start + i], own[rows[j]], np.round(exact, 9), k)


def words(content: Column) -> Column:
    return F.filter(F.split(F.lower(content), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, length) of chunks (id, content); with ``terms`` (term), only of those, which leave before any shuffle."""
    t = chunks.select("id", words(F.col("content")).alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    if terms is not None:
        t = t.join(small(terms), "term", "left_semi")
    return t.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def sparse_search(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, stages: Stages | None = None) -> DataFrame:
    """(query_id, id, score, rank): chunks that hold all of a query's terms, ranked by BM25.

    Only postings of asked terms are dealt out. ``queries`` may have a column ``files`` (an array, null or empty: no
    filter) that restricts candidates to chunks whose ``file`` contains, or is contained in, one of them. With
    ``stages`` what is used more than once is written and not computed again. ``keyword_index.KeywordIndex`` keeps
    postings from one batch of queries to the next.
    """
    own = ["files"] if "files" in queries.columns else []
    q = queries.select(F.lit("").alias("tenant_id"), "query_id", tokens(sanitize_query(F.col("text"))).alias("terms"), *own)
    split = chunks.select("id", words(F.col("content")).alias("w"), *(["file"] if own else []))
    lengths = split.select(F.lit("").alias("tenant_id"), "id", F.size("w").alias("length"), *(["file"] if own else []))
    if stages:
        q, lengths = stages.keep(q), stages.keep(lengths)
    some = postings(chunks, q.select(F.explode("terms").alias("term")).distinct()).withColumn("tenant_id", F.lit(""))
    if stages:
        some = stages.keep(some)
    # every word of two characters or more counts; chunks without any do not
    whole = lengths.where("length > 0").groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    return rank_postings(q, some, whole, lengths, k, k1, b)


#: Postings that one task holds, about, and queries that it answers at once.
PART_POSTINGS, QUERY_BLOCK = 4_000_000, 100_000


def rank_postings(queries: DataFrame, some: DataFrame, whole: DataFrame, files: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): BM25 of the chunks that hold all terms of queries (tenant_id, query_id, terms).

    ``some`` are postings (tenant_id, term, id, tf, length) of the terms asked for, ``whole`` is (tenant_id, n_docs,
    mean). Chunks are dealt to parts, and each part gives the best of every query only: what is dealt out does not grow
    with queries times chunks. Where a query has ``files``, its candidates are those of its rarest term, held to them by
    ``files`` (tenant_id, id, file), and its other terms are looked up for these alone.
    """
    df = some.groupBy("tenant_id", "term").agg(F.count("*").alias("df"))
    if "files" not in queries.columns:
        scored = _rank_in_parts(queries, some, df, whole, k, k1, b)
    else:
        bound = F.coalesce(F.size("files"), F.lit(0)) > 0
        scored = _rank_in_parts(queries.where(~bound), some, df, whole, k, k1, b).unionByName(_rank_in_files(queries.where(bound), some, df, whole, files, k1, b))
    return top_k(scored.select("query_id", "id", F.round("score", 6).alias("score")), k, F.desc("score"), F.col("id"))


def _rank_in_parts(queries: DataFrame, some: DataFrame, df: DataFrame, whole: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, id, score): of every part of the chunks those that may be among the ``k`` best of a query."""
    parts = max(8, -(-some.count() // PART_POSTINGS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["tenant_id", "part", "block"]
    lists = some.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("tenant_id", "part", "term").agg(F.collect_list(F.col("id")).alias("ids"), F.collect_list(F.col("tf").cast("int")).alias("tf"), F.collect_list(F.col("length").cast("int")).alias("length"))
    lists = lists.withColumn("block", each(blocks))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = queries.select("tenant_id", "query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(df, ["tenant_id", "term"]).join(whole, "tenant_id")
    terms = terms.groupBy("tenant_id", "query_id", "n_terms", "mean").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t")).where("size(t) = n_terms")
    terms = terms.select("tenant_id", "query_id", "mean", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", each(parts))

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found, order = {}, [np.argsort(x) for x in held["ids"]]
        for term, at, ids, tf, length in zip(held["term"], order, held["ids"], held["tf"], held["length"]):
            found[term] = ids[at], tf[at], length[at]
        out = []
        for query, mean, terms, idfs in zip(asked["query_id"], asked["mean"], asked["terms"], asked["idfs"]):
            if any(t not in found for t in terms):
                continue
            ids = min((found[t][0] for t in terms), key=len)
            places = []
            for t in terms:
                at = np.searchsorted(found[t][0], ids)
                at[at == len(found[t][0])] = 0
                hit = found[t][0][at] == ids
                ids, places = ids[hit], [p[hit] for p in places] + [at[hit]]
            score = np.zeros(len(ids))
            for t, idf, at in zip(terms, idfs, places):
                _, tf, length = found[t]
                score = score + idf * tf[at] * (k1 + 1) / (tf[at] + k1 * (1 - b + b * length[at] / mean))
            if len(ids) > k:  # rounding to six digits moves a score by less; of equal ones the first k by id
                near = score >= np.partition(score, -k)[-k] - 2e-6
                ids, score = ids[near], score[near]
                at = np.lexsort((ids, -score))
                ids, score = ids[at], score[at]
                near = np.arange(len(ids)) - np.searchsorted(-score, -score, side="left") < k
                ids, score = ids[near], score[near]
            out.append((query, ids, score))
        n = [len(x[1]) for x in out]
        none = np.empty(0)
        return pd.DataFrame({"query_id": np.repeat(np.array([x[0] for x in out], dtype=asked["query_id"].dtype), n), "id": np.concatenate([none.astype("int64"), *[x[1] for x in out]]), "score": np.concatenate([none, *[x[2] for x in out]])})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {some.schema['id'].dataType.simpleString()}, score double"
    return lists.groupBy(*own).cogroup(terms.groupBy(*own)).applyInPandas(best, schema)


def _rank_in_files(queries: DataFrame, some: DataFrame, df: DataFrame, whole: DataFrame, files: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of all chunks in a file that contains, or is contained in, one of the query's ``files``."""
    wanted = queries.select("tenant_id", "query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    wanted = wanted.join(df, ["tenant_id", "term"], "left")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term"))
    first = wanted.withColumn("nth", nth).where("nth = 1 and df > 0").select("tenant_id", "query_id", "term")
    candidates = first.join(some.select("tenant_id", "term", "id"), ["tenant_id", "term"]).select("tenant_id", "query_id", "id")
    near = F.exists("files", lambda f: F.contains(F.col("__file"), f) | F.contains(f, F.col("__file")))
    candidates = candidates.join(files.select("tenant_id", "id", F.col("file").alias("__file")), ["tenant_id", "id"]).join(queries.select("query_id", "files"), "query_id")
    candidates = candidates.where(near).select("tenant_id", "query_id", "id")
    found = candidates.join(wanted.select("query_id", "n_terms", "term", "df"), "query_id").join(some, ["tenant_id", "term", "id"])
    full = found.groupBy("tenant_id", "query_id", "id").agg(F.count("*").alias("n"), F.max("n_terms").alias("n_terms"), F.max("length").alias("length"), F.collect_list(F.struct("term", "tf", "df")).alias("t")).where("n = n_terms")
    full = full.join(whole, "tenant_id")
    idf = lambda x: F.log(1 + (F.col("n_docs") - x["df"] + 0.5) / (x["df"] + 0.5))
    part = lambda x: idf(x) * x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    score = F.aggregate(F.sort_array("t"), F.lit(0.0), lambda s, x: s + part(x))
    return full.select("query_id", "id", score.alias("score"))


def in_files(rows: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` (query_id, id, ...) of chunks whose ``file`` holds, or is held by, one of the query's ``files``, if it has any."""
    own = rows.columns
    asked = queries.select("query_id", "files")
    files = chunks.select("id", F.col("file").alias("__file"))
    near = F.exists("files", lambda f: F.contains(F.col("__file"), f) | F.contains(f, F.col("__file")))
    return rows.join(files, "id").join(asked, "query_id").where((F.coalesce(F.size("files"), F.lit(0)) <= 0) | near).select(*own)


def keyword_fallback(queries: DataFrame, chunks: DataFrame, hits: DataFrame, k: int, stages: Stages | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries without a hit: chunks that hold the first token, shortest first.

    A token is inside a word, so tokens are matched to the corpus's distinct words, and these to the chunks. Of each
    token (and set of files, where queries have ``files``) the ``k`` shortest chunks are kept before tokens meet their
    questions. With ``stages`` what is counted or used twice is written first.
    """
    keep = stages.keep if stages else lambda df: df
    token = F.try_element_at(tokens(sanitize_query(F.col("text"))), F.lit(1))
    own = ["files"] if "files" in queries.columns else []
    left = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", token.alias("term"), *own).where("term is not null")
    left = keep(left)
    held = chunks.select("id", F.length("content").alias("length"), F.explode(F.array_distinct(words(F.col("content")))).alias("text"), *(["file"] if own else []))
    pairs = keep(contained(left, held))
    rows = held.join(small(pairs), "text").select("term", "id", "length", *(["file"] if own else [])).distinct()
    if own:
        asked = left.select("term", "files").distinct()
        free = asked.where(F.coalesce(F.size("files"), F.lit(0)) <= 0)
        bound = asked.select("term", "files", F.explode("files").alias("one"))
        near = F.contains("file", "one") | F.contains("one", "file")
        held_to = rows.join(bound, "term").where(near).select("term", "id", "length", "files").distinct()
        rows = rows.join(free, "term").select("term", "id", "length", "files").unionByName(held_to)
    nth = F.row_number().over(Window.partitionBy("term", *own).orderBy("length", "id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("term").alias("__term"), "id", "length", *[F.col(c).alias("__files") for c in own])
    same = F.col("term") == F.col("__term")
    rows = left.join(rows, same & F.col("files").eqNullSafe(F.col("__files")) if own else same).select("query_id", "id", "length")
    return top_k(rows.withColumn("score", F.lit(0.5)), k, F.col("length"), F.col("id")).drop("length")


def seed_nodes(queries: DataFrame, chunks: DataFrame, k: int = 15, found: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): nodes of the 3 k nearest chunks (id, embedding, node), each by its nearest; score 0 is best.

    ``found`` is what dense_search returned for as many chunks or more, if it is there already.
    """
    rows = dense_search(queries, chunks, 3 * k) if found is None else found.where(F.col("rank") <= 3 * k)
    rows = rows.withColumnRenamed("id", "chunk").join(chunks.select(F.col("id").alias("chunk"), "node"), "chunk")
    best = rows.groupBy("query_id", F.col("node").alias("id")).agg(F.max("score").alias("score"))
    return top_k(best.withColumn("score", distance_score(1 - F.col("score"))), k, F.col("score"), F.col("id"))


def fused_seed_nodes(routed: DataFrame, chunks: DataFrame, k: int = 15, stages: Stages | None = None, hits: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): nodes of chunks found by vectors and by keywords (``hits``, or 2 k, each), fused by weight.

    ``routed`` is what route_query returns, with ``vector``; chunks are (id, content, embedding, node). ``found`` is what
    dense_search returned for as many chunks or more, if it is there already.
    """
    hits = hits or 2 * k
    node = chunks.select(F.col("id").alias("chunk"), "node")
    dense = dense_search(routed, chunks, hits) if found is None else found.where(F.col("rank") <= hits)
    both = [("dense", dense), ("sparse", sparse_search(routed, chunks, hits, stages=stages))]
    fused = rrf(_union(both, node), _weights(routed, [name for name, _ in both]))
    return fused.where(F.col("rank") <= k).select("query_id", F.col("key").alias("id"), "score", "rank")


def _union(channels: list[tuple[str, DataFrame]], node: DataFrame) -> DataFrame:
    """(query_id, channel, rank, key): ranked chunks under the id of their node, the best rank of each."""
    out = None
    for name, df in channels:
        one = df.select("query_id", "rank", F.col("id").alias("chunk")).join(node, "chunk").groupBy("query_id", F.col("node").alias("key")).agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _weights(routed: DataFrame, channels: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_weight").alias("weight")) for c in channels])
    return routed.select("query_id", F.explode(each).alias("w")).select("query_id", "w.channel", "w.weight")


def graph_search(routed: DataFrame, anchors: DataFrame, nodes: DataFrame, edges: DataFrame, ownership: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, rank, key, content): what the graph says about a query, ``k`` rows at most.

    ``routed`` has query_id, intent, person (or null) and files, the files of nodes that the query names (an array);
    ``anchors`` is (query_id, file, place), files that a search found. In order: the links of the named files, under
    each of them; the files that the person works on; the links of the ten first anchors, the named files before the
    found ones, under each of them (20 lines, 50 for questions of architecture and call flow); and for questions
    without an anchor, of architecture or of no other intent, the overview: five links of each of the first 80 files.
    Lines read ``source --[RELATION]--> target``.
    """
    line = F.concat(F.col("src"), F.lit(" --["), F.col("relation"), F.lit("]--> "), F.col("dst"))
    named = routed.select("query_id", F.posexplode(F.coalesce("files", F.array().cast("array<string>"))).alias("place", "file"))
    far = F.lit(1 << 20)
    both = named.unionByName(anchors.select("query_id", (F.col("place") + far).cast("int").alias("place"), "file")).groupBy("query_id", "file").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "file"))
    both = both.withColumn("nth", nth).where("nth <= 10").join(routed.select("query_id", "intent"), "query_id")
    # only links of files that are asked for are made lines of and dealt out
    asked = named.select("file").unionByName(both.select("file")).distinct()
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = lambda end: edges.join(F.broadcast(asked) if few else asked.hint("merge"), F.col(end) == F.col("file"), "left_semi").select(F.col(end).alias("file"), line.alias("line"))
    links = met("src").unionByName(met("dst")).distinct()

    def text(rows: DataFrame, most) -> DataFrame:
        """(query_id, content): the first distinct lines, sorted."""
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("line"))
        rows = rows.distinct().withColumn("place", place).where(F.col("place") <= most)
        return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content"))

    of_named = text(named.join(links, "file").select("query_id", "line"), 20)
    symbol = named.join(of_named, "query_id").select("query_id", F.lit(0).alias("part"), F.col("place"), F.col("file").alias("key"), F.substring("content", 1, 8000).alias("content"))

    asks = routed.where("person is not null").select("query_id", "person")
    work = person_work(asks.select("person").distinct(), nodes, ownership)
    work = text(asks.join(work, "person").select("query_id", F.concat("role", F.lit(" "), "id").alias("line")), 50).join(asks, "query_id")
    person = work.select("query_id", F.lit(1).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("person:"), "person").alias("key"), F.substring("content", 1, 8000).alias("content"))

    wide = F.col("intent").isin("architecture", "call_flow")
    around = both.join(links, "file")
    around = text(around.where(wide).select("query_id", "line"), 50).unionByName(text(around.where(~wide).select("query_id", "line"), 20))
    expansion = both.join(around, "query_id").select("query_id", F.lit(2).alias("part"), F.col("nth").alias("place"), F.concat(F.lit("graph:"), "file").alias("key"), F.substring("content", 1, 6000).alias("content"))

    general = routed.where(F.col("intent").isin("architecture", "semantic")).join(both.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst", "relation"))
    first = edges.join(small(nodes.where("type = 'file'").select(F.col("id").alias("src")).orderBy("src").limit(80)), "src", "left_semi")
    first = first.withColumn("place", place).where("place <= 5").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("content"))  # 400 lines
    overview = general.join(F.broadcast(first.limit(1))).where("content <> ''").select("query_id", F.lit(3).alias("part"), F.lit(0).alias("place"), F.lit("graph:overview").alias("key"), F.substring("content", 1, 8000).alias("content"))

    rows = symbol.unionByName(person).unionByName(expansion).unionByName(overview)
    return top_k(rows, k, F.col("part"), F.col("place"), F.col("key")).select("query_id", "rank", "key", "content")


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, ownership: DataFrame, stages: Stages, k: int = 20, budget: int = 120_000, scorer=None) -> DataFrame:
    """(query_id, intent, rank, key, score, content): the context of each query, from three channels.

    ``queries`` is (query_id, text, vector); chunks are (id, content, embedding, node, file). A query is routed; nodes
    that it names (20 at most) give files, and then only chunks of such files count, of twice as many by vectors as
    are kept. Vectors, keywords (or the first token, where no chunk holds all) and the graph are fused by the route's
    weights, under node ids, with the longest content; the first ones are kept, within a budget of characters.
    """
    routed = route_query(queries, k)
    terms = routed.select("query_id", F.explode(extract_symbols(F.col("text"))).alias("term"))
    matched = nodes_by_name(terms, nodes, 20)
    files = matched.groupBy("query_id").agg(F.array_sort(F.collect_set(F.substring_index("id", "::", 1))).alias("files"))
    routed = routed.withColumn("person", extract_person(F.col("text"))).join(files, "query_id", "left")
    routed = stages.keep(routed)
    most = routed.agg(F.max("k")).first()[0] or k

    def cut(df: DataFrame) -> DataFrame:
        """Ranked anew, at most the query's own k."""
        near = top_k(df.drop("rank"), most, F.desc("score"), *([F.col("length")] if "length" in df.columns else []), F.col("id"))
        return near.join(routed.select("query_id", "k"), "query_id").where("rank <= k").drop("k")

    wide = dense_search(routed, chunks, 2 * most).join(routed.select("query_id", "k"), "query_id").where("rank <= 2 * k").drop("k")
    dense = stages.keep(cut(in_files(wide, routed, chunks)))
    sparse = sparse_search(routed, chunks, most, stages=stages).join(routed.select("query_id", "k"), "query_id").where("rank <= k").drop("k")
    sparse = stages.keep(sparse)
    fallback = keyword_fallback(routed, chunks, sparse, most, stages).join(routed.select("query_id", "k"), "query_id").where("rank <= k").drop("k")
    fallback = stages.keep(fallback)
    places = dense.join(chunks.select("id", "file"), "id").groupBy("query_id", "file").agg(F.min("rank").alias("place"))
    graph = stages.keep(graph_search(routed, places, nodes, edges, ownership))

    text = chunks.select(F.col("node").alias("key"), "content")
    found = _union([("dense", dense), ("sparse", sparse.unionByName(fallback))], chunks.select(F.col("id").alias("chunk"), "node"))
    wanted = found.select("key").distinct()
    contents = text.join(small(wanted), "key", "left_semi").groupBy("key").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))
    found = found.join(contents, "key").unionByName(graph.withColumn("channel", F.lit("graph")), allowMissingColumns=True)
    fused = rrf(found, _weights(routed, ["dense", "sparse", "graph"]), content=True)
    kept = context_budget(rerank(fused.join(routed.select("query_id", "text"), "query_id"), scorer), budget)
    return kept.join(routed.select("query_id", "intent"), "query_id").select("query_id", "intent", "rank", "key", "score", "content")


def search_code(queries: DataFrame, chunks: DataFrame, k: int = 10, stages: Stages | None = None) -> DataFrame:
    """(query_id, channel, rank, id, preview): dense and sparse hits side by side, 300 characters of each."""
    dense, sparse = dense_search(queries, chunks, k), sparse_search(queries, chunks, k, stages=stages)
    rows = dense.select("query_id", F.lit("dense").alias("channel"), "rank", "id").unionByName(sparse.select("query_id", F.lit("sparse").alias("channel"), "rank", "id"))
    return rows.join(chunks.select("id", F.substring("content", 1, 300).alias("preview")), "id").select("query_id", "channel", "rank", "id", "preview")


def rrf(ranked: DataFrame, weights: DataFrame, k: int = 60, content: bool = False) -> DataFrame:
    """(query_id, key, score, rank): reciprocal rank fusion of (query_id, channel, rank, key) with weights per channel."""
    rows = ranked.join(weights, ["query_id", "channel"])
    best = rows.groupBy("query_id", "key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("s"), *([F.max_by("content", F.struct(F.length("content"), "content")).alias("content")] if content else []))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return best.withColumn("score", F.round("s", 6)).drop("s").withColumn("rank", nth)


def rerank(ranked: DataFrame, scorer=None, first: int = 20, keep: int = 8) -> DataFrame:
    """Cuts each query's list to ``keep``; with a ``scorer`` (query, content -> column) the first ones are re-ordered."""
    cut = ranked.where(F.col("rank") <= (first if scorer else keep))
    if scorer is None:
        return cut
    return top_k(cut.drop("rank").withColumn("score", scorer(F.col("text"), F.substring("content", 1, 4000))), keep, F.desc("score"), F.col("key"))


def context_budget(ranked: DataFrame, budget: int = 120_000) -> DataFrame:
    """Blocks (query_id, rank, content) whose running length stays within ``budget`` characters."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum(F.length("content")).over(w)).where(F.col("running") <= budget)


def extract_citations(text: Column) -> Column:
    """Cited paths, with their line where one is given, in order of the three patterns, each once."""
    found = []
    for i, p in enumerate(CITATIONS):
        paths = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: F.replace(s, F.lit("\\"), F.lit("/")))
        if i < 2:  # these two give a line, too
            lines = F.regexp_extract_all(text, F.lit(p), F.lit(2))
            paths = F.zip_with(paths, lines, lambda a, b: F.when(F.coalesce(b, F.lit("")) != "", F.concat(a, F.lit(":"), b)).otherwise(a))
        found.append(paths)
    return F.array_distinct(F.concat(*found))


def verify_citations(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, context) with n_found, n_verified, n_failed and passed."""
    cites = answers.select("query_id", F.lower("context").alias("context"), extract_citations(F.col("answer")).alias("cites"))
    path = lambda c: F.lower(F.regexp_replace(c, r":\d+(-\d+)?$", ""))
    held = lambda c: F.contains(F.col("context"), path(c)) | F.contains(F.col("context"), F.element_at(F.split(path(c), "/"), -1))
    n = F.size("cites")
    ok = F.size(F.filter("cites", held))
    out = cites.select("query_id", n.alias("n_found"), ok.alias("n_verified"), (n - ok).alias("n_failed"))
    return out.withColumn("passed", (F.col("n_failed") == 0) | ((F.col("n_verified") > 0) & (F.col("n_failed") <= F.col("n_verified"))))


def ungrounded_symbols(answers: DataFrame, keep: int = 20) -> DataFrame:
    """(query_id, symbols): identifiers of an answer that its context does not hold, sorted, ``keep`` at most."""
    s = F.array_distinct(F.regexp_extract_all("answer", F.lit(CLAIMED), F.lit(1)))
    s = F.filter(s, lambda x: (F.length(x) > 3) & ~F.lower(x).isin(*STOP) & ~F.contains(F.lower("context"), F.lower(x)))
    return answers.select("query_id", F.slice(F.array_sort(s), 1, keep).alias("symbols"))


def retrieval_benchmark(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall at each k and MRR of runs (query_id, id, rank) against qrels (query_id, id)."""
    r = qrels.join(runs, ["query_id", "id"], "left")
    per = r.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), *[F.round(F.avg(F.col(f"h{k}") / F.col("n")), 6).alias(f"recall_{k}") for k in ks])


def embed_chunks(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding): hashed bag of words, md5 bucket modulo ``dim``, unit length; empty texts give a zero vector."""
    t = chunks.select("id", F.explode_outer(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)).alias("term"))
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    per = t.groupBy("id", bucket.alias("b")).agg(F.count("term").alias("n"))
    maps = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "n")))).alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.greatest(F.lit(1e-12), F.sqrt("sq"))
    return maps.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"))
