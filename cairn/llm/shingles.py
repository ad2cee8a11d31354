"""Links between texts by exact Jaccard similarity of their word shingles; MinHash bands give the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Workspace
from cairn.llm.components import connected_components
from cairn.llm.decontaminate import small

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS, 0.0001; one of 0.9 never in practice.
ROWS, BANDS = 6, 30
#: Texts in question whose keys may be broadcast; more are joined by shuffling.
BROADCAST_KEYS = 500_000
_rng = np.random.default_rng(5)
_FLIP, _TIMES = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64), _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
#: Standard deviations by which a similarity estimated from a signature may be off.
SPREAD = 4.0


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all ``width``-word shingles; of all words, if they are fewer. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ROWS * BANDS hash functions."""
    out = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for a text of any length
        out = np.minimum(out, ((hashes[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0))
    return out


def bands(least: np.ndarray) -> list[int]:
    """One signed key for each band of a signature."""
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42) - (1 << 63) if len(hashes) else 0


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, key, fp, bands, sketch) per row: digests of the text and of its shingle set, and of its signature.

    ``more`` are further columns, by name, that are made in the same pass.
    """

    @F.pandas_udf("fp long, bands array<long>, sketch binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                hashes = shingle_set(t, width)
                least = signature(hashes)
                out.append((set_digest(hashes), bands(least) if len(hashes) else [], (least >> np.uint64(56)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["fp", "bands", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), sketch(F.col(text_col)).alias("s"), *[c.alias(n) for n, c in (more or {}).items()])
    return rows.select("doc_id", "key", "s.*", *(more or {}))


def _forest(fps: np.ndarray, marks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs estimated at ``least`` or more that takes the most similar first."""
    left, out = np.arange(1, len(fps)), []
    best, parent, at = np.full(len(left), -1.0), np.zeros(len(left), np.int64), 0
    while len(left):
        same = (marks[left] == marks[at]).mean(axis=1)
        closer = same > best
        best[closer], parent[closer] = same[closer], at
        nth = int(np.argmax(best))
        at = left[nth]
        if best[nth] >= least:
            out.append((int(fps[parent[nth]]), int(fps[at])))
        keep = np.arange(len(left)) != nth
        left, best, parent = left[keep], best[keep], parent[keep]
    return out


def _signatures(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, sketches)), np.uint8).reshape(len(sketches), ROWS * BANDS)


def similar_links(nodes: DataFrame, docs: DataFrame, text_col: str, work: Workspace, width: int = 5, similarity: float = 0.8, bucket_limit: int = 24, chunk: int = 512) -> DataFrame:
    """Links (a, b) of ``nodes`` (fp, key, bands, sketch), enough to connect all whose shingle sets are that similar.

    Nodes that share a band are candidates, and every candidate pair is held to the exact Jaccard similarity of both
    shingle sets, made again from the texts in question only. In a bucket of at most ``bucket_limit`` every pair is a
    candidate. A larger one is cut in chunks of about ``chunk``, and signatures, eight bits a value, estimate the
    similarity of its pairs. First come those of a spanning forest of each chunk, the most similar first; what they
    connect is one component. Then members outside a bucket's largest component are compared with all its members of
    other components, by their sets, chunk by chunk, and only links leave the task. So a crowd of near copies makes a
    pair or so for each member and band, no task holds more than two chunks, and no link between candidates is lost.
    """
    rows = nodes.select("fp", F.explode("bands").alias("band"))
    sizes = work.save(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = work.save(rows.join(sizes, "band"), "buckets")
    may = similarity - SPREAD * (similarity * (1 - similarity) / (ROWS * BANDS)) ** 0.5
    numbers = lambda n: F.sequence(F.lit(0), n - 1)

    def pairs(batches):
        for b in batches:
            found = [p for m in b["members"] for p in combinations(sorted(m), 2)]
            yield pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]}, dtype=np.int64)

    def forest(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("fp")
        found = _forest(m["fp"].to_numpy(), _signatures(m["sketch"]), may)
        return pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]}, dtype=np.int64)

    def across(key, rest: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        found = _across(rest, every, similarity) if len(rest) and len(every) else []
        return pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]}, dtype=np.int64)

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    few = met.where(F.col("n") <= bucket_limit).groupBy("band").agg(F.collect_list("fp").alias("members"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    many = met.where(F.col("n") > bucket_limit).join(nodes.select("fp", "sketch"), "fp")
    many = work.save(many.select("band", "fp", "sketch", chunks.alias("chunks"), F.pmod(F.xxhash64("fp", "band"), chunks).alias("chunk")), "crowds")
    found = few.select("members").mapInPandas(pairs, "a long, b long").unionByName(many.groupBy("band", "chunk").applyInPandas(forest, "a long, b long"))
    found = work.save(ordered(found), "candidates-1")
    links = work.save(_verified(found, nodes, docs, text_col, work, width, similarity, "1"), "links-of-trees")

    parts = connected_components(links, Workspace(work.spark, "crowds"))
    many = many.join(parts, many.fp == parts.node, "left").select("band", "fp", "sketch", "chunks", "chunk", F.coalesce("component", "fp").alias("part"))
    largest = many.groupBy("band", "part").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"))
    largest = largest.where("parts > 1").select("band", "largest", F.ceil((F.col("n") - F.col("most")) / chunk).cast("int").alias("rest_chunks"))
    many = work.save(many.join(largest, "band"), "open-crowds")
    sets = work.save(_sets(many.select("fp").distinct(), nodes, docs, text_col, work, width, "crowds"), "sets-of-crowds")
    many = many.drop("sketch").join(sets, "fp")
    rest = many.where("part <> largest").withColumn("rest_chunk", F.pmod(F.xxhash64("fp", "band"), "rest_chunks")).withColumn("chunk", F.explode(numbers(F.col("chunks"))))
    own = [F.col(c).alias(c) for c in ("band", "fp", "set", "chunk", "part")]  # columns apart from those of ``rest``
    every = many.select(*own, F.explode(numbers(F.col("rest_chunks"))).alias("rest_chunk"))
    tile = ["band", "chunk", "rest_chunk"]
    more = rest.select(*tile, "fp", "set", "part").groupBy(*tile).cogroup(every.groupBy(*tile)).applyInPandas(across, "a long, b long")
    return links.unionByName(work.save(ordered(more), "links-across"))


def _across(rest: pd.DataFrame, every: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a row of ``rest`` and one of ``every`` (fp, set, part) that have the similarity; one for each other part."""
    sizes = every["set"].map(len).to_numpy()
    values, owner = np.concatenate(every["set"].tolist()), np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fps, parts, out = every["fp"].to_numpy(), every["part"].to_numpy(), []
    for fp, own, part in zip(rest["fp"], rest["set"], rest["part"], strict=True):
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low  # where each of its shingles stands in the list of all
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(fps))
        near = np.flatnonzero((shared >= similarity * (sizes + len(own) - shared) - 1e-9) & (parts != part))
        _, first = np.unique(parts[near], return_index=True)
        out += [(int(fp), int(fps[i])) for i in near[first]]
    return out


def _verified(found: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, work: Workspace, width: int, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) of ``found`` whose shingle sets have the similarity, by the sets themselves."""
    asked = found.select("a").union(found.select("b")).distinct().withColumnRenamed("a", "fp")
    texts = work.save(_sets(asked, nodes, docs, text_col, work, width, name), f"sets-{name}")
    both = found.join(texts.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(F.col("n") >= similarity * (F.col("total") - F.col("n")) - 1e-9).select("a", "b")


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, work: Workspace, width: int, name: str) -> DataFrame:
    """(fp, set): the shingle sets of the nodes ``asked`` for (fp), made again from their texts."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in texts])

    asked = work.save(nodes.select("fp", "key").join(asked, "fp"), f"asked-{name}")
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key")).join(small(asked, BROADCAST_KEYS), "key")
    return texts.dropDuplicates(["fp"]).select("fp", hashes("text").alias("set"))
