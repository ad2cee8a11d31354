"""Near-duplicates by SimHash, found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Workspace
from cairn.llm.components import connected_components
from cairn.llm.shingles import similar_links, sketches

BITS = 64


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a whole text; see :func:`fingerprints`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, \\x20 and \\x09-\\x0D only
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    ones, total = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, total, 1 << 16):  # bounded memory for a text of any length
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One (doc_id, fp) per row of ``docs``; fp is the 64-bit fingerprint as a signed long.

    A bit is set if it is set in over half of the XXH64 (seed 42) of all ``width``-word shingles, repeats included.
    Fewer words than ``width``: the whole sequence is the one shingle. No words (null, empty, white space): 0.
    """
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(text_col, width).alias("fp"))


def fingerprint_of(text_col: str, width: int = 3) -> Column:
    """The fingerprint of a column of texts; see :func:`fingerprints`."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(F.col(text_col))


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """2^(radius+1) - 1 masks such that two words which differ in at most ``radius`` bits agree under one of them.

    Each bit position gets a non-zero vector of radius+1 bits; mask v takes the positions whose vector has an odd
    product with v. ``radius`` differing positions cannot span the space, so some v is orthogonal to all their
    vectors, and its mask leaves those positions out. Vectors are dealt evenly, so all masks are about half full.
    """
    n = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(seed).permutation([1 + i % n for i in range(BITS)])
    return [sum(1 << i for i in range(BITS) if bin(v & int(vectors[i])).count("1") % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, radius: int) -> list[int]:
    """Splits the positions outside ``mask`` in radius+1 parts: a pair within the radius agrees on one part."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def _spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within the radius among distinct ``values``: n-1 at most."""
    v, left, out = values.view(np.uint64), np.ones(len(values), bool), []
    for start in range(len(v)):
        if not left[start]:
            continue
        left[start], front = False, [start]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(v[rest] ^ v[at]) <= radius]
            left[near] = False
            out += [(int(values[at]), int(values[x])) for x in near]
            front += near.tolist()
    return out


def fingerprint_links(fps: DataFrame, work: Workspace, radius: int = 3, bucket_limit: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect all that lie within ``radius`` bits.

    Every fingerprint enters one bucket for each covering mask. A bucket of at most ``bucket_limit`` members is
    compared in one task. A larger one is not: its members are dealt to finer buckets, whose masks add to the first a
    part of the positions left out of it; the parts are one more than the radius, so no pair is lost. That repeats
    until buckets are small, which ends because the fullest mask holds a single fingerprint. The limit is 2^radius at
    least: a crowded bucket then always leaves out more positions than the radius, and no part is empty.
    """
    level, bucket_limit = 0, max(bucket_limit, 1 << radius)
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)])
    rows = fps.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    found: list[DataFrame] = []

    def link(batches):
        for b in batches:
            pairs = [p for values in b["members"] for p in _spanning_links(np.asarray(values, np.int64), radius)]
            yield pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def finer(masks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, list[int]] = {}
        for b in masks:
            known.update({m: [_signed(x) for x in _finer(int(m) & (1 << 64) - 1, radius)] for m in set(b) - set(known)})
            yield pd.Series([known[m] for m in b])

    while True:
        sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        sizes = work.save(sizes, f"sizes-{level}")
        hot = sizes.where(F.col("n") > bucket_limit)
        small = rows.join(sizes.where(F.col("n") <= bucket_limit), ["mask", "part"])
        small = small.groupBy("mask", "part").agg(F.collect_list("fp").alias("members")).select("members")
        found.append(work.save(small.mapInPandas(link, "a long, b long"), f"near-{level}"))
        if not hot.limit(1).count():
            break
        level += 1
        rows = rows.join(hot.select("mask", "part"), ["mask", "part"]).select("fp", F.explode(finer("mask")).alias("mask"))
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        rows = work.save(rows.distinct(), f"finer-{level}")
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int | None = None, similarity: float | None = None, fp_width: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id (smallest doc_id reachable over links).

    With a ``radius``, rows link if their SimHash fingerprints (of ``fp_width``-word shingles, else ``width``) differ in
    at most so many bits. With a ``similarity``, rows link if the Jaccard similarity of their sets of ``width``-word
    shingles is that or more. With both, either links them, and fp is the fingerprint; with neither, ``similarity`` is
    0.8. Without a ``radius``, fp is a digest of the set.
    Copies share a fingerprint, so only distinct fingerprints are compared, however many rows carry one. Null texts
    count as empty; repeated rows come out as often as they went in; an empty table gives no rows; a null doc_id never
    becomes a component's id unless it is alone. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    if similarity is None and radius is not None:
        fps = work.save(fingerprints(docs, id_col, text_col, fp_width or width), "fingerprints")
        nodes = work.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
        parts = connected_components(fingerprint_links(nodes.select("fp"), work, radius), work)
    else:
        more = {} if radius is None else {"simhash": fingerprint_of(text_col, fp_width or width)}
        found = work.save(sketches(docs, id_col, text_col, width, more), "sketches")
        fps = found.select("doc_id", "fp", *more)
        first = F.first(F.struct("key", "bands", "sketch")).alias("s")
        nodes = work.save(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first).select("fp", "first_id", "s.*"), "nodes")
        links = similar_links(nodes, docs, text_col, work, width, 0.8 if similarity is None else similarity)
        if radius is not None:
            links = links.unionByName(_links_of_sets(fps, work, radius))
        parts = connected_components(links, work)
    # components of fingerprints -> smallest doc_id over all their fingerprints
    member = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("comp"))
    member = work.save(member, "members")
    best = member.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    rows = fps.join(member.join(best, "comp").select("fp", "component_id"), "fp")
    return rows.select("doc_id", (F.col("simhash") if "simhash" in rows.columns else F.col("fp")).alias("fp"), "component_id")


def _links_of_sets(fps: DataFrame, work: Workspace, radius: int) -> DataFrame:
    """Links (a, b) of the shingle sets (fp) of rows whose fingerprints (simhash) lie within ``radius`` bits.

    The least set stands for its fingerprint: every other set of it links to it, and so do links of fingerprints.
    """
    both = work.save(fps.select("fp", "simhash").distinct(), "sets-of-fingerprints")
    one = work.save(both.groupBy("simhash").agg(F.min("fp").alias("one")), "fingerprints")
    near = fingerprint_links(one.select(F.col("simhash").alias("fp")), work, radius)
    near = near.join(one.select(F.col("simhash").alias("a"), F.col("one").alias("x")), "a").join(one.select(F.col("simhash").alias("b"), F.col("one").alias("y")), "b")
    same = both.join(one, "simhash").where("fp <> one").select(F.col("fp").alias("a"), F.col("one").alias("b"))
    return work.save(near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same), "links-of-fingerprints")
