"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS, UPPER = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
#: A longer run without blanks (scripts that write none, encoded data) counts by its pieces of PIECE characters.
LONGEST, PIECE = 32, 2
#: Features whose buckets a worker remembers; beyond it they are hashed each time they come.
KEPT = 300_000


def _features(word: str) -> tuple[str, str]:
    """A word, lower-cased, and its form: letters as a or A by case, digits as 9, other characters as they are."""
    form = UPPER.sub(lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "Aa" if m.group()[0].isupper() else "a", DIGITS.sub("9", word))
    return "w" + word.lower(), "f" + form


def _words(text: str) -> Counter[str]:
    """Words and their counts; a very long one as all its overlapping pieces, so that the whole text is read."""
    found = Counter(text.split())
    for word in [w for w in found if len(w) > LONGEST]:
        n = found.pop(word)
        for piece, m in Counter(map(word.__getitem__, (slice(i, i + PIECE) for i in range(len(word) - PIECE + 1)))).items():
            found[piece] += n * m
    return found


def term_counts(text: str | None, buckets: int, kept: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of hashed words and word forms of a whole text. Half of the buckets are for forms."""
    at: Counter[int] = Counter()
    half = buckets // 2
    for word, n in _words(text or "").items():
        two = kept.get(word)
        if two is None:
            w, f = _features(word)
            two = (zlib.crc32(w.encode("utf-8", "surrogatepass")) % half, half + zlib.crc32(f.encode("utf-8", "surrogatepass")) % half)
            if len(kept) < KEPT:
                kept[word] = two
        at[two[0]] += n
        at[two[1]] += n
    return np.fromiter(at.keys(), np.int64, len(at)), np.fromiter(at.values(), np.float64, len(at))


class LatentSpace:
    """Projection of weighted term counts to latent-semantic vectors of unit length."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], buckets: int, rank: int, seed: int = 7):
        rows = np.zeros((len(counts), buckets), np.float32)
        df = np.zeros(buckets)
        for at, _ in counts:
            df[at] += 1
        self.buckets = buckets
        self.idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        for i, (at, n) in enumerate(counts):
            rows[i, at] = self._weights(at, n)
        rank = max(1, min(rank, *rows.shape))
        # randomised subspace iteration for the leading right singular vectors
        basis = np.random.default_rng(seed).standard_normal((buckets, min(buckets, rank + 10))).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
        _, _, vt = np.linalg.svd(rows @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ vt.T)[:, :rank].astype(np.float32))
        self.known = self._unit(rows @ self.axes)

    def _weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[at]
        return (w / max(1e-12, np.linalg.norm(w))).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def project(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(counts), self.axes.shape[1]), np.float32)
        for i, (at, n) in enumerate(counts):
            if len(at):
                out[i] = self._weights(at, n) @ self.axes[at]
        return self._unit(out)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, power: float, prior: float) -> np.ndarray:
    """Share of label 1 among each row's nearest labelled vectors, weighted by cosine to ``power``; one prior vote.

    Exact: all products of the block with all labelled vectors. Labelled vectors that tie for the last place share it
    evenly. A row like none of them (empty text) gets the prior.
    """
    k = min(neighbours, len(known))
    if not k:
        return np.full(len(vectors), prior)
    cosine = vectors @ known.T
    last = np.partition(cosine, -k, axis=1)[:, -k][:, None]
    share = (cosine > last).astype(np.float64)
    tied = cosine == last
    share += tied * ((k - share.sum(axis=1)) / tied.sum(axis=1))[:, None]
    w = share * np.clip(cosine, 0, 1) ** power
    return (w @ labels + 0.5 * prior) / (w.sum(axis=1) + 0.5)


def held_out(id_col):
    """crc32 of the id as text, modulo 3, is 1: such rows are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 3000, buckets: int = 8192, rank: int = 64, neighbours: int = 25, power: float = 2.0, block: int = 512) -> DataFrame:
    """``docs`` (all columns) with ``held_out`` boolean, ``score`` double in 0..1 and ``predicted`` int (score >= 0.5).

    Learns from labelled rows outside the held-out third only, ``max_labelled`` of them at most, taken in the order of
    a hash of the id: half from each label where there are enough. That bound fixes what is broadcast: max_labelled x
    ``rank`` floats and the projection of ``buckets`` x ``rank``. Every document is then projected and compared with
    all labelled vectors, in blocks. Only texts enter a score. Texts may be null or empty (they get the prior vote);
    labels that are null or neither 0 nor 1, or of unknown documents, are ignored, and so are ids with both labels; a
    labelled id with several texts teaches the one of the smallest hash. Without usable labels every score is 0.5.
    Repeated rows are kept; ids may be of any type.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"), F.max(label_col).cast("int").alias("__most")).where("__label = __most").drop("__most")
    taken = known.where("__label = 0").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled // 2)
    taken = taken.unionByName(known.where("__label = 1").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled - max_labelled // 2))
    ids = spark.createDataFrame(taken.collect(), taken.schema)  # max_labelled rows at most

    def count(batches):
        kept: dict = {}
        for b in batches:
            both = [term_counts(t, buckets, kept) for t in b["text"]]
            yield pd.DataFrame({"id": b["__id"], "label": b["__label"], "at": [x[0] for x in both], "n": [x[1] for x in both]})

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "__id")
    texts = texts.groupBy("__id", "__label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = texts.select(F.col("__id").cast("string").alias("__id"), "__label", "text")
    rows = texts.mapInPandas(count, "id string, label int, at array<long>, n array<double>").collect()
    rows = sorted(rows, key=lambda r: r["id"])
    y = np.array([r["label"] for r in rows], np.float64)
    space = LatentSpace([(np.array(r["at"], np.int64), np.array(r["n"])) for r in rows], buckets, rank) if rows else None
    sent = spark.sparkContext.broadcast((space, y))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        space, y = sent.value
        kept: dict = {}
        for texts in batches:
            out = np.full(len(texts), 0.5)
            for at in range(0, len(texts) if space is not None else 0, block):
                part = space.project([term_counts(t, buckets, kept) for t in texts.iloc[at : at + block]])
                out[at : at + block] = vote(part, space.known, y, neighbours, power, 0.5)
            yield pd.Series(out)

    scored = docs.withColumn("score", score(F.col(text_col)))
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
