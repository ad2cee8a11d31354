"""Language-model scores: stupid backoff computed with joins over n-gram count tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cairn.llm.common import Workspace

#: Word numbers: 1 for the start of a text, dictionary words from 2; other words have a digest from TAIL on.
START, FIRST, TAIL = 1, 2, 1 << 62
#: Two dictionary words are one number, first * BASE + second.
BASE = 1 << 24


def split(text: str | None) -> list[bytes]:
    """Runs of characters other than blanks and \\x09-\\x0D, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Dictionary(dict):
    """Numbers of the most frequent words; any other word is known by a 62-bit digest, which Spark computes alike."""

    def __missing__(self, word: bytes) -> int:
        return (xxhash.xxh64_intdigest(word, 42) >> 2) | TAIL


def _numbers(texts: pd.Series, known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of its text, word before, word) for every word of a batch of texts, as numbers."""
    flat: list[int] = []
    lengths = []
    get = known.__getitem__
    for t in texts:
        words = split(t)
        flat.extend(map(get, words))
        lengths.append(len(words))
    ids, length = np.array(flat, np.int64), np.array(lengths, np.int64)
    before = np.concatenate([[START], ids[:-1]]) if len(ids) else ids
    before[(np.cumsum(length) - length)[length > 0]] = START
    return np.repeat(np.arange(len(length)), length), before, ids


def _slices(batch: pd.DataFrame, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``most`` characters, one row at least, so that a worker's arrays stay small."""
    part = batch["text"].str.len().fillna(0).cumsum() // most
    for _, rows in batch.groupby(part.to_numpy(), sort=False):
        yield rows


def _keys(before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, other) of each bigram: what it is dealt by, and what is needed beside that to tell it apart.

    Two dictionary words: their one number, and 0. A second word outside the dictionary: its digest, and the first
    word. Only the first one outside: its digest, negative, and the second word.
    """
    far, first = ids >= TAIL, before >= TAIL
    return np.where(far, ids, np.where(first, -before, before * BASE + ids)), np.where(far, before, np.where(first, ids, 0))


def _distinct(doc: np.ndarray, key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (doc, key, other) occurs first, and how often."""
    order = np.lexsort((other, key, doc))
    doc, key, other = doc[order], key[order], other[order]
    new = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(np.concatenate([[True], new])) if len(doc) else np.empty(0, np.int64)
    return order[first], np.diff(np.append(first, len(doc)))


class Frequent:
    """Bigrams that may make up a ``share`` of all words that a task reads, by at most ``room`` counters.

    Of a batch count those that make up a quarter of the share there. Where the counters run out, all of them fall
    (Misra and Gries), by another quarter of the share at most. So what has the share in the whole corpus has half of
    it in the sum over all tasks.
    """

    def __init__(self, share: float):
        self.room, self.share, self.seen = int(4 / share), share, 0
        self.counts: Counter[tuple[bytes, bytes]] = Counter()

    def add(self, words: list[bytes], counts: np.ndarray, before: np.ndarray, ids: np.ndarray) -> None:
        self.seen += len(ids)
        least = self.share / 4 * len(ids)
        often = counts >= least
        both = often[before] & often[ids]
        pairs, n = np.unique(before[both] * len(words) + ids[both], return_counts=True)
        for pair, m in zip(pairs[n >= least].tolist(), n[n >= least].tolist(), strict=True):
            self.counts[words[pair // len(words)], words[pair % len(words)]] += m
        if len(self.counts) > self.room:
            cut = sorted(self.counts.values(), reverse=True)[self.room]
            self.counts = Counter({k: m - cut for k, m in self.counts.items() if m > cut})

    def found(self) -> list[tuple[bytes, bytes, int]]:
        return [(v, w, n) for (v, w), n in self.counts.items() if n >= self.share / 4 * self.seen]


def _tally(share: float):
    """Batches of texts -> words with their counts and how often they end a text, and bigrams that may be frequent."""

    def run(batches):
        frequent = Frequent(share)
        for b in batches:
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            flat, ends, starts = [], [], []
            for t in b["text"]:
                words = split(t)
                if words:
                    starts.append(len(flat))
                    flat.extend(map(number.__getitem__, words))
                    ends.append(flat[-1])
            ids, names = np.array(flat, np.int64), list(number)
            n = np.bincount(ids, minlength=len(names))
            yield pd.DataFrame({"v": None, "w": names, "n": n, "last": np.bincount(np.array(ends, np.int64), minlength=len(names))})
            inner = np.ones(len(ids), bool)  # a text's first word has none before it
            inner[starts] = False
            at = np.flatnonzero(inner)
            if len(at):
                frequent.add(names, n, ids[at - 1], ids[at])
        for part in iter(lambda it=iter(frequent.found()): list(islice(it, 10_000)), []):
            yield pd.DataFrame(part, columns=["v", "w", "n"]).assign(last=0)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary_size: int = 200_000, head: int = 512, hot_share: float = 2e-4, least_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score, mean_log_score): stupid-backoff bigram scores under the corpus itself.

    Words are runs of characters other than blanks and \\x09-\\x0D, A-Z lower-cased; every word has counts of its own.
    S(w | v) is c(v w) / c(v) where the bigram occurs ``least_count`` times in the corpus or more, else ``backoff`` *
    c(w) / N; c(v) counts v as a context (the start of a text counts once a text). log_score sums natural logarithms
    over a document's words, n_seen counts the bigrams that needed no backoff. All counts cover all documents.

    Counts are tables that grow with the corpus. Of fixed size are only the ``dictionary_size`` most frequent words,
    which have short numbers (others have 62-bit digests), and counts of frequent bigrams: those of the ``head`` most
    frequent words, and all that make up ``hot_share`` of the corpus or more (4 / hot_share at most). Those go to every
    worker, so that no bigram which meets in one task holds a larger share. All other bigrams of a document are rows,
    dealt by the hash of the bigram, or of a word outside the dictionary, and counted where they meet; what a bigram
    then lacks, the count of a context outside the dictionary, is joined by its digest; scores are summed per document.

    Null or empty texts have n_words 0, log_score 0 and a null mean; rows that share an id are parts of one document;
    ids are of any type; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    no_id = -(1 << 63)  # pandas has no null for whole numbers
    rows, ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None
    if not isinstance(docs.schema[id_col].dataType, IntegralType):  # other ids are numbered
        ids = rows.where("doc_id is not null").select(F.col("doc_id").alias("named")).distinct()
        ids = work.save(ids.withColumn("number", F.monotonically_increasing_id()), "ids")
        rows = rows.join(ids, F.col("doc_id") == F.col("named"), "left").select(F.col("number").alias("doc_id"), "text")
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)).alias("doc_id"), "text")

    counted = rows.select("text").mapInPandas(_tally(hot_share), "v binary, w binary, n long, last long")
    counted = work.save(counted.groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("last").alias("last")), "counted")
    words = counted.where("v is null").select(F.col("w").alias("word"), "n", "last")
    sums = words.agg(F.sum("n"), F.sum("last")).first()
    total, texts = sums[0] or 0, sums[1] or 0
    top = work.save(words.where(f"n >= {least_count}").orderBy(F.desc("n"), "word").limit(dictionary_size), "dictionary").toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True], key=lambda c: c.map(bytes) if c.name == "word" else c, ignore_index=True)
    numbers = Dictionary({bytes(w): FIRST + i for i, w in enumerate(top["word"])})
    sent = spark.sparkContext.broadcast(dict(numbers))
    hot = counted.where("v is not null").where(F.col("n") >= hot_share / 4 * total).toPandas()
    pairs = [(numbers.get(bytes(v)), numbers.get(bytes(w))) for v, w in zip(hot["v"], hot["w"], strict=True)]
    hot_keys = np.array(sorted(v * BASE + w for v, w in pairs if v and w), np.int64)
    edge = FIRST + head  # numbers below it are of the head

    def frequent(before: np.ndarray, ids: np.ndarray, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hot_keys, key), max(0, len(hot_keys) - 1))
        return ((before < edge) & (ids < edge)) | (hot_keys[at] == key if len(hot_keys) else False)

    # exact counts of frequent bigrams
    def recount(batches):
        known = Dictionary(sent.value)
        for b in (part for whole in batches for part in _slices(whole)):
            _, before, ids = _numbers(b["text"], known)
            key, _ = _keys(before, ids)
            key, n = np.unique(key[frequent(before, ids, key)], return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})

    exact = rows.select("text").mapInPandas(recount, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    exact = work.save(exact, "frequent").where(F.col("n") >= least_count).toPandas().sort_values("key")
    n_top, last = top["n"].to_numpy(np.int64), top["last"].to_numpy(np.int64)
    context = np.log(np.maximum(1, np.concatenate([[1, texts], n_top - last])))
    back = np.log(np.maximum(1, np.concatenate([[1, 1], n_top]))) + math.log(backoff) - math.log(max(1, total))
    tables = spark.sparkContext.broadcast((exact["key"].to_numpy(np.int64), np.log(exact["n"].to_numpy(np.float64)), context, back))

    def explode(batches):
        known = Dictionary(sent.value)
        keys, log_two, context, back = tables.value
        for b in (part for whole in batches for part in _slices(whole)):
            doc, before, ids = _numbers(b["text"], known)
            n_docs, names = len(b), b["doc_id"].to_numpy()
            length = np.bincount(doc, minlength=n_docs)
            key, other = _keys(before, ids)
            at, n = _distinct(doc, key, other)
            doc, before, ids, key, other = doc[at], before[at], ids[at], key[at], other[at]
            inner = frequent(before, ids, key)
            d, k, m = doc[inner], key[inner], n[inner]
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            score = m * (np.where(hit, log_two[at] - context[k // BASE], back[k % BASE]) if len(keys) else back[k % BASE]) if len(k) else np.empty(0)
            out = ~inner
            # a document's own row: -1 - n_seen, n_words, and the score of its frequent bigrams, under any key
            spread = (names * 0x9E3779B1 + np.arange(n_docs)) % (1 << 40)
            yield pd.DataFrame(
                {
                    "doc_id": np.concatenate([names[doc[out]], names]),
                    "key": np.concatenate([key[out], spread]),
                    "other": np.concatenate([other[out], length]),
                    "n": np.concatenate([n[out], -1 - np.bincount(d, m * hit, n_docs)]).astype(np.int32),
                    "score": np.concatenate([np.zeros(out.sum()), np.bincount(d, score, n_docs)]),
                }
            )

    grams = rows.mapInPandas(explode, "doc_id long, key long, other long, n int, score double")
    # all rows of a bigram, and all of a word outside the dictionary as a second word, meet: one exchange counts both
    own, far, near = F.col("n") < 0, F.col("key") >= TAIL, F.col("key").between(0, TAIL - 1)
    n = F.greatest("n", F.lit(0))
    grams = grams.repartition("key").sortWithinPartitions("key", "other")
    grams = grams.withColumn("one", F.sum(n).over(Window.partitionBy("key"))).withColumn("two", F.sum(n).over(Window.partitionBy("key", "other")))
    v = F.when(near, F.shiftright("key", BASE.bit_length() - 1)).when(far, F.col("other"))
    w = F.when(near, F.col("key").bitwiseAND(F.lit(BASE - 1))).when(~far, F.col("other"))
    logs = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(context)), "context": context, "back": back}))
    contexts, backs = F.broadcast(logs.select(F.col("id").alias("v"), "context")), F.broadcast(logs.select(F.col("id").alias("w"), "back"))
    grams = grams.withColumns({"v": v, "w": w}).join(contexts, "v", "left").join(backs, "w", "left")
    seen = ~own & (F.col("two") >= least_count)
    # what a bigram that was seen may lack: the count of a context outside the dictionary
    lacks = F.when(seen & (F.col("key") < 0), -F.col("key")).when(seen & far & (F.col("other") >= TAIL), F.col("other"))
    unseen = F.coalesce("back", F.log("one") + F.lit(math.log(backoff) - math.log(max(1, total))))
    log = F.when(seen, F.log("two") - F.coalesce("context", F.lit(0.0))).otherwise(unseen)
    parts = grams.groupBy("doc_id", lacks.alias("digest")).agg(
        F.sum(F.when(own, F.col("other")).otherwise(0)).cast("long").alias("n_words"),
        F.sum(F.when(own, -1 - F.col("n")).when(seen, F.col("n")).otherwise(0)).cast("long").alias("n_seen"),
        F.sum(n).cast("long").alias("n"),
        F.sum(F.when(own, F.col("score")).otherwise(F.col("n") * log)).alias("score"),
    )
    parts = work.save(parts, "parts")
    digest = F.shiftrightunsigned(F.xxhash64("word"), 2).bitwiseOR(F.lit(TAIL))
    tail = words.where(f"n >= {least_count}").select(digest.alias("digest"), (F.col("n") - F.col("last")).alias("before"))
    lacking = parts.where("digest is not null").join(tail, "digest", "left")
    lacking = lacking.select("doc_id", "n_words", "n_seen", (F.col("score") - F.col("n") * F.log(F.greatest(F.coalesce("before", F.lit(1)), F.lit(1)).cast("double"))).alias("score"))
    out = parts.where("digest is null").select("doc_id", "n_words", "n_seen", "score").unionByName(lacking)
    out = out.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_seen").alias("n_seen"), F.sum("score").alias("log_score"))
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != no_id, F.col("doc_id")))
    if ids is not None:
        out = out.join(ids, F.col("doc_id") == F.col("number"), "left").select(F.col("named").alias("doc_id"), "n_words", "n_seen", "log_score")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
