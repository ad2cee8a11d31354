"""Periodic runs of words, found with suffix trees and the longest extensions that these answer in constant time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class SuffixTree:
    """Ukkonen's tree of a sequence of positive symbols, closed by the end mark 0.

    The suffix at i has the leaf i; the root is n, inner nodes follow. ``edges`` leads from node * base + symbol to a
    child, whose edge holds the symbols from ``start`` to ``end``; leaves end where the sequence does.
    """

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        n = self.n = root = len(s)
        base = self.base = max(s) + 1
        edges: dict[int, int] = {}
        start, end, link = [0] * (n + 1), [n] * n + [0], [root] * (n + 1)
        node, edge, length, first = root, 0, 0, 0  # the active point; first is the next suffix without a leaf
        for i, c in enumerate(s):
            above = -1  # the node made last, while its suffix link is open
            while first <= i:
                if not length:
                    edge = i
                key = node * base + s[edge]
                child = edges.get(key)
                if child is None:
                    start[first] = i
                    edges[key] = first
                    if above >= 0:
                        link[above], above = node, -1
                else:
                    at = start[child]
                    size = (end[child] if child > n else i + 1) - at
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if above >= 0:
                            link[above] = node
                        break
                    inner = len(start)
                    start.append(at)
                    end.append(at + length)
                    link.append(root)
                    edges[key] = inner
                    start[child] = at + length
                    edges[inner * base + s[at + length]] = child
                    start[first] = i
                    edges[inner * base + c] = first
                    if above >= 0:
                        link[above] = inner
                    above = inner
                first += 1
                if node != root:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = first
        self.edges, self.start, self.end = edges, start, end

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The Euler tour as depths in symbols, where each leaf stands in it, and the rank of each suffix."""
        n, base = self.n, self.base
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        child = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        order = np.argsort(keys)
        parent, inner = keys[order] // base, np.arange(n, len(self.start))
        low, high = np.searchsorted(parent, inner).tolist(), np.searchsorted(parent, inner, "right").tolist()
        children, start, end = child[order].tolist(), self.start, self.end
        depths, at, leaves = [0], [0] * n, []
        open_nodes, k, last, depth = [], low[0], high[0], 0
        while k < last or open_nodes:
            if k == last:
                k, last, depth = open_nodes.pop()
                depths.append(depth)
                continue
            x = children[k]
            k += 1
            if x < n:
                at[x] = len(depths)
                leaves.append(x)
                depths += (n - x, depth)
            else:
                open_nodes.append((k, last, depth))
                depth += end[x] - start[x]
                depths.append(depth)
                k, last = low[x - n], high[x - n]
        rank = np.empty(n, np.int64)
        rank[leaves] = np.arange(n)
        return np.array(depths, np.int64), np.array(at, np.int64), rank


class Extensions:
    """How far the suffixes at two places agree: the depth of their lowest common ancestor, in constant time.

    That is the least depth of the Euler tour between both leaves. Least depths are stored from each place to both ends
    of its block, and for every power of two of blocks, so the memory is linear in the tour.
    """

    BLOCK = 32

    def __init__(self, depths: np.ndarray, at: np.ndarray):
        self.at, b = at, self.BLOCK
        blocks = np.append(depths, np.full(-len(depths) % b, depths.max())).reshape(-1, b)
        self.depths, self.left = blocks.ravel(), np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.powers = [blocks.min(axis=1)]
        while 2 << len(self.powers) - 1 <= len(blocks):
            half, last = 1 << len(self.powers) - 1, self.powers[-1]
            self.powers.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.at[i], self.at[j]), np.maximum(self.at[i], self.at[j])
        out, a, z = np.minimum(self.right[lo], self.left[hi]), lo // self.BLOCK, hi // self.BLOCK
        between = z - a - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k, least in enumerate(self.powers):
            w = np.flatnonzero((between > 0) & (level == k))
            out[w] = np.minimum(out[w], np.minimum(least[a[w] + 1], least[z[w] - (1 << k)]))
        same = np.flatnonzero(a == z)
        for part in np.array_split(same, len(same) // 65_536 + 1):
            inside = np.minimum(lo[part, None] + np.arange(self.BLOCK), hi[part, None])
            out[part] = self.depths[inside].min(axis=1)
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """The next place of a smaller rank; -1 if there is none."""
    out, stack = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def all_runs(symbols: list[int]) -> np.ndarray:
    """Rows (start, length, period) of all runs of two periods or more, by start, then period.

    A run holds a Lyndon word of its period's length which is the longest one from its start on, in one of both orders
    of the symbols. Longest Lyndon words end before the next smaller suffix; each is extended to the right by the tree
    of the sequence, to the left by the tree of its reversal.
    """
    m = len(symbols)
    depths, at, rank = SuffixTree(symbols).tour()
    ahead = Extensions(depths, at)
    ends = [np.array(_next_smaller(r.tolist())) for r in (rank, -rank)]
    depths, at, _ = SuffixTree(symbols[::-1]).tour()
    behind = Extensions(depths, at)
    found = []
    for end in ends:
        i = np.flatnonzero(end[:m] >= 0)
        j = end[i]
        period, right, left = j - i, ahead(i, j), behind(m - i, m - j)
        long = right + left >= period
        found.append(np.stack([i - left, period + right + left, period], axis=1)[long])
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a sequence outside which no run of ``times`` periods and ``least`` words can be.

    In a run of period q every word but the first q has an equal one at most q words before. For each power of two b the
    longest stretches whose words have an equal one at most b before are looked for; those too short for a period of
    more than b / 2 are passed over. Each comes with the b words before it. Overlapping parts are united, so a run lies
    in one part as a whole, with the words that bound it wherever it does not end with the part.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    back = np.full(n, n)
    equal = ids[order[1:]] == ids[order[:-1]]
    back[order[1:][equal]] = np.diff(order)[equal]
    parts, b = [], 1
    while n >= max(least, times * (b // 2 + 1)):
        shortest = max(least - b, (times - 1) * (b // 2 + 1))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], back <= b, [False]])))
        first, end = edges[::2], edges[1::2]
        long = end - first >= shortest
        parts += zip(np.maximum(0, first[long] - b).tolist(), end[long].tolist(), strict=True)
        b *= 2
    out: list[tuple[int, int]] = []
    for a, z in sorted(parts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def word_runs(words: list[bytes], least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words and ``times`` (two or more) periods."""
    if len(words) < max(least, times):
        return np.empty((0, 3), np.int64)
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for a, z in stretches(ids, least, times):
        part = np.unique(ids[a:z], return_inverse=True)[1] + 1
        found.append(all_runs(part.tolist()) + (a, 0, 0))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return rows[(rows[:, 1] >= least) & (rows[:, 1] >= times * rows[:, 2])]


def collapsed(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, rows[:, 0] + rows[:, 2], 1)
    np.add.at(inside, rows[:, 0] + rows[:, 1], -1)
    return [w for w, k in zip(words, np.cumsum(inside).tolist(), strict=False) if not k] if len(rows) else words


def periodic_runs(docs: DataFrame, text_col: str = "text", least_words: int = 6, least_times: int = 4, rewrite: tuple[Column, Callable[[list[bytes], int], list[bytes]]] | None = None) -> DataFrame:
    """``docs`` (all columns) with ``__runs``: n_words, runs (array of start, length, period) and text without repeats.

    Words are runs of characters other than blanks and \\x09-\\x0D, numbered from 0. A run is a stretch of words with the
    smallest period q (words q apart are equal) that no neighbour extends, of ``least_words`` words and ``least_times``
    periods at least; runs come by start, then period. The text keeps the words that no run holds after its first q
    words, joined by one space.

    Suffix trees are built of those stretches of a text that can hold a run (see ``stretches``), which leaves out no run.
    Texts are rows of their own: no shuffle, and memory grows with the longest such stretch. A null text has no words, as
    an empty one; repeated rows stay; an empty table gives no rows; a column named ``__runs`` is replaced. With
    ``rewrite``, a column of whole numbers and a function of a text's words and its number, words are replaced first.
    """
    number, change = rewrite or (F.lit(0), lambda words, _: words)
    fields = "n_words long, start array<long>, length array<long>, period array<long>, text string"

    @F.pandas_udf(fields)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, numbers in batches:
            out = []
            for t, h in zip(texts, numbers, strict=True):
                words = change((t or "").encode("utf-8", "surrogatepass").split(), h)  # bytes part at ASCII blanks only
                rows = word_runs(words, least_words, least_times)
                out.append((len(words), *rows.T, b" ".join(collapsed(words, rows)).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "start", "length", "period", "text"])

    x = F.col("__runs")
    rows = docs.withColumn("__runs", run(F.col(text_col), number.cast("long")))
    return rows.withColumn("__runs", F.struct(x["n_words"].alias("n_words"), F.arrays_zip(x["start"].alias("start"), x["length"].alias("length"), x["period"].alias("period")).alias("runs"), x["text"].alias("text")))


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The contract's rewriting: where ``h`` is a multiple of ten, the words from a on repeat with period p."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest rows of ``periodic_runs`` over planted texts: one per document, nulls for the longest run where none is.

    A document without an id is not planted. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    found = periodic_runs(rows, rewrite=(h, planted))
    runs = F.col("__runs.runs")
    # the greatest length; of several the smallest start, then period
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("__runs.text"), 256).alias("collapsed_sha256"))
    length = -F.col("best.n")
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
