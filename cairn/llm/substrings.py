"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, IntegralType, LongType, StructType

from cairn.llm.common import Workspace

#: Characters below FAR have their white space and their values in tables; no white space lies beyond.
FAR = 0x3001
NEWLINE = 10
#: A sentence ends with a word that ends with one of these, and with its line.
STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)
#: A sentence is cut after every word whose hash is a multiple of PART, and MOST words after the last cut at the latest.
PART, MOST = 6, 12
#: Bases of the polynomials that hash the characters of a word, and, twice, the words of a run; the last keeps 32 bits.
BASES = (0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** k modulo 2 ** 64 for k below ``n`` at least; short rows are kept."""
    if base in known and len(known[base]) >= n:
        return known[base]
    with np.errstate(over="ignore"):
        out = np.cumprod(np.full(max(n, 4096), base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
    if len(out) <= 1 << 16:
        known[base] = out
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _between(values: np.ndarray, a: np.ndarray, z: np.ndarray, base: int) -> np.ndarray:
    """A hash of the values from each ``a`` to its ``z``: a polynomial modulo 2 ** 64, mixed.

    Sums of value * base ** place are taken once for all places; what stands before ``a`` is taken off, and the place
    of ``a`` by the inverse base.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values))[: len(values)], out=total[1:])
        inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
        return _mixed((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64))


def _values(chars: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


SOLID, VALUES = np.array([not chr(c).isspace() for c in range(FAR + 1)]), _values(np.arange(FAR + 1))


def pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of a text, where each begins, and the number of words up to the end of each piece.

    Words are runs of characters other than white space. Pieces are sentences, see STOPS; long ones are cut where
    their words say so, so cuts meet wherever a passage begins.
    """
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    near = np.minimum(chars, FAR)
    solid = SOLID[near]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    edges = np.concatenate([[0] if len(solid) and solid[0] else [], edges, [len(chars)] if len(solid) and solid[-1] else []]).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    value = VALUES[near]
    far = np.flatnonzero(near == FAR)
    value[far] = _values(chars[far])
    hashes = _between(value, starts, ends, BASES[0])
    over = np.isin(chars[ends - 1], STOPS) | (hashes % np.uint64(PART) == 0)
    line_ends = np.searchsorted(starts, np.flatnonzero(chars == NEWLINE)) - 1
    over[line_ends[line_ends >= 0]] = True
    over[-1] = True
    cuts = np.flatnonzero(over) + 1
    gaps = np.diff(cuts, prepend=0)
    more = (gaps - 1) // MOST  # cuts by length alone
    if more.any():
        after = np.repeat(cuts - gaps, more)
        nth = np.arange(len(after)) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.sort(np.concatenate([cuts, after + MOST * nth]))
    return hashes, starts, cuts


def runs(cuts: np.ndarray, least_words: int, least_pieces: int, last: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) piece of the shortest run from every piece on that has so many words and pieces, where there is one.

    With ``last``, a run ends before the piece that it names for the run's first.
    """
    begin = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    first = np.arange(len(cuts))
    end = np.maximum(first + least_pieces, np.searchsorted(cuts, begin + least_words) + 1)
    fits = end <= (len(cuts) if last is None else last)
    return first[fits], end[fits]


def run_hashes(hashes: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the words from each ``a`` to its ``z``."""
    one, two = (_between(hashes, a, z, base) for base in BASES[1:])
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans_of(texts: list[str], least_words: int, least_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first piece, hashes) of the runs of all texts, and where those of each text begin and the last ones end.

    The texts are cut and hashed as one, line after line.
    """
    hashes, starts, cuts = pieces("\n".join(texts))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bound = np.searchsorted(cuts, np.searchsorted(starts, at), "right")  # the first piece of each text
    first, end = runs(cuts, least_words, least_pieces, np.repeat(bound[1:], np.diff(bound)))
    one, two = run_hashes(hashes, np.concatenate([[0], cuts]).astype(np.int64)[first], cuts[end - 1])
    cut = np.searchsorted(first, bound)
    return (first - np.repeat(bound[:-1], np.diff(cut))).astype(np.int32), one, two, cut


def _parts(texts: pa.Array, most: int = 1 << 16) -> Iterator[slice]:
    """Consecutive texts of about ``most`` characters, one at least, so that arrays are neither many nor long."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
        yield slice(a, z)
        a = z


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, which cover it without gaps: white space goes with the piece before it."""
    _, starts, cuts = pieces(text)
    if not len(cuts):
        return [(0, len(text))] if text else []
    at = [0, *starts[cuts[:-1]].tolist(), len(text)]
    return list(zip(at, at[1:], strict=False))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 25) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without repeats, n_removed (sentences and pieces of long ones).

    A span starts at every sentence and takes as many consecutive ones as it needs for ``least_words`` words, at least
    ``least_sentences``; long sentences count as several (see ``pieces``). Its words are hashed to 96 bits. The first
    occurrence of a span is the one of the smallest doc_id (of rows that share it, the smallest hash of the text), and
    there the earliest. Sentences covered by any other occurrence are removed; white space of the rest stays as it was,
    except that white space at the end goes with the sentences before it. A text that loses nothing
    is returned unchanged, a null text as null. Shorter texts have no spans, and the few words that a repeated passage
    has after its last whole span stay. Rows equal in id and text are one document and lose the same sentences. An
    empty table gives no rows; other columns are ignored; rows with a null id come after all others.
    """
    work = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for at in _parts(texts):
                pos, one, two, cut = spans_of([t or "" for t in texts[at].to_pylist()], least_words, least_sentences)
                has = np.diff(cut) > 0
                offsets = pa.array(cut[np.append(has, True)], pa.int32())  # texts without runs have no length between
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pos, one, two)]
                own = [b.column(c)[at].filter(pa.array(has)) for c in ("id", "key")]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=["id", "key", "pos", "h1", "h2"])

    last = F.lit((1 << 63) - 1) if isinstance(docs.schema[id_col].dataType, IntegralType) else F.lit("\uffff")  # after all ids
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", last).alias("id"), F.hash("text").alias("key"))  # the key tells rows of one id apart
    to_hash = rows.select("id", "key", "text")
    found = StructType(to_hash.schema.fields[:2]).add("pos", ArrayType(IntegerType())).add("h1", ArrayType(LongType())).add("h2", ArrayType(IntegerType()))
    listed = work.save(to_hash.mapInArrow(spans, found), "spans")
    flat = listed.select("id", "key", F.explode(F.arrays_zip("pos", "h1", "h2")).alias("s")).select("id", "key", "s.*")
    # hashes that occur again, by their first part; only rows that have one are looked at further
    repeated = work.save(flat.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "repeated")
    met = work.save(flat.join(repeated, "h1"), "met")
    first = met.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "pos")).alias("first"))
    again = met.join(first, ["h1", "h2"]).where("struct(id, key, pos) <> first")
    again = work.save(again.groupBy("id", "key").agg(F.collect_set("pos").alias("at")), "repeats")

    @F.pandas_udf("text string, n_removed int")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spots in batches:
            out = []
            for t, at in zip(texts, spots, strict=True):
                n_gone = 0
                if at is not None:
                    cuts = pieces(t)[2]
                    first, end = runs(cuts, least_words, least_sentences)
                    gone = np.zeros(len(cuts) + 1, np.int64)
                    np.add.at(gone, first[at], 1)
                    np.add.at(gone, end[at], -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    n_gone = int(gone.sum())
                    t = "".join(t[a:z] for (a, z), x in zip(sentences(t), gone.tolist(), strict=True) if not x).rstrip()
                out.append((t, n_gone))
            yield pd.DataFrame(out, columns=["text", "n_removed"])

    joined = rows.join(again, ["id", "key"], "left")
    hit = F.col("at").isNotNull()  # other texts stay in the JVM
    joined = joined.withColumn("cut", cut(F.when(hit, F.col("text")), F.col("at")))
    return joined.select("doc_id", F.when(hit, F.col("cut.text")).otherwise(F.col("text")).alias("text"), F.when(hit, F.col("cut.n_removed")).otherwise(0).alias("n_removed"))
