"""Benchmark decontamination over a distributed positional inverted index; DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Workspace, ascii_lower

#: What separates words: ASCII characters that are neither digits nor letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A vocabulary of at most so many terms (some 20 MB) is broadcast; a larger one is joined by shuffling.
BROADCAST_TERMS = 200_000
#: Candidate documents whose ids may be broadcast (some 12 MB); more are joined by shuffling.
BROADCAST_DOCS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a written table of at most ``rows`` rows; a larger one is left to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """Words as an array, case kept. A null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


@dataclass
class PhraseIndex:
    """Stored postings (row, term_id, pos) of the terms that the tests use; per row its doc_id and number of words.

    A row of the documents is known by a number of its own, so rows that share a doc_id stay apart.
    """

    postings: DataFrame
    lengths: DataFrame
    work: Workspace


def test_terms(tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, row, pos, term, n): the lower-cased words of the distinct test rows, whose numbers hold once written."""
    rows = tests.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    rows = rows.select("item_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    rows = rows.select("item_id", "row", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    return rows.select("item_id", "row", "n", "pos", ascii_lower(F.col("word")).alias("term"))


def build_index(docs: DataFrame, vocabulary: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> PhraseIndex:
    """Postings of ``vocabulary`` (term, term_id) in all texts, written once, in document order, without a shuffle.

    Every text ends with an empty word of term 0, whose position is the number of words; it alone carries the doc_id.
    """
    known = small(vocabulary, broadcast_terms)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.array_append(words(F.col(text_col)), F.lit("")).alias("w"))
    rows = rows.select("doc_id", "row", F.posexplode("w").alias("pos", "word"))
    rows = rows.select("doc_id", "row", "pos", ascii_lower(F.col("word")).alias("term"))
    found = rows.join(known, "term").select("term_id", "row", "pos", F.when(F.col("term_id") == 0, F.col("doc_id")).alias("doc_id"))
    found = work.save(found, "postings")  # one write, which fixes the numbers
    lengths = found.where("term_id = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return PhraseIndex(found.where("term_id > 0").drop("doc_id"), lengths, work)


def _with_terms(tests: DataFrame, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    terms = work.save(test_terms(tests, id_col, text_col), "test-terms")
    # ids from 1, fixed by the written table; 0 stands for the empty word that ends a text
    numbered = terms.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("term_id"))
    empty = tests.sparkSession.createDataFrame([("", 0)], "term string, term_id long")
    vocabulary = work.save(numbered.unionByName(empty), "vocabulary")
    return terms.join(vocabulary, "term").select("item_id", "row", "n", "pos", "term_id"), vocabulary


def phrase_matches(index: PhraseIndex, phrases: DataFrame, broadcast_terms: int = BROADCAST_TERMS, broadcast_docs: int = BROADCAST_DOCS, salts: int = 64) -> DataFrame:
    """Exact occurrences (phrase_id, row, start) of ``phrases`` (phrase_id, off, term_id).

    The list of a phrase's rarest term, moved back by that term's offset, gives the places where the phrase could
    start. They are intersected with the moved list of its second rarest term, and what is left with those of all
    its other terms at once. These joins are on (row, term_id, pos), so a frequent term is spread over its
    documents. Phrases, and numbers of the rows still in question, are broadcast up to the two bounds; beyond them
    the first join deals each term over ``salts`` tasks and the last one shuffles by row.
    """
    posts, work = index.postings, index.work
    df = work.save(posts.groupBy("term_id").agg(F.count("*").alias("df")), "frequencies")
    phrase = Window.partitionBy("phrase_id")
    ranked = phrases.join(df, "term_id", "left").na.fill(0, ["df"])
    ranked = ranked.select("phrase_id", "off", "term_id", F.row_number().over(phrase.orderBy("df", "off")).alias("nth"), F.min("df").over(phrase).alias("least"), F.count("*").over(phrase).alias("size"))
    ranked = work.save(ranked.where("least > 0").drop("least"), "ranked")  # a term that never occurs: no match
    part = lambda name, cond: work.save(ranked.where(cond), name)
    first, second, rest = part("first", "nth = 1"), part("second", "nth = 2").drop("nth", "size"), part("rest", "nth > 2").drop("nth", "size")

    if first.limit(broadcast_terms + 1).count() <= broadcast_terms:
        met = posts.join(F.broadcast(first), "term_id")
    else:
        salt = F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int")
        dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = posts.withColumn("salt", salt).join(dealt, ["term_id", "salt"])
    starts = met.select("phrase_id", "size", "row", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    starts = work.save(starts, "starts-1")

    terms = small(work.save(second.select("term_id").distinct(), "second-terms"), broadcast_terms)
    wanted = starts.where("size > 1").join(small(second, broadcast_terms), "phrase_id").withColumn("pos", F.col("start") + F.col("off"))
    left = wanted.join(posts.join(terms, "term_id", "left_semi"), ["row", "term_id", "pos"], "left_semi").select("phrase_id", "size", "row", "start")
    left = work.save(left.unionByName(starts.where("size = 1")).distinct(), "starts-2")

    docs = small(work.save(left.where("size > 2").select("row").distinct(), "left-docs"), broadcast_docs)
    wanted = left.where("size > 2").join(small(rest, broadcast_terms), "phrase_id").withColumn("pos", F.col("start") + F.col("off"))
    met = wanted.join(posts.join(docs, "row", "left_semi"), ["row", "term_id", "pos"], "left_semi")
    met = met.groupBy("phrase_id", "row", "start", "size").agg(F.count("*").alias("n")).where("n = size - 2")
    return met.select("phrase_id", "row", "start").unionByName(left.where("size <= 2").select("phrase_id", "row", "start"))


def proximity_matches(index: PhraseIndex, pairs: DataFrame, within: int) -> DataFrame:
    """(pair_id, row, doc_id, pos_a, pos_b) where terms a and b of ``pairs`` (pair_id, a, b) lie ``within`` words, either way.

    Positions are cut in blocks of ``within`` words; a term's list joins the other's on document and block, with each
    posting of b entered in its own and both neighbouring blocks.
    """
    a = pairs.join(index.postings.withColumnRenamed("term_id", "a"), "a").withColumn("block", F.floor(F.col("pos") / within)).withColumnRenamed("pos", "pos_a")
    b = pairs.join(index.postings.withColumnRenamed("term_id", "b"), "b").withColumnRenamed("pos", "pos_b")
    at = F.floor(F.col("pos_b") / within)
    b = b.select("pair_id", "row", "pos_b", F.explode(F.array(at - 1, at, at + 1)).alias("block"))
    both = a.join(b, ["pair_id", "row", "block"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b")))
    return both.select("pair_id", "row", "pos_a", "pos_b").distinct().join(index.lengths.select("row", "doc_id"), "row")


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of a test item (an item of fewer words, but not none, is one window). A
    document's word is hit if it lies in an occurrence of some window; n_items counts the items with one, and
    items_sha256 digests their ids, sorted as strings and joined by commas (none: the digest of the empty string).
    Null texts have no words. Rows of one item id are
    texts of one item, rows without an id those of one more (counted, not digested). Windows that several items share are looked up once. Repeated rows come out as often as
    they went in, each with the same figures; rows that share a doc_id but not the text are documents of their own. An
    empty table of either kind is no error. Other columns are ignored; ids may be of any type.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    terms, vocabulary = _with_terms(tests, item_col, item_text_col, work)
    index = build_index(docs, vocabulary, work, id_col, text_col, broadcast_terms)
    span = F.least(F.col("n"), F.lit(window))
    spread = terms.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - span + 1), F.least(F.col("pos"), F.col("n") - span))))
    listed = spread.groupBy("row", "start").agg(F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("pos", "term_id"))).getField("term_id").alias("terms"))
    listed = work.save(listed.select("item_id", "terms"), "windows")
    phrases = work.save(listed.select("terms").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    hits = work.save(phrase_matches(index, phrases.select("phrase_id", F.posexplode("terms").alias("off", "term_id")), broadcast_terms), "hits")
    sizes = small(phrases.select("phrase_id", F.size("terms").alias("size")), broadcast_terms)
    covered = hits.join(sizes, "phrase_id").select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    covered = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    of = work.save(listed.join(phrases, "terms").select("phrase_id", F.col("item_id").cast("string").alias("item")).distinct(), "items")
    items = hits.select("row", "phrase_id").distinct().join(small(of, broadcast_terms), "phrase_id").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("ids"))
    found = covered.join(items, "row")
    out = index.lengths.join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
