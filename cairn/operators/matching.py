"""Containment of short texts in others as an equi-join on runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A term is looked up by a run of so many characters, the most that it has, or by all of its own if it has fewer.
GRAMS = (8, 3)
#: Rows of what is asked that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where ``df`` has at most ``rows`` rows; a larger one is left to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _runs(text: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)


def contained(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, text): distinct pairs of ``terms`` (term) and ``texts`` (text) where the text holds the term.

    Each term is joined by the rarest of its runs of characters (see GRAMS) among the texts' own, and what meets is
    compared in full. Empty terms are in nothing. Texts are short (names, paths, words): their runs are rows, which are
    counted where they are and shuffled only where terms are too many to be sent to them. Spark takes runs for smaller
    than they are, so joins say how they are done.
    """
    t = terms.select("term").where("length(term) > 0").distinct()
    n = F.length("term")
    size = F.when(n >= GRAMS[0], GRAMS[0]).when(n >= GRAMS[1], GRAMS[1]).otherwise(n)
    sizes = [r[0] for r in t.select(size.alias("n")).distinct().collect()] or [GRAMS[1]]  # four numbers at most
    few = t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring("term", i, size))
    asked = t.select("term", F.explode(F.array_distinct(own)).alias("gram"))
    every = F.array_distinct(F.concat(*[_runs(F.col("text"), k) for k in sizes]))
    grams = texts.select("text").distinct().select("text", F.explode(every).alias("gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        df = grams.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    # a run that no text has rules the term out
    nth = F.row_number().over(Window.partitionBy("term").orderBy("df", "gram"))
    key = asked.join(df.hint("merge"), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("nth", nth).where("nth = 1 and df > 0").select("term", "gram")
    return grams.join(F.broadcast(key) if few else key.hint("merge"), "gram").where(F.contains("text", "term")).select("term", "text")
