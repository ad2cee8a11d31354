"""Commit history and ownership. ``touches`` has (file, hash, author, date, branch), a row per commit and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import feature_name, ratio2, zone

NOBODY = ("", "None", "Unknown")


def commit_files(commits: DataFrame, branch_order: tuple[str, ...] = ("main", "master")) -> DataFrame:
    """(hash, file, author, date, branch): commits once each, preferring the named branches, files exploded."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, branch_order)), F.col("branch")), F.lit(0))
    rank = F.when(rank == 0, len(branch_order) + 1).otherwise(rank)
    first = Window.partitionBy("hash").orderBy(rank, "branch", "date")
    once = commits.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return once.select("hash", F.explode(F.array_distinct("files")).alias("file"), "author", "date", "branch")


def file_commit_stats(touches: DataFrame, as_of: DataFrame, days: int = 180) -> DataFrame:
    """Per file: commit_count, n_authors, n_branches, recent (last ``days`` up to as_of), first and last change and who."""
    recent = F.col("date") >= F.date_sub(F.col("as_of").cast("date"), days).cast("timestamp")
    rows = touches.join(F.broadcast(as_of.limit(1)))  # one row
    return rows.groupBy("file").agg(
        F.count_distinct("hash").alias("commit_count"),
        F.count_distinct("author").alias("n_authors"),
        F.count_distinct("branch").alias("n_branches"),
        F.count_if(recent).alias("recent"),
        F.min("date").alias("created_at"),
        F.max("date").alias("last_modified"),
        F.max_by("author", F.struct("date", "hash")).alias("last_author"),
    )


def author_counts(touches: DataFrame) -> DataFrame:
    return touches.groupBy("file", "author").agg(F.count_distinct("hash").alias("n"), F.max("date").alias("last"))


def bus_factor(touches: DataFrame) -> DataFrame:
    """(file, bus_risk_score, top_owner): the top author's share of commits; ties to the later, then the smaller name."""
    counts = author_counts(touches)
    top = F.min(F.struct((-F.col("n")).alias("n"), (-F.unix_micros(F.col("last").cast("timestamp"))).alias("last"), "author")).alias("top")
    out = counts.groupBy("file").agg(F.sum("n").alias("total"), top)
    return out.select("file", ratio2(-F.col("top.n"), F.col("total")).alias("bus_risk_score"), F.col("top.author").alias("top_owner"))


def volatility(recent: Column) -> Column:
    return F.least(F.lit(100), 5 * recent).cast("double") / 100


def churn(recent: Column, total: Column) -> Column:
    high = F.least(F.lit(1000), 700 + 15 * recent).cast("double") / 1000
    low = F.least(F.lit(1000), 35 * recent + 6 * total).cast("double") / 1000
    return F.when(total >= 50, high).when(total > 0, low).otherwise(0.0)


def expert_edges(nodes: DataFrame) -> DataFrame:
    """(person, file, weight) from a file's top owner and commit count."""
    return nodes.where(F.col("top_owner").isNotNull() & ~F.col("top_owner").isin(*NOBODY)).select(F.col("top_owner").alias("person"), F.col("id").alias("file"), F.col("commit_count").alias("weight"))


def feature_map(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(feature_id, feature_name, file): files touched by the commits whose message names a feature."""
    named = commits.select("hash", feature_name(F.col("msg")).alias("feature_name")).where("feature_name <> ''")
    rows = named.join(files, "hash").select(F.lower("feature_name").alias("feature_id"), "feature_name", "file")
    return rows.groupBy("feature_id", "file").agg(F.min("feature_name").alias("feature_name"))


def bus_factor_trend(commits: DataFrame, as_of: DataFrame, days: int = 56, grain: str = "month", keep: int = 8) -> DataFrame:
    """(bucket, commits, top_share) of the last ``keep`` buckets of the last ``days``."""
    rows = commits.join(F.broadcast(as_of.limit(1))).where(F.col("date") >= F.date_sub(F.col("as_of").cast("date"), days).cast("timestamp"))
    per = rows.groupBy(F.date_trunc(grain, "date").alias("bucket"), "author").agg(F.count("*").alias("n"))
    out = per.groupBy("bucket").agg(F.sum("n").alias("commits"), F.max("n").alias("top"))
    share = F.floor((2000 * F.col("top") + F.col("commits")) / (2 * F.col("commits"))).cast("double") / 1000
    return out.select("bucket", "commits", share.alias("top_share")).orderBy(F.desc("bucket")).limit(keep)


def throughput(commits: DataFrame, as_of: DataFrame, days: int = 56, grain: str = "month", keep: int = 8) -> DataFrame:
    rows = commits.join(F.broadcast(as_of.limit(1))).where(F.col("date") >= F.date_sub(F.col("as_of").cast("date"), days).cast("timestamp"))
    return rows.groupBy(F.date_trunc(grain, "date").alias("bucket")).agg(F.count("*").alias("commits")).orderBy(F.desc("bucket")).limit(keep)


def active_zones(touches: DataFrame, as_of: DataFrame, days: int = 30, k: int = 15) -> DataFrame:
    """(zone, touches, activity): the zones most touched in the last ``days``; High over ten touches."""
    rows = touches.join(F.broadcast(as_of.limit(1))).where(F.col("date") >= F.date_sub(F.col("as_of").cast("date"), days).cast("timestamp"))
    out = rows.groupBy(zone(F.col("file")).alias("zone")).agg(F.count("*").alias("touches"))
    return out.withColumn("activity", F.when(F.col("touches") > 10, "High").otherwise("Normal")).orderBy(F.desc("touches"), "zone").limit(k)


def line_owners(symbols: DataFrame, blame: DataFrame) -> DataFrame:
    """Per symbol (file, symbol, start_line, end_line): lines, top author and email, owner_confidence, n_authors.

    A range join within the file: blame lines with start_line <= line_no <= end_line. No lines: Unknown and 0.
    """
    s = symbols.select("file", "symbol", "start_line", "end_line")
    b = blame.select(F.col("file").alias("of"), "line_no", "author", "email")
    rows = s.join(b, (s.file == b["of"]) & b.line_no.between(s.start_line, s.end_line), "left")
    keys = ["file", "symbol", "start_line", "end_line"]
    lines = F.count("line_no")
    per = rows.groupBy(*keys, "author", "email").agg(lines.alias("n"))
    by_author = per.groupBy(*keys, "author").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("lines"), F.max(F.struct("n")).alias("b"), F.count("author").alias("n_authors"), F.min(F.struct((-F.col("n")).alias("m"), "author")).alias("top_author"))
    by_email = per.groupBy(*keys, "email").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "email")).alias("top_email"))
    out = by_author.join(by_email, keys)
    confidence = F.when(F.col("lines") > 0, F.floor((-2000 * F.col("top_email.m") + F.col("lines")) / (2 * F.col("lines"))).cast("double") / 1000).otherwise(0.0)
    return out.select(*keys, "lines", F.coalesce("top_author.author", F.lit("Unknown")).alias("last_author"), F.coalesce("top_email.email", F.lit("unknown@unknown.com")).alias("owner_email"), confidence.alias("owner_confidence"), "n_authors")


def file_owner(blame: DataFrame) -> DataFrame:
    """(file, lines, owner_email, owner_confidence) over all lines of a file; ties to the smaller address."""
    per = blame.groupBy("file", "email").agg(F.count("*").alias("n"))
    out = per.groupBy("file").agg(F.sum("n").alias("lines"), F.min(F.struct((-F.col("n")).alias("m"), "email")).alias("top"))
    return out.select("file", "lines", F.col("top.email").alias("owner_email"), (F.floor((-2000 * F.col("top.m") + F.col("lines")) / (2 * F.col("lines"))).cast("double") / 1000).alias("owner_confidence"))
