"""Mixing sources to target weights: temperature mixing with block permutations; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import Workspace

#: Exponents tried by one job: five halvings of the interval at a time.
PROBES = 31
#: Sources that may be broadcast (a few MB); more are joined by shuffling.
BROADCAST_SOURCES = 50_000
#: Buckets whose running sums are taken in one task.
STRETCH = 4096


def _probe(totals: DataFrame, budget: float, exponents: list[float]) -> DataFrame:
    """(exponent, entropy in nats, most repetitions) of the normalised weights, one row per exponent."""
    rows = totals.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents))))
    rows = rows.withColumn("v", F.pow("share", "exponent"))
    # H = log Z - sum(v log v) / Z; the weight is v / Z, and tokens / weight is least where share / v is
    return rows.groupBy("exponent").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.log("v")).alias("vlogv"), F.max(F.col("v") / F.col("tokens")).alias("most")).select("exponent", (F.log("z") - F.col("vlogv") / F.col("z")).alias("entropy"), (F.col("most") / F.col("z") * budget).alias("repeats"))


def solve_exponent(totals: DataFrame, budget: float, entropy_share: float | None = None, max_repeats: float | None = None, rounds: int = 6) -> float:
    """Bisects the exponent in 0..1 (0: equal weights, 1: the sources' own shares).

    The result is the largest exponent whose entropy reaches ``entropy_share`` of the greatest possible (the log of
    the number of sources), and if ``max_repeats`` is given, at least the smallest exponent that repeats no source
    more often than that; the repetition limit wins where both can't hold, and 1 is used where it can't hold at all.
    Only figures per tried exponent reach the driver, never the sources.
    """
    n = totals.count()
    if n < 2:
        return 1.0
    high = 1.0
    import math

    def bisect(good) -> float:
        """The boundary of ``good``, which holds at 0 and stops holding somewhere up to 1."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            tried = [lo + (hi - lo) * (i + 1) / (PROBES + 1) for i in range(PROBES)]
            rows = {r["exponent"]: r for r in _probe(totals, budget, tried).collect()}
            held = [x for x in tried if good(rows[x])]
            lo, hi = (held[-1] if held else lo), next((x for x in tried if not good(rows[x])), hi)
        return (lo + hi) / 2

    one, zero = (_probe(totals, budget, [x]).first() for x in (1.0, 0.0))
    if entropy_share is not None and one["entropy"] < entropy_share * math.log(n):
        high = bisect(lambda r: r["entropy"] >= entropy_share * math.log(n))
    if max_repeats is not None and zero["repeats"] > max_repeats:
        low = 1.0 if one["repeats"] > max_repeats else bisect(lambda r: r["repeats"] > max_repeats)
        high = max(high, low)
    return high


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, entropy_share: float | None = 0.97, max_repeats: float | None = 4.0, block_tokens: int = 100_000, bucket_rows: int = 2000, seed: int = 17, tokens_col: str | None = None) -> DataFrame:
    """The mixture as rows (doc_id, source, key, n_tokens, epoch, block, position), by temperature mixing.

    Tokens are runs of characters other than white space, or what ``tokens_col`` counts. key is a hash of the text. A source's share of all tokens is raised to an exponent
    that ``solve_exponent`` bisects, and the normalised weights times ``budget`` (tokens; all tokens of ``docs`` where
    None) give each source's quota. Every epoch of a source is a permutation of its documents by a seeded hash; whole
    documents are taken in that order, epoch after epoch, until the quota is reached, so each source ends within one
    document of it. ``position`` is the token offset at which the document starts, in its source's own order, scaled
    to the whole budget; ``block`` is position / ``block_tokens``: each block of the output holds every source in its
    weight, and the order inside a block is that of ``position``, source and doc_id.

    The permutation hashes the id, the text and the number of a copy, so it is the same however the table is
    partitioned. Running sums are taken in hash buckets of about ``bucket_rows`` rows, on top of totals of buckets and
    of stretches of buckets, so that no source is gathered in one task. Documents without tokens (null, empty) are never taken, as they add to no quota. A null
    source is a source of its own. Repeated rows count each time and get places of their own. No documents or no
    tokens give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long") if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    source = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.xxhash64(F.col(text_col)).alias("key"), n.alias("n_tokens")).where("n_tokens > 0")
    # repeated rows are one row with a number of copies until they are placed
    rows = rows.groupBy("doc_id", "source", "key", "n_tokens").agg(F.count("*").alias("copies"))
    rows = work.save(rows, "rows")
    totals = work.save(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("tokens"), F.sum("copies").alias("n_rows")), "totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0.0
    budget = float(budget if budget is not None else whole)
    shares = work.save(totals.withColumn("share", F.col("tokens") / F.lit(whole or 1.0)), "shares")
    exponent = solve_exponent(shares, budget, entropy_share, max_repeats)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    # quotas in whole tokens, so that the order in which shares are added has no say
    quota = F.round(F.pow("share", F.lit(exponent)) / F.lit(z) * F.lit(budget))
    plan = shares.select("source", "tokens", quota.alias("quota"), F.ceil(F.col("n_rows") / bucket_rows).alias("n_buckets"))
    plan = work.save(plan, "plan")
    known = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan

    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("tokens")) - 1).cast("int"))
    dealt = rows.join(known, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies").withColumn("epoch", F.explode(epochs))
    dealt = dealt.withColumn("order", F.xxhash64("doc_id", "key", "copy", "epoch", F.lit(seed)))
    # the top of the hash picks the bucket, so buckets follow one another in the permutation
    dealt = dealt.withColumn("bucket", F.floor((F.col("order").cast("double") / F.lit(2.0**64) + 0.5) * F.col("n_buckets")).cast("long"))
    # running sums on three levels: stretches of buckets, buckets of a stretch, rows of a bucket
    stretch = F.floor(F.col("bucket") / STRETCH).cast("long")
    sums = dealt.groupBy("source", "epoch", stretch.alias("stretch"), "bucket").agg(F.sum("n_tokens").alias("t"))
    sums = work.save(sums, "sums")  # a row per bucket
    tops = sums.groupBy("source", "epoch", "stretch").agg(F.sum("t").alias("t"))
    before = Window.partitionBy("source").orderBy("epoch", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("source", "epoch", "stretch", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("top"))
    before = Window.partitionBy("source", "epoch", "stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).join(tops, ["source", "epoch", "stretch"])
    sums = sums.select("source", "epoch", "bucket", (F.col("top") + F.col("base")).alias("base"))
    within = Window.partitionBy("source", "epoch", "bucket").orderBy("order", "doc_id", "key", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.join(sums, ["source", "epoch", "bucket"]).withColumn("at", F.col("base") + F.col("inner")).where("at < quota")
    position = F.col("at") / F.col("quota") * F.lit(budget)
    name = F.when(F.col("source") == "null", None).otherwise(F.substring("source", 3, 1 << 30))
    return placed.select("doc_id", name.alias("source"), "key", "n_tokens", "epoch", F.floor(position / block_tokens).cast("long").alias("block"), position.alias("position"))
