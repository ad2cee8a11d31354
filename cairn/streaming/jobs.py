"""Structured Streaming jobs over push, pull-request, incident, telemetry and request events."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import check_conclusion
from cairn.sources.tables import Stages


def drain(stream: DataFrame, stages: Stages, mode: str = "append", name: str = "out", each=None) -> DataFrame:
    """Runs a stream over what is available now and returns what it wrote, with the number of its micro-batch.

    Output goes to a table in the shared folder by ``foreachBatch``; a replayed batch overwrites its own part, so each
    row counts once. In update mode the row of the latest batch is the valid one.
    """
    out = stages.path(name)

    def put(df: DataFrame, batch: int) -> None:
        df = each(df) if each else df
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", stages.path(f"{name}-checkpoint")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return stages.spark.read.option("basePath", out).parquet(out)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max(F.struct("batch_id", *values)).alias("v")).select(*keys, *[f"v.{c}" for c in values])


def push_changes(pushes: DataFrame, branch: str = "main", most: int = 200, delay: str = "1 day") -> DataFrame:
    """(repo, head, mode, files): one row a head, from pushes (repo, ref, before, after, ts, commits) on one branch.

    The files are the union of added, modified and removed ones; the mode is full without a previous head, without
    files, or with more than ``most`` of them, else delta.
    """
    kept = pushes.where(F.col("ref") == f"refs/heads/{branch}").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo", "after"])
    lists = F.flatten(F.transform("commits", lambda c: F.concat(c["added"], c["modified"], c["removed"])))
    files = F.array_sort(F.array_distinct(lists))
    full = F.coalesce(F.col("before"), F.lit("")).rlike("^0*$") | (F.size(files) == 0) | (F.size(files) > most)
    return kept.select("repo", F.col("after").alias("head"), F.when(full, "full").otherwise("delta").alias("mode"), files.alias("files"))


def pr_events(events: DataFrame, review: Callable[[DataFrame], DataFrame], blocking: bool = True) -> DataFrame:
    """(pr_id, action, score, conclusion) for the actions of a micro-batch that start a review.

    ``review`` scores the pull requests (pr_id) of the batch, and no others: (pr_id, score, level).
    """
    kept = events.where(F.col("action").isin("opened", "synchronize", "reopened", "ready_for_review"))
    risk = review(kept.select("pr_id").distinct())
    return kept.join(risk, "pr_id").select("pr_id", "action", "score", check_conclusion(F.col("level"), F.lit(blocking)).alias("conclusion"))


def incidents_7d(incidents: DataFrame, delay: str = "1 day") -> DataFrame:
    """(file, start, end, n): sliding seven-day counts, a window a day."""
    w = F.window("ts", "7 days", "1 day")
    return incidents.withWatermark("ts", delay).groupBy(w.alias("w"), "file").agg(F.count("*").alias("n")).select("file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def telemetry_rollup(telemetry: DataFrame, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """(intent, start, queries, p50, p95, pass_rate): tumbling windows of (ts, intent, latency_ms, passed)."""
    w = F.window("ts", every)
    out = telemetry.withWatermark("ts", delay).groupBy(w.alias("w"), "intent")
    out = out.agg(F.count("*").alias("queries"), F.percentile_approx("latency_ms", 0.5, 100_000).alias("p50"), F.percentile_approx("latency_ms", 0.95, 100_000).alias("p95"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return out.select("intent", F.col("w.start").alias("start"), "queries", "p50", "p95", "pass_rate")


def rate_limit_report(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """(event_id, key, in_window): requests that stand over the limit; counts rejected ones too, so an upper bound."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > most).select("event_id", "key", "in_window")


def admitted(events: DataFrame, most: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, event_id, ok): exact sliding-window admission of a stream of (event_id, key, ts).

    A rejected request does not count, which makes admission sequential within a key. A key's state is the times of at
    most ``most`` admitted requests, and goes once the watermark has passed the last of them by the window. Requests
    of one micro-batch are taken by time and id; those later than the watermark are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event, at in zip(rows["event_id"], rows["at"], strict=True):
            while times and times[0] <= at - seconds:
                times.popleft()
            ok = len(times) < most
            if ok:
                times.append(at)
            out.append((key[0], event, ok))
        state.update((list(times),))
        if times:
            gone = int((times[-1] + seconds) * 1000)
            state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "ok"])

    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    rows = events.withWatermark("ts", delay).select("event_id", "key", "ts", at)
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event_id long, ok boolean", "times array<double>", "append", "EventTimeTimeout")
