"""Job logs as streams: state machines, retries, rate limits, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Legal transitions of an ingest job and of a reuse check.
INGEST = {
    "pending": {"parsing", "cancelled"},
    "parsing": {"chunking", "retry_wait", "failed"},
    "chunking": {"embedding", "retry_wait", "failed"},
    "embedding": {"indexing", "retry_wait", "failed"},
    "indexing": {"completed", "retry_wait", "failed"},
    "retry_wait": {"pending", "parsing", "cancelled"},
    "completed": set(),
    "failed": {"pending"},
    "cancelled": {"pending"},
}
CHECK = {
    "pending": {"running", "cancelled", "failed"},
    "running": {"completed", "completed_partial", "failed", "cancel_requested", "pending"},
    "cancel_requested": {"cancelled", "completed", "completed_partial", "failed"},
    "completed": set(),
    "completed_partial": set(),
    "failed": set(),
    "cancelled": set(),
}


def can_move(current: Column, target: Column, machine: dict[str, set[str]]) -> Column:
    """Whether a transition is legal; unknown states never are."""
    legal = F.create_map(*[x for s, t in machine.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in sorted(t)]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.element_at(legal, current), target), F.lit(False))


def current_states(log: DataFrame) -> DataFrame:
    """(job_id, state, seq): the last entry of every job in an append-only log (job_id, seq, state)."""
    return log.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def replay(log: DataFrame, machine: dict[str, set[str]], start: str = "pending") -> DataFrame:
    """(job_id, state, applied, rejected): the log folded by the machine; illegal entries are skipped and counted."""
    ordered = log.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda e: e["state"]).alias("_states"))
    legal = F.create_map(*[x for s, t in machine.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in sorted(t)]).cast("array<string>"))])
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(acc: Column, s: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.element_at(legal, acc["state"]), s), F.lit(False))
        return F.struct(
            F.when(ok, s).otherwise(acc["state"]).alias("state"),
            (acc["applied"] + F.when(ok, 1).otherwise(0)).alias("applied"),
            (acc["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"),
        )

    return ordered.withColumn("_end", F.aggregate("_states", zero, step)).select("job_id", "_end.*")


def rate_usage(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same key in the ``seconds`` up to and with each one (key, ts, id -> in_window)."""
    order = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count("*").over(order))


def usage_by_window(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) with late rows dropped behind the watermark; for streams and batches."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user no further apart than the gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def events_after(log: DataFrame, last: int, key: str = "event_id") -> DataFrame:
    """What a reader that has seen ``last`` has still to see, in order."""
    return log.where(F.col(key) > last).orderBy(key)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop, exactly once for files: a checkpoint keeps what was taken."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", target).start().awaitTermination()


def allow_requests(stream: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(key, ts, id, allowed): the exact limiter, sequential by key, with its window kept as state.

    A refused request takes no room in the window.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        allowed = []
        for ts in rows["ts"]:
            now = ts.value // 1000
            kept = [t for t in kept if t > now - seconds * 1_000_000]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(now)
        state.update((kept,))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "id": rows["id"], "allowed": allowed})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, id long, allowed boolean", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def retry_plan(failures: DataFrame, base: float = 5.0, cap: float = 600.0, most: int = 3) -> DataFrame:
    """Failed attempts (job_id, attempts) with what follows: a later retry, or parked as failed."""
    from lectern.functions.identity import backoff_seconds

    again = F.col("attempts") < most
    return failures.withColumn("state", F.when(again, "retry_wait").otherwise("failed")).withColumn("delay", F.when(again, backoff_seconds(F.col("attempts"), base, cap)))
