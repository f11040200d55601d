"""Streams: progress, work in batches, duplicates in flight, request spacing and cached answers with state that ends."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackmill.functions.urls import domain, origin
from stackmill.session import ensure_checkpoint_dir

# How long an idle domain and a read rules file are remembered, how often progress is told, how long a stop waits.
IDLE_MS, RULES_MS, TELL_MS, DRAIN_S = 1_800_000, 86_400_000, 300, 5


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path belongs to, whatever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(at) and system.getFileStatus(at).isDirectory()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table of a directory as a stream of its files; times without zone become UTC timestamps."""
    path = f"{folder}/{name}.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", str(files_per_batch))
    df = read.parquet(path) if _is_folder(spark, path) else read.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in plain}) if plain else df


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All output of a stream over what is there now, through a parquet sink with its own checkpoint."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def consumed(stream: DataFrame, work: Callable[[DataFrame, int], None], folder: str | None = None, mode: str = "append") -> StreamingQuery:
    """Work on every batch of a stream; what a batch is given is bounded by the stream's files per batch.

    ``work`` gets a batch and its number and may be called again with both after a failure.
    """
    folder = folder or shared_folder(stream.sparkSession)
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(work).trigger(availableNow=True).start()


def stopped(query: StreamingQuery, drain_s: float = DRAIN_S) -> bool:
    """Let a query finish what it is at for so long, then stop it; whether it came to an end by itself."""
    until = time.monotonic() + drain_s
    while query.isActive and time.monotonic() < until:
        query.awaitTermination(0.1)
    ended = not query.isActive
    query.stop()
    return ended


class ProgressTeller(StreamingQueryListener):
    """Tells a callback (query name, batch, rows read) of running queries, at most every ``every_ms``."""

    def __init__(self, tell: Callable[[str | None, int, int], None], every_ms: int = TELL_MS) -> None:
        self.tell, self.every_ms, self.last = tell, every_ms, 0.0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.last = 0.0

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        now = time.monotonic() * 1000
        if now - self.last >= self.every_ms:
            self.last = now
            self.tell(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        return


def progress(events: DataFrame, time: str = "ts", kind: str = "event_type", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per window and kind, once the watermark has passed the window."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), kind, "n")


def snapshot(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Counts per kind so far; for update or complete mode."""
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def snapshots(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """The last of the snapshots of a stream over what is there now."""
    folder = shared_folder(events.sparkSession)
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    consumed(snapshot(events, kind), keep, folder, "update").awaitTermination()
    told = events.sparkSession.read.parquet(f"{folder}/out")
    return told.groupBy(kind).agg(F.max(F.struct("batch", "n")).alias("_last")).select(kind, F.col("_last.n").alias("n"))


def first_sights(events: DataFrame, key: list[str], time: str = "ts", delay: str = "365 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def _timeout(after_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if after_ms is None else GroupStateTimeout.ProcessingTimeTimeout


SPACED = "domain string, id bigint, arrived_ms bigint, start_ms bigint"


def spaced_requests(requests: DataFrame, delay_ms: int, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Start time of each request of (id, url, arrived_ms): per domain, FIFO within a batch, ``delay_ms`` apart.

    State per domain: the last start, one number. It ends ``idle_ms`` after the domain's last request,
    but not before that start: a start in the past delays nothing. With ``idle_ms`` None it never ends,
    as a query needs that is to end itself when its input is drained. Within a batch the starts are a
    running maximum, no loop.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            left = state.get[0] - state.getCurrentProcessingTimeMs()
            if left > 0:
                state.setTimeoutDuration(left)
            else:
                state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["arrived_ms", "id"], kind="stable")
        arrived = rows["arrived_ms"].to_numpy(np.int64)
        place = np.arange(len(arrived), dtype=np.int64) * delay_ms
        slack = arrived - place
        if state.exists:
            slack[0] = max(slack[0], state.get[0] + delay_ms)
        starts = np.maximum.accumulate(slack) + place
        state.update((int(starts[-1]),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"domain": key[0], "id": rows["id"].to_numpy(), "arrived_ms": arrived, "start_ms": starts})

    keyed = requests.select(domain(F.col("url")).alias("domain"), "id", "arrived_ms")
    return keyed.groupBy("domain").applyInPandasWithState(run, SPACED, "last bigint", "append", _timeout(idle_ms))


MISSED = "origin string, id bigint, at_ms bigint"


def rules_to_read(requests: DataFrame, ttl_ms: int = RULES_MS, ends: bool = True) -> DataFrame:
    """(origin, id, at_ms): the requests of (id, url, at_ms) at which the rules of their origin are read, as none or only older than ``ttl_ms`` are held.

    State per origin: when its rules were last read; it ends with them, unless ``ends`` is false, as a
    query needs that is to end itself. Requests of a batch are taken in order of time.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at_ms", "id"], kind="stable")
        at = rows["at_ms"].to_numpy(np.int64)
        picks: list[int] = []
        last = state.get[0] if state.exists else None
        i = 0 if last is None else int(np.searchsorted(at, last + ttl_ms, "right"))
        while i < len(at):
            picks.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + ttl_ms, "right"))
        if last is not None:
            state.update((last,))
            if ends:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"origin": key[0], "id": rows["id"].to_numpy()[picks], "at_ms": at[picks]})

    keyed = requests.select(origin(F.col("url")).alias("origin"), "id", "at_ms").filter("origin IS NOT NULL")
    return keyed.groupBy("origin").applyInPandasWithState(run, MISSED, "read_ms bigint", "append", _timeout(ttl_ms if ends else None))
