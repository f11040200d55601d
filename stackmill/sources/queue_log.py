"""A work queue kept in two folders of a file system: what was enqueued, and what happened to it since.

Every change is an append; nothing is rewritten. One writer at a time: two that number new items at
once would give the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.operators import queue

ITEMS = "id bigint, url string, source_type string, original_input string, project string, status string, priority bigint, retry_count bigint, suggested_filename string, meta_title string, meta_authors string, meta_year string, meta_doi string, topics string, parse_confidence string, parse_confidence_factors string, created_at string, updated_at string"


class UnknownItems(LookupError):
    """A change was asked of ids that no item has."""


class QueueLog:
    """Enqueuing, claims, changes, listings and counts over a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.items_folder, self.events_folder = spark, f"{folder}/items", f"{folder}/events"

    def _read(self, folder: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(folder) if there else self.spark.createDataFrame([], schema)

    def _items(self) -> DataFrame:
        return self._read(self.items_folder, ITEMS)

    def _events(self) -> DataFrame:
        return self._read(self.events_folder, queue.EVENT)

    def state(self) -> DataFrame:
        """Every item that is not removed, as it is now."""
        now = queue.replayed(self._events())
        fixed = [c for c in self._items().columns if c not in now.columns or c == "id"]
        return self._items().select(*fixed).join(now, "id")

    def enqueue(self, items: DataFrame, now: str) -> DataFrame:
        """Append (ord, url, source_type, ...) as pending items; gives their ids with their ``ord``."""
        new = queue.enqueued(self._items(), items, now)
        new.write.mode("append").parquet(self.items_folder)
        added = self._items().join(self._events().select("id").distinct(), "id", "left_anti")
        self._append(added.withColumns({"seq": F.lit(0), "saved_path": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string"), "bytes_downloaded": F.lit(0), "content_length": F.lit(None).cast("bigint")}), queue.first_events)
        return self._items().filter(F.col("created_at") == now).select("id", "url")

    def _append(self, changes: DataFrame, make) -> None:  # noqa: ANN001
        make(changes).write.mode("append").parquet(self.events_folder)

    def _change(self, changes: DataFrame, now: str, make) -> None:  # noqa: ANN001
        """Append changes after checking that their ids are known; each is the next of its item."""
        known = queue.replayed(self._events()).select("id")
        if changes.join(known, "id", "left_anti").head(1):
            raise UnknownItems("no item has one of these ids")
        last = self._events().groupBy("id").agg(F.max("seq").alias("_last"))
        self._append(changes.join(last, "id").withColumn("seq", F.col("_last") + 1).withColumn("updated_at", F.lit(now)).drop("_last"), make)

    def claim(self, size: int, now: str, project: str | None = None) -> DataFrame:
        """The next pending items, from now on in progress."""
        ids = [r["id"] for r in queue.claim_batch(self.state(), size, project).select("id").collect()]  # at most ``size``
        chosen = self.spark.createDataFrame([(i,) for i in ids], "id bigint")
        self._change(chosen, now, queue.claimed)
        return self.state().join(F.broadcast(chosen), "id", "left_semi")

    def complete(self, changes: DataFrame, now: str) -> None:
        """Completions of (id, saved_path)."""
        self._change(changes, now, queue.completed)

    def fail(self, changes: DataFrame, now: str) -> None:
        """Failures of (id, last_error, retry_count)."""
        self._change(changes, now, queue.failed)

    def progress(self, changes: DataFrame, now: str) -> None:
        """Progress of (id, bytes_downloaded, content_length)."""
        self._change(changes, now, queue.progressed)

    def requeue(self, ids: DataFrame, now: str) -> None:
        self._change(ids.select("id"), now, queue.requeued)

    def remove(self, ids: DataFrame, now: str) -> None:
        self._change(ids.select("id"), now, queue.removed)

    def clear(self, status: str, now: str) -> int:
        """Remove the items of a status; how many there were."""
        ids = self.state().filter(F.col("status") == status).select("id")
        n = ids.count()
        self._change(ids, now, queue.removed)
        return n

    def reset(self, now: str, project: str | None = None) -> int:
        """Make what was in progress pending again; how many there were."""
        ids = queue.in_progress(self.state(), project).select("id")
        n = ids.count()
        self._change(ids, now, queue.requeued)
        return n

    def get(self, item: int) -> DataFrame:
        return queue.by_id(self.state(), item)

    def listed(self, status: str | None = None, project: str | None = None) -> DataFrame:
        return queue.listed(self.state(), status, project)

    def in_progress(self, project: str | None = None) -> DataFrame:
        return queue.in_progress(self.state(), project)

    def counts(self) -> DataFrame:
        return queue.counts(self.state())

    def unscoped(self) -> int:
        """Items without a project."""
        return self.state().filter("project IS NULL").count()

    def active(self, items: DataFrame) -> DataFrame:
        """Those of (url, project) that are already pending or in progress."""
        return queue.in_flight(items, self.state())
