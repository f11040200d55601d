"""Queue events, runs and registry."""

import pytest
from pyspark.sql import functions as F

from stackmill.operators import queue


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, source_type string, original_input string, project string, status string, priority long, retry_count long, created_at string, updated_at string, saved_path string, last_error string, bytes_downloaded long, content_length long")


ROWS = [(1, "u1", "doi", None, "p", "pending", 0, 0, "2022", "2022", None, None, 0, None), (2, "u2", "doi", "in", None, "in_progress", 5, 1, "2021", "2023", None, "old", 0, 10), (3, "u3", "doi", None, "p", "failed", 0, 0, "2020", "2021", None, None, 0, None), (4, "u4", "doi", None, "p", "completed", 0, 0, "2020", "2021", "f", None, 0, None)]


def test_transitions_are_folded(spark):
    start = queue.first_events(items(spark, ROWS))
    change = lambda rows, more="": spark.createDataFrame(rows, f"id long, seq long, updated_at string{more}")
    events = start
    for part in (
        queue.claimed(change([(1, 1, "t1")])),
        queue.progressed(change([(1, 2, "t2", 7, None)], ", bytes_downloaded long, content_length long")),
        queue.completed(change([(1, 3, "t3", "p/a.pdf"), (4, 2, "t3", None)], ", saved_path string")),
        queue.failed(change([(2, 1, "t4", "timeout", 3)], ", last_error string, retry_count long")),
        queue.requeued(change([(2, 2, "t5")])),
        queue.removed(change([(3, 1, "t6")])),
        queue.requeued(change([(99, 1, "t7")])),
    ):
        events = events.unionByName(part)
    got = {r["id"]: r for r in queue.replayed(events).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1]["status"], got[1]["saved_path"], got[1]["bytes_downloaded"], got[1]["content_length"], got[1]["updated_at"]) == ("completed", "p/a.pdf", 7, None, "t3")
    assert (got[2]["status"], got[2]["last_error"], got[2]["retry_count"], got[2]["content_length"]) == ("pending", "timeout", 3, 10)
    assert got[4]["saved_path"] is None
    assert [r["id"] for r in queue.unknown_ids(events).collect()] == [99]


def test_enqueue_numbers_on(spark):
    held = items(spark, ROWS)
    new = spark.createDataFrame([(30, "n3", "doi"), (10, "n1", "url"), (20, "n2", "doi")], "ord long, url string, source_type string")
    got = [(r["id"], r["url"], r["status"], r["priority"], r["retry_count"], r["created_at"], r["project"]) for r in queue.enqueued(held, new, "now").orderBy("id").collect()]
    assert got == [(5, "n1", "pending", 0, 0, "now", None), (6, "n2", "pending", 0, 0, "now", None), (7, "n3", "pending", 0, 0, "now", None)]
    assert [r["id"] for r in queue.enqueued(held.limit(0), new, "now").orderBy("id").collect()] == [1, 2, 3]


def test_listings(spark):
    held = items(spark, ROWS)
    assert [r["id"] for r in queue.listed(held).collect()] == [2, 3, 4, 1]
    assert [r["id"] for r in queue.in_progress(held).collect()] == [2] and queue.in_progress(held, "p").count() == 0
    assert queue.by_id(held, 3).first()["url"] == "u3" and sorted(r["id"] for r in queue.cleared(held, "failed").collect()) == [1, 2, 4]
    assert {r["id"]: r["status"] for r in queue.recovered(held, "p").collect()}[2] == "in_progress"


def test_outcomes(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 1), (0, 2)], "c long, f long")
    assert [r["o"] for r in df.select(queue.exit_outcome(df["c"], df["f"]).alias("o")).collect()] == ["success", "success", "partial", "failure"]
    rows = spark.createDataFrame([(1, "enqueued", None), (2, "auth_failed", "b"), (3, "other_failed", "a"), (4, "enqueue_failed", "c"), (5, "duplicate", None)], "ord long, outcome string, error string")
    got = queue.resolution_outcome(rows).first()
    assert (got["parsed"], got["duplicates"], got["has_failures"], got["first_resolution_error"], got["first_enqueue_error"]) == (5, 1, True, "b", "c")
    none = queue.resolution_outcome(rows.limit(0)).first()
    assert none["parsed"] == 0 and none["has_failures"] is False and none["first_resolution_error"] is None
    assert tuple(queue.run_stats(spark.createDataFrame([("success", 0), ("failed", 2), ("skipped", 5)], "status string, retry_count long")).first()) == (1, 1, 2, 2)


def test_registry_by_two_keys(spark):
    done = spark.createDataFrame([("https://X.example/a#f", "doi:10.5555/A", "old.pdf", "2021"), ("https://x.example/a", None, "new.pdf", "2022")], "url string, doi string, relative_path string, seen_at string")
    keyed = queue.recorded(done)
    got = {r["dedup_key"]: (r["relative_path"], r["first_seen_at"], r["last_seen_at"]) for r in queue.upserted(keyed.limit(0), keyed).collect()}
    assert got == {"url:https://x.example/a": ("new.pdf", "2021", "2022"), "doi:10.5555/a": ("old.pdf", "2021", "2021")}
    stale = spark.createDataFrame([("doi:10.5555/a",)], "dedup_key string")
    assert queue.without_stale(keyed, stale).select("dedup_key").distinct().count() == 1


def test_items_without_keys_are_misses(spark):
    rows = spark.createDataFrame([(i, None, None) for i in range(50)] + [(90, None, "url:x")], "id long, doi_key string, url_key string")
    registry = spark.createDataFrame([("url:x", True)], "dedup_key string, present boolean")
    got = {r["id"]: r["outcome"] for r in queue.looked_up(rows, registry).collect()}
    assert got.pop(90) == "hit" and set(got.values()) == {"miss"} and len(got) == 50


def test_queue_in_a_folder(spark, tmp_path):
    from stackmill.sources.queue_log import QueueLog, UnknownItems

    log = QueueLog(spark, str(tmp_path))
    assert log.state().count() == 0
    new = spark.createDataFrame([(1, "u1", "doi", "p"), (2, "u2", "url", None)], "ord long, url string, source_type string, project string")
    log.enqueue(new, "t0")
    log.enqueue(new.limit(1), "t1")
    assert [(r["id"], r["url"], r["status"]) for r in log.listed().collect()] == [(1, "u1", "pending"), (2, "u2", "pending"), (3, "u1", "pending")]
    assert [r["id"] for r in log.claim(2, "t2").orderBy("id").collect()] == [1, 2] and log.in_progress().count() == 2 and log.unscoped() == 1
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id long")
    log.complete(ids(1).withColumn("saved_path", F.lit("p/a.pdf")), "t3")
    log.fail(ids(2).withColumn("last_error", F.lit("timeout")).withColumn("retry_count", F.lit(2)), "t3")
    log.progress(ids(3).withColumn("bytes_downloaded", F.lit(5)).withColumn("content_length", F.lit(9)), "t3")
    log.requeue(ids(2), "t4")
    log.claim(1, "t5", "p")
    assert log.reset("t6") == 1 and log.clear("completed", "t7") == 1
    got = {r["id"]: (r["status"], r["retry_count"], r["last_error"], r["bytes_downloaded"]) for r in log.state().collect()}
    assert got == {2: ("pending", 2, "timeout", 0), 3: ("pending", 0, None, 5)}
    assert log.active(spark.createDataFrame([("u1", "p"), ("u1", "q")], "url string, project string")).count() == 1 and log.get(3).first()["content_length"] == 9
    log.remove(ids(3), "t8")
    with pytest.raises(UnknownItems):
        log.requeue(ids(77), "t9")
    assert {r["status"]: r["items"] for r in log.counts().collect()} == {"pending": 1}
