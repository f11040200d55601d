"""Schedules in closed form: request spacing per domain and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.functions.failures import DEFAULT_ATTEMPTS, retry_delay_ms

WARN_MS, BUCKET_MS = 30_000, 3_600_000


def request_schedule(requests: DataFrame, delay_ms: int, domain: str = "domain", arrived_ms: str = "arrived_ms", order: str = "id", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Adds ``start_ms``: requests of a domain in order of arrival, each at least ``delay_ms`` after the one before.

    start_i = max(arrival_i, start_{i-1} + d) equals the running maximum of arrival_j - j d, plus i d.
    The running count and maximum are taken within buckets of arrival time and carried over from
    bucket to bucket, so a domain that holds most requests is spread over its buckets.
    """
    bucket = F.floor(F.col(arrived_ms) / bucket_ms).alias("_bucket")
    out = requests.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(domain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy(domain, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    line = Window.partitionBy(domain, "_bucket").orderBy(arrived_ms, order)
    out = out.withColumn("_rank", F.row_number().over(line)).join(counts, [domain, "_bucket"])
    out = out.withColumn("_place", (F.col("_before") + F.col("_rank") - 1) * delay_ms).withColumn("_slack", F.col(arrived_ms) - F.col("_place"))
    tops = out.groupBy(domain, "_bucket").agg(F.max("_slack").alias("_top")).withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
    out = out.withColumn("_most", F.max("_slack").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(tops, [domain, "_bucket"])
    return out.withColumn("start_ms", (F.greatest("_most", "_carried") + F.col("_place")).cast("bigint")).drop("_bucket", "_before", "_rank", "_place", "_slack", "_carried", "_most")


def cumulative_wait(scheduled: DataFrame, domain: str = "domain", arrived_ms: str = "arrived_ms") -> DataFrame:
    """Per domain: requests, time waited in all and whether it warrants a warning."""
    out = scheduled.groupBy(domain).agg(F.count("*").alias("requests"), F.sum(F.col("start_ms") - F.col(arrived_ms)).cast("bigint").alias("waited_ms"))
    return out.withColumn("warned", F.col("waited_ms") >= WARN_MS)


def server_delays(scheduled: DataFrame, told: DataFrame, domain: str = "domain") -> DataFrame:
    """Per domain: time waited, time servers told to wait (``delay_ms`` of ``told``), both together and whether they warrant a warning.

    What a server tells only adds to the account; it moves no request.
    """
    own = scheduled.groupBy(domain).agg(F.sum("waited_ms").alias("waited_ms"))
    theirs = told.groupBy(domain).agg(F.sum("delay_ms").cast("bigint").alias("told_ms"))
    both = own.join(theirs, domain, "full_outer").fillna(0, ["waited_ms", "told_ms"]).withColumn("total_ms", F.col("waited_ms") + F.col("told_ms"))
    return both.withColumn("warned", F.col("total_ms") >= WARN_MS)


def retry_schedule(failures: DataFrame, most_attempts: int = DEFAULT_ATTEMPTS) -> DataFrame:
    """One row per attempt that is made: attempt number, the delay before it and whether it poses as a browser.

    ``failures`` has (id, failure) and may have http_status and retry_after_s. At least one attempt
    is made, whatever ``most_attempts``; permanent failures make no other. Where a server that limits
    the rate says how long to wait, that replaces the delay. A refusal (403) is tried once more at
    once as a browser.
    """
    told = F.when(F.col("failure") == "rate_limited", F.col("retry_after_s") * 1000) if "retry_after_s" in failures.columns else F.lit(None).cast("bigint")
    refused = F.coalesce(F.col("http_status") == 403, F.lit(False)) if "http_status" in failures.columns else F.lit(False)
    tries = F.when(F.col("failure").isin("transient", "rate_limited"), F.lit(max(most_attempts, 1))).otherwise(F.when(refused, 2).otherwise(1))
    each = failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), tries)))
    browser = refused & ~F.col("failure").isin("transient", "rate_limited") & (F.col("attempt") > 1)
    delay = F.when((F.col("attempt") == 1) | browser, F.lit(0).cast("bigint")).otherwise(F.coalesce(told.cast("bigint"), retry_delay_ms(F.col("attempt") - 1)))
    return each.withColumn("delay_ms", delay).withColumn("as_browser", browser)
