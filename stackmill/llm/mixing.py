"""Mixing sources to target weights by weighted fair queueing (problem 9).

Within each source the documents are shuffled by hash, once per repetition. A document's virtual
finish time in a mix is the tokens its source has given up to and with it, over the source's target
share; sorted by that time, the mix holds its target shares at every point, and is cut at its
budget. The running sums never run through one task: hash buckets are summed first, their offsets
added, and only a bucket's rows are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackmill.session import cut

#: Rows of one hash bucket on average.
BUCKET_ROWS = 20_000


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, share, max_repeats, have, budget): the most tokens every source can serve its share of.

    ``sizes`` has (source, have). Targets that are null or not above 0 are left out; shares are
    scaled to sum to 1 over the rest. A source of the mix that has no tokens forces the budget to 0.
    """
    wanted = targets.groupBy("mix", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL AND mix IS NOT NULL")
    total = wanted.groupBy("mix").agg(F.sum("target_share").alias("_sum"))
    held = wanted.join(total, "mix").withColumn("share", F.col("target_share") / F.col("_sum")).drop("_sum").join(sizes, "source", "left").fillna(0, ["have"])
    most = held.groupBy("mix").agg(F.floor(F.min(F.col("have") * F.col("max_repeats") / F.col("share"))).cast("bigint").alias("budget"))
    return held.join(most, "mix")


def mixed(items: DataFrame, targets: DataFrame, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(mix, doc_id, source, repeat, tokens, finish): the documents of each mix, globally sorted by finish time.

    ``items`` has (doc_id, source, tokens). Texts without tokens and documents of a null or untargeted
    source are in no mix. A document occurs at most ``max_repeats`` times, the k-th time only after
    all of its source occurred k - 1 times. Rows that repeat a doc_id are documents of their own.
    """
    items = cut(items.select("doc_id", "source", "tokens")).filter("tokens > 0 AND source IS NOT NULL")  # a filter below the cut would count tokens twice
    sizes = items.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("rows"))
    plan = cut(budgets(sizes, targets))
    # Repetitions that some mix begins, per source: a row per source of the targets.
    needed = plan.groupBy("source").agg(F.max(F.ceil(F.col("share") * F.col("budget") / F.greatest(F.col("have"), F.lit(1)))).cast("int").alias("rounds"), F.max("have").alias("have"), F.max("rows").alias("rows")).filter("rounds > 0")
    rounds = items.join(needed, "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    order = F.xxhash64("doc_id", "repeat", F.lit(seed))
    rounds = rounds.withColumn("order", order).withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("rows") / F.lit(bucket_rows))).cast("bigint"))
    rounds = cut(rounds.select("source", "repeat", "bucket", "order", "doc_id", "tokens", "have"))
    sums = rounds.groupBy("source", "repeat", "bucket").agg(F.sum("tokens").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source", "repeat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"]).drop("_sum")
    inside = Window.partitionBy("source", "repeat", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = rounds.withColumn("_run", F.sum("tokens").over(inside)).join(before, ["source", "repeat", "bucket"])
    given = given.withColumn("given", (F.col("repeat") - 1) * F.col("have") + F.col("_before") + F.col("_run")).select("source", "repeat", "doc_id", "tokens", "given")
    served = given.join(plan.select("mix", "source", "share", "budget"), "source").withColumn("finish", F.col("given") / F.col("share")).filter("finish <= budget")
    return served.select("mix", "doc_id", "source", "repeat", "tokens", "finish").orderBy("mix", "finish", "doc_id", "repeat")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, max_repeats, tokens, share, most_repeats): what each source came to."""
    got = mix.groupBy("mix", "source").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.max("repeat").alias("most_repeats"))
    whole = got.groupBy("mix").agg(F.sum("tokens").alias("_all"))
    out = targets.select("mix", "source", "target_share", "max_repeats").join(got, ["mix", "source"], "left").join(whole, "mix", "left")
    return out.select("mix", "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
