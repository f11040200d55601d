"""Filling containers of fixed capacity (problem 8).

Items are hashed into partitions small enough for one task and packed there best-fit decreasing.
Dual feasible functions give a lower bound on the containers any packing of the partition needs; a
partition that meets its bound is certified and done. The others exchange their items (one new
hash over all of them) and are packed again, as long as that saves containers; a lone partition
above its bound exchanges with a certified one. Each result tells the containers and the bound of
its partition.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackmill.session import cut

#: Items of a partition on average. A partition of an exchange may hold GROWTH times as many.
PARTITION_ITEMS, GROWTH = 20_000, 4
#: Exchanges end when one saves less than this share of the containers that took part (or none).
LEAST_SAVING = 0.0005
MOST_SPECS = 1000


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that items of these sizes (each ``counts`` times) need at least, by two families of dual feasible functions.

    u_k rounds sizes to k-ths of the capacity; f_t drops items below t and counts those above
    capacity - t as full. Both keep any feasible filling feasible, so the sums bound the containers.
    """
    values, counts = np.unique(sizes, return_counts=True) if counts is None else (sizes, counts)
    values, counts = values[values > 0], counts[values > 0]
    if len(values) == 0:
        return 0
    best = -(-int((values * counts).sum()) // capacity)
    for k in range(1, 21):
        scaled = values * (k + 1)
        whole = scaled % capacity == 0
        # In units of k * capacity: exact multiples keep their share, others are rounded down to k-ths.
        units = np.where(whole, values * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    for t in np.unique(np.minimum(values, capacity // 2)):
        if 0 < t <= capacity // 2:
            units = np.where(values > capacity - t, capacity, np.where(values >= t, values, 0))
            best = max(best, -(-int((units * counts).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of each item and the number of containers. Sizes must not exceed the capacity."""
    place = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # residual capacities that some container has, sorted
    holders: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bin_no, room = used, capacity
            used += 1
        else:
            room = rooms[at]
            bin_no = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(at)
        place[i] = bin_no
        left = room - size
        if left in holders:
            holders[left].append(bin_no)
        else:
            holders[left] = [bin_no]
            insort(rooms, left)
    return place, used


PACKED = "spec string, capacity int, doc_id bigint, piece int, tokens int, part bigint, slot bigint, used bigint, bound bigint"


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    capacity = int(group["capacity"].iloc[0])
    group = group.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    sizes = group["tokens"].to_numpy(np.int64)
    place, used = best_fit_decreasing(sizes, capacity)
    return group.assign(slot=place, used=used, bound=lower_bound(sizes, capacity))[["spec", "capacity", "doc_id", "piece", "tokens", "part", "slot", "used", "bound"]]


def pieces(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, capacity, doc_id, piece, tokens): every item once, only those above the capacity in pieces.

    Pieces but the last are full. Items of no tokens stay, as one piece of size 0. Specs without a
    positive capacity are left out; repeated items are packed each.
    """
    specs = specs.select("spec", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0 AND spec IS NOT NULL").distinct()
    # The sizes are a short list; it is unrolled into the plan, and a longer one is refused, never cut.
    rows = specs.orderBy("spec").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    offered = F.array(*[F.struct(F.lit(r["spec"]).alias("spec"), F.lit(r["capacity"]).alias("capacity")) for r in rows]) if rows else F.array().cast("array<struct<spec:string,capacity:int>>")
    each = items.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("total"), F.inline(offered))
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")).cast("int"), F.lit(1)) - 1
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return each.select("spec", "capacity", "doc_id", "piece", F.least(F.col("capacity").cast("bigint"), F.col("total") - F.col("piece").cast("bigint") * F.col("capacity")).cast("int").alias("tokens"))


def pack(items: DataFrame, specs: DataFrame, partition_items: int = PARTITION_ITEMS, rounds: int | None = None) -> DataFrame:
    """(spec, capacity, doc_id, piece, tokens, container, part, part_containers, part_bound) of every piece.

    ``items`` has (doc_id, tokens). Containers are numbered per spec, unique but not without gaps.
    ``part_containers`` is what the piece's partition was packed into and ``part_bound`` what it
    needs at least: the partition is certified where they are equal. Pieces that fill a container
    are in no partition and null there. Exchanges go on while they save containers, or for
    ``rounds`` rounds. An empty table gives no rows.
    """
    loose = cut(pieces(items, specs))
    # Full pieces need no packing: each is a container.
    none = F.lit(None).cast("bigint")
    full = loose.filter("tokens = capacity").withColumn("container", -1 - F.monotonically_increasing_id()).withColumns({"part": none, "part_containers": none, "part_bound": none})  # fixed, as the pieces are written
    open_ = loose.filter("tokens < capacity")
    parts = {r["spec"]: max(1, -(-r["n"] // partition_items)) for r in open_.groupBy("spec").agg(F.count("*").alias("n")).collect()}
    packed = _packed(open_, parts, 0)
    done: list[DataFrame] = []
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        gaps = _gaps(packed, GROWTH * partition_items)
        if not gaps:
            break
        again = _packed(packed.filter(_taking_part(gaps)).drop("part", "slot", "used", "bound"), {s: g["parts"] for s, g in gaps.items()}, turn)
        saved = {s: gaps[s]["used"] - used for s, used in _used(again).items() if used < gaps[s]["used"]}
        if not saved:
            break
        better = {s: g for s, g in gaps.items() if s in saved}
        done.append(packed.filter(~_taking_part(better)))
        packed = again.filter(F.col("spec").isin(list(saved)))
        if all(n < LEAST_SAVING * gaps[s]["used"] for s, n in saved.items()):
            break
    done.append(packed)
    columns = [c for c in full.columns if c not in ("part", "part_containers", "part_bound")]
    out = full.select(*columns, "part", "part_containers", "part_bound")
    for part in done:
        part = part.withColumn("container", F.col("part") * (1 << 24) + F.col("slot"))
        out = out.unionByName(part.select(*columns, "part", F.col("used").alias("part_containers"), F.col("bound").alias("part_bound")))
    return out


def _gapped() -> Column:
    return F.col("used") > F.col("bound")


def _packed(open_: DataFrame, parts: dict[str, int], turn: int) -> DataFrame:
    """Pieces with their partition and slot; part numbers of different turns never meet."""
    number = F.coalesce(*[F.when(F.col("spec") == s, F.lit(n)) for s, n in parts.items()], F.lit(1)) if parts else F.lit(1)
    part = F.lit(turn * (1 << 32)) + F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), number).cast("bigint")
    return cut(open_.withColumn("part", part).groupBy("spec", "part").applyInPandas(_pack, PACKED))


def _partitions(packed: DataFrame) -> DataFrame:
    return packed.groupBy("spec", "part").agg(F.first("used").alias("used"), F.first("bound").alias("bound"), F.count("*").alias("n"))


def _gaps(packed: DataFrame, most_items: int) -> dict[str, dict]:
    """Per spec that may exchange: the containers of those that take part, their new number of partitions, and the partner of a lone one.

    Specs whose one partition above its bound has no partner, or would come to more than ``most_items``, stay as they are.
    """
    above = F.col("used") > F.col("bound")
    partner = F.min(F.when(~above, F.struct("n", "part", "used")))
    rows = _partitions(packed).groupBy("spec").agg(F.count_if(above).alias("above"), F.sum(F.when(above, F.col("used"))).alias("used"), F.sum(F.when(above, F.col("n"))).alias("n"), partner.alias("partner")).filter("above > 0").collect()
    out: dict[str, dict] = {}
    for r in rows:
        alone = r["above"] == 1
        if alone and r["partner"] is None:
            continue
        used, n = (r["used"] + r["partner"]["used"], r["n"] + r["partner"]["n"]) if alone else (r["used"], r["n"])
        parts = 1 if alone else r["above"] - 1
        if n <= most_items * parts:
            out[r["spec"]] = {"used": used, "parts": parts, "partner": r["partner"]["part"] if alone else None}
    return out


def _taking_part(gaps: dict[str, dict]) -> Column:
    """Pieces of partitions above their bound, and of the partner of a lone one."""
    mine = F.col("spec").isin(list(gaps)) & _gapped()
    for spec, gap in gaps.items():
        if gap["partner"] is not None:
            mine = mine | ((F.col("spec") == spec) & (F.col("part") == gap["partner"]))
    return mine


def _used(packed: DataFrame) -> dict[str, int]:
    return {r["spec"]: r["used"] for r in _partitions(packed).groupBy("spec").agg(F.sum("used").alias("used")).collect()}


FILLED = "spec string, least_containers bigint"


def _spec_bound(sizes: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"spec": [sizes["spec"].iloc[0]], "least_containers": [lower_bound(sizes["tokens"].to_numpy(np.int64), int(sizes["capacity"].iloc[0]), sizes["n"].to_numpy(np.int64))]})


def filling(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the bound no packing can beat, and the share of room left unused.

    The bound is that of the dual feasible functions over all pieces of the spec; they are counted
    by size first, and a spec has no more sizes than its capacity.
    """
    sizes = packed.groupBy("spec", "capacity", "tokens").agg(F.count("*").alias("n"))
    bounds = sizes.groupBy("spec").applyInPandas(_spec_bound, FILLED)
    per = packed.groupBy("spec", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("pieces"))
    return per.join(bounds, "spec").withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))
