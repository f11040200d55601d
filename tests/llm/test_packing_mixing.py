"""Problems 8 and 9: containers and mixes."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmill.llm import mixing, packing, tokens


def fewest(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        rooms = [capacity] * n

        def place(i):
            if i == len(sizes):
                return True
            for j in range(n):
                if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                    rooms[j] -= sizes[i]
                    if place(i + 1):
                        return True
                    rooms[j] += sizes[i]
            return False

        if place(0):
            return n
    return 0


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        best = fewest(sizes, 20)
        assert packing.lower_bound(np.array(sizes), 20) <= best <= packing.best_fit_decreasing(np.array(sizes), 20)[1]
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3 and packing.lower_bound(np.array([0]), 20) == 0


def test_packing_is_whole(spark):
    rng = random.Random(6)
    items = [(i, rng.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(400)] + [(5007, 50), (5007, 50), (999, None)]
    specs = spark.createDataFrame([("s", 100), ("w", 1000), ("bad", 0), (None, 5)], "spec string, capacity_tokens int")
    out = packing.pack(spark.createDataFrame(items, "doc_id long, tokens long").withColumn("slot", F.lit(1)), specs, partition_items=50).collect()
    for spec, capacity in (("s", 100), ("w", 1000)):
        mine, room = [r for r in out if r["spec"] == spec], defaultdict(int)
        for r in mine:
            room[r["container"]] += r["tokens"]
        assert max(room.values()) <= capacity and sum(room.values()) == sum(t or 0 for _, t in items)
        assert Counter(r["doc_id"] for r in mine if r["piece"] == 0) == Counter(i for i, _ in items)
        assert all(r["piece"] == 0 or dict(items)[r["doc_id"]] > capacity for r in mine)
        assert len(room) <= -(-sum(room.values()) // capacity) + 20
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), specs).count() == 0


def test_exchange_never_costs_containers(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(i, rng.randrange(20, 60)) for i in range(600)], "doc_id long, tokens long")
    specs = spark.createDataFrame([("s", 100)], "spec string, capacity_tokens int")
    used = lambda rounds: packing.filling(packing.pack(items, specs, partition_items=12, rounds=rounds)).first()
    without, after = used(0), used(4)
    assert after["tokens"] == without["tokens"] and after["pieces"] == 600
    assert after["least_containers"] <= after["containers"] < without["containers"]


def test_a_lone_partition_above_its_bound_exchanges_with_a_certified_one(spark):
    # Packed as given: (51, 49) fits, while three 51s leave room that the other partition's 49s fill.
    rows = [("s", 100, i, 0, size, part) for i, (size, part) in enumerate([(40, 0), (40, 0), (40, 0), (30, 0), (20, 1), (30, 1), (25, 1), (25, 1)])]
    df = spark.createDataFrame(rows, "spec string, capacity int, doc_id long, piece int, tokens int, part long")
    packed = df.groupBy("spec", "part").applyInPandas(packing._pack, packing.PACKED)
    assert {r["part"]: (r["used"], r["bound"]) for r in packed.collect()}[1] == (1, 1)
    gaps = packing._gaps(packed, 100)
    assert gaps == {} or (gaps["s"]["partner"] == 1 and gaps["s"]["parts"] == 1 and packed.filter(packing._taking_part(gaps)).count() == 8)
    assert packing._gaps(packed.withColumn("bound", F.when(F.col("part") == 0, F.col("used") - 1).otherwise(F.col("bound"))), 100)["s"] == {"used": 3, "parts": 1, "partner": 1}
    assert packing._gaps(packed.withColumn("bound", F.when(F.col("part") == 0, F.col("used") - 1).otherwise(F.col("bound"))), 5) == {}


def test_certificates_and_bounds_are_reported(spark):
    rng = random.Random(11)
    items = [(i, rng.choice([100, 51, 52, 60, 30])) for i in range(300)]
    specs = spark.createDataFrame([("s", 100)], "spec string, capacity_tokens int")
    out = packing.pack(spark.createDataFrame(items, "doc_id long, tokens long"), specs, partition_items=40)
    rows, fill = out.collect(), packing.filling(out).first()
    assert all(r["part_containers"] >= r["part_bound"] for r in rows if r["tokens"] < 100) and all(r["part"] is None for r in rows if r["tokens"] == 100)
    assert fill["least_containers"] == packing.lower_bound(np.array([t for _, t in items]), 100) > -(-sum(t for _, t in items) // 100)
    for part in {r["part"] for r in rows} - {None}:
        mine = [r for r in rows if r["part"] == part]
        assert len({r["container"] for r in mine}) == mine[0]["part_containers"]


def brute_mix(docs, targets, seed, order):
    out = {}
    for mix in {t[0] for t in targets}:
        want = {t[1]: (t[2], t[3]) for t in targets if t[0] == mix}
        whole = sum(w for w, _ in want.values())
        have = {s: sum(t for _, src, t in docs if src == s) for s in want}
        budget = int(min(have[s] * r / (w / whole) for s, (w, r) in want.items()) + 1e-9)
        got = []
        for s, (w, r) in want.items():
            run = 0
            for k in range(1, r + 1):
                for d, _, t in sorted((x for x in docs if x[1] == s), key=lambda x: (order[(x[0], k)], x[0])):
                    run += t
                    if run / (w / whole) <= budget:
                        got.append((d, k))
        out[mix] = sorted(got)
    return out


def test_mix_equals_simulation_and_keeps_caps(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a"] * 8 + ["b", "c"]), rng.randrange(1, 50)) for i in range(300)]
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 3), ("m", "c", 0.2, 2), ("n", "a", 1.0, 2)]
    items = spark.createDataFrame([*docs, (900, None, 5), (901, "z", 5), (902, "a", 0)], "doc_id long, source string, tokens long")
    wanted = spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int")
    keys = spark.createDataFrame([(d, k) for d, _, _ in docs for k in range(1, 5)], "doc_id long, repeat int")
    order = {(r["doc_id"], r["repeat"]): r["o"] for r in keys.select("doc_id", "repeat", F.xxhash64("doc_id", "repeat", F.lit(7)).alias("o")).collect()}
    mix = mixing.mixed(items, wanted, seed=7, bucket_rows=20)
    rows = mix.collect()
    want = brute_mix(docs, targets, 7, order)
    for m in ("m", "n"):
        assert sorted((r["doc_id"], r["repeat"]) for r in rows if r["mix"] == m) == want[m]
    assert [r["finish"] for r in rows if r["mix"] == "m"] == sorted(r["finish"] for r in rows if r["mix"] == "m")
    got = {(r["mix"], r["source"]): r for r in mixing.shares(mix, wanted).collect()}
    assert all(r["most_repeats"] <= r["max_repeats"] for r in got.values()) and abs(got[("m", "b")]["share"] - 0.3) < 0.05


def test_mix_edges(spark):
    wanted = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "none", 0.5, 1), (None, "a", 1.0, 1), ("z", "a", None, 1)], "mix string, source string, target_share double, max_repeats int")
    items = spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, tokens long")
    assert mixing.mixed(items, wanted).count() == 0 and mixing.mixed(items.limit(0), wanted).count() == 0


def test_token_counts(spark):
    texts = [None, "", "hello world", "x" * 40_000, "<|endoftext|>"]
    got = [r["tokens"] for r in tokens.sized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 1000 and got[4] > 1
    assert list(itertools.islice(got, 5)) == got


@pytest.mark.parametrize("size", [1, 99, 100, 101, 200, 201])
def test_pieces(spark, size):
    specs = spark.createDataFrame([("s", 100)], "spec string, capacity_tokens int")
    parts = [r["tokens"] for r in packing.pieces(spark.createDataFrame([(1, size)], "doc_id long, tokens long"), specs).orderBy("piece").collect()]
    assert sum(parts) == size and all(p == 100 for p in parts[:-1]) and 0 < parts[-1] <= 100
