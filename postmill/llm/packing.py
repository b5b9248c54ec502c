"""Filling fixed-capacity containers with whole texts, planned on counts of lengths.

The plan sees only how many pieces of each length there are, at most ``capacity`` numbers, so the
driver's work is bounded by the capacity and not by the documents. Best fit in decreasing order runs
over these counts: bins of equal room form ranges, and a whole run of equal pieces is put into a
range at a time. Documents then take the planned slots by their rank within their length; ranks are
built from salted sub-ranks, so that one length holding a third of all rows is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import checkpoint


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, n, first_bin, per_bin).

    Ranks first_rank .. first_rank + n - 1 of that length go into bins from first_bin on, per_bin
    in each. Lengths must lie in 1 .. capacity.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first bin, bins)
    rooms: list[int] = []  # sorted distinct rooms
    bins = 0

    def put_back(left: int, first: int, n: int) -> None:
        if left <= 0 or n <= 0:
            return
        if left not in room:
            room[left] = []
            at = int(np.searchsorted(rooms, left))
            rooms.insert(at, left)
        room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo > 0:
            at = int(np.searchsorted(rooms, length))
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(todo, per)
                if full:
                    slots.append((length, rank, full * per, bins, per))
                    put_back(capacity - per * length, bins, full)
                    bins, rank = bins + full, rank + full * per
                if rest:
                    slots.append((length, rank, rest, bins, rest))
                    put_back(capacity - rest * length, bins, 1)
                    bins += 1
                todo = 0
                break
            left = rooms[at]
            ranges = room[left]
            first, n = ranges.pop()
            if not ranges:
                del room[left]
                rooms.pop(at)
            # every bin of a range takes as many of these pieces as best fit would put there at once
            per = min(left // length, todo)
            take = min(n, todo // per)
            slots.append((length, rank, take * per, first, per))
            put_back(left - per * length, first, take)
            if n > take:
                put_back(left, first + take, n - take)
            todo, rank = todo - take * per, rank + take * per
    return slots


def bins_used(slots: list[tuple[int, int, int, int, int]]) -> int:
    """Number of bins that a plan opens."""
    return max((first + -(-n // per) for _, _, n, first, per in slots), default=0)


def pack(sizes: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", salts: int | None = None) -> DataFrame:
    """Assign each item to a bin of each container kind.

    ``sizes`` has the key and the size of an item; ``containers`` has container_id and capacity and
    is a small dimension (it is collected). One row comes out for each container kind and piece:
    container_id, key, piece (from 1), start (from 0), n, bin_id (from 0).

    An item is cut only where it is longer than the capacity, into full pieces and a rest. Items of
    size 0 or null need no room: they come out once with bin_id null. Container kinds with a null
    capacity or one below 1 are left out. Repeated keys are separate items.
    """
    spark = sizes.sparkSession
    salts = salts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = [(r.container_id, r.capacity) for r in containers.select("container_id", "capacity").distinct().collect() if r.capacity and r.capacity > 0]
    sized = checkpoint(sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n")))
    shape = f"container_id int, `{key}` {sized.schema[key].dataType.simpleString()}, piece int, start long, n int, bin_id long"
    if not kinds:
        return spark.createDataFrame([], shape)
    caps = F.array(*[F.struct(F.lit(i).cast("int").alias("container_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, c in sorted(kinds)])
    pieces = (
        sized.select(key, "_n", F.explode(caps).alias("_c"))
        .select(key, "_n", "_c.container_id", "_c.capacity")
        .select("container_id", key, "_n", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / F.col("capacity")), F.lit(0).cast("long")))).alias("_k"))
        .select(
            "container_id", key, (F.col("_k") + 1).cast("int").alias("piece"), (F.col("_k") * F.col("capacity")).alias("start"),
            F.least(F.col("_n") - F.col("_k") * F.col("capacity"), F.col("capacity")).cast("int").alias("n"),
        )
        .withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    )
    group = ["container_id", "n", "_salt"]
    counted = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("container_id", "n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    totals: dict[int, dict[int, int]] = {}
    for r in counted.where(F.col("n") > 0).groupBy("container_id", "n").agg(F.sum("_count").alias("m")).collect():
        totals.setdefault(r.container_id, {})[r.n] = r.m
    rows = np.array(
        [(i, *slot) for i, c in sorted(kinds) for slot in sorted(plan(totals.get(i, {}), int(c)), key=lambda s: s[:2])], np.int64
    ).reshape(-1, 6)  # one row for each planned run: bounded by the capacities
    slots = spark.sparkContext.broadcast(rows)
    ranked = (
        pieces.join(offsets.drop("_count"), group)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(key, "piece")) - 1 + F.col("_before"))
        .select("container_id", key, "piece", "start", "n", "_rank")
    )

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        table = slots.value
        runs = pd.DataFrame(table[:, :2], columns=["container_id", "n"]).groupby(["container_id", "n"]).indices
        for b in batches:
            rank, bin_id = b["_rank"].to_numpy(np.int64), np.full(len(b), -1, np.int64)
            for kind, at in b.groupby(["container_id", "n"]).indices.items():
                if (run := runs.get(kind)) is None:
                    continue
                k = run[np.searchsorted(table[run, 2], rank[at], side="right") - 1]
                bin_id[at] = table[k, 4] + (rank[at] - table[k, 2]) // table[k, 5]
            yield b.drop(columns="_rank").assign(bin_id=pd.arrays.IntegerArray(bin_id, bin_id < 0))

    return ranked.mapInPandas(place, shape)
