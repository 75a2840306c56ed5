"""Items into containers of a few permitted capacities with little unused space: variable-capacity best fit, decreasing.

The packing is planned for all items at once from the number of items of each size, at most as many numbers as the
largest capacity, however many items there are. Sizes are placed in decreasing order, each item into the open bin that
it leaves the least space in; where none has room, a bin of the least-cost size for what is still to place is opened, and
at the end each bin gets the smallest permitted capacity that holds its contents. With costs that grow faster than the
capacity the sizes to open are optimised jointly: packings that turn from the largest to smaller bins at different
points are planned in full, and of those with no more unused space than the largest capacity alone would leave the one
of the least cost is taken. The plan says which ranks among the items of a size go to which bins; items then find their
bin by their rank, so that no task sees a bin's items together.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

#: Permitted container capacities, in tokens.
CAPACITIES = (1024, 2048, 4096)
#: Points tried for turning to smaller bins, as parts of all that there is to place.
TURNS = 20
#: Length at which attention costs as much as all else of a training step.
ATTENTION = 4096


def training_costs(capacities: tuple[int, ...] = CAPACITIES) -> dict[int, float]:
    """What a sequence of each capacity costs to train on: its length, and attention by the square of it."""
    return {c: c * (1 + c / ATTENTION) for c in capacities}


@dataclass
class _Group:
    """``bins`` alike bins from number ``first``, with ``space`` left and ``used`` filled."""

    first: int
    bins: int
    space: int
    used: int


@dataclass(frozen=True)
class Plan:
    """For each placement, sorted by size and rank: items of ``size`` from ``rank`` on go ``each`` to a bin from ``bin`` on.

    ``last`` (sorted), ``capacity`` and ``used`` describe the bins up to number ``last``.
    """

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    last: np.ndarray
    capacity: np.ndarray
    used: np.ndarray

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, its capacity and its contents' size for items given by size and rank."""
        key = (self.size << 44) + self.rank
        i = np.searchsorted(key, (size << 44) + rank, side="right") - 1
        number = self.bin[i] + (rank - self.rank[i]) // self.each[i]
        j = np.searchsorted(self.last, number)
        return number, self.capacity[j], self.used[j]


def least_cost(capacities: tuple[int, ...], costs: dict[int, float], size: int, left: int) -> int:
    """The bin size to open for an item of ``size`` with items of ``left`` in all still to place.

    Of the sizes that hold the item, the one with the least cost a unit; where all that is left fits into the largest, the
    one that holds it at the least cost. The larger of equals.
    """
    fit = [c for c in capacities if c >= size]
    if left > capacities[-1]:
        return min(fit, key=lambda c: (costs[c] / c, -c))
    return min(fit, key=lambda c: (costs[c] * max(1, -(-left // c)), -c))


def plan_packing(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, costs: dict[int, float] | None = None, turn: float = 1.0, sizes: tuple[int, ...] | None = None) -> Plan:
    """The plan for ``counts`` items of each size (from 0 to the largest capacity). A bin costs its capacity by default.

    While more than ``turn`` of the sum of sizes is left to place, only bins of the largest capacity are opened. At the end
    bins get the smallest of ``sizes`` (``capacities`` if None) that holds their contents.
    """
    capacities = tuple(sorted(set(capacities)))
    costs = costs or {c: float(c) for c in capacities}
    if not capacities or capacities[0] <= 0:
        raise ValueError("capacities must be above 0")
    if counts and max(counts) > capacities[-1]:
        raise ValueError("an item is larger than the largest capacity")
    by_space: dict[int, list[_Group]] = {}
    spaces: list[int] = []
    placed: list[tuple[int, int, int, int]] = []
    left = sum(s * n for s, n in counts.items())
    wide = int(left * turn)
    bins = 0

    def keep(g: _Group) -> None:
        if g.space not in by_space:
            by_space[g.space] = []
            bisect.insort(spaces, g.space)
        by_space[g.space].append(g)

    def put(g: _Group, size: int, rank: int, n: int) -> int:
        """Up to ``n`` items into bins of ``g``, each bin as full as it gets before the next; returns how many."""
        each = min(g.space // size if size else n, n)
        whole = min(g.bins, n // each)
        done = whole * each
        placed.append((size, rank, g.first, each))
        keep(_Group(g.first, whole, g.space - each * size, g.used + each * size))
        rest = g.bins - whole
        at = g.first + whole
        if rest and done < n and n - done < each:
            placed.append((size, rank + done, at, n - done))
            keep(_Group(at, 1, g.space - (n - done) * size, g.used + (n - done) * size))
            at, rest, done = at + 1, rest - 1, n
        if rest:
            keep(_Group(at, rest, g.space, g.used))
        return done

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[size]
        while n:
            i = bisect.bisect_left(spaces, size)
            if i < len(spaces):
                group = by_space[spaces[i]].pop()
                if not by_space[spaces[i]]:
                    del by_space[spaces[i]]
                    del spaces[i]
            else:
                capacity = capacities[-1] if left > wide else least_cost(capacities, costs, size, left)
                several = capacity // size if size else n
                # as many bins at once as the choice of size stays the same for
                until = max(capacities[-1], wide) if left > wide else capacities[-1]
                alike = min(n // several, (left - until) // (several * size)) if size else 1
                group = _Group(bins, max(1, alike), capacity, 0)
                bins += group.bins
            done = put(group, size, rank, n)
            rank, n, left = rank + done, n - done, left - done * size
    groups = sorted((g for gs in by_space.values() for g in gs), key=lambda g: g.first)
    placed.sort()
    table = np.array(placed, np.int64).reshape(-1, 4)
    sizes = tuple(sorted(sizes or capacities))
    capacity = [next(c for c in sizes if c >= g.used) for g in groups]  # the downsizing
    return Plan(*table.T.copy(), np.array([g.first + g.bins - 1 for g in groups], np.int64), np.array(capacity, np.int64), np.array([g.used for g in groups], np.int64))


def space_and_cost(plan: Plan, costs: dict[int, float]) -> tuple[int, float]:
    """Sum of the capacities, and of the costs, of a plan's bins."""
    bins = np.diff(np.r_[-1, plan.last])
    each = {c: int(bins[plan.capacity == c].sum()) for c in np.unique(plan.capacity).tolist()}
    return sum(c * n for c, n in each.items()), sum(costs[c] * n for c, n in each.items())


def plan_jointly(counts: dict[int, int], capacities: tuple[int, ...], costs: dict[int, float]) -> Plan:
    """The plan of the least cost among those with no more unused space than bins of the largest capacity alone leave.

    Tried are all sets of capacities with the largest, each with TURNS points at which smaller bins begin to be opened:
    some dozens of plans over the same counts, whatever the number of items.
    """
    capacities = tuple(sorted(set(capacities)))
    best = plan_packing(counts, capacities[-1:], costs, sizes=capacities)
    most, least = space_and_cost(best, costs)
    for k in range(1, len(capacities)):
        for smaller in combinations(capacities[:-1], k):
            for i in range(1, TURNS + 1):
                plan = plan_packing(counts, (*smaller, capacities[-1]), costs, i / TURNS, capacities)
                space, cost = space_and_cost(plan, costs)
                if space <= most and cost < least:
                    best, least = plan, cost
    return best


def pieces(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``id``, ``piece``, ``start`` and ``size``: items up to ``capacity`` whole, larger ones in pieces of ``capacity`` and the rest."""
    size = F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0))
    n = F.greatest(F.ceil(size / F.lit(capacity)), F.lit(1)).cast("bigint")
    rows = items.select(F.col(f"`{id_col}`").alias("id"), size.alias("whole"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("whole") - start).alias("size"))


def pack(items: DataFrame, id_col: str, size_col: str, capacities: tuple[int, ...] = CAPACITIES, costs: dict[int, float] | None = None) -> DataFrame:
    """Every item, or piece of an item above the largest capacity, with its container.

    Rows: ``id_col``, ``piece`` (from 0), ``start`` (of the piece within the item), ``size``, ``container_id`` (from 0
    without gaps), ``capacity`` (of the container) and ``container_size`` (of its contents). Items are split only if
    larger than the largest capacity. A null size counts as 0, and items of size 0 lie in some container like all others;
    a negative size is an error. A repeated row is an item each time; null ids stay null; an empty table gives no rows.
    With ``costs`` of the capacities the sizes to open are chosen by :func:`plan_jointly`.

    The items are written to the shared checkpoint folder once, as the plan and the assignment both need them.
    """
    largest = max(capacities)
    spark = items.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checked = F.when(F.col(f"`{size_col}`") < 0, F.raise_error(F.lit("an item's size is negative"))).otherwise(F.col(f"`{size_col}`"))
    sized = items.select(F.col(f"`{id_col}`").alias("id"), checked.alias("n"))
    # equal sizes are numbered in parts, so that a size that many items have is no one task's; the part is drawn by a
    # hash of the id, or of the place for rows without a telling id
    cut = pieces(sized, "id", "n", largest)
    rows = checkpointed(cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(salts)).cast("int")))
    part = ["size", "salt"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    # at most as many rows as the largest capacity + 1
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacities) if costs is None else plan_jointly(histogram, capacities, costs)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*part).orderBy("id", "piece")) - 1
    ranked = rows.withColumn("number", number).join(offsets, part).select("id", "piece", "start", "size", (F.col("number") + F.col("before")).alias("rank"))
    id_type = rows.schema["id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, long) for c in ("piece", "start", "size", "container_id", "capacity", "container_size"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = plan.find(batch.column(3).to_numpy(), batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.int64()) for x in found)], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
