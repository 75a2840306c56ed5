"""Percentiles of very large numeric columns by mergeable digests of dyadic-tree counts.

A value is quantized to the 24 leading bits of its order-preserving form (sign, exponent, 12 bits of mantissa): a
universe of 2^24 ordered leaves under a binary tree, in which node ``x`` has the children ``2x`` and ``2x + 1``, the root
is 1 and leaf ``v`` is ``2^24 + v``. A digest holds counts of nodes. Digests merge by adding counts of equal nodes, and
are compressed by folding nodes with few values into the parent.

A rank read from a digest is off by at most its error: the largest sum of the counts of inner nodes on a way from the
root to a leaf. Adding digests adds their errors at most, and compression is allowed only as far as the error, which is
measured, stays within the share of the group's values that was asked for. So the bound holds for any data and any order
of merging; half of the share is used in the tasks that read rows, the rest in merging.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HEIGHT = 24
#: Largest relative difference of a reported value from one in its leaf.
VALUE_ERROR = 2.0**-12
#: Largest rank error as a share of the group's values.
RANK_ERROR = 0.005
#: Rows that a task digests at a time.
FLUSH_ROWS = 500_000
_SIGN = np.uint64(1 << 63)
_SHIFT = np.uint64(64 - HEIGHT)
_LOW = np.uint64((1 << (64 - HEIGHT)) - 1)


def leaves(x: np.ndarray) -> np.ndarray:
    """Leaf numbers, ordered as the values; -0.0 counts as 0.0."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    ordered = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    return (ordered >> _SHIFT).astype(np.int64)


def leaf_values(v: np.ndarray) -> np.ndarray:
    """The value of each leaf that is nearest to zero."""
    wide = np.asarray(v, np.int64).astype(np.uint64) << _SHIFT
    positive = wide >= _SIGN
    return np.where(positive, wide ^ _SIGN, ~(wide | _LOW)).view(np.float64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added; keys sorted."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


_BASE = HEIGHT + 1
_MASK = (1 << _BASE) - 1
#: Nodes that a task holds before it compresses what it has, and before it gives partial digests away.
HOLD_NODES, FLUSH_NODES = 1_000_000, 4_000_000


def _levels(node: np.ndarray) -> np.ndarray:
    return np.frexp(node.astype(np.float64))[1] - 1


def _fold(keys: np.ndarray, counts: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of digests (sorted keys: group number above node) folded from the leaves up, where a family has at most the
    group's ``limit`` values. Each group's largest leaf stays a leaf: no value above it is ever reported."""
    large = (limit[keys >> _BASE] > 0) & np.r_[keys[1:] >> _BASE == keys[:-1] >> _BASE, False]
    done_k, done_c = [keys[~large]], [counts[~large]]
    keys, counts = keys[large], counts[large]
    if len(keys):
        level = _levels(keys & _MASK)
        at, at_c = keys[level == HEIGHT], counts[level == HEIGHT]
        for depth in range(HEIGHT, 0, -1):
            upper = level == depth - 1
            above, above_c = keys[upper], counts[upper]
            if not len(at):
                at, at_c = above, above_c
                continue
            parent = (at >> _BASE << _BASE) | ((at & _MASK) >> 1)
            both, both_c = _added(np.r_[parent, above], np.r_[at_c, above_c])
            folds = both_c <= limit[both >> _BASE]
            stays = ~folds[np.searchsorted(both, parent)]
            done_k.append(at[stays])
            done_c.append(at_c[stays])
            kept = ~folds[np.searchsorted(both, above)]
            at, at_c = _added(np.r_[both[folds], above[kept]], np.r_[both_c[folds], above_c[kept]])
        done_k.append(at)
        done_c.append(at_c)
    return _added(np.concatenate(done_k), np.concatenate(done_c))


def errors(keys: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The error of each group's digest: the largest sum of counts of inner nodes on a way from the root down."""
    inner = (keys & _MASK) < (1 << HEIGHT)
    keys, counts = keys[inner], counts[inner]
    level = _levels(keys & _MASK)
    at, most = keys[:0], counts[:0]
    for depth in range(HEIGHT - 1, -1, -1):
        own, own_c = keys[level == depth], counts[level == depth]
        both = np.r_[at, own]
        if len(both):
            order = np.argsort(both, kind="stable")
            sums = np.r_[most, np.zeros(len(own), np.int64)][order]
            both = both[order]
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            at, most = both[starts], np.maximum.reduceat(sums, starts)
            most[np.searchsorted(at, own)] += own_c
        if depth and len(at):
            at = (at >> _BASE << _BASE) | ((at & _MASK) >> 1)
    out = np.zeros(groups, np.int64)
    np.maximum.at(out, at >> _BASE, most)
    return out


def _totals(keys: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    n = np.zeros(groups, np.int64)
    np.add.at(n, keys >> _BASE, counts)
    return n


def tightened(keys: np.ndarray, counts: np.ndarray, groups: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Digests compressed as far as each one's error stays within ``share`` of its values. Keys sorted, each once.

    The limit of folding is halved for those groups whose error came out too large, at most down to where the height of
    the tree alone keeps it.
    """
    allowed = np.floor(_totals(keys, counts, groups) * share + 1e-9).astype(np.int64)
    limit = allowed // 2
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(keys):
        new_k, new_c = _fold(keys, counts, limit)
        bad = errors(new_k, new_c, groups) > allowed
        bad &= limit > 0  # without any folding the errors are those of the parts
        good = ~bad[new_k >> _BASE]
        done.append((new_k[good], new_c[good]))
        again = bad[keys >> _BASE]
        keys, counts = keys[again], counts[again]
        limit = limit // 2
    if not done:
        return keys, counts
    keys, counts = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of many groups (numbered from 0) by the limit ``n / k`` of folding; equal nodes of a group are added first.

    Every inner node then has at most ``n / k`` values, and the error is at most ``HEIGHT n / k``.
    """
    keys, counts = _added((group.astype(np.int64) << _BASE) | node.astype(np.int64), count.astype(np.int64))
    if len(keys):
        keys, counts = _fold(keys, counts, _totals(keys, counts, int(keys[-1] >> _BASE) + 1) // k)
    return keys >> _BASE, keys & _MASK, counts


def pack(node: np.ndarray, count: np.ndarray) -> bytes:
    """One digest (nodes sorted) as bytes: differences of nodes and counts, equal bytes of all numbers together, deflated."""
    steps, counts = np.diff(node, prepend=0).astype("<u4"), count.astype("<u8")
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (steps, counts)]
    return zlib.compress(b"".join(planes), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(n)
    counts = np.ascontiguousarray(raw[4 * n :].reshape(8, n).T).view("<u8").reshape(n)
    return np.cumsum(steps.astype(np.int64)), counts.astype(np.int64)


def _digest_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keys), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())])


class _Held:
    """Digests of the groups of one scope that a task has met."""

    def __init__(self) -> None:
        self.place: dict[tuple, int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, groups: list[tuple], group: np.ndarray, node: np.ndarray, count: np.ndarray, share: float) -> None:
        numbers = np.array([self.place.setdefault(g, len(self.place)) for g in groups], np.int64)
        keys, counts = _added((numbers[group] << _BASE) | node, count)
        self.keys, self.counts = _added(np.r_[self.keys, keys], np.r_[self.counts, counts])
        if len(self.keys) > HOLD_NODES:
            self.tighten(share)

    def tighten(self, share: float) -> None:
        self.keys, self.counts = tightened(self.keys, self.counts, len(self.place), share)

    def take(self, share: float) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
        """Every group with its number of values and its digest, which are then forgotten."""
        self.tighten(share)
        ends = np.searchsorted(self.keys >> _BASE, np.arange(len(self.place) + 1))
        for g, i in self.place.items():
            at = slice(ends[i], ends[i + 1])
            yield g, int(self.counts[at].sum()), self.keys[at] & _MASK, self.counts[at]
        self.__init__()


def _groups(columns: list[pa.ChunkedArray], rows: int) -> tuple[list[tuple], np.ndarray]:
    """The different keys of some rows, and the number of each row's among them."""
    group = np.zeros(rows, np.int64)
    for c in columns:
        codes = c.combine_chunks().dictionary_encode(null_encoding="encode")
        group = group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False)
        group = np.unique(group, return_inverse=True)[1].reshape(-1)
    first = np.zeros(int(group.max()) + 1, np.int64)
    first[group[::-1]] = np.arange(rows)[::-1]
    taken = [c.take(pa.array(first)).to_pylist() for c in columns]
    return (list(zip(*taken)) if columns else [()]), group


def _local(df: DataFrame, keys: list[str], scopes: dict[str, list[str]], value: str, share: float) -> DataFrame:
    """A digest for each group of each scope in each task's rows: ``scope``, ``keys`` (null beside the scope's own), ``n``,
    ``digest``. Rows are read once for all scopes; nothing is shuffled."""
    rows = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{value}`").cast("double").alias("__x"))
    rows = rows.filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    schema = T.StructType([T.StructField("scope", T.StringType()), *_digest_schema(rows, keys).fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: _Held() for name in scopes}
        waiting: list[pa.RecordBatch] = []

        def digest() -> None:
            t = pa.Table.from_batches(waiting)
            node = leaves(t.column("__x").to_numpy()) + (1 << HEIGHT)
            one = np.ones(len(node), np.int64)
            for name, own in scopes.items():
                held[name].add(*_groups([t.column(c) for c in own], len(node)), node, one, share)
            waiting.clear()

        def give() -> Iterator[pa.RecordBatch]:
            for name, own in scopes.items():
                out = [(name, *(dict(zip(own, g)).get(c) for c in keys), n, pack(node, count)) for g, n, node, count in held[name].take(share)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= FLUSH_ROWS:
                digest()
                if sum(len(h.keys) for h in held.values()) > FLUSH_NODES:
                    yield from give()
        if waiting:
            digest()
        yield from give()

    return rows.mapInArrow(run, schema)


def local_digests(df: DataFrame, keys: list[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """A digest for each group of each task's rows: ``keys``, ``n`` (values) and ``digest``. Nothing is shuffled."""
    _checked(rank_error)
    return _local(df, keys, {"": keys}, value, rank_error / 2).drop("scope")


def _checked(rank_error: float) -> None:
    if not 0 < rank_error <= 1:
        raise ValueError("rank_error must be above 0 and at most 1")


def _merged(parts: DataFrame, keys: list[str], share: float, points: list[float] | None) -> DataFrame:
    """Digests of equal ``keys`` added, or with ``points`` the percentiles read from them. A task takes its groups in order
    and holds no more of them than some nodes; a group of any number of parts is added up as they come."""
    placed = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    schema = _digest_schema(parts, keys)
    if points is not None:
        schema = T.StructType([*schema.fields[:-2], *(T.StructField(c, t) for c, t in (("p", T.DoubleType()), ("value", T.DoubleType()), ("n", T.LongType()), ("rank_error", T.LongType())))])
    kinds = to_arrow_schema(schema)

    def give(held: _Held) -> Iterator[pa.RecordBatch]:
        if not held.place:
            return
        if points is None:
            out = [(*g, n, pack(node, count)) for g, n, node, count in held.take(share)]
        else:
            value, n, error = _read(held.keys, held.counts, len(held.place), points)
            out = [(*g, p, value[j, i], n[i], error[i]) for g, i in held.place.items() for j, p in enumerate(points)]
            held.__init__()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        waiting: list[tuple[tuple, np.ndarray, np.ndarray]] = []

        def add() -> None:
            order: dict[tuple, int] = {}
            group = np.concatenate([np.full(len(node), order.setdefault(g, len(order)), np.int64) for g, node, _ in waiting])
            held.add(list(order), group, *(np.concatenate([w[i] for w in waiting]) for i in (1, 2)), share)
            waiting.clear()

        nodes, last = 0, None
        for batch in batches:
            names = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            for g, data in zip(names, batch.column(batch.schema.get_field_index("digest")).to_pylist()):
                if nodes > HOLD_NODES:
                    add()
                    nodes = 0
                    if g != last and len(held.keys) > HOLD_NODES // 2:
                        yield from give(held)
                waiting.append((g, *unpack(data)))
                nodes, last = nodes + len(waiting[-1][1]), g
        if waiting:
            add()
        yield from give(held)

    return placed.mapInArrow(run, schema)


def merge_digests(parts: DataFrame, keys: list[str], rank_error: float = RANK_ERROR, shard: Column | None = None) -> DataFrame:
    """Digests per ``keys`` from any number of digests of parts of the groups (of tasks, days, earlier merges), by adding
    the counts of equal nodes: ``keys``, ``n``, ``digest``.

    With ``shard``, an integer that parts the digests of a group, groups are merged per shard first, so that no task
    meets all parts of a group that every task has.
    """
    _checked(rank_error)
    if shard is not None:
        parts = _merged(parts.withColumn("__shard", shard), [*keys, "__shard"], rank_error, None).drop("__shard")
    return _merged(parts, keys, rank_error, None)


def _read(keys: np.ndarray, counts: np.ndarray, groups: int, points: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (percentile x group), numbers of values and errors."""
    group, node = keys >> _BASE, keys & _MASK
    level = _levels(node)
    last = ((node + 1) << (HEIGHT - level)) - 1 - (1 << HEIGHT)
    largest = np.full(groups, -1, np.int64)
    leaf = level == HEIGHT
    np.maximum.at(largest, group[leaf], last[leaf])
    last = np.minimum(last, largest[group])
    order = np.lexsort((-level, last, group))
    upto = np.cumsum(counts[order])
    n = _totals(keys, counts, groups)
    start = np.cumsum(n) - n
    at = [np.searchsorted(upto, start + np.maximum(np.ceil(p * n).astype(np.int64), 1)) for p in points]
    return leaf_values(last[order][np.array(at)]), n, errors(keys, counts, groups)


def read_percentiles(digests: DataFrame, keys: list[str], percentiles: list[float]) -> DataFrame:
    """``keys``, ``p``, ``value``, ``n`` and ``rank_error`` (in values, as measured) of every group and percentile.

    ``digests`` may be parts; those of a group are added. ``value`` is at most ``rank_error`` ranks from rank
    ``ceil(p n)``, and off by VALUE_ERROR of itself at most.
    """
    for p in percentiles:
        if not 0 <= p <= 1:
            raise ValueError("a percentile must be from 0 to 1")
    return _merged(digests, keys, 1.0, [float(p) for p in percentiles])


def _shards(df: DataFrame) -> int:
    """Parts that the partial digests of a group are merged in: 1 for up to 256 tasks that read, else the root of their number."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    tasks = int(str(stats.sizeInBytes())) // max(1, df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return 1 if tasks <= 256 else math.isqrt(tasks)


def percentiles(df: DataFrame, scopes: dict[str, list[str]], value: str, points: list[float], rank_error: float = RANK_ERROR) -> DataFrame:
    """Percentiles of ``value`` for each scope, a name and its grouping columns, from one pass over the rows.

    Rows: ``scope``, all grouping columns (null where the scope doesn't group by one), ``p``, ``value``, ``n``,
    ``rank_error`` (error in ranks as measured, at most ``rank_error`` of n).

    Null and NaN are no values; a group without values has no row, an empty table gives none. Infinities are values at the
    ends; -0.0 is 0.0. Null keys form groups. Ties and repeated rows each count. Other columns are not read.
    """
    _checked(rank_error)
    every = list(dict.fromkeys(c for keys in scopes.values() for c in keys))
    short = {c: f"g{i}" for i, c in enumerate(every)}
    rows = df.select(*[F.col(f"`{c}`").alias(short[c]) for c in every], F.col(f"`{value}`").alias("x"))
    names = list(short.values())
    parts = _local(rows, names, {scope: [short[c] for c in keys] for scope, keys in scopes.items()}, "x", rank_error / 2)
    keys, shards = ["scope", *names], _shards(rows)
    if shards > 1:
        parts = _merged(parts.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(shards))), [*keys, "shard"], rank_error, None).drop("shard")
    out = read_percentiles(parts, keys, points)
    return out.select("scope", *[F.col(short[c]).alias(c) for c in every], "p", "value", "n", "rank_error")
