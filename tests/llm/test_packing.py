import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeflow.llm import packing


def best_fit(sizes, capacity):
    spaces, bins = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(spaces, s)
        if i < len(spaces):
            bisect.insort(spaces, spaces.pop(i) - s)
        else:
            bins += 1
            bisect.insort(spaces, capacity - s)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    r = random.Random(seed)
    c = r.choice([10, 50, 4096])
    sizes = [r.choice([r.randint(0, c), r.randint(0, max(1, c // 5)), c // 3]) for _ in range(r.randint(0, 500))]
    capacities = (c,) if seed % 2 else tuple({max(1, c // 4), max(1, c // 2), c})
    counts = Counter(sizes)
    plan = packing.plan_packing(dict(counts), capacities)
    used, capacity, said = defaultdict(int), {}, {}
    for s, n in counts.items():
        for b, k, u in zip(*plan.find(np.full(n, s, np.int64), np.arange(n, dtype=np.int64))):
            used[b] += s
            capacity[b], said[b] = k, u
    assert sorted(used) == list(range(len(used)))
    assert all(used[b] == said[b] <= capacity[b] for b in used)
    assert all(capacity[b] == min(x for x in capacities if x >= used[b]) for b in used)  # downsized
    if seed % 2 and sizes:
        assert len(used) == max(1, best_fit(sizes, c))  # as packing item by item would


def test_least_cost():
    costs = {1024: 1024.0, 2048: 2048.0, 4096: 4096.0}
    assert packing.least_cost((1024, 2048, 4096), costs, 10, 10**9) == 4096
    assert packing.least_cost((1024, 2048, 4096), costs, 900, 900) == 1024
    assert packing.least_cost((1024, 2048, 4096), costs | {4096: 9000.0}, 10, 10**9) == 2048
    with pytest.raises(ValueError, match="larger"):
        packing.plan_packing({5: 1}, (4,))
    with pytest.raises(ValueError, match="above 0"):
        packing.plan_packing({}, ())


def test_operator(spark):
    r = random.Random(2)
    sizes = [None, 0, 0, 4096, 4097, 9000, 8192] + [r.randint(1, 3000) for _ in range(400)] + [700] * 300
    df = spark.createDataFrame([(i if i else None, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, size string")
    rows = packing.pack(df, "doc_id", "n_tokens").collect()
    whole = defaultdict(list)
    for x in rows:
        whole[x["doc_id"]].append((x["piece"], x["start"], x["size"]))
    for i, s in enumerate(sizes):
        parts = sorted(whole[i if i else None])
        assert sum(p[2] for p in parts) == (s or 0)
        assert [p[1] for p in parts] == [4096 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-(s or 0) // 4096))  # split only above the capacity
    used = defaultdict(int)
    for x in rows:
        used[x["container_id"]] += x["size"]
    assert all(used[x["container_id"]] == x["container_size"] <= x["capacity"] for x in rows)
    assert sorted(used) == list(range(len(used))) and len(used) == best_fit([x["size"] for x in rows], 4096)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty, "doc_id", "n_tokens").collect() == []
    same = spark.createDataFrame([(1, 1000)] * 8, "doc_id long, n_tokens long")
    rows = packing.pack(same, "doc_id", "n_tokens").collect()
    assert sorted(Counter(r["container_id"] for r in rows).values()) == [4, 4]
    with pytest.raises(Exception, match="negative"):
        packing.pack(spark.createDataFrame([(1, -1)], "doc_id long, n_tokens long"), "doc_id", "n_tokens").collect()


@pytest.mark.parametrize("seed", range(6))
def test_capacities_are_chosen_jointly(seed):
    r = random.Random(seed)
    counts = Counter(min(4096, max(1, int(r.lognormvariate(7, 0.6)))) for _ in range(4000))
    costs = packing.training_costs()
    plan, alone = packing.plan_jointly(dict(counts), packing.CAPACITIES, costs), packing.plan_packing(dict(counts), (4096,), sizes=packing.CAPACITIES)
    (space, cost), (most, dear) = (packing.space_and_cost(p, costs) for p in (plan, alone))
    assert space <= most and cost < 0.97 * dear and len(np.unique(plan.capacity)) > 1
    used, said = defaultdict(int), {}
    for s, n in counts.items():
        for b, k, u in zip(*plan.find(np.full(n, s, np.int64), np.arange(n, dtype=np.int64))):
            used[b] += s
            said[b] = (k, u)
    assert all(used[b] == said[b][1] <= said[b][0] for b in used) and sorted(used) == list(range(len(used)))


def test_operator_with_costs(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, r.randint(0, 5000)) for i in range(900)] + [(None, None)], "doc_id long, n_tokens long")
    rows = packing.pack(df, "doc_id", "n_tokens", costs=packing.training_costs()).collect()
    used = defaultdict(int)
    for x in rows:
        used[x["container_id"]] += x["size"]
    assert all(used[x["container_id"]] == x["container_size"] <= x["capacity"] for x in rows) and sum(used.values()) == sum(x["n_tokens"] or 0 for x in df.collect())
