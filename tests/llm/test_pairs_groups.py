"""Pair counts, percentiles and top N against brute force and on odd input."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nearfold.llm import cooccur, percentiles, topn

LOG = "shard int, search_id long, id long, expanded boolean, n string, _s string"


def brute_pairs(rows, least, lift):
    baskets, n = defaultdict(set), defaultdict(set)
    for s, b, i, p, *_ in rows:
        if s is None or b is None:
            continue
        n[s].add(b)
        if p and i is not None:
            baskets[s, b].add(i)
    single, both = Counter(), Counter()
    for (s, _), items in baskets.items():
        single.update((s, i) for i in items)
        both.update((s, x, y) for x, y in combinations(sorted(items), 2))
    return {
        (s, a, b, c, single[s, a], single[s, b], len(n[s]))
        for (s, a, b), c in both.items()
        if c >= least and c * len(n[s]) >= lift * single[s, a] * single[s, b]
    }


def logs(seed, n=1500):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        b = int(rng.integers(0, 90))
        # Items of a basket come from its own few, one item is nearly everywhere, one basket is huge.
        item = int(rng.choice([b % 7 * 10 + rng.integers(0, 4), 99, rng.integers(0, 300)], p=[0.6, 0.2, 0.2]))
        b = 1000 if rng.random() < 0.3 else b
        rows.append((b % 3 if b != 1000 else 1, b, item, [True, False, None][rng.choice(3, p=[0.7, 0.2, 0.1])], "x", "y"))
    return [*rows, *rows[:50], (None, 1, 1, True, "", ""), (1, None, 1, True, "", ""), (1, 2, None, True, "", "")]


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.sampled_from([0.0, 1.0, 2.5]))
def test_pairs_equal_brute_force(spark, seed, least, lift):
    rows = logs(seed)
    df = spark.createDataFrame(rows, LOG)
    # Baskets of more than 15 present rows are hot: some scopes have more of them than may be set aside.
    hot = cooccur.cooccurrence(df, "shard", "search_id", "id", F.col("expanded"), least, lift, hot_items=15)
    assert {(r.shard, r.id_a, r.id_b, r.n_ab, r.n_a, r.n_b, r.n) for r in hot.collect()} == brute_pairs(rows, least, lift)
    got = cooccur.cooccurrence(df, "shard", "search_id", "id", F.col("expanded"), least, lift)
    assert {(r.shard, r.id_a, r.id_b, r.n_ab, r.n_a, r.n_b, r.n) for r in got.collect()} == brute_pairs(rows, least, lift)
    for r in got.limit(20).collect():
        assert math.isclose(r.lift, r.n_ab * r.n / (r.n_a * r.n_b)) and math.isclose(r.pmi, math.log(r.lift), abs_tol=1e-12)


def test_pairs_of_nothing(spark):
    e = spark.createDataFrame([], LOG)
    assert cooccur.cooccurrence(e, "shard", "search_id", "id", F.col("expanded")).count() == 0
    with pytest.raises(ValueError):
        cooccur.cooccurrence(e, "shard", "search_id", "id", min_count=0)


def stats(seed, n=3000):
    rng = np.random.default_rng(seed)
    v = np.round(np.exp(rng.standard_normal(n) * 3), 2)
    odd = [None, float("nan"), -1.0, 0.0, 1e30]
    rows = []
    for i in range(n):
        tag = "hot" if rng.random() < 0.5 else (None if rng.random() < 0.05 else f"t{rng.integers(0, 5)}")
        x = odd[rng.integers(0, 5)] if rng.random() < 0.1 else float(v[i])
        rows.append((i, tag, x, int(rng.integers(0, 50))))
    return [*rows, *rows[:300], (None, "hot", 1.0, 1), (None, "hot", 1.0, 1)]


STATS = "stat_id long, tag string, a double, b int"


def brute_percentiles(rows, points):
    seen, groups = set(), defaultdict(list)
    for i, tag, a, b in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        for m, x in (("a", a), ("b", b)):
            if x is not None and not math.isnan(x) and x >= 0:
                groups[tag, m].append(float(x))
    return {(*k, len(v), p, sorted(v)[min(math.floor(p * len(v)), len(v) - 1)]) for k, v in groups.items() for p in points}


def test_percentiles_equal_brute_force_and_merge(spark):
    points = [0.0, 0.5, 0.95, 0.999, 1.0]
    rows = stats(1)
    df = spark.createDataFrame(rows, STATS).withColumn("value", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("metric", F.lit(""))
    counts = percentiles.value_counts(df, ["tag"], ["a", "b"], "stat_id", minimum=0.0)
    assert {tuple(r) for r in percentiles.percentiles(counts, points).collect()} == brute_percentiles(rows, points)
    parts = [percentiles.value_counts(df.filter(f"coalesce(stat_id, 0) % 3 = {k}"), ["tag"], ["a", "b"], "stat_id", minimum=0.0) for k in range(3)]
    assert {tuple(r) for r in percentiles.percentiles(percentiles.merge_counts(parts), points).collect()} == brute_percentiles(rows, points)


def test_bounded_error(spark):
    rows = stats(2)
    df = spark.createDataFrame(rows, STATS)
    exact = {r[:4]: r[4] for r in brute_percentiles(rows, [0.5, 0.9])}
    rough = percentiles.percentiles(percentiles.value_counts(df, ["tag"], ["a", "b"], "stat_id", value_bits=6, minimum=0.0), [0.5, 0.9])
    for r in rough.collect():
        want = exact[tuple(r)[:4]]
        assert want * (1 - 2**-5) <= r.value <= want


def test_negative_values_and_nothing(spark):
    df = spark.createDataFrame([(float(x),) for x in range(-50, 51)], "v double")
    got = percentiles.percentiles(percentiles.value_counts(df, [], ["v"]), [0.1, 0.5, 1.0])
    assert {r.p: r.value for r in got.collect()} == {0.1: -40.0, 0.5: 0.0, 1.0: 50.0}
    assert percentiles.percentiles(percentiles.value_counts(df.filter("false"), [], ["v"]), [0.5]).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.booleans())
def test_top_n_equals_brute_force(spark, seed, n, largest):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(1200):
        g = -1 if rng.random() < 0.4 else (None if rng.random() < 0.05 else int(rng.integers(0, 40)))
        s = [None, float("nan"), float(rng.integers(0, 9)) / 4][rng.choice(3, p=[0.05, 0.05, 0.9])]
        rows.append((g, None if rng.random() < 0.05 else int(rng.integers(0, 60)), s, "clash"))
    best = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = (max if largest else min)(best.get((g, i), s), s)
    want = set()
    for g in {g for g, _ in best}:
        order = sorted((((-s if largest else s), i, s) for (h, i), s in best.items() if h == g))[:n]
        want |= {(g, i, s, r + 1) for r, (_, i, s) in enumerate(order)}
    df = spark.createDataFrame(rows, "g long, i long, s double, rank string")
    assert {tuple(r) for r in topn.top_n(df, "g", "i", "s", n, largest).collect()} == want


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 3 AS g", "id AS i", "id AS s")
    plan = topn.top_n(df, "g", "i", "s", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert topn.top_n(df.filter("false"), "g", "i", "s", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "i", "s", 0)
