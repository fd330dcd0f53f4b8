"""Histogram statistics and ordered helpers with one key holding most rows."""

import random

import numpy as np
import pytest

from strandframe.operators import histograms as H
from strandframe.operators import ordering as O


def hist(spark, values):
    return H.histogram(spark.createDataFrame([(v,) for v in values], "v long"), "v")


def test_median_is_the_first_value_leaving_half(spark):
    assert H.median(hist(spark, range(10))).first().median == 4
    assert H.median(hist(spark, [1, 1, 1, 9])).first().median == 1


def test_mass_quantile_weighs_values(spark):
    got = {r.q: r.value for r in H.mass_quantile(hist(spark, [1, 1, 1, 1, 16]), 0.2, 0.5).collect()}
    assert got == {0.2: 1, 0.5: 16}


def test_deviation_keeps_the_larger_side(spark):
    h = spark.createDataFrame([(1, 100), (5, 200), (9, 3)], "value long, n long")
    dev = {r.value: r.n for r in H.deviations(h, H.median(h)).collect()}
    assert dev == {0: 200, 4: 3}


def test_insert_sizes_ignore_outliers(spark):
    rng = random.Random(1)
    values = [int(rng.gauss(200, 10)) for _ in range(3000)] + [100000, 5]
    s = H.insert_size_stats(hist(spark, values)).first()
    kept = np.array(values[:-2], float)
    assert s.total == 3000 and s.mean == pytest.approx(kept.mean()) and s.sd == pytest.approx(kept.std())


@pytest.mark.parametrize("seed", range(6))
def test_central_interval_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    h = {v: rng.choice([1, 2, 2, 3, 5]) for v in range(40) if rng.random() < 0.93 or v == 20}
    total, mass = sum(h.values()), rng.choice([0.2, 0.5, 0.9])
    lo, hi, have = 19, 21, h[20] / total
    while have < mass:
        a, b = h.get(lo, -1) / total, h.get(hi, -1) / total
        if a < 0 and b < 0:
            break
        if a >= 0 and a > b:
            have, lo = have + a, lo - 1
        else:
            have, hi = have + b, hi + 1
    df = spark.createDataFrame(list(h.items()), "value long, n long")
    assert tuple(H.central_interval(df, 20, mass).first()) == (lo, hi)


def test_keyed_running_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(5), i, rng.randrange(100)) for i in range(3000)]
    split = O.keyed_ranges(spark.createDataFrame(rows, "k int, o long, v long"), ["k"], ["o"])
    assert split.groupBy(O.RANGE).count().agg({"count": "max"}).first()[0] < 1500
    out = O.keyed_running(split, ["k"], ["o"], "sum", "v", "s")
    out = O.keyed_running(out, ["k"], ["o"], "min", "v", "m")
    out = O.keyed_running(out, ["k"], ["o"], "max", "v", "x", inclusive=False)
    out = O.keyed_previous(out, ["k"], ["o"], "v", "p")
    out = O.keyed_previous(out, ["k"], ["o"], "v", "q", step=-1)
    got = {(r.k, r.o): (r.s, r.m, r.x, r.p, r.q) for r in out.collect()}
    want, by_key = {}, {}
    for k, o, v in sorted(rows):
        by_key.setdefault(k, []).append((o, v))
    for k, items in by_key.items():
        vs = [v for _, v in items]
        for i, (o, v) in enumerate(items):
            want[k, o] = (sum(vs[:i + 1]), min(vs[:i + 1]), max(vs[:i]) if i else None, vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None)
    assert got == want


def test_neighbour_values_cross_ranges(spark):
    df = spark.range(500).selectExpr("id as k", "id * 2 as v")
    got = O.neighbour_values(df, ["k"], previous={"p": "v"}, following={"f": "v"}).orderBy("k").collect()
    assert [r.p for r in got] == [None] + [2 * i for i in range(499)]
    assert [r.f for r in got] == [2 * i for i in range(1, 500)] + [None]


def test_ordinals_are_dense(spark):
    df = spark.range(400).selectExpr("(id * 7919) % 4001 as k")
    assert [r.ordinal for r in O.row_ordinals(df, ["k"]).orderBy("k").collect()] == list(range(1, 401))


def test_merged_ranges_over_many_ranges(spark):
    rows = [(1, i, i + 2) for i in range(300)] + [(1, 1000, 1001), (2, 0, 5000)]
    got = sorted(tuple(r) for r in H.merge_ranges(spark.createDataFrame(rows, "k int, lo long, hi long"), ["k"]).select("k", "lo", "hi").collect())
    assert got == [(1, 0, 301), (1, 1000, 1001), (2, 0, 5000)]


def test_half_weights_on_ties_and_far_points_dropped(spark):
    pts = spark.createDataFrame([("a", 5.0, 2.0), ("a", 11.0, 1.0), ("a", 30.0, 7.0)], "k string, d double, weight double")
    graph = spark.createDataFrame([("a", 0), ("a", 10), ("a", 20)], "k string, length long")
    got = {r.length: r.weight for r in H.estimate_distances(pts, graph, ["k"], 5).collect()}
    assert got == {0: 1.0, 10: 2.0, 20: 0.0}


def test_smoothing_keeps_monotone_series_and_drops_spikes():
    up = np.arange(12.0)
    assert np.array_equal(H.smooth_3rs3r(up), up)
    spiked = up.copy()
    spiked[6] = 100
    assert H.smooth_3rs3r(spiked)[6] <= 7


def test_threshold_on_a_rising_histogram(spark):
    counts = [50, 30, 10, 5, 2, 1, 1, 2, 4, 8, 16, 32, 64, 128, 64, 32, 16, 8, 4, 2, 1, 1, 1, 1, 1, 1]
    h = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "value long, n long")
    width, n = 4, len(counts)
    w = lambda i: sum(counts[i + j] * min(j + 1, width - j) for j in range(width) if i + j < n)
    count, want = 0, None
    for i in range(1, n - width):
        count += w(i) > w(i - 1)
        if i > width and w(i - width) > w(i - width - 1):
            count -= 1
        if 2 * count >= width:
            want = i
            break
    assert H.rising_threshold(h, width).first().threshold == want


@pytest.mark.parametrize("how", ["sum", "min", "max"])
def test_running_values_carry_one_row_per_range(spark, how):
    """a key over many ranges, keys inside one range; what is carried is broadcast and not joined by key."""
    from strandframe.operators.ordering import RANGE, keyed_ranges, keyed_running
    rows = [(k, i, (i * 7 + k) % 11 if i % 5 else None) for k, n in ((1, 3), (2, 400), (3, 1), (4, 90)) for i in range(n)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = keyed_ranges(spark.createDataFrame(rows, "k int, i int, v long"), ["k"], ["i"])
        assert split.where("k = 2").select(RANGE).distinct().count() > 2
        for inclusive in (True, False):
            out = keyed_running(split, ["k"], ["i"], how, "v", "o", inclusive)
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            got = {(r.k, r.i): r.o for r in out.collect()}
            for k, i, _ in rows:
                seen = [v for kk, j, v in rows if kk == k and (j <= i if inclusive else j < i) and v is not None]
                want = {"sum": sum, "min": min, "max": max}[how](seen) if seen else None
                assert got[k, i] == want or (how == "sum" and not seen and got[k, i] in (0, None))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
