"""Tail-probability helpers against independent computations."""

import itertools
import math

from pyspark.sql import functions as F

from ledgerlens.functions.distributions import betainc, mann_whitney_p, mw_exact_sf, t_two_sided_p
from ledgerlens.operators import frames as fr
from ledgerlens.operators import stats as st


def test_t_p_matches_known_values():
    # t distribution with 1 df is Cauchy: p = 1 - 2/pi * atan(|t|)
    for t in (0.5, 1.0, 3.0):
        assert abs(t_two_sided_p(t, 1.0) - (1 - 2 / math.pi * math.atan(t))) < 1e-12
    # 2 df: p = 1 - |t| / sqrt(t^2 + 2)
    for t in (0.3, 2.0):
        assert abs(t_two_sided_p(t, 2.0) - (1 - t / math.sqrt(t * t + 2))) < 1e-12
    assert abs(betainc(2.0, 3.0, 0.4) - 0.5248) < 1e-12


def test_exact_mann_whitney_by_enumeration():
    for n1, n2 in [(3, 4), (2, 6), (5, 5)]:
        vals = list(range(n1 + n2))
        us = []
        for combo in itertools.combinations(vals, n1):
            r1 = sum(v + 1 for v in combo)
            us.append(r1 - n1 * (n1 + 1) / 2)
        for u in range(0, n1 * n2 + 1):
            want = sum(1 for x in us if x >= u) / len(us)
            assert abs(mw_exact_sf(u, n1, n2) - want) < 1e-12


def _counts_by_products(m, n):
    """Subsets of size m of 1..m+n by rank sum less its least, by adding one
    number after the other."""
    ways = [[0] * (m * n + 1) for _ in range(m + 1)]
    ways[0][0] = 1
    for number in range(n + m):
        for k in range(min(m, number + 1), 0, -1):
            step = number - (k - 1)
            if step <= n:
                for x in range(m * n, step - 1, -1):
                    ways[k][x] += ways[k - 1][x - step]
    return ways[m]


def test_exact_tail_of_larger_samples_and_bounded_memory():
    import math
    import tracemalloc

    for m, n in ((1, 4), (3, 7), (5, 12), (8, 20), (13, 15)):
        ways = _counts_by_products(m, n)
        assert sum(ways) == math.comb(m + n, m)
        for u in range(-1, m * n + 2):
            want = sum(ways[max(u, 0):]) / math.comb(m + n, m)
            assert abs(mw_exact_sf(u, n, m) - want) < 1e-14, (m, n, u)
    tracemalloc.start()
    got = mw_exact_sf(6_000_000, 8, 1_000_000)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    # close to the normal tail, whose variance is known
    z = (6_000_000 - 4_000_000) / math.sqrt(8e6 * 1_000_009 / 12)
    assert abs(got - 0.5 * math.erfc(z / math.sqrt(2))) < 2e-3
    assert mw_exact_sf(8_000_000, 8, 1_000_000) == 1 / math.comb(1_000_008, 8)


def test_mann_whitney_p_bounds_and_branches():
    assert mann_whitney_p(6.0, 3, 4, 0.0, exact_max_n=8) <= 1.0
    assert mann_whitney_p(0.0, 3, 4, 0.0, exact_max_n=8) == 2 * mw_exact_sf(12, 3, 4)
    assert mann_whitney_p(0.0, 3, 4, 0.0) != 2 * mw_exact_sf(12, 3, 4)   # the exact rule is off by default
    p = mann_whitney_p(75.0, 10, 8, 6.0)          # ties -> normal approximation
    assert 0.0 < p < 0.01


def test_t_p_keeps_its_digits_at_large_df():
    normal = math.erfc(2.0 / math.sqrt(2.0))
    for df in (1e8, 1e10, 1e12):
        # the t tail exceeds the normal one by about phi(t) (t^3 + t) / (2 df)
        gap = math.exp(-2.0) / math.sqrt(2 * math.pi) * 10 / (2 * df)
        assert abs(t_two_sided_p(2.0, df) - normal - gap) < 1e-12
    # both ways agree where they meet
    for t in (0.1, 1.0, 2.5, 6.0):
        assert abs(t_two_sided_p(t, 99_999.0) / t_two_sided_p(t, 100_001.0) - 1) < 1e-6
    assert t_two_sided_p(0.0, 5.0) == 1.0
    assert abs(t_two_sided_p(40.0, 3.0) / 3.43e-5 - 1) < 0.01


def _long(spark, rows):
    return spark.createDataFrame(rows, "status string, feature string, value double")


def test_third_group_and_constant_features(spark):
    rows = [("failed", "f", 1.0), ("failed", "f", 2.0), ("survived", "f", 3.0), ("survived", "f", 4.0),
            ("other", "f", 9.0), (None, "f", 0.0), ("failed", "g", 1.0), ("failed", "g", 1.0),
            ("survived", "g", 1.0), ("survived", "g", 1.0)]
    long = _long(spark, rows)
    mw = {r.feature: r for r in st.mann_whitney_with_p(long).collect()}
    assert (mw["f"].n1, mw["f"].n2, mw["f"].u_stat, mw["f"].tie_term) == (2, 2, 0.0, 0.0)
    assert mw["g"].u_p_value is None or math.isnan(mw["g"].u_p_value)
    w = {r.feature: r for r in st.welch(st.group_moments(long)).collect()}
    assert w["g"].t_stat is None and w["g"].welch_df is None and w["g"].cohens_d == 0.0
    assert abs(w["f"].t_stat + 2 / math.sqrt(0.5)) < 1e-12 and abs(w["f"].welch_df - 2.0) < 1e-12


def test_millions_of_ties_do_not_overflow(spark):
    n = 3_100_000
    long = spark.range(n).select(F.when(F.col("id") % 2 == 0, "failed").otherwise("survived").alias("status"),
                                 F.lit("f").alias("feature"), F.lit(5.0).alias("value"))
    r = st.mann_whitney(long).collect()[0]
    assert r.u_stat == n * n / 8 and r.tie_term == float(n) ** 3 - n


def test_spearman_by_hand_and_constant(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, 1.0, 7.0), (3.0, 4.0, 7.0), (4.0, 3.0, 7.0), (None, 5.0, 7.0), (2.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.feature_x, r.feature_y): (r.n, r.rho) for r in st.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert got[("b", "a")][0] == 4 and abs(got[("b", "a")][1] - 0.6) < 1e-12   # 1 - 6 * 4 / (4 * 15)
    assert got[("c", "a")] == (4, None) and got[("c", "b")] == (5, None)
    assert st.spearman_pairs(df, ["a", "b", "c"], min_nonnull=5).count() == 0


def test_labels_round_ties_to_even(spark):
    rows = [(12.25, 2.5e9, 0.0125), (6.25, 4.5e9, 0.0004), (6.35, 1234567.0, 0.5)]
    df = spark.createDataFrame(rows, "pct double, usd double, p double")
    got = df.select(fr.pct_label(F.col("pct")), fr.billions_label(F.col("usd")), fr.comma_label(F.col("usd")),
                    st.p_label(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("12.2%", "$2B", "2,500,000,000", "p=0.012"),
                                       ("6.2%", "$4B", "4,500,000,000", "p<0.001"),
                                       ("6.4%", "$0B", "1,234,567", "p=0.500")]


def test_spearman_of_every_pair_by_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [tuple(None if rng.random() < 0.3 else float(rng.randrange(6)) if i < 3 else rng.gauss(0, 1) for i in range(5)) for _ in range(300)]
    rows += [(None,) * 5, (1.0, None, None, None, None)]
    names = ["a", "b", "c", "d", "feature_x"]
    got = {(r.feature_x, r.feature_y): (r.n, r.rho) for r in st.spearman_pairs(
        spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names, lower_only=False).collect()}
    assert len(got) == 20

    def ranks(v):
        return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            if i == j:
                continue
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            rx, ry = ranks([p[0] for p in both]), ranks([p[1] for p in both])
            m = (len(both) + 1) / 2
            xy = sum((a - m) * (b - m) for a, b in zip(rx, ry))
            want = xy / math.sqrt(sum((a - m) ** 2 for a in rx)) / math.sqrt(sum((b - m) ** 2 for b in ry))
            assert got[(x, y)][0] == len(both) and abs(got[(x, y)][1] - want) < 1e-12


def test_spearman_ranks_once_whatever_the_pairs(spark, monkeypatch):
    made = []
    whole = st.materialize
    monkeypatch.setattr(st, "materialize", lambda df: made.append(1) or whole(df))
    df = spark.createDataFrame([(float(i), float(-i), float(i % 3), float(i * i)) for i in range(20)], "a double, b double, c double, d double")
    out = st.spearman_pairs(df, ["a", "b", "c", "d"])
    assert len(made) == 2 and out.count() == 6
