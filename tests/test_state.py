"""Merged states against the whole."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from conftest import approx_equal
from ledgerlens.operators import state as sta
from ledgerlens.operators import stats as st


def long(spark, seed, n, shift=0.0):
    rng = random.Random(seed)
    rows = [(rng.choice(["f", "g"]), rng.choice(["failed", "survived", "other", None]), 1e6 + shift + float(rng.randrange(40))) for _ in range(n)]
    return spark.createDataFrame(rows, "feature string, status string, value double")


def test_state_after_three_batches_equals_the_whole(spark):
    parts = [long(spark, 1, 400), long(spark, 2, 300, 7.0), spark.createDataFrame(
        [("h", "failed", 3.0), ("h", "survived", 4.0), ("f", "failed", None)], "feature string, status string, value double")]
    whole = parts[0].union(parts[1]).union(parts[2]).where("value is not null")
    root = tempfile.mkdtemp(prefix="ll-state-")
    for i, p in enumerate(parts):
        m = sta.update(spark, os.path.join(root, "m"), i, sta.moments(p), sta.merge_moments)
        c = sta.update(spark, os.path.join(root, "c"), i, sta.counted(p.where("value is not null")), lambda a, b: sta.merge_counts(a, b, ["_cnt", "_c1"]))
        # a batch that comes again changes nothing
        m = sta.update(spark, os.path.join(root, "m"), i, sta.moments(p), sta.merge_moments)
    got = {r.feature: r for r in st.welch(sta.group_moments(m)).collect()}
    want = {r.feature: r for r in st.welch(st.group_moments(whole)).collect()}
    assert set(got) == set(want) == {"f", "g"}
    for f, r in want.items():
        assert all(approx_equal(got[f][k], r[k], rel=1e-9) for k in r.asDict() if k != "feature")
    sem = {(r.feature, r.status): (r.n, r.mean, r.sem) for r in sta.group_sem(m).collect()}
    for r in st.group_sem(whole).collect():
        assert all(approx_equal(x, y, rel=1e-9) for x, y in zip(sem[(r.feature, r.status)], (r.n, r["mean"], r.sem)))
    u = lambda d: sorted(tuple(r) for r in d.collect())
    assert u(st.mann_whitney_from_counts(c)) == u(st.mann_whitney(whole))
    assert m.count() == whole.select("feature", "status").distinct().count()


def test_a_lost_version_is_not_entered(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="ll-state-"), "s")
    first = sta.column_counts(spark.createDataFrame([("x", 1, None), ("y", None, 2)], "k string, a int, b int"), ["a", "b"])
    merge = lambda a, b: sta.merge_counts(a, b, ["present", "total"])
    sta.update(spark, path, 0, first, merge)
    # the state of batch 1 was written, its entry was not
    first.where(F.lit(False)).write.parquet(os.path.join(path, "v000000000001", "state"))
    state = sta.update(spark, path, 1, first, merge)
    assert sorted(tuple(r) for r in state.collect()) == [("a", 2, 4), ("b", 2, 4)]
