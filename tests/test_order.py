"""Ordinals over several files, first matches and positions."""

import os
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerlens.operators import order as od


def files(rows, n):
    root = tempfile.mkdtemp(prefix="ll-order-")
    step = -(-len(rows) // n)
    for i in range(n):
        part = rows[i * step:(i + 1) * step]
        table = pa.table({"k": pa.array([r[0] for r in part], pa.string()), "v": pa.array([r[1] for r in part], pa.int64())})
        pq.write_table(table, os.path.join(root, f"part-{i:05d}.parquet"), row_group_size=7)
    return root


def test_first_rows_and_order_of_appearance(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None, "d", "hot"] + ["hot"] * 9), i) for i in range(300)] + [("late", 300), ("hot", 301)]
    rng.shuffle(rows)
    df = od.with_ordinal(spark.read.parquet(files(rows, 4)))
    first = {}
    for k, v in rows:
        first.setdefault(k, v)
    assert {r.k: r.v for r in od.first_in_order(df, ["k"]).collect()} == first
    got = sorted(od.in_order_of_appearance(df, ["k"]).collect(), key=lambda r: r.position)
    assert [(r.k, r.v) for r in got] == list(first.items()) and [r.position for r in got] == list(range(len(first)))
    # the same after a shuffle of the rows, since the place travels with them
    mixed = od.first_in_order(df.repartition(5), ["k"])
    assert {r.k: r.v for r in mixed.collect()} == first
    assert {r.k for r in od.first_in_order(df.select("k", od.ORDINAL), ["k"]).collect()} == set(first)


def test_positions_of_sorted_rows(spark):
    rows = [(random.Random(i).choice([None, "x", "y"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(4)
    got = {(r.k, r.v): r.position for r in od.numbered(df, ["k", "v"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {r: i for i, r in enumerate(want)}
    assert od.numbered(df.limit(0), ["k"]).count() == 0
