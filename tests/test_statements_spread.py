"""Statements are built in many tasks whatever the file's row groups, and the
amounts near labels are those of a plain scan on odd texts."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import extract as ex
from ledgerlens.plans import shapes as S
from ledgerlens.sources.tables import INPUT_PARTITIONS
from test_position_table import by_re

N = 3000


@pytest.fixture()
def one_row_group(tmp_path):
    n = list(range(N))
    cust = {"c_custkey": n, "c_name": [f"c{i}" for i in n], "c_nationkey": pa.array(n, pa.int32()), "c_acctbal": [i * 1.5 for i in n],
            "c_mktsegment": [["BUILDING", "MACHINERY", None][i % 3] for i in n]}
    orders = {"o_orderkey": n, "o_custkey": n, "o_orderstatus": ["FOP"[i % 3] for i in n], "o_totalprice": [i * 10.25 for i in n],
              "o_orderdate": pa.array([datetime.datetime(1998, 1, 1)] * N, pa.timestamp("us")), "o_orderpriority": ["2-HIGH"] * N}
    for name, cols in (("customer", cust), ("orders", orders)):
        pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("made", [S.full_statements, S.statements])
def test_one_row_group_is_dealt_over_the_task_slots(spark, one_row_group, made):
    local = made(spark, one_row_group).collect()
    was = spark.conf.get(INPUT_PARTITIONS)
    spark.conf.unset(INPUT_PARTITIONS)       # as on a cluster
    try:
        df = made(spark, one_row_group)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        rows = df.collect()
    finally:
        spark.conf.set(INPUT_PARTITIONS, was)
    assert sum(sizes) == N and len(sizes) >= 4 * 4 and max(sizes) < N / 4
    assert sorted(rows) == sorted(local)


def test_numbers_beside_control_characters_and_in_many_rows(spark):
    rng = random.Random(3)
    words = ["Total assets", "TOTAL EQUITY", "net income", "net loss", "Net income (loss)", "short-term borrowings",
             "\x01", "\x02", "\x03", "\x01\x02\x03", "", "é", "\n", "\n", "(1)", "$ 5", "(1,234)", "$\n 77.5", "12", "007"]
    rows = ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    rows += ["total assets 7 12 total equity 30 \x03" * 90, "total assets", "Total equity\n" * 70 + "99"]
    labels = [p for pats in C.FIELD_PATTERNS.values() for p in pats]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    for r in df.select("id", ex.numbers_near_labels("t", labels).alias("n")).collect():
        text = rows[r.id]
        assert [(n.pattern_no, n.match_no, n.value, n.position) for n in r.n] == [
            (k, *x) for k, p in enumerate(labels) for x in by_re(text, p)]
        for n in r.n:
            end = text.find(n.raw, n.position)
            assert end >= 0 and text[n.position:].replace("\n", " ").startswith(n.context)


def test_overlapping_matches_are_counted_as_by_a_plain_scan(spark):
    rows = ["aba 11 ababa 22 abababa 33", "ababababa 44", "aba" * 100 + " 55", "x"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    for r in df.select("id", ex.numbers_near_labels("t", ["b+", "aba"]).alias("n")).collect():
        assert [(n.pattern_no, n.match_no, n.value, n.position) for n in r.n] == [
            (k, *x) for k, p in enumerate(["b+", "aba"]) for x in by_re(rows[r.id], p)]
