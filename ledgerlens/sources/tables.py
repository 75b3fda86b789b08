"""Readers for the benchmark parquet tables with explicit schemas.

An explicit schema skips footer-based inference and pins types, so an
all-NULL column never turns into STRING and a changed writer cannot change
the plan. Column pruning and filters still reach the scan (ReadSchema /
PushedFilters) because the reads stay plain ``spark.read.parquet``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S),
                         ("n_chars", _L)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
}


#: Session setting: partitions that text scans are spread over by one shuffle
#: (unset: none). For files of one row group on a machine with many cores;
#: a cluster reads many splits and leaves it unset.
INPUT_PARTITIONS = "spark.ledgerlens.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    """One benchmark table; with ``balance`` spread as ``INPUT_PARTITIONS``
    says, where that is set."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    n = spark.conf.get(INPUT_PARTITIONS, None) if balance else None
    return df.repartition(int(n)) if n else df


def spread(df: DataFrame) -> DataFrame:
    """Short rows that long work per row follows, dealt over all task slots.

    A file is split at its row groups at best. A row group of a million keys is
    a few MB, one task, and minutes of regex work once a text is built from
    each key. Where ``INPUT_PARTITIONS`` is set, ``table`` has dealt already."""
    spark = df.sparkSession
    if spark.conf.get(INPUT_PARTITIONS, None):
        return df
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(max(4 * slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
