"""Mergeable state of the aggregates and tests.

A new batch of firm-years is reduced to small tables and merged with those of
all earlier batches, so old texts and panels are not read again:

* moments per feature and group: n, mean and the sum of squared distances
  from it (merged pairwise, without the cancellation of plain sums of squares),
* counts per feature and value, by group, for ranks,
* non-NULL counts per column, for coverage and completeness.

A state is a table; ``save`` and ``load`` keep its versions under a path, each
named after the batches it holds, so a batch that comes again is not counted
twice.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import value_counts


# ------------------------------------------------------------------ moments
def moments(long: DataFrame, keys: Sequence[str] = ("feature", "status"), value: str = "value") -> DataFrame:
    """(keys..., n, mean, m2) of the non-NULL values."""
    v = F.col(value).cast("double")
    return (long.where(v.isNotNull()).groupBy(*keys)
            .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")))


def merge_moments(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("feature", "status")) -> DataFrame:
    """The moments of both batches (NULL keys are keys)."""
    a = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "m2")])
    b = new.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "m2")])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(k))
    j = a.withColumn("_old", F.lit(True)).join(b, same, "full")
    out = j.select(
        *[F.when(F.col("_old"), F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)],
        F.expr("coalesce(a_n, 0) + coalesce(b_n, 0)").alias("n"),
        F.expr("CASE WHEN a_n IS NULL THEN b_mean WHEN b_n IS NULL THEN a_mean "
               "ELSE a_mean + (b_mean - a_mean) * b_n / (a_n + b_n) END").alias("mean"),
        F.expr("CASE WHEN a_n IS NULL THEN b_m2 WHEN b_n IS NULL THEN a_m2 "
               "ELSE a_m2 + b_m2 + (b_mean - a_mean) * (b_mean - a_mean) * a_n * b_n / (a_n + b_n) END").alias("m2"))
    return out


def group_moments(state: DataFrame, group: str = "status", groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """G1 of a moments state, in the shape that ``stats.welch`` takes: per
    feature n, mean and sample standard deviation of both groups."""
    aggs = []
    for tag, g in (("1", groups[0]), ("2", groups[1])):
        own = F.col(group) == g
        aggs += [F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias(f"n{tag}"), F.max(F.when(own, F.col("mean"))).alias(f"mean{tag}"),
                 F.max(F.when(own & (F.col("n") > 1), F.sqrt(F.col("m2") / (F.col("n") - 1)))).alias(f"sd{tag}")]
    return state.groupBy("feature").agg(*aggs)


def group_sem(state: DataFrame) -> DataFrame:
    """G2 of a moments state: n, mean and standard error."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return state.select(*[c for c in state.columns if c not in ("n", "mean", "m2")], "n", "mean", (sd / F.sqrt("n")).alias("sem"))


# ------------------------------------------------------------------ counts
def counted(long: DataFrame, group: str = "status", groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """(feature, value, _cnt, _c1), what ``stats.mann_whitney_from_counts``
    takes."""
    return value_counts(long, group, groups)


def column_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., column, present, total) for coverage and completeness."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().cast("long").alias("p")) for c in columns])
    return (df.select(*keys, F.explode(pairs).alias("c")).groupBy(*keys, "c.column")
            .agg(F.sum("c.p").alias("present"), F.count(F.lit(1)).alias("total")))


def merge_counts(old: DataFrame, new: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Counts of both batches, added per other columns."""
    keys = [c for c in old.columns if c not in counts]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


# ------------------------------------------------------------------ versions
def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(os.path.join(path, "*", "batch"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update(spark: SparkSession, path: str, batch: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Merge batch number ``batch`` into the state under ``path`` and return the
    state. A version is entered by a file written after it, so a lost job
    leaves the version before; a batch that is not after the last entered one
    changes nothing."""
    entered = _batches(spark, path)
    last = None if entered is None else entered.agg(F.max(F.col("value").cast("long"))).first()[0]
    where = lambda n: os.path.join(path, f"v{n:012d}")
    if last is not None and batch <= last:
        return spark.read.parquet(os.path.join(where(last), "state"))
    state = new if last is None else merge(spark.read.parquet(os.path.join(where(last), "state")), new)
    state.write.mode("overwrite").parquet(os.path.join(where(batch), "state"))
    spark.range(1).select(F.lit(str(batch)).alias("value")).coalesce(1).write.mode("overwrite").text(os.path.join(where(batch), "batch"))
    return spark.read.schema(state.schema).parquet(os.path.join(where(batch), "state"))
