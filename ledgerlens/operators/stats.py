"""Two-group statistics and rank correlation: A1-A11, W3, W4.

Shapes: features arrive wide (one row per firm-year); they are melted with
``unpivot`` to (group, feature, value) and reduced by one ``groupBy`` per
feature with map-side partial aggregates (count / sum / sum of squares),
so a feature or group holding most rows is still combined from partials.
Ranks (W4) are computed on (value, count) aggregates instead of raw rows:
the average rank of a value is the number of smaller values plus
(ties + 1) / 2, from running sums inside range partitions plus a
per-partition offset (no window holds a whole feature).
Tail probabilities (A3, A5 p) run in a pandas UDF on one row per feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.distributions import mann_whitney_p_udf, welch_p_udf
from ..session import materialize


def melt(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Wide -> long (ids..., feature, value) without NULL values."""
    long = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value")
    return long.where(F.col("value").isNotNull())


def group_moments(long: DataFrame, group: str = "status",
                  groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """G1 per feature and both groups in one row: n, mean, sample std."""
    g1, g2 = groups
    aggs = []
    for tag, g in (("1", g1), ("2", g2)):
        v = F.when(F.col(group) == g, F.col("value"))
        aggs += [F.count(v).alias(f"n{tag}"), F.avg(v).alias(f"mean{tag}"),
                 F.stddev_samp(v).alias(f"sd{tag}")]
    return long.groupBy("feature").agg(*aggs)


def welch(m: DataFrame) -> DataFrame:
    """A1 (skip when a group has < 2 values), A2 Welch t and df, A4 Cohen's d."""
    n1, n2 = F.col("n1"), F.col("n2")
    v1, v2 = F.col("sd1") * F.col("sd1"), F.col("sd2") * F.col("sd2")
    se1, se2 = v1 / n1, v2 / n2
    diff = F.col("mean1") - F.col("mean2")
    # two constant groups have no t and no df; the feature stays with d = 0
    t = F.try_divide(diff, F.sqrt(se1 + se2))
    dof = F.try_divide((se1 + se2) * (se1 + se2), se1 * se1 / (n1 - 1) + se2 * se2 / (n2 - 1))
    pooled = F.sqrt((v1 + v2) / 2)
    d = F.when(pooled > 0, diff / pooled).otherwise(F.lit(0.0))
    return (m.where((n1 >= 2) & (n2 >= 2))
            .select("feature", "n1", "n2", "mean1", "mean2", "sd1", "sd2",
                    t.alias("t_stat"), dof.alias("welch_df"), d.alias("cohens_d")))


def significance(p: Column, levels=C.SIGNIFICANCE) -> Column:
    """Stars by p."""
    expr = None
    for cut, stars in levels:
        expr = F.when(p < cut, stars) if expr is None else expr.when(p < cut, stars)
    return expr.otherwise("")


def p_label(p: Column) -> Column:
    """A8: 'p=0.123' (ties to even) or 'p<0.001'."""
    return F.when(p >= 0.001, F.format_string("p=%.3f", F.bround(p, 3))).otherwise(F.lit("p<0.001"))


def with_welch_p(w: DataFrame) -> DataFrame:
    """A3 + A6."""
    x = w.withColumn("p_value", welch_p_udf(F.col("t_stat"), F.col("welch_df")))
    return x.withColumn("significant", significance(F.col("p_value")))


def test_table(features: DataFrame, feature_labels: Sequence[tuple[str, str]] = C.TEST_FEATURES,
               group: str = "status", groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """Feature, Failed Mean, Survived Mean, t-stat, p-value, Cohen's d,
    Significant — one row per testable feature, in the given order."""
    cols = [c for c, _ in feature_labels if c in features.columns]
    long = melt(features, cols, [group])
    w = with_welch_p(welch(group_moments(long, group, groups)))
    spark = features.sparkSession
    labels = spark.createDataFrame([(c, lab, i) for i, (c, lab) in enumerate(feature_labels)],
                                   "feature string, label string, ord int")
    j = w.join(F.broadcast(labels), "feature")   # one row per configured feature
    return j.select(F.col("label").alias("Feature"), F.col("mean1").alias("Failed Mean"),
                    F.col("mean2").alias("Survived Mean"), F.col("t_stat").alias("t-stat"),
                    F.col("p_value").alias("p-value"), F.col("cohens_d").alias("Cohen's d"),
                    F.col("significant").alias("Significant"), "ord").orderBy("ord").drop("ord")


# ------------------------------------------------------------------ ranks
def prefix_counts(counts: DataFrame, part: Sequence[str], value: str, columns: Sequence[str],
                  partitions: int | None = None) -> DataFrame:
    """Adds, for every count column c of (part..., value, c...) rows with
    distinct values, ``_below_c``, its sum over the smaller values of the part,
    and ``_total_c``, its sum over the part.

    Scales without a single-task window: the rows are range-partitioned by
    (part, value); each range partition computes running counts locally,
    the per-partition totals (a table of partitions x parts rows) give each
    partition its offset, and a join on (partition, part) adds it back."""
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(n, *part, value).withColumn("_pid", F.spark_partition_id())
    wl = Window.partitionBy("_pid", *part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = materialize(ranged.select("*", *[F.coalesce(F.sum(c).over(wl), F.lit(0)).alias(f"_below_{c}") for c in columns]))
    totals = local.groupBy("_pid", *part).agg(*[F.sum(c).alias(c) for c in columns])
    whole = Window.partitionBy(*part)
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_offset_{c}") for c in columns],
                            *[F.sum(c).over(whole).alias(f"_total_{c}") for c in columns])
    out = local.join(offsets, ["_pid", *part])
    return out.select(*counts.columns, *[(F.col(f"_offset_{c}") + F.col(f"_below_{c}")).alias(f"_below_{c}") for c in columns],
                      *[f"_total_{c}" for c in columns])


def ranks_from_counts(counts: DataFrame, part: Sequence[str], value: str = "value",
                      cnt: str = "_cnt", partitions: int | None = None) -> DataFrame:
    """W4 on (part..., value, cnt) rows with distinct values: adds
    ``avg_rank`` = (number of smaller values in the part) + (cnt + 1) / 2."""
    out = prefix_counts(counts, part, value, [cnt], partitions)
    return out.withColumn("avg_rank", F.col(f"_below_{cnt}") + (F.col(cnt) + 1) / 2.0).drop(f"_below_{cnt}", f"_total_{cnt}")


def value_ranks(long: DataFrame, part: Sequence[str], value: str = "value") -> DataFrame:
    """Average rank of each distinct value within ``part``. Aggregates
    to (part, value, count) first, so ranking runs over distinct values."""
    counts = long.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_cnt"))
    return ranks_from_counts(counts, part, value)


def mann_whitney(long: DataFrame, group: str = "status",
                 groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """A5: U of the first group (rank sum - n1(n1+1)/2), sizes and tie term.
    Rows of any other group, or of none, take no part. Counts are doubles
    before they are multiplied: a value shared by millions of rows does not
    overflow."""
    return mann_whitney_from_counts(value_counts(long, group, groups))


def value_counts(long: DataFrame, group: str = "status", groups: Sequence[str] = ("failed", "survived")) -> DataFrame:
    """(feature, value, _cnt, _c1): how often a value occurs in both groups and
    in the first. Rows of any other group, or of none, take no part."""
    first, second = groups
    g = long.where(F.col(group).isin(first, second)).withColumn("_in1", (F.col(group) == first).cast("int"))
    return g.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_cnt"), F.sum("_in1").alias("_c1"))


def mann_whitney_from_counts(per_value: DataFrame) -> DataFrame:
    """A5 from ``value_counts``."""
    ranked = ranks_from_counts(per_value, ["feature"], "value")
    c = F.col("_cnt").cast("double")
    agg = ranked.groupBy("feature").agg(
        F.sum(F.col("_c1") * F.col("avg_rank")).alias("r1"),
        F.sum("_c1").alias("n1"), (F.sum("_cnt") - F.sum("_c1")).alias("n2"),
        F.sum(c * c * c - c).alias("tie_term"))
    agg = agg.where((F.col("n1") >= 2) & (F.col("n2") >= 2))
    n1 = F.col("n1").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    return agg.select("feature", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                      u.alias("u_stat"), "tie_term")


def mann_whitney_with_p(long: DataFrame, group: str = "status", groups: Sequence[str] = ("failed", "survived"),
                        exact_max_n: int | None = None) -> DataFrame:
    """A5 with the two-sided p: by the normal tail with tie and continuity
    correction, and by the exact distribution where the smaller group has at
    most ``exact_max_n`` values and there are no ties (the study's rule is 8;
    off by default)."""
    mw = mann_whitney(long, group, groups)
    return mw.withColumn("u_p_value", mann_whitney_p_udf(exact_max_n)(
        F.col("u_stat"), F.col("n1"), F.col("n2"), F.col("tie_term")))


def group_sem(long: DataFrame, group: str = "status") -> DataFrame:
    """Mean and standard error per feature and group."""
    return long.groupBy("feature", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


# ------------------------------------------------------------------ Spearman
def spearman_pairs(df: DataFrame, features: Sequence[str], min_nonnull: int = 0,
                   labels: Mapping[str, str] | None = None, lower_only: bool = True) -> DataFrame:
    """A9 + A10: pairwise-complete Spearman correlation.

    Rows where all features are NULL are dropped; a feature enters when it
    has more than ``min_nonnull`` values (the study's rule is 3; by default
    any feature with a value enters).

    Each feature is ranked once, whatever the number of pairs. Its distinct
    values carry one count per other feature, of the rows that have both;
    prefix sums of these counts give the value's rank inside every pair at
    once, and with the totals its distance from the pair's mean rank. The
    rows then meet these distances by (feature, value) and come back together
    by row, and rho is the Pearson correlation of the ranks: cross products
    from the rows, squares from the distinct values."""
    feats = list(features)
    k = range(len(feats))
    # the input feeds the counts and the rows: compute it once
    base = materialize(df.select(*[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(feats)])
                       .na.drop("all").withColumn("_row", F.monotonically_increasing_id()))
    entries = ", ".join(f"named_struct('f', {i}, 'value', v{i})" for i in k)
    both = (base.selectExpr(f"inline(array({entries}))", *[f"CAST(v{i} IS NOT NULL AS BIGINT) AS n{i}" for i in k])
            .where("value IS NOT NULL").groupBy("f", "value").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in k]))
    ranked = prefix_counts(both, ["f"], "value", [f"n{i}" for i in k])
    # ranks 1..n have mean (n + 1) / 2 whatever the ties
    away = ", ".join(f"_below_n{i} + (n{i} + 1) / 2.0D - (_total_n{i} + 1) / 2.0D" for i in k)
    ranked = ranked.selectExpr("f", "value", f"array({away}) AS away", f"array({', '.join(f'n{i}' for i in k)}) AS n")
    squares = ranked.groupBy("f").agg(F.expr(f"array({', '.join(f'sum(n[{i}] * away[{i}] * away[{i}])' for i in k)})").alias("square"),
                                      F.expr(f"array({', '.join(f'sum(n[{i}])' for i in k)})").alias("n"))
    rows = (base.selectExpr("_row", f"inline(array({entries}))").where("value IS NOT NULL")
            .join(ranked.select("f", "value", "away"), ["f", "value"]))
    wide = rows.groupBy("_row").agg(*[F.expr(f"max(CASE WHEN f = {i} THEN away END)").alias(f"a{i}") for i in k])
    pairs = [(i, j) for i in k for j in k if (i > j if lower_only else i != j)]
    products = ", ".join(f"named_struct('i', {i}, 'j', {j}, '_xy', sum(a{i}[{j}] * a{j}[{i}]))" for i, j in pairs)
    crossed = wide.agg(F.expr(f"array({products})").alias("p")).selectExpr("inline(p)")
    # one row per feature on the right
    out = (crossed.join(F.broadcast(squares.selectExpr("f AS i", "square AS _si", "n AS _ni")), "i")
           .join(F.broadcast(squares.selectExpr("f AS j", "square AS _sj", "n AS _nj")), "j")
           .where(f"_ni[i] > {int(min_nonnull)} AND _nj[j] > {int(min_nonnull)} AND _ni[j] > 0"))
    name = F.array(*[F.lit(f) for f in feats])
    part = ["feature_x", "feature_y"]
    out = out.select(F.get(name, F.col("i")).alias("feature_x"), F.get(name, F.col("j")).alias("feature_y"),
                     F.expr("_ni[j] AS n"), "_xy", F.expr("_si[j] AS _xx"), F.expr("_sj[i] AS _yy"))
    # NULL where one side is constant
    out = out.select(*part, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("rho"))
    if labels:
        m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
        out = (out.withColumn("label_x", F.coalesce(F.try_element_at(m, F.col("feature_x")), F.col("feature_x")))
                  .withColumn("label_y", F.coalesce(F.try_element_at(m, F.col("feature_y")), F.col("feature_y"))))
    return out


# ------------------------------------------------------------------ W3
def lead_lag(df: DataFrame, nlp_col: str, fin_col: str, firm: str = "firm",
             year: str = "fiscal_year") -> DataFrame:
    """Per firm, year-to-year differences of both series and their
    direction (UP if > 0 else DOWN; a NULL difference reads DOWN). Firms
    with fewer than two rows or a wholly missing series are skipped."""
    w = Window.partitionBy(firm).orderBy(year)
    wf = Window.partitionBy(firm)
    x = df.select(firm, year, F.col(nlp_col).cast("double").alias("_n"), F.col(fin_col).cast("double").alias("_f"))
    x = (x.withColumn("_rows", F.count(F.lit(1)).over(wf))
          .withColumn("_nn", F.count("_n").over(wf)).withColumn("_fn", F.count("_f").over(wf))
          .withColumn("prev_year", F.lag(year).over(w))
          .withColumn("nlp_change", F.col("_n") - F.lag("_n").over(w))
          .withColumn("fin_change", F.col("_f") - F.lag("_f").over(w)))
    x = x.where((F.col("_rows") >= 2) & (F.col("_nn") > 0) & (F.col("_fn") > 0) & F.col("prev_year").isNotNull())
    up = lambda c: F.when(F.col(c) > 0, "UP").otherwise("DOWN")
    return x.select(firm, F.col("prev_year").alias("from_year"), F.col(year).alias("to_year"),
                    "nlp_change", up("nlp_change").alias("nlp_dir"), "fin_change", up("fin_change").alias("fin_dir"))
