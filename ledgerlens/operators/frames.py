"""Chart-ready frames (C1-C5), pivots and annotations.

The study draws charts; the data behind each chart is built here as long
DataFrames ordered for plotting. Windows are per (firm, feature), bounded
by the number of years.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

# The six feature series of the overview charts
SERIES = ["leverage_ratio", "cash_coverage", "net_income", "provision_for_losses",
          "risk_total_crisis_density", "risk_section_wc"]
NON_NULL_ONLY = {"provision_for_losses"}


def series_long(df: DataFrame, features: Sequence[str] = SERIES, firm: str = "firm",
                year: str = "fiscal_year", status: str = "status",
                non_null_only: Sequence[str] = tuple(NON_NULL_ONLY)) -> DataFrame:
    """(feature, firm, fiscal_year, status, value); the provision series
    keeps only non-null values."""
    feats = [f for f in features if f in df.columns]
    long = df.select(firm, year, status, *[F.col(f).cast("double").alias(f) for f in feats]).unpivot(
        [firm, year, status], feats, "feature", "value")
    keep = ~F.col("feature").isin(*non_null_only) | F.col("value").isNotNull() if non_null_only else F.lit(True)
    return long.where(keep)


def dashboard_long(df: DataFrame, features: Sequence[str] = SERIES, firm: str = "firm",
                   year: str = "fiscal_year", status: str = "status") -> DataFrame:
    """All series in one table; a (firm, feature) pair that is wholly
    NULL is dropped."""
    long = series_long(df, features, firm, year, status, non_null_only=())
    w = Window.partitionBy(firm, "feature")
    return long.withColumn("_nn", F.count("value").over(w)).where("_nn > 0").drop("_nn")


def half_even(c: Column, digits: int) -> Column:
    """Rounded with ties to even; a small negative value keeps its sign as
    -0.0, as number formatting shows it."""
    r = F.bround(c, digits)
    return F.when((c < 0) & (r == 0), F.lit(-0.0)).otherwise(r)


def comma_label(c: Column) -> Column:
    """1,234 (ties to even, as in all labels)."""
    return F.format_number(F.bround(c, 0), 0)


def billions_label(c: Column) -> Column:
    """$12B."""
    return F.format_string("$%.0fB", half_even(c / 1e9, 0))


def pct_label(c: Column) -> Column:
    """12.3%."""
    return F.format_string("%.1f%%", half_even(c, 1))


def annotation_heights(df: DataFrame, features: Sequence[str], share: float = C.ANNOTATION_SHARE) -> DataFrame:
    """Max x 0.9 per feature (one aggregate row, then unpivot)."""
    agg = df.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in features])
    return agg.unpivot([], list(features), "feature", "max_value").withColumn(
        "y_pos", F.col("max_value") * F.lit(share))


def event_annotations(df: DataFrame, features: Sequence[str],
                      events: Mapping[int, str] = C.CHART_EVENTS) -> DataFrame:
    """C4: event years with their label and the annotation height per
    feature; the events are a literal array exploded per feature row."""
    ev = F.array(*[F.struct(F.lit(y).alias("event_year"), F.lit(lab).alias("label"))
                   for y, lab in sorted(events.items())])
    return annotation_heights(df, features).select(
        "feature", "max_value", "y_pos", F.explode(ev).alias("ev")).select(
        "feature", "max_value", "y_pos", "ev.event_year", "ev.label")


def distinct_firms(df: DataFrame, firm: str = "firm", year: str = "fiscal_year") -> DataFrame:
    """Firms with the first year they appear, in that order (firms of
    one year by name: rows of a table have no order of appearance)."""
    return df.groupBy(firm).agg(F.min(year).alias("first_year")).orderBy("first_year", firm)


def sentiment_series(sent: DataFrame, firm: str = "firm", year: str = "fiscal_year",
                     section: str = "section") -> DataFrame:
    """Per section, sentiment score and negative share x 100; firms with
    a wholly NULL series are dropped."""
    long = sent.select(firm, year, section, "status",
                       F.col("sentiment_score").alias("score"),
                       (F.col("negative_ratio") * 100).alias("negative_pct"))
    w = Window.partitionBy(firm, section)
    return (long.withColumn("_n1", F.count("score").over(w))
                .where("_n1 > 0").drop("_n1"))
