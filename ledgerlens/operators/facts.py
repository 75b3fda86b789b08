"""Structured facts -> one value per (company, field, period end).

1. keep annual facts (form and fiscal period),
2. latest filing per (company, tag, end): ``max_by`` over (filed, accn) —
   an aggregate with map-side partials, so a tag with very many facts is
   combined from partial results,
3. map tags to fields by an ordered fallback list (a literal array of
   (field, tag, priority) exploded in a projection, then joined: the list
   is bounded by configuration size),
4. first available tag by priority per (company, field, end): ``min_by``.

Facts also cover durations: a quarter and a year may end on the same day, and
a later filing may restate either. ``period_class`` names the duration, and
``as_filed`` selects what was known on given days: each filing of a fact is
valid until the next, and the days meet these intervals in a range join that
is keyed by company and month.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C


def tag_priorities(spark: SparkSession, field_tags: Mapping[str, Sequence[str]] = C.FACT_TAGS) -> DataFrame:
    rows = [(f, t, i) for f, tags in field_tags.items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "field string, tag string, priority int")


def latest_facts(facts: DataFrame, keys: Sequence[str] = ("cik", "tag", "end"),
                 forms: Sequence[str] = ("10-K",), fp: str | None = "FY",
                 order: Sequence[str] = ("filed", "accn")) -> DataFrame:
    x = facts.where(F.col("form").isin(*forms))
    if fp is not None:
        x = x.where(F.col("fp") == fp)
    rank = F.struct(*[F.col(o) for o in order])
    payload = F.struct(*[F.col(c) for c in facts.columns if c not in keys])
    return x.groupBy(*keys).agg(F.max_by(payload, rank).alias("f")).select(*keys, "f.*")


def facts_by_field(latest: DataFrame, priorities: DataFrame,
                   keys: Sequence[str] = ("cik", "end")) -> DataFrame:
    j = latest.join(F.broadcast(priorities), "tag")
    payload = F.struct(F.col("tag"), *[F.col(c) for c in latest.columns if c not in (*keys, "tag")])
    return j.groupBy(*keys, "field").agg(F.min_by(payload, F.col("priority")).alias("f")).select(
        *keys, "field", "f.*")


#: Days that a duration may have, both ends included, by class.
PERIODS = {"quarter": (80, 100), "half": (170, 195), "nine_months": (260, 285), "year": (350, 380)}


def period_class(start: str = "start", end: str = "end") -> Column:
    """The class of the interval from ``start`` to ``end``: instant (no start),
    one of ``PERIODS`` by its days, or other."""
    days = F.datediff(F.col(end).cast("date"), F.col(start).cast("date")) + 1
    out = F.when(F.col(start).isNull(), "instant")
    for name, (least, most) in PERIODS.items():
        out = out.when(days.between(least, most), name)
    return out.otherwise("other")


def validity(facts: DataFrame, keys: Sequence[str] = ("cik", "tag", "end", "period"),
             order: Sequence[str] = ("filed", "accn")) -> DataFrame:
    """Adds ``until``, the day on which the next filing of the same fact takes
    over (NULL: still valid). Of several filings of one day the last in
    ``order`` counts, so the others are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = order[0]
    x = facts.withColumn(first, F.col(first).cast("date")).withColumn("until", F.lead(first).over(w))
    return x.where(F.col("until").isNull() | (F.col("until") > F.col(first)))


def as_filed(facts: DataFrame, asof: DataFrame, keys: Sequence[str] = ("cik", "tag", "end", "period"),
             order: Sequence[str] = ("filed", "accn"), company: str = "cik") -> DataFrame:
    """The facts known on each day of ``asof(company, as_of)``: one row per key
    and day, the latest filing up to that day. Facts first filed later are
    absent.

    Both sides are keyed by company and month. The intervals of one fact
    follow each other, so together they have no more rows than months up to
    the company's last day plus filings, and no company's facts meet all its
    days. Rows with a NULL filing day or as-of day take no part; a repeated
    as-of row counts once."""
    days = asof.select(F.col(company).alias("_company"), F.col("as_of").cast("date").alias("as_of")).where("as_of is not null").distinct()
    last = days.groupBy("_company").agg(F.max("as_of").alias("_last"))
    valid = validity(facts.where(F.col(order[0]).isNotNull()), keys, order)
    first, until = F.col(order[0]), F.least(F.coalesce(F.date_sub("until", 1), F.col("_last")), F.col("_last"))
    spread = (valid.join(last, F.col(company).eqNullSafe(F.col("_company"))).drop("_company").where(first <= F.col("_last"))
              .withColumn("_month", F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(until, "MM"), F.expr("interval 1 month")))))
    days = days.withColumn("_day_month", F.trunc("as_of", "MM"))
    hit = spread.join(days, F.col(company).eqNullSafe(F.col("_company")) & (F.col("_month") == F.col("_day_month"))
                      & (F.col("as_of") >= first) & (F.col("until").isNull() | (F.col("as_of") < F.col("until"))))
    return hit.select("as_of", *[c for c in facts.columns if c != order[0]], order[0])
