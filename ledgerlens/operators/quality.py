"""Data-quality operators: sanity flags (V1-V5), unit jumps (W2), comparison
with a reference panel (V6, J1, G8), the validated panel (V7, J2, G9), the
identity check (V8), missing-field and coverage reports (V9, G5, G6).

All operators are column expressions, windows partitioned by firm (bounded
by years per firm) and equi-joins on (firm, fiscal_year). Nothing is
collected; reports are DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def _abs_rel(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.abs(b))


def sanity_flags(df: DataFrame, out: str = "_flags",
                 liab_tol: float = C.LIAB_EQ_ASSETS_TOL,
                 balance_pct: float = C.BALANCE_OFF_PCT,
                 ni_share: float = C.NET_INCOME_SHARE) -> DataFrame:
    """V1-V4: per-row flags joined by '; ' ('' when clean)."""
    ta, tl = F.col("total_assets"), F.col("total_liabilities")
    se, ni = F.col("stockholders_equity"), F.col("net_income")
    pos = ta.isNotNull() & (ta > 0)
    diff_pct = F.try_divide(F.abs(ta - (tl + se)), ta) * 100
    f1 = F.when(pos & tl.isNotNull() & (F.try_divide(F.abs(tl - ta), ta) < liab_tol),
                F.lit("liabilities=assets"))
    f2 = F.when(pos & tl.isNotNull() & se.isNotNull() & (diff_pct > balance_pct),
                F.concat(F.lit("balance_off_"),
                         F.bround(diff_pct, 0).cast("long").cast("string"), F.lit("%")))
    f3 = F.when(pos & ni.isNotNull() & (F.try_divide(F.abs(ni), ta) > ni_share),
                F.lit("net_income_suspicious"))
    return df.withColumn(out, F.concat_ws("; ", f1, f2, f3))


def unit_jumps(df: DataFrame, measures: Sequence[str] = C.UNIT_JUMP_MEASURES,
               firm: str = "firm", year: str = "fiscal_year",
               ratio: float = C.UNIT_JUMP_RATIO) -> DataFrame:
    """Per firm, a jump when |cur / prev| > ratio between consecutive
    non-null values (prev != 0). Adds boolean ``jump_{m}`` columns that are
    true on every row of a firm with at least one jump."""
    w_prev = (Window.partitionBy(firm).orderBy(year)
              .rowsBetween(Window.unboundedPreceding, -1))
    w_firm = Window.partitionBy(firm)
    out = df
    for m in measures:
        cur = F.col(m)
        prev = F.last(cur, ignorenulls=True).over(w_prev)
        hit = cur.isNotNull() & prev.isNotNull() & (prev != 0) & (F.abs(F.try_divide(cur, prev)) > ratio)
        out = out.withColumn(f"jump_{m}", F.coalesce(F.max(hit).over(w_firm), F.lit(False)))
    return out


def all_flags(df: DataFrame, measures: Sequence[str] = C.UNIT_JUMP_MEASURES,
              firm: str = "firm", year: str = "fiscal_year") -> DataFrame:
    """V4: sanity flags followed by one ``unit_jump_{m}`` per jumping measure."""
    x = unit_jumps(sanity_flags(df, "_base"), measures, firm, year)
    parts = [F.when(F.col("_base") != "", F.col("_base"))]
    parts += [F.when(F.col(f"jump_{m}"), F.lit(f"unit_jump_{m}")) for m in measures]
    return x.withColumn("_flags", F.concat_ws("; ", *parts)).drop("_base", *[f"jump_{m}" for m in measures])


def flagged_rows(df: DataFrame) -> DataFrame:
    """V5."""
    return df.where(F.col("_flags") != "")


# ------------------------------------------------------------------ reference
def scale_reference(ref: DataFrame, measures: Sequence[str] = C.MEASURES,
                    unit: float = C.REFERENCE_UNIT) -> DataFrame:
    """Reference values are in millions."""
    out = ref
    for m in measures:
        if m in ref.columns:
            out = out.withColumn(m, F.col(m) * F.lit(float(unit)))
    return out


def _ensure(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    for m in measures:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(None).cast("double"))
    return df


def compare_cells(scraped: DataFrame, reference: DataFrame,
                  measures: Sequence[str] = C.MEASURES,
                  keys: Sequence[str] = ("firm", "fiscal_year"),
                  tol: float = C.MATCH_TOLERANCE) -> DataFrame:
    """V6 + J1: full outer join on the keys, one row per (key, measure) with
    a reference value; result MATCH / MISMATCH / MISSING."""
    # a measure that one side has no column for is not compared
    measures = [m for m in measures if m in scraped.columns and m in reference.columns]
    s = scraped.select(*keys, *[F.col(m).alias(f"{m}_scraped") for m in measures])
    r = reference.select(*keys, *[F.col(m).alias(f"{m}_ref") for m in measures])
    j = s.join(r, on=list(keys), how="full")
    stack = ", ".join(f"'{m}', `{m}_scraped`, `{m}_ref`" for m in measures)
    long = j.selectExpr(*keys, f"stack({len(measures)}, {stack}) AS (measure, scraped, reference)")
    long = long.where(F.col("reference").isNotNull())
    sc, rf = F.col("scraped"), F.col("reference")
    res = (F.when(sc.isNull(), "MISSING")
           .when((rf != 0) & (_abs_rel(sc, rf) > tol), "MISMATCH")
           .otherwise("MATCH"))
    return long.withColumn("result", res)


def comparison_summary(cells: DataFrame) -> DataFrame:
    """Counts of matched, mismatched, missing and total checks."""
    r = F.col("result")
    return cells.agg(
        F.sum(F.when(r == "MATCH", 1).otherwise(0)).cast("long").alias("matched"),
        F.sum(F.when(r == "MISMATCH", 1).otherwise(0)).cast("long").alias("mismatched"),
        F.sum(F.when(r == "MISSING", 1).otherwise(0)).cast("long").alias("missing"),
        F.count(F.lit(1)).alias("total_checks"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """J2 helper: keep the first row per key under a stable total order.

    An aggregate (``min_by`` over the order columns) rather than a window:
    partial aggregation keeps a key with very many rows out of one task."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ordering = F.struct(*[F.col(o) for o in order])
    payload = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min_by(payload, ordering).alias("_first")).select(*keys, "_first.*")


def validated_panel(scraped: DataFrame, reference: DataFrame,
                    measures: Sequence[str] = C.MEASURES,
                    keys: Sequence[str] = ("firm", "fiscal_year"),
                    order: Sequence[str] | None = None,
                    tol: float = C.MATCH_TOLERANCE) -> DataFrame:
    """V7: the reference is the base; a scraped value replaces it when within
    the tolerance (inclusive), fills it when the reference is missing, and is
    ignored otherwise. Adds ``_overridden`` and ``_filled`` cell counts per
    row (G9)."""
    measures = list(measures)
    scraped = _ensure(scraped, measures)
    reference = _ensure(reference, measures)
    # without a filing order the values themselves decide, so that equal
    # inputs always give equal results
    order = list(order) if order else [c for c in ("filing_date", "accession", *measures) if c in scraped.columns]
    s = first_per_key(scraped, keys, order).select(
        *keys, F.lit(True).alias("_has_scraped"), *[F.col(m).alias(f"_s_{m}") for m in measures])
    j = reference.join(s, on=list(keys), how="left")
    has = F.coalesce(F.col("_has_scraped"), F.lit(False))
    cols, over, fill = [], [], []
    for m in measures:
        rf, sc = F.col(m), F.col(f"_s_{m}")
        within = (rf != 0) & (_abs_rel(sc, rf) <= tol)
        val = (F.when(~has, rf)
               .when(rf.isNull(), sc)
               .when(sc.isNull(), rf)
               .when(within, sc)
               .otherwise(rf))
        cols.append(val.alias(m))
        over.append(F.when(has & rf.isNotNull() & sc.isNotNull() & ~within, 1).otherwise(0))
        fill.append(F.when(has & rf.isNotNull() & sc.isNull(), 1).otherwise(0))
    others = [c for c in reference.columns if c not in measures]
    overridden = sum(over[1:], over[0])
    filled = F.when(~has, F.lit(len(measures))).otherwise(sum(fill[1:], fill[0]))
    return j.select(*others, *cols, overridden.alias("_overridden"), filled.alias("_filled"))


def override_counts(validated: DataFrame) -> DataFrame:
    """Overridden and reference-filled cells in total."""
    return validated.agg(F.sum("_overridden").cast("long").alias("overridden"),
                         F.sum("_filled").cast("long").alias("filled_from_reference"))


def identity_check(df: DataFrame, ok_pct: float = C.IDENTITY_OK_PCT) -> DataFrame:
    """V8: |A - (L + E)| / A x 100; ok below the threshold; NULL when a
    value is missing or assets <= 0."""
    ta, tl, se = F.col("total_assets"), F.col("total_liabilities"), F.col("stockholders_equity")
    valid = ta.isNotNull() & tl.isNotNull() & se.isNotNull() & (ta > 0)
    diff = F.when(valid, F.try_divide(F.abs(ta - (tl + se)), ta) * 100)
    return df.withColumn("identity_diff_pct", diff).withColumn(
        "identity_ok", F.when(valid, diff < ok_pct))


def missing_fields(df: DataFrame, measures: Sequence[str] = C.MEASURES,
                   ids: Sequence[str] = ("firm", "fiscal_year")) -> DataFrame:
    """V9: rows with any missing measure and the list of missing names."""
    present = [m for m in measures if m in df.columns]
    names = [F.when(F.col(m).isNull(), F.lit(m)) for m in present]
    n = sum([F.when(F.col(m).isNull(), 1).otherwise(0) for m in present][1:],
            F.when(F.col(present[0]).isNull(), 1).otherwise(0))
    return (df.select(*ids, F.concat_ws(", ", *names).alias("missing"), n.alias("n_missing"))
            .where(F.col("n_missing") > 0))


def coverage(df: DataFrame, measures: Sequence[str] = C.MEASURES, firm: str = "firm",
             year: str = "fiscal_year", with_none: bool = True) -> DataFrame:
    """Per firm and measure, non-null count, rows, all/some/none flag and
    the year range. One partial aggregate per firm, then unpivot."""
    present = [m for m in measures if m in df.columns]
    agg = df.groupBy(firm).agg(
        F.count(F.lit(1)).alias("total"), F.min(year).alias("min_year"), F.max(year).alias("max_year"),
        *[F.count(F.col(m)).alias(f"n_{m}") for m in present])
    stack = ", ".join(f"'{m}', `n_{m}`" for m in present)
    long = agg.selectExpr(firm, "total", "min_year", "max_year",
                          f"stack({len(present)}, {stack}) AS (measure, found)")
    none = "none" if with_none else "some"
    flag = (F.when(F.col("found") == F.col("total"), "all")
            .when(F.col("found") > 0, "some").otherwise(none))
    return long.withColumn("coverage", flag)


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null / total per column, in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(f"n__{c}") for c in cols])
    stack = ", ".join(f"'{c}', `n__{c}`" for c in cols)
    return agg.selectExpr("total", f"stack({len(cols)}, {stack}) AS (feature, non_null)")
