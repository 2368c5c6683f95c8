"""The feature frame, its profiles and pruning, and hour imputation
(K22-K25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.functions import leading_number, safe_name
from homerange.sources.reviews import flatten

# Fixed values of the analysis: NA share above which a column is dropped,
# and the near-zero-variance rule (frequency ratio 95/5, 10 % distinct).
NA_SHARE = 0.75
FREQ_CUT = 95 / 5
UNIQUE_CUT = 10.0


def _q(name: str):
    return F.col(f"`{name}`")


def business_features(businesses: DataFrame, columns=("hours", "attributes")) -> DataFrame:
    """Business id plus the given (possibly nested) columns, flattened to one
    text column per leaf with safe names (``attributes.Wi-Fi`` ->
    ``attributes_Wi_Fi``)."""
    present = [c for c in columns if c in businesses.columns]
    flat = flatten(businesses.select("business_id", *present))
    return flat.select(
        "business_id",
        *[_q(c).cast("string").alias(safe_name(c)) for c in flat.columns if c != "business_id"],
    )


def feature_frame(
    liked: DataFrame,
    flags: DataFrame,
    businesses: DataFrame,
    columns=("hours", "attributes"),
    restaurants_only: bool = False,
) -> DataFrame:
    """Every rated business with its label, category flags (NULL when it
    is not a restaurant) and text attributes. Two left joins on
    ``business_id``; with ``restaurants_only`` the first is inner."""
    base = liked.select("business_id", "Highly_Liked")
    out = base.join(flags, "business_id", "inner" if restaurants_only else "left")
    return out.join(business_features(businesses, columns), "business_id", "left")


def missing_profile(df: DataFrame) -> DataFrame:
    """Share of NULLs per column as rows (column_name, na_share); one
    pass, one aggregate row, then unpivoted."""
    cols = df.columns
    shares = df.agg(
        *[F.avg(F.when(_q(c).isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias(c) for c in cols]
    )
    return shares.unpivot([], [_q(c) for c in cols], "column_name", "na_share")


def _profile_rows(profile: DataFrame, flag: str) -> list[str]:
    # One row per column of the profiled frame: bounded by the schema width.
    return [r["column_name"] for r in profile.filter(F.col(flag)).select("column_name").collect()]


def drop_sparse(df: DataFrame, max_share: float = NA_SHARE, keep=("business_id", "Highly_Liked")) -> DataFrame:
    """Drop the columns whose NULL share is above ``max_share``."""
    prof = missing_profile(df).withColumn("__drop", F.col("na_share") > F.lit(max_share))
    drop = [c for c in _profile_rows(prof, "__drop") if c not in keep]
    return df.drop(*drop)


def near_zero_variance(df: DataFrame, freq_cut: float = FREQ_CUT, unique_cut: float = UNIQUE_CUT) -> DataFrame:
    """Per column the near-zero-variance metrics, as rows
    (column_name, freqRatio, percentUnique, zeroVar, nzv).

    freqRatio = count of the most common value / count of the second (NULLs
    not counted; 0 with fewer than two values); percentUnique = distinct
    non-NULL values / rows * 100; zeroVar = at most one distinct value;
    nzv = zeroVar or (freqRatio > freq_cut and percentUnique <= unique_cut).

    Values are unpivoted as text to (column, value) and counted with
    map-side partial aggregation, so a constant column (one group holding
    every row) costs no more than any other. The top and second counts come
    from two aggregates; no window over a column's values."""
    cols = df.columns
    text = df.select(*[_q(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], [_q(c) for c in cols], "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    first = counts.groupBy("column_name").agg(
        F.sum("cnt").alias("n"),
        F.count("value").alias("n_unique"),
        F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("top"),
    )
    # one row per column: bounded by the schema width
    tops = F.broadcast(first.select("column_name", "top"))
    second = (
        counts.filter(F.col("value").isNotNull())
        .join(tops, "column_name")
        .groupBy("column_name")
        .agg(
            F.sum(F.when(F.col("cnt") == F.col("top"), F.lit(1)).otherwise(F.lit(0))).alias("n_top"),
            F.max(F.when(F.col("cnt") < F.col("top"), F.col("cnt"))).alias("below"),
        )
    )
    m = first.join(second, "column_name", "left")
    second_count = F.when(F.col("n_top") >= 2, F.col("top")).otherwise(F.col("below"))
    freq = F.when(F.col("n_unique") <= 1, F.lit(0.0)).otherwise(F.col("top") / second_count)
    pct = F.lit(100.0) * F.col("n_unique") / F.col("n")
    zero = F.col("n_unique") <= 1
    return m.select(
        "column_name",
        freq.alias("freqRatio"),
        pct.alias("percentUnique"),
        zero.alias("zeroVar"),
        (zero | ((freq > F.lit(freq_cut)) & (pct <= F.lit(unique_cut)))).alias("nzv"),
    )


def drop_nzv(df: DataFrame, keep=("Highly_Liked",), **kw) -> DataFrame:
    """Drop the near-zero-variance columns."""
    drop = [c for c in _profile_rows(near_zero_variance(df, **kw), "nzv") if c not in keep]
    return df.drop(*drop)


def fill_missing(df: DataFrame, exclude=()) -> DataFrame:
    """NULL -> 0 in every column, "0" in text columns (the analysis fills the
    whole frame with 0 before modelling)."""
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name not in exclude:
            if isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit("0"))
            elif isinstance(f.dataType, T.NumericType):
                c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most common value of each column (ties -> lowest), as one row
    with a column per input column.

    Values are counted per (column, value) with map-side partial
    aggregation; the winner per column is a ``min`` over (-count, value),
    also partial -- no task ever holds a column's whole value distribution."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), _q(c).cast("string").alias("v")) for c in cols])
    counts = df.select(F.explode(pairs).alias("e")).groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("v").alias("v"))).alias("b"))
    # one row per column in, one row out: the pivot values are given, so no extra job
    return best.groupBy().pivot("k", list(cols)).agg(F.first("b.v"))


def impute_hours(
    df: DataFrame,
    hour_cols: list[str] | None = None,
    exclude=("business_id", "Highly_Liked"),
    width: int = 2,
) -> DataFrame:
    """Fill NULLs with 0, then in each hour column replace the
    placeholder "0" by the column's most common value (ties -> lowest; the
    mode is taken after the fill, so it can be "0" itself), then keep the
    hour as a number from the first ``width`` characters.

    The modes (:func:`column_modes`) are one row used as a scalar subquery,
    so no join is needed."""
    if hour_cols is None:
        hour_cols = [c for c in df.columns if c.startswith("hours") or c == "hrs"]
    filled = fill_missing(df, exclude=exclude)
    if not hour_cols:
        return filled
    modes = column_modes(filled, hour_cols)
    mode_row = modes.select(F.struct(*[_q(c) for c in hour_cols]).alias("m")).select("m").scalar()
    out = []
    for c in filled.columns:
        col = _q(c)
        if c in hour_cols:
            col = leading_number(F.when(col == F.lit("0"), mode_row.getField(c)).otherwise(col), width)
        out.append(col.alias(c))
    return filled.select(*out)
