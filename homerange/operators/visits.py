"""Visits and local users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homerange.operators.geo import BUSINESS_COUNT, LOCAL_SPREAD_DEG
from homerange.operators.quantiles import exact_quantiles

# Fixed values of the analysis: probabilities of the city-count quantiles.
CITY_QUANTILE_PROBS = (0.8, 0.85, 0.9, 0.95, 0.96, 0.97, 0.99)


def visit_hits(reviews: DataFrame, tips: DataFrame) -> DataFrame:
    """K1: all (user, business) visits, tips and reviews together, duplicates
    kept."""
    return tips.select("user_id", "business_id").unionByName(reviews.select("user_id", "business_id"))


def visits_by_city(hits: DataFrame, businesses: DataFrame) -> DataFrame:
    """K6: visits per (city, state) of the visited business. Visits to
    unknown businesses form the NULL group with count 0 (the count is over
    ``state``, which is NULL there).

    Visits are first counted per business (map-side combined, so a business
    holding a third of all visits is one row per task), and only those
    per-business counts are joined to the businesses and summed by city."""
    per_business = hits.groupBy("business_id").agg(F.count(F.lit(1)).alias("__n"))
    loc = businesses.select("business_id", "city", "state")
    counted = F.when(F.col("state").isNotNull(), F.col("__n"))
    return (
        per_business.join(loc, "business_id", "left")
        .groupBy("city", "state")
        .agg(F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("Counts"))
    )


def businesses_by_city(businesses: DataFrame) -> DataFrame:
    """K8: businesses per (city, state)."""
    return businesses.groupBy("city", "state").agg(F.count("state").alias("Counts"))


def quantiles_long(df: DataFrame, col: str, probs=CITY_QUANTILE_PROBS, name: str = "value") -> DataFrame:
    """Exact quantiles (linear interpolation, R type 7) as rows (prob, value);
    see :mod:`homerange.operators.quantiles`."""
    return exact_quantiles(df, col, probs, name=name)


def top_cities(city_counts: DataFrame, min_count: int = 25000) -> DataFrame:
    """K7: cities with more than ``min_count`` visits, smallest first."""
    return city_counts.filter(F.col("Counts") > min_count).orderBy("Counts", "city", "state")


def tight_users(users: DataFrame, max_deg: float = LOCAL_SPREAD_DEG, n_sd: float = 3.0) -> DataFrame:
    """Users whose mean distance plus ``n_sd`` standard deviations is
    within ``max_deg`` of their centroid."""
    spread = F.col("AVG_Distance_From_Centroid") + F.lit(n_sd) * F.col("STDEV_Distance_From_Centroid")
    return users.filter(spread <= F.lit(max_deg))


def unique_visits(located: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct (user, business) pairs of the given users."""
    return (
        located.select("user_id", "business_id")
        .join(users.select("user_id"), "user_id", "left_semi")
        .distinct()
    )


def businesses_per_user(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("user_id").agg(F.count("user_id").alias("Counts"))


def local_users(
    tight: DataFrame,
    located: DataFrame,
    min_businesses: int = 3,
    max_businesses: int | None = None,
) -> DataFrame:
    """The tight users who visited at least ``min_businesses`` distinct
    businesses (and at most ``max_businesses`` when given)."""
    counts = businesses_per_user(unique_visits(located, tight))
    keep: Column = F.col("Counts") >= min_businesses
    if max_businesses is not None:
        keep = keep & (F.col("Counts") <= max_businesses)
    return tight.join(counts.filter(keep).select("user_id"), "user_id", "left_semi")


def local_users_counted(
    tight: DataFrame,
    min_businesses: int = 3,
    max_businesses: int | None = None,
    count_col: str = BUSINESS_COUNT,
) -> DataFrame:
    """K12 when the tight users already carry their distinct-business count
    (``user_dispersion(..., count_businesses=True)``): a filter, no join and
    no further pass over the visits. Same rows as :func:`local_users`."""
    keep: Column = F.col(count_col) >= min_businesses
    if max_businesses is not None:
        keep = keep & (F.col(count_col) <= max_businesses)
    return tight.filter(keep).drop(count_col)
