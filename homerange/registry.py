"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs the operators over the stand-in tables of one scale. Double
columns are rounded to :data:`homerange.oracle.DIGITS` places so that results
compare exactly with the DuckDB check (sums in another order differ in the
last bit); of the operators only ``exact_mean`` rounds, to 1e-10 degrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.oracle import DIGITS, LOOKUP_NAMES
from homerange.plans import LocalMarket, Params

# Parameters of the registered queries on the driver tables.
PARAMS = Params(
    names=LOOKUP_NAMES,
    top_city_min_count=5000,
    min_ratings=3,
    restaurant="ring",
    min_funny=9000,
)

Query = Callable[[SparkSession, str], DataFrame]


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # the same IEEE steps as the SQL side: scale, round half away, unscale
            c = F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _market(spark: SparkSession, sf_dir: str, params: Params | None = None) -> LocalMarket:
    return LocalMarket.from_standin(spark, sf_dir, params or PARAMS)


def _attr(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(getattr(_market(spark, sf_dir), name))

    run.__name__ = name
    return run


# Query names in the order of the analysis.
MARKET_QUERIES = [
    "visit_hits",
    "located_hits",
    "user_centroids",
    "hit_distances",
    "user_dispersion",
    "visits_by_city",
    "visits_by_city_quantiles",
    "top_cities",
    "businesses_by_city",
    "users_in_radius",
    "businesses_in_radius",
    "businesses_in_circles",
    "tight_users",
    "unique_visits",
    "local_users",
    "local_reviews",
    "business_ratings",
    "rating_quantiles",
    "rating_quantiles_by_city",
    "star_quantiles_by_user",
    "highly_liked",
    "elbow_k1",
    "elbow_curve",
    "user_clusters",
    "local_reviews_clustered",
    "category_edges",
    "restaurants",
    "co_categories",
    "category_vocabulary",
    "category_hits",
    "category_patterns",
    "category_flags",
    "feature_frame",
    "missing_profile",
    "drop_sparse",
    "nzv_profile",
    "drop_nzv",
    "imputed_hours",
    "stratified_split",
    "dictionary_codes",
    "forest_scores",
    "confusion",
    "forest_rates",
    "bag_sizes",
    "out_of_bag_error",
    "confusion_rates",
    "share_five_star",
    "wifi_values",
    "share_free_wifi",
    "find_users",
    "association_2x2",
    "flatten_nested",
    "sample_head",
    "json_leaves",
    "json_flat",
    "json_quarantine",
]


# Frames whose columns follow from the data are registered in long form.
LONG_QUERIES = ["category_flags", "feature_frame", "drop_sparse", "drop_nzv"]


def _long(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = getattr(_market(spark, sf_dir), name)
        columns = [c for c in wide.columns if c != "business_id"]
        text = wide.select("business_id", *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        return text.unpivot("business_id", [F.col(f"`{c}`") for c in columns], "column_name", "value")

    run.__name__ = name
    return run


# Three questions about one forest: it is grown once per session and scale.
FOREST_QUERIES = ["forest_scores", "confusion", "forest_rates"]
_grown: dict[tuple[str, str], LocalMarket] = {}


def _forest(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in _grown:
            _grown[key] = _market(spark, sf_dir)
        return round_doubles(getattr(_grown[key], name))

    run.__name__ = name
    return run


def _query(name: str) -> Query:
    if name in FOREST_QUERIES:
        return _forest(name)
    return _long(name) if name in LONG_QUERIES else _attr(name)


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in MARKET_QUERIES}
