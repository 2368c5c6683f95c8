"""Where users are: locate visits, centroid and spread per user, radius
filters (K2-K5, K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homerange.functions import exact_mean, planar_distance, stdev_or_zero, within_box
from homerange.operators.skew import join_per_key

# Fixed values of the analysis: the centre of the study area (a campus in
# the Phoenix metro area), 25 miles and 11.25 miles (45 mph for 15 minutes)
# in degrees at 69 miles per degree, as written in the analysis.
CENTER_LON = -111.928276
CENTER_LAT = 33.446492
RADIUS_DEG = 0.3623188
LOCAL_SPREAD_DEG = 0.1630435
MILES_PER_DEGREE = 69.0


def miles_to_degrees(miles: float, miles_per_degree: float = MILES_PER_DEGREE) -> float:
    """Planar conversion used by the analysis on both axes."""
    return miles / miles_per_degree


def locate_hits(hits: DataFrame, businesses: DataFrame) -> DataFrame:
    """K2: every visit with its business' coordinates (NULL when the business
    is unknown). The business side is small next to the visits; Catalyst
    broadcasts it when its size is under the broadcast threshold, otherwise
    AQE splits skewed business keys in the sort-merge join."""
    loc = businesses.select("business_id", "longitude", "latitude")
    return hits.select("user_id", "business_id").join(loc, "business_id", "left").select(
        "user_id", "business_id", "longitude", "latitude"
    )


def user_centroids(located: DataFrame, with_count: bool = False) -> DataFrame:
    """K3: mean longitude and latitude of each user's located visits. One
    aggregate with map-side partial sums, so a hot user costs nothing
    extra. The means are exact sums (:func:`exact_mean`), so a centroid does
    not change with the partitioning."""
    aggs = [
        exact_mean("longitude").alias("longitude_Centroid"),
        exact_mean("latitude").alias("latitude_Centroid"),
    ]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("__rows"))
    return located.groupBy("user_id").agg(*aggs)


def distance_from_centroid(located: DataFrame, split_rows: int = 1_000_000) -> DataFrame:
    """K4: each visit with its user's centroid and its planar distance to it.

    The centroid is an aggregate joined back by user. Users with more than
    ``split_rows`` visits are split across tasks (see
    :func:`homerange.operators.skew.join_per_key`) instead of landing in one
    task, as a window over the user would."""
    cent = user_centroids(located, with_count=True)
    joined = join_per_key(located, cent, "user_id", "__rows", how="left", split_rows=split_rows)
    return joined.select(
        "user_id",
        "business_id",
        "longitude",
        "latitude",
        "longitude_Centroid",
        "latitude_Centroid",
        planar_distance("longitude", "latitude", "longitude_Centroid", "latitude_Centroid").alias(
            "Distance_From_Centroid"
        ),
    )


BUSINESS_COUNT = "Business_Count"


def user_dispersion(distances: DataFrame, count_businesses: bool = False) -> DataFrame:
    """K5: per user the centroid, number of located visits, and mean and
    sample standard deviation of the distance (0 for a single visit).

    With ``count_businesses`` the same pass also counts each user's distinct
    businesses (``Business_Count``), which is what the local-user rule needs;
    that saves a separate pass over all visits. Where the column is not used,
    Catalyst prunes the distinct count away."""
    d = F.col("Distance_From_Centroid")
    aggs = [
        F.max("longitude_Centroid").alias("longitude_Centroid"),
        F.max("latitude_Centroid").alias("latitude_Centroid"),
        F.count(d).alias("Tip_or_Review_Count"),
        F.avg(d).alias("AVG_Distance_From_Centroid"),
        stdev_or_zero(d).alias("STDEV_Distance_From_Centroid"),
    ]
    if count_businesses:
        aggs.append(F.countDistinct("business_id").alias(BUSINESS_COUNT))
    return distances.groupBy("user_id").agg(*aggs)


def within_radius(
    df: DataFrame,
    lon: str,
    lat: str,
    center: tuple[float, float] = (CENTER_LON, CENTER_LAT),
    radius_deg: float = RADIUS_DEG,
) -> DataFrame:
    """K9: rows whose point is strictly closer than ``radius_deg`` to
    ``center`` (planar degrees). The implied bounding box is added as a
    plain range predicate so it can reach Parquet statistics."""
    cx, cy = center
    return df.filter(within_box(lon, lat, cx, cy, radius_deg)).filter(
        planar_distance(lon, lat, cx, cy) < F.lit(radius_deg)
    )


def users_in_radius(dispersion: DataFrame, **kw) -> DataFrame:
    return within_radius(dispersion, "longitude_Centroid", "latitude_Centroid", **kw)


def businesses_in_radius(businesses: DataFrame, **kw) -> DataFrame:
    return within_radius(businesses.select("business_id", "longitude", "latitude"), "longitude", "latitude", **kw)
