"""What locals like: their reviews, ratings per business, the liked cut
(K14-K17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homerange.operators.quantiles import exact_quantiles, quantile_scalar

# Fixed values of the analysis: probabilities of the rating quantiles, the
# one that defines "highly liked", and the tolerance that lets a tie with
# the printed cut (4.363636, just under 48/11) count as liked.
RATING_QUANTILE_PROBS = (0.8, 0.85, 0.9, 0.95, 0.99)
LIKED_PROB = 0.8
CUT_TOLERANCE = 1e-6


def local_reviews(
    reviews: DataFrame,
    local_users: DataFrame,
    businesses: DataFrame,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Reviews (not tips) written by local users about businesses in the
    area; with ``clusters`` each review also gets its user's cluster.

    Both filters are semi-joins: nothing from the right side is carried, and
    duplicate keys on the right cannot multiply reviews."""
    out = (
        reviews.select("user_id", "business_id", "stars")
        .join(local_users.select("user_id"), "user_id", "left_semi")
        .join(businesses.select("business_id"), "business_id", "left_semi")
        .select("user_id", "business_id", "stars")
    )
    if clusters is not None:
        out = out.join(clusters.select("user_id", "cluster"), "user_id", "left")
    return out


def business_ratings(reviews: DataFrame, min_ratings: int = 10) -> DataFrame:
    """Mean stars and number of ratings per business, kept when there
    are at least ``min_ratings``."""
    return (
        reviews.groupBy("business_id")
        .agg(F.avg("stars").alias("AVG_stars"), F.count("stars").alias("Counts"))
        .filter(F.col("Counts") >= min_ratings)
    )


def rating_summary(ratings: DataFrame, probs=RATING_QUANTILE_PROBS) -> DataFrame:
    """Mean of the business means and its quantiles, as rows
    (stat, value) with stat ``mean`` or ``p80``, ``p85``, ..."""
    probs = [float(p) for p in probs]
    names = F.create_map(*[x for p in probs for x in (F.lit(p), F.lit(f"p{round(p * 100):d}"))])
    mean = ratings.agg(F.lit("mean").alias("stat"), F.avg("AVG_stars").alias("value"))
    qs = exact_quantiles(ratings, "AVG_stars", probs).select(names[F.col("prob")].alias("stat"), "value")
    return mean.unionByName(qs)


def flag_highly_liked(
    ratings: DataFrame,
    prob: float = LIKED_PROB,
    cut: float | None = None,
    tolerance: float = CUT_TOLERANCE,
) -> DataFrame:
    """``Highly_Liked`` = "Y" when the mean is at or above the cut, else
    "N". The cut is the ``prob`` quantile of the means unless given."""
    cut_col = F.lit(float(cut)) if cut is not None else quantile_scalar(ratings, "AVG_stars", prob)
    return ratings.withColumn(
        "Highly_Liked",
        F.when(F.col("AVG_stars") >= cut_col - F.lit(tolerance), F.lit("Y")).otherwise(F.lit("N")),
    )
