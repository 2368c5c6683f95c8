"""The analysis end to end, as lazily built DataFrames.

:class:`LocalMarket` wires the operators into the three questions of the
analysis: who is local, what do locals like, which features go with being
liked. Each attribute is a DataFrame built when it is first read. Most run
nothing until an action; the narrow waists (``_keep``) are written when they
are read, and the frames whose columns follow from the data (flags, pruned
frames, model) run the jobs that find them. The tables go when the application
ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.functions import exact_mean
from homerange.session import materialize
from homerange.operators import categories, circles, clusters, dictionary, features, geo, model, patterns, ratings, stats, visits
from homerange.operators.quantiles import grouped_quantiles
from homerange.sources import standin, variant
from homerange.sources.reviews import flatten, sample_head


@dataclass(frozen=True)
class Params:
    """Thresholds of the analysis; the defaults are its own literals. The
    registered queries pass the values that suit the driver tables (see
    ``registry.PARAMS``)."""

    center: tuple[float, float] = (geo.CENTER_LON, geo.CENTER_LAT)
    radius_deg: float = geo.RADIUS_DEG
    local_spread_deg: float = geo.LOCAL_SPREAD_DEG
    n_sd: float = 3.0
    min_businesses: int = 3
    max_businesses: int | None = None
    top_city_min_count: int = 25_000
    min_ratings: int = 10
    liked_prob: float = 0.8
    restaurant: str = "Restaurant"
    na_share: float = 0.75
    split_p: float = 0.6
    split_seed: int = 1900
    kmeans_k: int = 6
    kmeans_seed: int = 1986
    elbow_ks: tuple[int, ...] = tuple(range(2, 51))
    min_funny: int = 10_000
    names: tuple[str, ...] = field(default=())  # empty: no name filter
    split_rows: int = 1_000_000
    feature_columns: tuple[str, ...] = ("hours", "hrs", "attributes")
    num_trees: int = model.NUM_TREES
    max_depth: int = 30
    forest_seed: int = model.FOREST_SEED
    wifi_column: str = "attributes_Wi_Fi"


def _keep(df: DataFrame, name: str) -> DataFrame:
    """A narrow waist of the flow -- a frame sized by users or businesses,
    not by visits, that several later jobs read (the vocabulary, the column
    profiles, the quantile cut, the model fits) -- written once to the shared
    checkpoint folder and read back (see :func:`homerange.session.materialize`)."""
    return materialize(df, name)


class LocalMarket:
    """All steps over one set of review tables."""

    def __init__(
        self,
        business: DataFrame,
        review: DataFrame,
        tip: DataFrame,
        user: DataFrame,
        params: Params | None = None,
    ):
        self.business = business
        self.review = review
        self.tip = tip
        self.user = user
        self.p = params or Params()

    @classmethod
    def from_standin(cls, spark: SparkSession, sf_dir: str, params: Params | None = None) -> LocalMarket:
        t = standin.load(spark, sf_dir)
        return cls(t.business, t.review, t.tip, t.user, params)

    # ----------------------------------------------------- who is local
    @cached_property
    def visit_hits(self) -> DataFrame:
        return visits.visit_hits(self.review, self.tip)

    @cached_property
    def located_hits(self) -> DataFrame:
        return geo.locate_hits(self.visit_hits, self.business)

    @cached_property
    def user_centroids(self) -> DataFrame:
        return geo.user_centroids(self.located_hits)

    @cached_property
    def hit_distances(self) -> DataFrame:
        return geo.distance_from_centroid(self.located_hits, split_rows=self.p.split_rows)

    @cached_property
    def counted_dispersion(self) -> DataFrame:
        """Dispersion plus each user's distinct-business count, one pass."""
        return geo.user_dispersion(self.hit_distances, count_businesses=True)

    @cached_property
    def user_dispersion(self) -> DataFrame:
        return self.counted_dispersion.drop(geo.BUSINESS_COUNT)

    @cached_property
    def visits_by_city(self) -> DataFrame:
        return _keep(visits.visits_by_city(self.visit_hits, self.business), "visits_by_city")

    @cached_property
    def visits_by_city_quantiles(self) -> DataFrame:
        return visits.quantiles_long(self.visits_by_city, "Counts", visits.CITY_QUANTILE_PROBS)

    @cached_property
    def top_cities(self) -> DataFrame:
        return visits.top_cities(self.visits_by_city, self.p.top_city_min_count)

    @cached_property
    def businesses_by_city(self) -> DataFrame:
        return visits.businesses_by_city(self.business)

    def _radius(self) -> dict:
        return {"center": self.p.center, "radius_deg": self.p.radius_deg}

    @cached_property
    def users_in_radius(self) -> DataFrame:
        return geo.users_in_radius(self.user_dispersion, **self._radius())

    @cached_property
    def businesses_in_radius(self) -> DataFrame:
        return geo.businesses_in_radius(self.business, **self._radius())

    @cached_property
    def city_circles(self) -> DataFrame:
        """A circle around the centre of every city's businesses, wider where the city's number is
        even."""
        centre = [exact_mean("longitude").alias("cx"), exact_mean("latitude").alias("cy")]
        cities = self.business.groupBy("city").agg(*centre)
        even = F.substring_index("city", "_", -1).cast("int") % 2 == 0
        radius = F.when(even, F.lit(self.p.radius_deg)).otherwise(F.lit(self.p.local_spread_deg))
        return cities.select(F.col("city").alias("circle_id"), "cx", "cy", radius.alias("radius"))

    @cached_property
    def businesses_in_circles(self) -> DataFrame:
        points = self.business.select("business_id", "longitude", "latitude")
        return circles.within_circles(points, self.city_circles).select("circle_id", "business_id", "distance")

    @cached_property
    def tight_users(self) -> DataFrame:
        return visits.tight_users(self.users_in_radius, self.p.local_spread_deg, self.p.n_sd)

    @cached_property
    def unique_visits(self) -> DataFrame:
        return visits.unique_visits(self.located_hits, self.tight_users)

    @cached_property
    def local_users(self) -> DataFrame:
        counted = visits.tight_users(
            geo.users_in_radius(self.counted_dispersion, **self._radius()), self.p.local_spread_deg, self.p.n_sd
        )
        return _keep(
            visits.local_users_counted(counted, self.p.min_businesses, self.p.max_businesses), "local_users"
        )

    # ----------------------------------------------------- what locals like
    @cached_property
    def local_reviews(self) -> DataFrame:
        return ratings.local_reviews(self.review, self.local_users, self.businesses_in_radius)

    @cached_property
    def business_ratings(self) -> DataFrame:
        return _keep(ratings.business_ratings(self.local_reviews, self.p.min_ratings), "business_ratings")

    @cached_property
    def rating_quantiles(self) -> DataFrame:
        return ratings.rating_summary(self.business_ratings)

    @cached_property
    def rating_quantiles_by_city(self) -> DataFrame:
        """Quantiles of the businesses' mean ratings in every city."""
        placed = self.business_ratings.join(self.business.select("business_id", "city"), "business_id")
        return grouped_quantiles(placed, ["city"], "AVG_stars", ratings.RATING_QUANTILE_PROBS)

    @cached_property
    def star_quantiles_by_user(self) -> DataFrame:
        """Quartiles of the stars that every reviewer gave."""
        return grouped_quantiles(self.review, ["user_id"], "stars", (0.25, 0.5, 0.75))

    @cached_property
    def highly_liked(self) -> DataFrame:
        return _keep(ratings.flag_highly_liked(self.business_ratings, self.p.liked_prob), "highly_liked")

    # ----------------------------------------------------- area clusters
    @cached_property
    def user_clusters(self) -> DataFrame:
        return clusters.cluster_users(self.local_users, self.p.kmeans_k, self.p.kmeans_seed)

    @cached_property
    def local_reviews_clustered(self) -> DataFrame:
        return ratings.local_reviews(
            self.review, self.local_users, self.businesses_in_radius, clusters=self.user_clusters
        )

    @cached_property
    def elbow_k1(self) -> DataFrame:
        return clusters.total_sse(self.local_users)

    @cached_property
    def elbow_curve(self) -> DataFrame:
        return clusters.elbow(self.local_users, self.p.elbow_ks, seed=self.p.kmeans_seed)

    # ----------------------------------------------------- categories
    @cached_property
    def rated_businesses(self) -> DataFrame:
        return self.business.join(self.highly_liked.select("business_id"), "business_id", "left_semi")

    @cached_property
    def category_edges(self) -> DataFrame:
        return categories.category_edges(self.rated_businesses)

    @cached_property
    def restaurants(self) -> DataFrame:
        return categories.restaurants(self.category_edges, self.p.restaurant)

    @cached_property
    def co_categories(self) -> DataFrame:
        return categories.co_categories(self.category_edges, self.p.restaurant)

    @cached_property
    def category_vocabulary(self) -> DataFrame:
        return categories.category_vocabulary(self.co_categories)

    @cached_property
    def category_hits(self) -> DataFrame:
        return categories.category_hits(self.co_categories)

    @cached_property
    def pattern_table(self) -> DataFrame:
        """Patterns of every kind made from the vocabulary: the term anywhere, its third letter
        open, its first two letters, its last letter before one more character."""
        v = F.col("category")
        kinds = [
            patterns.containing(v),
            F.concat(F.substring(v, 1, 2), F.lit("_"), F.expr("substring(category, 4)")),
            F.concat(F.substring(v, 1, 2), F.lit("%")),
            F.concat(F.lit("%"), F.expr("right(category, 1)"), F.lit("_")),
        ]
        return self.category_vocabulary.select(F.explode(F.array(*kinds)).alias("pattern")).distinct()

    @cached_property
    def category_patterns(self) -> DataFrame:
        return patterns.like_join(self.category_edges, self.pattern_table, text_col="categories")

    @cached_property
    def category_flags(self) -> DataFrame:
        return categories.category_flags(self.co_categories)

    # ----------------------------------------------------- features
    @cached_property
    def feature_frame(self) -> DataFrame:
        return _keep(
            features.feature_frame(self.highly_liked, self.category_flags, self.business, self.p.feature_columns),
            "feature_frame",
        )

    @cached_property
    def missing_profile(self) -> DataFrame:
        return features.missing_profile(self.feature_frame)

    @cached_property
    def drop_sparse(self) -> DataFrame:
        return features.drop_sparse(self.feature_frame, self.p.na_share)

    @cached_property
    def nzv_profile(self) -> DataFrame:
        return features.near_zero_variance(self.drop_sparse)

    @cached_property
    def drop_nzv(self) -> DataFrame:
        return features.drop_nzv(self.drop_sparse)

    @cached_property
    def imputed_hours(self) -> DataFrame:
        return features.impute_hours(self.drop_nzv)

    # ----------------------------------------------------- model
    @cached_property
    def dictionary_codes(self) -> DataFrame:
        df = self.imputed_hours
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "Highly_Liked"]
        return dictionary.dictionary_codes(df, text)

    @cached_property
    def stratified_split(self) -> DataFrame:
        return _keep(
            model.stratified_split(self.imputed_hours, p=self.p.split_p, seed=self.p.split_seed), "stratified_split"
        )

    @cached_property
    def forest_scores(self) -> DataFrame:
        split = self.stratified_split
        train = split.filter(F.col("split") == "train").drop("split")
        test = split.filter(F.col("split") == "test").drop("split")
        scored = model.grow_and_score(
            train, test, num_trees=self.p.num_trees, max_depth=self.p.max_depth, seed=self.p.forest_seed
        )
        return _keep(scored, "forest_scores")

    @cached_property
    def confusion(self) -> DataFrame:
        return model.confusion(self.forest_scores)

    @cached_property
    def forest_rates(self) -> DataFrame:
        """The analysis' accuracy, sensitivity and specificity: of the forest."""
        return model.confusion_rates(self.forest_scores, positive="N")

    @cached_property
    def training_rows(self) -> DataFrame:
        return self.stratified_split.filter(F.col("split") == "train").drop("split")

    @cached_property
    def bag_sizes(self) -> DataFrame:
        return model.bag_sizes(self.training_rows, model.OOB_TREES // model.OOB_BAG_TREES, seed=self.p.forest_seed)

    @cached_property
    def out_of_bag_error(self) -> DataFrame:
        return model.out_of_bag_error(
            model.out_of_bag(self.training_rows, max_depth=self.p.max_depth, seed=self.p.forest_seed)
        )

    @cached_property
    def rule_scores(self) -> DataFrame:
        """A fixed rule (free Wi-Fi -> liked) on the held-out rows, so the
        confusion arithmetic can be checked against SQL."""
        test = self.stratified_split.filter(F.col("split") == "test")
        pred = F.when(F.col(self.p.wifi_column) == "free", F.lit("Y")).otherwise(F.lit("N"))
        return test.select("business_id", "Highly_Liked", pred.alias("prediction"))

    @cached_property
    def confusion_rates(self) -> DataFrame:
        return model.confusion_rates(self.rule_scores, positive="N")

    # ----------------------------------------------------- profile questions
    @cached_property
    def share_five_star(self) -> DataFrame:
        return stats.share_of(self.review, F.col("stars") == 5)

    @cached_property
    def wifi_values(self) -> DataFrame:
        return stats.distinct_values(self.business, "attributes.`Wi-Fi`")

    @cached_property
    def share_free_wifi(self) -> DataFrame:
        wifi = F.col("attributes.`Wi-Fi`")
        return stats.share_of(self.business, wifi == "free", among=wifi.isNotNull())

    @cached_property
    def find_users(self) -> DataFrame:
        return stats.find_users(self.user, self.p.min_funny, self.p.names or None)

    @cached_property
    def association_2x2(self) -> DataFrame:
        return stats.association_2x2(self.user, "fans", "compliments_funny")

    @cached_property
    def flatten_nested(self) -> DataFrame:
        return flatten(self.business.drop("categories"))

    @cached_property
    def json_lines(self) -> DataFrame:
        """Businesses as JSON text: missing attributes are left out, every 13th line is cut short."""
        text = F.to_json(F.struct("business_id", "city", "categories", "hrs", "attributes"))
        cut = F.col("business_id") % 13 == 0
        lines = self.business.select(text.alias("line"), cut.alias("cut"))
        return lines.select(F.expr("CASE WHEN cut THEN left(line, length(line) - 7) ELSE line END").alias("line"))

    @cached_property
    def json_records(self) -> DataFrame:
        return variant.parse(self.json_lines)

    @cached_property
    def json_leaves(self) -> DataFrame:
        return variant.leaf_counts(self.json_records)

    @cached_property
    def json_flat(self) -> DataFrame:
        return variant.spread(self.json_records).drop("categories")

    @cached_property
    def json_quarantine(self) -> DataFrame:
        return variant.quarantine(self.json_records).agg(F.count(F.lit(1)).alias("bad_lines"))

    @cached_property
    def sample_head(self) -> DataFrame:
        return sample_head(self.flatten_nested, "business_id", 10)
