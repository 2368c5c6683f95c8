"""Operators on tiny hand-made frames that hold the quirk rows of
FIXTURES.md: one-hit user, hit on an unknown business, a point exactly on
the radius, a far-away user, "Beer, Wine & Spirits", "Seafood" without
"Food", an empty category list, tied ratings at the cut, all-NULL and
constant columns, hours NULL in most rows, NULL compliments."""

import math

import pytest
from pyspark.sql import functions as F

from homerange.functions import planar_distance, safe_name
from homerange.operators import categories, features, geo, model, ratings, stats, visits
from homerange.operators.skew import join_per_key


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def biz(spark):
    return spark.createDataFrame(
        [
            ("b1", -111.9, 33.4, "Tempe", "AZ", ["Restaurants", "Seafood", "Beer, Wine & Spirits"]),
            ("b2", -111.8, 33.5, "Mesa", "AZ", ["Food", "Restaurants"]),
            ("b3", -115.1, 36.1, "Las Vegas", "NV", ["Bars"]),
            ("b4", -111.9, 33.4, "Tempe", "AZ", []),
            ("b5", -111.928276 + 0.3623188, 33.446492, "Edge", "AZ", None),
        ],
        "business_id string, longitude double, latitude double, city string, state string, categories array<string>",
    )


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(
        [
            ("u1", "b1"),  # one-hit user
            ("u2", "b1"),
            ("u2", "b2"),
            ("u2", "b2"),
            ("u3", "zz"),  # unknown business
            ("u4", "b1"),
            ("u4", "b3"),  # far away
        ],
        "user_id string, business_id string",
    )


def test_locate_and_dispersion(spark, hits, biz):
    loc = geo.locate_hits(hits, biz)
    unknown = [r for r in loc.collect() if r.business_id == "zz"]
    assert unknown and unknown[0].longitude is None
    disp = {r.user_id: r for r in geo.user_dispersion(geo.distance_from_centroid(loc)).collect()}
    assert disp["u1"].STDEV_Distance_From_Centroid == 0.0  # one hit: sd 0
    assert disp["u1"].Tip_or_Review_Count == 1
    assert disp["u3"].Tip_or_Review_Count == 0 and disp["u3"].STDEV_Distance_From_Centroid is None
    d = math.dist((-111.9, 33.4), (-115.1, 36.1)) / 2
    assert disp["u4"].AVG_Distance_From_Centroid == pytest.approx(d)
    cx = (-111.9 - 111.8 - 111.8) / 3
    assert disp["u2"].longitude_Centroid == pytest.approx(cx)


def test_hot_user_split_equals_plain_join(spark):
    data = [("hot", f"b{i % 7}", float(i % 5), float(i % 3)) for i in range(500)]
    data += [(f"u{i}", "b1", float(i), 1.0) for i in range(20)]
    loc = spark.createDataFrame(data, "user_id string, business_id string, longitude double, latitude double")
    split = geo.distance_from_centroid(loc, split_rows=37)
    plain = geo.distance_from_centroid(loc, split_rows=10**9)
    a = rows(split.withColumn("d", F.round("Distance_From_Centroid", 9)), "user_id", "business_id", "d")
    b = rows(plain.withColumn("d", F.round("Distance_From_Centroid", 9)), "user_id", "business_id", "d")
    assert a == b and len(a) == 520


def test_join_per_key_copies(spark):
    big = spark.createDataFrame([("k", i) for i in range(100)] + [("c", 1)], "key string, v int")
    per = spark.createDataFrame([("k", 100, "K"), ("c", 1, "C")], "key string, n long, tag string")
    out = join_per_key(big, per, "key", "n", split_rows=10)
    assert out.count() == 101
    assert {r.tag for r in out.collect()} == {"K", "C"}


def test_radius_is_strict(spark, biz):
    kept = {r.business_id for r in geo.businesses_in_radius(biz).collect()}
    assert "b1" in kept and "b3" not in kept
    edge = planar_distance(F.lit(-111.928276 + 0.3623188), F.lit(33.446492), -111.928276, 33.446492)
    dist = spark.range(1).select(edge.alias("d")).first().d
    assert ("b5" in kept) == (dist < 0.3623188)


def test_city_counts_null_group(spark, hits, biz):
    got = {(r.city, r.state): r.Counts for r in visits.visits_by_city(hits, biz).collect()}
    assert got[(None, None)] == 0  # unknown business: counted over state, which is NULL
    assert got[("Tempe", "AZ")] == 3


def test_local_users_min_businesses(spark):
    tight = spark.createDataFrame([("a",), ("b",)], "user_id string")
    loc = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "1"), ("b", "2")],
        "user_id string, business_id string",
    )
    assert rows(visits.local_users(tight, loc, 3), "user_id") == [("a",)]
    assert rows(visits.local_users(tight, loc, 2, max_businesses=2), "user_id") == [("b",)]


def test_category_edges_quirks(spark, biz):
    e = categories.category_edges(biz)
    got = rows(e.filter(F.col("business_id") == "b1"), "categories")
    # joined with ", ", split on "," without trimming: the comma name splits
    assert got == [(" Beer",), (" Seafood",), (" Wine & Spirits",), ("Restaurants",)]
    # empty and missing lists give one NULL edge
    assert rows(e.filter(F.col("business_id").isin("b4", "b5")), "business_id", "categories") == [
        ("b4", None),
        ("b5", None),
    ]


def test_flags_substring_and_exact(spark, biz):
    e = categories.category_edges(biz)
    co = categories.co_categories(e, "Restaurant")
    vocab = sorted(r.category for r in categories.category_vocabulary(co).collect())
    assert vocab == ["beer", "food", "seafood", "wine & spirits"]
    flags = {r.business_id: r.asDict() for r in categories.category_flags(co).collect()}
    assert flags["b1"]["category_food"] == 1  # "Seafood" contains "food"
    assert flags["b2"]["category_seafood"] == 0
    assert flags["b1"]["category_wine_spirits"] == 1
    exact = {r.business_id: r.asDict() for r in categories.category_flags(co, exact=True).collect()}
    assert exact["b1"]["category_food"] == 0 and exact["b2"]["category_food"] == 1
    assert set(flags) == {"b1", "b2"}


def test_liked_cut_ties(spark):
    # 10 businesses; the 0.8 quantile lands exactly on a tied value
    vals = [3.0, 3.5, 3.5, 4.0, 4.0, 4.0, 4.5, 4.5, 4.5, 5.0]
    r = spark.createDataFrame([(f"b{i}", v, 10) for i, v in enumerate(vals)], "business_id string, AVG_stars double, Counts long")
    liked = {x.business_id: x.Highly_Liked for x in ratings.flag_highly_liked(r).collect()}
    assert sum(v == "Y" for v in liked.values()) == 4  # 4.5 x3 and 5.0
    summ = {x.stat: x.value for x in ratings.rating_summary(r).collect()}
    assert summ["p80"] == pytest.approx(4.5) and summ["mean"] == pytest.approx(sum(vals) / 10)


def test_business_ratings_min(spark):
    rv = spark.createDataFrame([("u", "a", 5), ("v", "a", 4), ("u", "b", 1)], "user_id string, business_id string, stars int")
    got = rows(ratings.business_ratings(rv, 2), "business_id", "AVG_stars", "Counts")
    assert got == [("a", 4.5, 2)]


@pytest.fixture(scope="module")
def wide(spark):
    data = []
    for i in range(40):
        data.append(
            (
                i,
                "Y" if i % 4 == 0 else "N",
                None,  # all NULL
                "const",  # constant
                None if i % 10 else f"{(i % 24):02d}:00",  # hours NULL in most rows
                "a" if i == 0 else "b",  # frequency ratio 39
                f"v{i % 3}",
            )
        )
    return spark.createDataFrame(
        data, "business_id long, Highly_Liked string, empty string, konst string, hrs string, mostly string, tri string"
    )


def test_missing_and_drop_sparse(spark, wide):
    prof = {r.column_name: r.na_share for r in features.missing_profile(wide).collect()}
    assert prof["empty"] == 1.0 and prof["hrs"] == pytest.approx(0.9) and prof["konst"] == 0.0
    kept = features.drop_sparse(wide, 0.75).columns
    assert "empty" not in kept and "hrs" not in kept and "konst" in kept


def test_near_zero_variance(spark, wide):
    prof = {r.column_name: r for r in features.near_zero_variance(wide).collect()}
    assert prof["konst"].zeroVar and prof["konst"].nzv
    assert prof["empty"].zeroVar and prof["empty"].nzv  # all NULL
    assert prof["mostly"].freqRatio == pytest.approx(39.0) and prof["mostly"].nzv
    assert prof["tri"].freqRatio == pytest.approx(14 / 13) and not prof["tri"].nzv
    assert prof["business_id"].percentUnique == pytest.approx(100.0) and not prof["business_id"].nzv
    assert set(features.drop_nzv(wide).columns) == {"business_id", "Highly_Liked", "hrs", "tri"}


def test_impute_hours_mode_is_placeholder(spark, wide):
    out = features.impute_hours(wide.select("business_id", "Highly_Liked", "hrs", "tri"))
    # 36 of 40 hours are NULL -> "0", which is then the mode itself: stays 0
    got = rows(out, "business_id", "hrs")
    assert got[1] == (1, 0.0) and got[10] == (10, 10.0)
    assert dict(out.dtypes)["hrs"] == "double"


def test_impute_hours_mode_replaces(spark):
    df = spark.createDataFrame(
        [(1, "07:00"), (2, "07:30"), (3, None), (4, "09:00"), (5, "08:00"), (6, "08:00")], "business_id long, hrs string"
    )
    # after the fill: "0" x1, "08:00" x2 -> mode "08:00"
    got = dict(rows(features.impute_hours(df, ["hrs"]), "business_id", "hrs"))
    assert got[3] == 8.0 and got[1] == 7.0


def test_stratified_split_exact_counts(spark):
    n_y, n_n = 37, 91
    df = spark.createDataFrame([(i, "Y" if i < n_y else "N") for i in range(n_y + n_n)], "business_id long, Highly_Liked string")
    s = model.stratified_split(df, p=0.6, seed=7)
    got = {(r.Highly_Liked, r.split): r["count"] for r in s.groupBy("Highly_Liked", "split").count().collect()}
    assert got[("Y", "train")] == math.ceil(0.6 * n_y) and got[("N", "train")] == math.ceil(0.6 * n_n)
    # reproducible and equal to a plain ranking by the hash
    import hashlib

    def h(i):
        return hashlib.md5(f"{i}#7".encode()).hexdigest()

    for lab, ids in (("Y", range(n_y)), ("N", range(n_y, n_y + n_n))):
        order = sorted(ids, key=lambda i: (h(i), i))
        want = set(order[: math.ceil(0.6 * len(order))])
        assert {r.business_id for r in s.collect() if r.Highly_Liked == lab and r.split == "train"} == want


def test_fisher_known_values(spark):
    t = spark.createDataFrame([(3, 1, 1, 3)], "tl long, tr long, bl long, br long")
    assert stats.fisher_exact(t).first().p_value == pytest.approx(0.4857142857, abs=1e-10)
    t2 = spark.createDataFrame([(10, 0, 0, 10)], "tl long, tr long, bl long, br long")
    # two-sided: 2 / C(20, 10)
    assert stats.fisher_exact(t2).first().p_value == pytest.approx(2 / 184756, rel=1e-9)


def test_association_missing_as_zero_and_groups(spark):
    users = spark.createDataFrame(
        [(1, 2, None, "x"), (2, 0, 5, "x"), (3, 3, 3, "y"), (4, None, None, "y")],
        "user_id long, fans long, compliments_funny long, g string",
    )
    one = stats.association_2x2(users).first()
    assert (one.tl, one.tr, one.bl, one.br) == (1, 1, 1, 1)
    grouped = {r.g: (r.tl, r.tr, r.bl, r.br) for r in stats.association_2x2(users, by=["g"]).collect()}
    assert grouped == {"x": (1, 0, 0, 1), "y": (0, 1, 1, 0)}


def test_share_and_find(spark):
    df = spark.createDataFrame([(5, "free"), (4, None), (5, "no"), (1, "free")], "stars int, wifi string")
    assert stats.share_of(df, F.col("stars") == 5).first().share == 0.5
    w = F.col("wifi")
    assert stats.share_of(df, w == "free", among=w.isNotNull()).first().share == pytest.approx(2 / 3)
    users = spark.createDataFrame([("Ira", 20000), ("Bob", 30000), ("Jeff", 10)], "name string, votes_funny long")
    assert rows(stats.find_users(users, 10000), "name") == [("Ira",)]


def test_confusion_rates_orientation(spark):
    scored = spark.createDataFrame(
        [("N", "N")] * 451 + [("N", "Y")] * 20 + [("Y", "N")] * 98 + [("Y", "Y")] * 24,
        "Highly_Liked string, prediction string",
    )
    r = model.confusion_rates(scored, positive="N").first()
    assert r.n == 593 and r.accuracy == pytest.approx(475 / 593)
    assert r.sensitivity == pytest.approx(451 / 471) and r.specificity == pytest.approx(24 / 122)
    assert r.published_sensitivity == pytest.approx(451 / 549)  # as printed by the analysis: 0.8215
    assert r.published_specificity == pytest.approx(24 / 44)  # 0.5455


def test_safe_name():
    assert safe_name("attributes.Wi-Fi") == "attributes_Wi_Fi"
    assert safe_name("category_American (New)") == "category_American_New"


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from homerange.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.integers(0, 50, 3000), np.full(2000, 17), rng.normal(size=500) * 100]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.5, 0.8, 0.85, 0.97, 0.99, 1.0]
    got = {r.prob: r.value for r in exact_quantiles(df, "x", probs, buckets=16).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-9)
    one = spark.createDataFrame([(4.0,)], "x double")
    assert exact_quantiles(one, "x", [0.8]).first().value == 4.0


def test_far_away_distance_stays_double(spark):
    # over 100 degrees apart: a decimal(10,8) cast would overflow; doubles do not
    loc = spark.createDataFrame(
        [("u", "a", -111.9, 33.4), ("u", "b", 100.0, -40.0)], "user_id string, business_id string, longitude double, latitude double"
    )
    d = geo.user_dispersion(geo.distance_from_centroid(loc)).first()
    assert d.AVG_Distance_From_Centroid == pytest.approx(math.dist((-111.9, 33.4), (100.0, -40.0)) / 2)


def test_feature_frame_non_restaurant_and_restaurants_only(spark, biz):
    liked = spark.createDataFrame([("b1", "Y"), ("b3", "N")], "business_id string, Highly_Liked string")
    attrs = biz.select(
        "business_id",
        F.struct(F.lit("free").alias("Wi-Fi"), F.lit(True).alias("BYOB")).alias("attributes"),
        F.struct(F.struct(F.lit("08:00").alias("open")).alias("Monday")).alias("hours"),
    )
    co = categories.co_categories(categories.category_edges(biz), "Restaurant")
    flags = categories.category_flags(co)
    ff = features.feature_frame(liked, flags, attrs)
    assert {"attributes_Wi_Fi", "attributes_BYOB", "hours_Monday_open", "category_food"} <= set(ff.columns)
    got = {r.business_id: r for r in ff.collect()}
    assert got["b3"]["category_food"] is None and got["b1"]["category_food"] == 1  # rated, not a restaurant
    assert got["b1"]["attributes_BYOB"] == "true" and got["b1"]["hours_Monday_open"] == "08:00"
    only = features.feature_frame(liked, flags, attrs, restaurants_only=True)
    assert [r.business_id for r in only.collect()] == ["b1"]


def test_local_users_counted_equals_join_form(spark, hits, biz):
    loc = geo.locate_hits(hits, biz)
    disp = geo.user_dispersion(geo.distance_from_centroid(loc), count_businesses=True)
    assert {r.user_id: r.Business_Count for r in disp.collect()} == {"u1": 1, "u2": 2, "u3": 1, "u4": 2}
    for k in (1, 2, 3):
        a = rows(visits.local_users_counted(disp, k), "user_id")
        b = rows(visits.local_users(disp.drop("Business_Count"), loc, k), "user_id")
        assert a == b


def test_column_modes_ties_lowest(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("b", "y"), ("a", "x"), ("c", "x")], "p string, q string")
    m = features.column_modes(df, ["p", "q"]).first()
    assert (m.p, m.q) == ("a", "x")  # p: a and b tie at 2 -> lowest; q: x wins 3-2


def test_fisher_exact_at_large_counts(spark):
    from homerange.operators.stats import fisher_exact

    rows = [(1, 30000, 20000, 290000, 26715), (2, 250_000_000, 250_000_100, 250_000_000, 250_000_000)]
    table = spark.createDataFrame(rows, "g int, tl long, tr long, bl long, br long")
    got = {r.g: r.p_value for r in fisher_exact(table, by=["g"]).collect()}
    assert got[1] < 1e-12 and 0.9 < got[2] <= 1.0


def test_split_leaves_out_rows_without_label(spark):
    from homerange.operators.model import stratified_split

    rows = [(k, None if k % 2 else "Y") for k in range(10)]
    out = stratified_split(spark.createDataFrame(rows, "business_id long, Highly_Liked string"))
    assert out.count() == 5 and out.filter("split = 'train'").count() == 3
