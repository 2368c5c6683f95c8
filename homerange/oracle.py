"""DuckDB SQL for the correctness check of the registered queries.

Each query is one statement over the driver's tables (region nation customer
supplier part orders lineitem ...). The stand-in review tables and every
intermediate step are common table expressions; :func:`sql` puts the needed
ones, in dependency order, in front of the final SELECT.

Doubles are rounded to :data:`DIGITS` places on both sides (sums in another
order differ in the last bit).
"""

from __future__ import annotations

from homerange.operators.model import BAG_CUTS, OOB_BAG_TREES, OOB_TREES

DIGITS = 6

# The names looked up by the user query on the driver tables.
LOOKUP_NAMES = ("Customer#000000007", "Customer#000000024", "Customer#000000035", "Customer#000000100")

# name -> (dependencies, body)
_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], body: str) -> None:
    _CTE[name] = (deps, body)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in _CTE[n][0]:
            visit(d)  # a recursive one names itself in its body only
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(select: str, *needs: str) -> str:
    names = _order(needs)
    if not names:
        return select
    ctes = ",\n".join(f"{n} AS (\n{_CTE[n][1]}\n)" for n in names)
    return f"WITH RECURSIVE {ctes}\n{select}"


def _round(expr: str, digits: int = DIGITS) -> str:
    """Round with the same IEEE steps as the Spark side (scale, round half
    away from zero, unscale), so equal doubles give equal results."""
    scale = f"1e{digits}::DOUBLE"
    return f"(round(({expr}) * {scale}) / {scale})"


def _mean(col: str) -> str:
    """The exact, order-independent coordinate mean of the Spark side."""
    return (
        f"((CAST(CAST(sum(CAST(round({col} * 1e10::DOUBLE) AS BIGINT)) AS BIGINT) AS DOUBLE)"
        f" / 1e10::DOUBLE) / count({col}))"
    )


def rounded(select_from: str, cols: list[str], digits: int = DIGITS) -> str:
    """``SELECT * REPLACE (round(c, digits) AS c ...) FROM <cte or table>``."""
    rep = ", ".join(f'{_round(chr(34) + c + chr(34), digits)} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM {select_from}"


# ---------------------------------------------------------------- stand-in
_cte(
    "business",
    (),
    """SELECT p_partkey AS business_id,
  CASE WHEN p_partkey % 4 = 3 THEN -115.2::DOUBLE ELSE -112.03::DOUBLE END
    + 0.002::DOUBLE * (p_partkey % 101) AS longitude,
  CASE WHEN p_partkey % 4 = 3 THEN 36.1::DOUBLE ELSE 33.35::DOUBLE END
    + 0.002::DOUBLE * ((p_partkey * 7) % 97) AS latitude,
  'city_' || CAST(p_partkey % 12 AS VARCHAR) AS city,
  'st_' || CAST(p_partkey % 4 AS VARCHAR) AS state,
  list_concat([p_type], string_split(p_name, ' ')) AS categories,
  CASE WHEN p_partkey % 5 = 0 THEN NULL
       ELSE lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || ':00' END AS hrs,
  CASE WHEN p_size % 3 = 1 THEN 'free' WHEN p_size % 3 = 2 THEN 'no' END AS wifi,
  p_brand AS brand,
  'const' AS konst,
  CASE WHEN p_partkey % 9 = 0 THEN 'x' END AS rare,
  CASE WHEN p_partkey % 50 = 0 THEN 'a' ELSE 'b' END AS mostly
FROM part""",
)
_cte(
    "hits",
    (),
    """SELECT o.o_custkey AS user_id,
  CASE WHEN l.l_linenumber = 7 AND o.o_custkey % 3 = 0 THEN l.l_partkey
       ELSE l.l_partkey - l.l_partkey % 4 + o.o_custkey % 4 END AS business_id,
  CASE WHEN l.l_returnflag = 'R' THEN 'tip' ELSE 'review' END AS kind,
  1 + CAST(l.l_quantity AS INTEGER) % 5 AS stars
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
)
_cte("tip", ("hits",), "SELECT user_id, business_id FROM hits WHERE kind = 'tip'")
_cte("review", ("hits",), "SELECT user_id, business_id, stars FROM hits WHERE kind = 'review'")
_cte(
    "users",
    (),
    """SELECT c_custkey AS user_id, c_name AS name, c_custkey % 4 AS fans,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey % 3 END AS compliments_funny,
  CAST(floor(c_acctbal) AS BIGINT) AS votes_funny
FROM customer""",
)

# ------------------------------------------------------- who is local
_cte(
    "visit_hits",
    ("tip", "review"),
    "SELECT user_id, business_id FROM tip UNION ALL SELECT user_id, business_id FROM review",
)
_cte(
    "located",
    ("visit_hits", "business"),
    """SELECT h.user_id, h.business_id, b.longitude, b.latitude
FROM visit_hits h LEFT JOIN business b ON h.business_id = b.business_id""",
)
_cte(
    "centroids",
    ("located",),
    f"""SELECT user_id, {_mean("longitude")} AS longitude_Centroid, {_mean("latitude")} AS latitude_Centroid
FROM located GROUP BY user_id""",
)
_cte(
    "distances",
    ("located", "centroids"),
    """SELECT l.user_id, l.business_id, l.longitude, l.latitude,
  c.longitude_Centroid, c.latitude_Centroid,
  sqrt(pow(l.longitude - c.longitude_Centroid, 2) + pow(l.latitude - c.latitude_Centroid, 2))
    AS Distance_From_Centroid
FROM located l LEFT JOIN centroids c ON l.user_id = c.user_id""",
)
_cte(
    "dispersion",
    ("distances",),
    """SELECT user_id,
  max(longitude_Centroid) AS longitude_Centroid,
  max(latitude_Centroid) AS latitude_Centroid,
  count(Distance_From_Centroid) AS Tip_or_Review_Count,
  avg(Distance_From_Centroid) AS AVG_Distance_From_Centroid,
  CASE WHEN count(Distance_From_Centroid) = 1 THEN 0.0::DOUBLE
       ELSE stddev_samp(Distance_From_Centroid) END AS STDEV_Distance_From_Centroid
FROM distances GROUP BY user_id""",
)
_cte(
    "users_in_radius",
    ("dispersion",),
    """SELECT * FROM dispersion
WHERE sqrt(pow(longitude_Centroid - (-111.928276::DOUBLE), 2)
         + pow(latitude_Centroid - 33.446492::DOUBLE, 2)) < 0.3623188::DOUBLE""",
)
_cte(
    "businesses_in_radius",
    ("business",),
    """SELECT business_id, longitude, latitude FROM business
WHERE sqrt(pow(longitude - (-111.928276::DOUBLE), 2)
         + pow(latitude - 33.446492::DOUBLE, 2)) < 0.3623188::DOUBLE""",
)
_cte(
    "tight_users",
    ("users_in_radius",),
    """SELECT * FROM users_in_radius
WHERE AVG_Distance_From_Centroid + 3.0::DOUBLE * STDEV_Distance_From_Centroid <= 0.1630435::DOUBLE""",
)
_cte(
    "unique_visits",
    ("located", "tight_users"),
    """SELECT DISTINCT user_id, business_id FROM located
WHERE user_id IN (SELECT user_id FROM tight_users)""",
)
_cte(
    "local_users",
    ("tight_users", "unique_visits"),
    """SELECT * FROM tight_users
WHERE user_id IN (SELECT user_id FROM unique_visits GROUP BY user_id HAVING count(*) >= 3)""",
)
_cte(
    "visits_by_city",
    ("visit_hits", "business"),
    """SELECT b.city, b.state, count(b.state) AS Counts
FROM visit_hits h LEFT JOIN business b ON h.business_id = b.business_id
GROUP BY b.city, b.state""",
)

# ------------------------------------------------- what locals like
_cte(
    "local_reviews",
    ("review", "local_users", "businesses_in_radius"),
    """SELECT user_id, business_id, stars FROM review
WHERE user_id IN (SELECT user_id FROM local_users)
  AND business_id IN (SELECT business_id FROM businesses_in_radius)""",
)
_cte(
    "business_ratings",
    ("local_reviews",),
    """SELECT business_id, avg(stars) AS AVG_stars, count(stars) AS Counts
FROM local_reviews GROUP BY business_id HAVING count(stars) >= 3""",
)
_cte(
    "highly_liked",
    ("business_ratings",),
    """SELECT *, CASE WHEN AVG_stars >= (SELECT quantile_cont(AVG_stars, 0.8) FROM business_ratings) - 1e-6
                 THEN 'Y' ELSE 'N' END AS Highly_Liked
FROM business_ratings""",
)

# ------------------------------------------------------ categories
_cte(
    "rated_business",
    ("business", "highly_liked"),
    "SELECT * FROM business WHERE business_id IN (SELECT business_id FROM highly_liked)",
)
_cte(
    "category_edges",
    ("rated_business",),
    """SELECT DISTINCT business_id,
  unnest(coalesce(string_split(CASE WHEN len(categories) > 0 THEN array_to_string(categories, ', ') END, ','),
                  [NULL])) AS categories
FROM rated_business""",
)
_cte("restaurants", ("category_edges",), "SELECT * FROM category_edges WHERE contains(lower(categories), 'ring')")
_cte(
    "co_categories",
    ("category_edges", "restaurants"),
    """SELECT * FROM category_edges
WHERE business_id IN (SELECT business_id FROM restaurants) AND NOT contains(lower(categories), 'ring')""",
)
_cte(
    "category_vocabulary",
    ("co_categories",),
    """SELECT DISTINCT lower(trim(categories)) AS category FROM co_categories
WHERE categories IS NOT NULL AND lower(trim(categories)) <> ''""",
)
_cte(
    "flag_long",
    ("co_categories", "category_vocabulary"),
    """SELECT c.business_id,
  trim(regexp_replace('category_' || v.category, '[^0-9A-Za-z]+', '_', 'g'), '_') AS name,
  max(CASE WHEN contains(lower(c.categories), v.category) THEN 1 ELSE 0 END) AS flag
FROM co_categories c CROSS JOIN category_vocabulary v
GROUP BY ALL""",
)

# -------------------------------------------------------- features
_cte(
    "business_features",
    ("business",),
    """SELECT business_id, hrs, wifi AS attributes_Wi_Fi, brand AS attributes_Brand,
  konst AS attributes_konst, rare AS attributes_rare, mostly AS attributes_mostly
FROM business""",
)
# The wide frames have columns that follow from the data, so they are checked in
# long form: one row per business and column, values as text.
_cte(
    "feature_long",
    ("highly_liked", "flag_long", "business_features"),
    """SELECT business_id, 'business_id' AS column_name, CAST(business_id AS VARCHAR) AS value FROM highly_liked
UNION ALL SELECT business_id, 'Highly_Liked', Highly_Liked FROM highly_liked
UNION ALL SELECT h.business_id, n.name, CAST(f.flag AS VARCHAR)
  FROM highly_liked h CROSS JOIN (SELECT DISTINCT name FROM flag_long) n
  LEFT JOIN flag_long f ON f.business_id = h.business_id AND f.name = n.name
"""
    + "\n".join(
        f"UNION ALL SELECT h.business_id, '{c}', b.{c} FROM highly_liked h "
        "LEFT JOIN business_features b ON h.business_id = b.business_id"
        for c in ("hrs", *(f"attributes_{k}" for k in ("Wi_Fi", "Brand", "konst", "rare", "mostly")))
    ),
)
_cte(
    "missing_profile",
    ("feature_long",),
    """SELECT column_name, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS na_share
FROM feature_long GROUP BY column_name""",
)
_cte(
    "sparse_long",
    ("feature_long", "missing_profile"),
    """SELECT * FROM feature_long
WHERE column_name IN (SELECT column_name FROM missing_profile WHERE na_share <= 0.75)""",
)
_cte(
    "value_counts",
    ("sparse_long",),
    "SELECT column_name, value, count(*) AS cnt FROM sparse_long GROUP BY column_name, value",
)
_cte(
    "nzv_profile",
    ("value_counts",),
    """SELECT column_name, freqRatio, percentUnique, zeroVar,
  zeroVar OR (freqRatio > 19.0 AND percentUnique <= 10.0) AS nzv
FROM (
  SELECT column_name,
    CASE WHEN count(value) <= 1 THEN 0.0::DOUBLE
         ELSE max(CASE WHEN rk = 1 THEN cnt END) / max(CASE WHEN rk = 2 THEN cnt END) END AS freqRatio,
    100.0::DOUBLE * count(value) / sum(cnt) AS percentUnique,
    count(value) <= 1 AS zeroVar
  FROM (SELECT *, CASE WHEN value IS NULL THEN NULL
                       ELSE row_number() OVER (PARTITION BY column_name, value IS NULL ORDER BY cnt DESC) END AS rk
        FROM value_counts)
  GROUP BY column_name)""",
)
_cte(
    "nzv_long",
    ("sparse_long", "nzv_profile"),
    """SELECT * FROM sparse_long
WHERE column_name IN (SELECT column_name FROM nzv_profile WHERE NOT nzv OR column_name = 'Highly_Liked')""",
)
# Imputation names the columns that are left after pruning at the check scale; the
# long form of drop_nzv checks that these are the ones.
_cte(
    "filled",
    ("highly_liked", "business_features"),
    """SELECT h.business_id, h.Highly_Liked, coalesce(hrs, '0') AS hrs,
  coalesce(attributes_Wi_Fi, '0') AS attributes_Wi_Fi, coalesce(attributes_Brand, '0') AS attributes_Brand
FROM highly_liked h LEFT JOIN business_features b ON h.business_id = b.business_id""",
)
_cte(
    "imputed",
    ("filled",),
    """SELECT business_id, Highly_Liked,
  TRY_CAST(substr(CASE WHEN hrs = '0'
                       THEN (SELECT hrs FROM filled GROUP BY hrs ORDER BY count(*) DESC, hrs ASC LIMIT 1)
                       ELSE hrs END, 1, 2) AS DOUBLE) AS hrs,
  attributes_Wi_Fi, attributes_Brand
FROM filled""",
)
_cte(
    "split",
    ("imputed",),
    """SELECT *, CASE WHEN row_number() OVER (PARTITION BY Highly_Liked
                                        ORDER BY md5(CAST(business_id AS VARCHAR) || '#1900'), business_id)
                  <= ceil(0.6 * count(*) OVER (PARTITION BY Highly_Liked))
             THEN 'train' ELSE 'test' END AS split
FROM imputed""",
)
_cte(
    "rule_counts",
    ("split",),
    """SELECT count_if(Highly_Liked = 'N' AND p = 'N')::BIGINT AS tp,
  count_if(Highly_Liked = 'N' AND p <> 'N')::BIGINT AS fn,
  count_if(Highly_Liked <> 'N' AND p = 'N')::BIGINT AS fp,
  count_if(Highly_Liked <> 'N' AND p <> 'N')::BIGINT AS tn
FROM (SELECT Highly_Liked, CASE WHEN attributes_Wi_Fi = 'free' THEN 'Y' ELSE 'N' END AS p
      FROM split WHERE split = 'test')""",
)

# ------------------------------------------------------------- clusters
# k-means of all k as one recursion: a k is carried on while one of its centres moves.
_cte(
    "km_points",
    ("local_users",),
    """SELECT user_id, longitude_Centroid AS x, latitude_Centroid AS y,
  CAST(round(longitude_Centroid * 1e10::DOUBLE) AS BIGINT) AS ux,
  CAST(round(latitude_Centroid * 1e10::DOUBLE) AS BIGINT) AS uy
FROM local_users WHERE longitude_Centroid IS NOT NULL AND latitude_Centroid IS NOT NULL""",
)
_cte(
    "km_picks",
    ("km_points",),
    """SELECT o, x, y, 'Infinity'::DOUBLE AS far, 0 AS c, o = 1 AS pick
FROM (SELECT x, y, row_number() OVER (ORDER BY draw, x, y) AS o
      FROM (SELECT x, y, min(md5(CAST(user_id AS VARCHAR) || '#1986')) AS draw FROM km_points GROUP BY x, y))
WHERE o <= 1000
UNION ALL
SELECT o, x, y, far, c + 1, far > 0 AND row_number() OVER (ORDER BY far DESC, o) = 1
FROM (SELECT o, x, y, c, least(far, (x - px) * (x - px) + (y - py) * (y - py)) AS far
      FROM (SELECT *, max(CASE WHEN pick THEN x END) OVER () AS px, max(CASE WHEN pick THEN y END) OVER () AS py
            FROM km_picks WHERE c < 49))""",
)
_cte("km_starts", ("km_picks",), "SELECT x, y, c FROM km_picks WHERE pick")
_cte(
    "km_rounds",
    ("km_points", "km_starts"),
    """SELECT k, c, x, y, 0 AS turn, TRUE AS moved
FROM km_starts CROSS JOIN (SELECT unnest(range(2, 51)) AS k) WHERE c < k
UNION ALL
SELECT k, c, nx, ny, turn + 1, bool_or(nx <> x OR ny <> y) OVER (PARTITION BY k)
FROM (
  SELECT k, c, any_value(cx) AS x, any_value(cy) AS y, any_value(turn) AS turn,
    CASE WHEN count_if(near) = 0 THEN any_value(cx)
         ELSE CAST(sum(CASE WHEN near THEN ux END) AS DOUBLE) / 1e10::DOUBLE / count_if(near) END AS nx,
    CASE WHEN count_if(near) = 0 THEN any_value(cy)
         ELSE CAST(sum(CASE WHEN near THEN uy END) AS DOUBLE) / 1e10::DOUBLE / count_if(near) END AS ny
  FROM (
    SELECT s.k, s.c, s.x AS cx, s.y AS cy, s.turn, p.ux, p.uy,
      row_number() OVER (PARTITION BY s.k, p.user_id
        ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.c) = 1 AS near
    FROM km_rounds s CROSS JOIN km_points p WHERE s.moved AND s.turn < 1000)
  GROUP BY k, c)""",
)
_cte(
    "km_nearest",
    ("km_points", "km_rounds"),
    """SELECT s.k, p.user_id, p.x, p.y, min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d,
  arg_min(s.c, {'d': (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), 'c': s.c})::INTEGER AS cluster
FROM (SELECT * FROM km_rounds QUALIFY turn = max(turn) OVER (PARTITION BY k)) s CROSS JOIN km_points p
GROUP BY ALL""",
)

# ----------------------------------------------------------- stats
_cte(
    "cells",
    ("users",),
    """SELECT count_if(f AND NOT c)::BIGINT AS tl, count_if(f AND c)::BIGINT AS tr,
  count_if(NOT f AND NOT c)::BIGINT AS bl, count_if(NOT f AND c)::BIGINT AS br
FROM (SELECT coalesce(fans, 0) > 1 AS f, coalesce(compliments_funny, 0) > 1 AS c FROM users)""",
)
_cte(
    "fisher_support",
    ("cells",),
    """SELECT *, sum(ln(r1 - x) - ln(x + 1) + ln(c1 - x) - ln(r2 - c1 + x + 1))
               OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS L
FROM (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS x
      FROM (SELECT *, tl + tr AS r1, bl + br AS r2, tl + bl AS c1 FROM cells))""",
)

DISPERSION_DOUBLES = [
    "longitude_Centroid",
    "latitude_Centroid",
    "AVG_Distance_From_Centroid",
    "STDEV_Distance_From_Centroid",
]


CITY_PROBS = [0.8, 0.85, 0.9, 0.95, 0.96, 0.97, 0.99]


def _quantiles_sql(table: str, col: str, probs: list[float]) -> str:
    lst = "[" + ", ".join(repr(p) for p in probs) + "]::DOUBLE[]"
    return (
        f"SELECT unnest({lst}) AS prob, ((round((unnest(quantile_cont({col}::DOUBLE, {lst}))) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS value "
        f"FROM {table}"
    )


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["visit_hits"] = sql("SELECT * FROM visit_hits", "visit_hits")
    q["located_hits"] = sql(rounded("located", ["longitude", "latitude"]), "located")
    q["user_centroids"] = sql(rounded("centroids", ["longitude_Centroid", "latitude_Centroid"]), "centroids")
    q["hit_distances"] = sql(
        rounded(
            "distances",
            ["longitude", "latitude", "longitude_Centroid", "latitude_Centroid", "Distance_From_Centroid"],
        ), "distances"
    )
    q["user_dispersion"] = sql(rounded("dispersion", DISPERSION_DOUBLES), "dispersion")
    q["visits_by_city"] = sql("SELECT * FROM visits_by_city", "visits_by_city")
    q["visits_by_city_quantiles"] = sql(_quantiles_sql("visits_by_city", "Counts", CITY_PROBS), "visits_by_city")
    q["top_cities"] = sql("SELECT * FROM visits_by_city WHERE Counts > 5000", "visits_by_city")
    q["businesses_by_city"] = sql(
        "SELECT city, state, count(state) AS Counts FROM business GROUP BY city, state", "business"
    )
    q["users_in_radius"] = sql(rounded("users_in_radius", DISPERSION_DOUBLES), "users_in_radius")
    q["businesses_in_radius"] = sql(
        rounded("businesses_in_radius", ["longitude", "latitude"]), "businesses_in_radius"
    )
    q["tight_users"] = sql(rounded("tight_users", DISPERSION_DOUBLES), "tight_users")
    q["unique_visits"] = sql("SELECT * FROM unique_visits", "unique_visits")
    q["local_users"] = sql(rounded("local_users", DISPERSION_DOUBLES), "local_users")
    q["local_reviews"] = sql("SELECT * FROM local_reviews", "local_reviews")
    q["business_ratings"] = sql(rounded("business_ratings", ["AVG_stars"]), "business_ratings")
    q["rating_quantiles"] = sql(
        f"""SELECT 'mean' AS stat, ((round((avg(AVG_stars)) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS value FROM business_ratings
UNION ALL
SELECT unnest(['p80', 'p85', 'p90', 'p95', 'p99']) AS stat,
       ((round((unnest(quantile_cont(AVG_stars, [0.8, 0.85, 0.9, 0.95, 0.99]::DOUBLE[]))) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS value
FROM business_ratings""",
        "business_ratings",
    )
    q["highly_liked"] = sql(rounded("highly_liked", ["AVG_stars"]), "highly_liked")
    q["elbow_k1"] = sql(
        f"""SELECT 1 AS k, ((round(((count(*) - 1) * (var_samp(longitude_Centroid) + var_samp(latitude_Centroid))) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS wss
FROM local_users""",
        "local_users",
    )
    q["elbow_curve"] = sql(
        f"""{q["elbow_k1"][q["elbow_k1"].rindex("SELECT 1 AS k"):]}
UNION ALL
SELECT CAST(k AS INTEGER) AS k, {_round("sum(d)")} AS wss FROM km_nearest GROUP BY k""",
        "km_nearest",
    )
    q["user_clusters"] = sql(
        f"""SELECT user_id, {_round("x")} AS "longitude_Centroid", {_round("y")} AS "latitude_Centroid", cluster
FROM km_nearest WHERE k = 6""",
        "km_nearest",
    )
    q["local_reviews_clustered"] = sql(
        "SELECT r.*, n.cluster FROM local_reviews r LEFT JOIN km_nearest n ON n.user_id = r.user_id AND n.k = 6",
        "local_reviews",
        "km_nearest",
    )
    for name in ("category_edges", "restaurants", "co_categories", "category_vocabulary"):
        q[name] = sql(f"SELECT * FROM {name}", name)
    q["category_hits"] = sql("SELECT business_id, name AS column_name FROM flag_long WHERE flag = 1", "flag_long")
    q["category_patterns"] = sql(
        """SELECT t.text, p.pattern
FROM (SELECT DISTINCT categories AS text FROM category_edges WHERE categories IS NOT NULL) t
JOIN (SELECT DISTINCT unnest(['%' || category || '%', left(category, 2) || '_' || substr(category, 4),
                              left(category, 2) || '%', '%' || right(category, 1) || '_']) AS pattern
      FROM category_vocabulary) p ON lower(t.text) LIKE p.pattern""",
        "category_edges",
        "category_vocabulary",
    )
    q["category_flags"] = sql(
        "SELECT business_id, name AS column_name, CAST(flag AS VARCHAR) AS value FROM flag_long", "flag_long"
    )
    for name, source in (("feature_frame", "feature_long"), ("drop_sparse", "sparse_long"), ("drop_nzv", "nzv_long")):
        q[name] = sql(f"SELECT * FROM {source} WHERE column_name <> 'business_id'", source)
    q["missing_profile"] = sql(rounded("missing_profile", ["na_share"]), "missing_profile")
    q["nzv_profile"] = sql(rounded("nzv_profile", ["freqRatio", "percentUnique"]), "nzv_profile")
    q["imputed_hours"] = sql("SELECT * FROM imputed", "imputed")
    q["stratified_split"] = sql("SELECT * FROM split", "split")
    q["dictionary_codes"] = sql(
        """SELECT column_name, value, count(*) AS n,
  row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) - 1 AS code
FROM (SELECT 'attributes_Wi_Fi' AS column_name, attributes_Wi_Fi AS value FROM imputed
      UNION ALL SELECT 'attributes_Brand', attributes_Brand FROM imputed)
WHERE value IS NOT NULL GROUP BY column_name, value""",
        "imputed",
    )
    cuts = ", ".join(map(str, BAG_CUTS))
    q["bag_sizes"] = sql(
        f"""SELECT bag::INTEGER AS bag, count_if(w > 0)::BIGINT AS n_in, count_if(w = 0)::BIGINT AS n_out, sum(w)::BIGINT AS draws
FROM (SELECT bag, len(list_filter([{cuts}]::BIGINT[], lambda c: h >= c)) AS w
      FROM (SELECT bag, CAST('0x' || left(md5(business_id::VARCHAR || '#1950#' || bag::VARCHAR), 12) AS BIGINT) AS h
            FROM split CROSS JOIN (SELECT unnest(range({OOB_TREES // OOB_BAG_TREES})) AS bag) WHERE split = 'train'))
GROUP BY bag""",
        "split",
    )
    q["confusion_rates"] = sql(
        f"""SELECT tp + fn + fp + tn AS n, tp, fn, fp, tn,
  ((round((CASE WHEN tp + fn + fp + tn > 0 THEN (tp + tn) / (tp + fn + fp + tn) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS accuracy,
  ((round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS sensitivity,
  ((round((CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS specificity,
  ((round((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS ppv,
  ((round((CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS npv,
  ((round((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS published_sensitivity,
  ((round((CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS published_specificity
FROM rule_counts""",
        "rule_counts",
    )
    q["share_five_star"] = sql(
        f"SELECT ((round((avg(CASE WHEN stars = 5 THEN 1.0 ELSE 0.0 END)) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS share FROM review", "review"
    )
    q["wifi_values"] = sql("SELECT DISTINCT wifi AS value FROM business", "business")
    q["share_free_wifi"] = sql(
        f"""SELECT ((round((avg(CASE WHEN wifi IS NOT NULL THEN CASE WHEN wifi = 'free' THEN 1.0 ELSE 0.0 END END)) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS share FROM business""",
        "business",
    )
    names = ", ".join(f"'{n}'" for n in LOOKUP_NAMES)
    q["find_users"] = sql(f"SELECT * FROM users WHERE votes_funny > 9000 AND name IN ({names})", "users")
    q["association_2x2"] = sql(
        f"""SELECT tl, tr, bl, br,
  ((round((coalesce(sum(CASE WHEN d <= dobs * (1 + 1e-7) THEN d END) / sum(d), 0.0)) * 1e{DIGITS}::DOUBLE)) / 1e{DIGITS}::DOUBLE) AS p_value
FROM (SELECT *, exp(L - max(L) OVER ()) AS d FROM
        (SELECT * REPLACE (coalesce(L, 0.0) AS L) FROM fisher_support))
CROSS JOIN (SELECT exp(coalesce(L, 0.0) - (SELECT max(coalesce(L, 0.0)) FROM fisher_support)) AS dobs
            FROM fisher_support WHERE x = tl)
GROUP BY tl, tr, bl, br""",
        "fisher_support",
    )
    flat = f"""SELECT business_id, longitude, latitude, city, state, hrs, wifi AS "attributes.Wi-Fi",
  brand AS "attributes.Brand", konst AS "attributes.konst", rare AS "attributes.rare",
  mostly AS "attributes.mostly" FROM business"""
    paths = ("business_id", "city", "categories", "hrs", *(f"attributes.{c}" for c in ("Wi-Fi", "Brand", "konst", "rare", "mostly")))
    stored = {"attributes.Wi-Fi": "wifi"} | {f"attributes.{c}": c.lower() for c in ("Brand", "konst", "rare", "mostly")}
    q["json_leaves"] = sql(
        "\nUNION ALL ".join(
            f"SELECT '{p}' AS path, count({stored.get(p, p)}) AS n FROM business WHERE business_id % 13 <> 0" for p in paths
        ),
        "business",
    )
    q["json_flat"] = sql(
        "SELECT business_id, city, hrs, "
        + ", ".join(f'{c} AS "{p}"' for p, c in stored.items())
        + " FROM business WHERE business_id % 13 <> 0",
        "business",
    )
    q["json_quarantine"] = sql("SELECT count(*) AS bad_lines FROM business WHERE business_id % 13 = 0", "business")
    q["businesses_in_circles"] = sql(
        f"""SELECT circle_id, business_id, {_round("distance")} AS distance
FROM (SELECT c.circle_id, b.business_id, c.radius,
        sqrt(pow(b.longitude - c.cx, 2) + pow(b.latitude - c.cy, 2)) AS distance
      FROM business b CROSS JOIN (
        SELECT city AS circle_id, {_mean("longitude")} AS cx, {_mean("latitude")} AS cy,
          CASE WHEN CAST(string_split(city, '_')[2] AS INTEGER) % 2 = 0 THEN 0.3623188::DOUBLE ELSE 0.1630435::DOUBLE END AS radius
        FROM business GROUP BY city) c)
WHERE distance < radius""",
        "business",
    )
    q["rating_quantiles_by_city"] = sql(
        f"""SELECT city, prob, {_round("value")} AS value
FROM (SELECT b.city, unnest([0.8, 0.85, 0.9, 0.95, 0.99]::DOUBLE[]) AS prob,
        unnest(quantile_cont(r.AVG_stars, [0.8, 0.85, 0.9, 0.95, 0.99]::DOUBLE[])) AS value
      FROM business_ratings r JOIN business b ON b.business_id = r.business_id GROUP BY b.city)""",
        "business_ratings",
        "business",
    )
    q["star_quantiles_by_user"] = sql(
        f"""SELECT user_id, prob, {_round("value")} AS value
FROM (SELECT user_id, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS prob,
        unnest(quantile_cont(stars::DOUBLE, [0.25, 0.5, 0.75]::DOUBLE[])) AS value
      FROM review GROUP BY user_id)""",
        "review",
    )
    q["flatten_nested"] = sql(rounded(f"({flat})", ["longitude", "latitude"]), "business")
    q["sample_head"] = sql(
        rounded(f"({flat} ORDER BY business_id LIMIT 10)", ["longitude", "latitude"]), "business"
    )
    return q
