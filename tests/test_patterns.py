"""LIKE by q-gram index against SQL's own LIKE; long-form flags with very many terms."""

import random
import re

from pyspark.sql import functions as F

from homerange.operators import categories, patterns


def plain_like(text: str, pattern: str) -> bool:
    out, i, p = "", 0, pattern.lower()
    while i < len(p):
        if p[i] == "\\" and p[i + 1 : i + 2] and p[i + 1] in "%_\\":
            out += re.escape(p[i + 1])
            i += 1
        else:
            out += {"%": ".*", "_": "."}.get(p[i], re.escape(p[i]))
        i += 1
    return re.fullmatch(out, text.lower(), re.S) is not None


def test_like_join_matches_like(spark):
    rng = random.Random(2)
    letters = "aAbB%_\\é \n"
    texts = {"".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(150)} | {"Seafood", "Fast Food", "Bars"}
    table = {"".join(rng.choice(letters + "%%__\\") for _ in range(rng.randrange(0, 6))) for _ in range(150)}
    table |= {"%", "", "__", "%food%", "b_rs", "sea%", "%\\%%", "%\\_", "nothing has this", "%\\"}
    t = spark.createDataFrame([(x,) for x in [*texts, None, "Bars"]], "text string")
    p = spark.createDataFrame([(x,) for x in [*table, None, "%food%"]], "pattern string")
    got = [tuple(r) for r in patterns.like_join(t, p).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in texts for y in table if plain_like(x, y)}


def test_literal_terms(spark):
    words = ["50%", "a_b", "c\\d", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", patterns.containing(F.col("w")).alias("pattern"))
    texts = spark.createDataFrame([(x,) for x in ["save 50% now", "save 500 now", "A_B", "axb", "c\\d", "cd", "Plain text"]], "text string")
    got = {tuple(r) for r in patterns.like_join(texts, df).join(df, "pattern").select("text", "w").collect()}
    assert got == {("save 50% now", "50%"), ("A_B", "a_b"), ("c\\d", "c\\d"), ("Plain text", "plain")}


def test_flags_of_fifty_thousand_terms(spark):
    n = 50_000
    co = spark.range(n, numPartitions=8).select(
        (F.col("id") % 5000).alias("business_id"), F.concat(F.lit(" Kind "), F.col("id").cast("string")).alias("categories")
    )
    hits = categories.category_hits(co)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # "kind 12" is in "kind 12", "kind 120".."kind 129", ...; a term of d digits is in all that begin with it
    ids = [str(i) for i in range(n)]
    want = len({(i % 5000, ids[i][:k]) for i in range(n) for k in range(1, len(ids[i]) + 1) if int(ids[i][:k]) < n and (k == 1 or ids[i][0] != "0")})
    assert hits.count() == want


def test_wide_flags_equal_the_long_form(spark):
    co = spark.createDataFrame(
        [(1, "Seafood"), (1, " Fast Food"), (2, "Food"), (3, None), (4, "Bars & Grills"), (4, "bars  grills")],
        "business_id long, categories string",
    )
    wide = categories.category_flags(co)
    hits = {tuple(r) for r in categories.category_hits(co).collect()}
    got = {(r.business_id, c) for r in wide.collect() for c in wide.columns[1:] if r[c] == 1}
    assert got == hits and wide.count() == 4
    assert {r.business_id: r.category_food for r in wide.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert categories.category_flags(co, terms=["FOOD"], exact=True).filter("category_food = 1").count() == 1
    assert categories.category_flags(co.filter("false")).count() == 0
