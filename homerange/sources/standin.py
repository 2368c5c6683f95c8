"""Review-data stand-in built from the driver's TPC-H-like tables.

The driver tables hold no reviews, so the four review tables are projected
from them (rules in FIXTURES.md). All of it is lazy DataFrame code: the
scans read only the columns used, and every derived column is a built-in
expression.

    business  <- part      (coordinates on a 0.002-degree grid, two regions)
    review/tip <- lineitem JOIN orders (user = customer, business = part)
    user      <- customer
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the driver tables that the stand-in reads. With the schema given
# the reader skips the footer-reading job that infers it; columns not listed
# are never read.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: id, coordinates, city/state, category list, opening
    hour (``hrs``) and a nested ``attributes`` struct."""
    key = F.col("p_partkey")
    travel = (key % 4) == 3
    longitude = F.when(travel, F.lit(-115.2)).otherwise(F.lit(-112.03)) + F.lit(0.002) * (key % 101)
    latitude = F.when(travel, F.lit(36.1)).otherwise(F.lit(33.35)) + F.lit(0.002) * ((key * 7) % 97)
    hrs = F.when((key % 5) == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lit(":00"))
    )
    wifi = (
        F.when((F.col("p_size") % 3) == 1, F.lit("free"))
        .when((F.col("p_size") % 3) == 2, F.lit("no"))
        .otherwise(F.lit(None).cast("string"))
    )
    attributes = F.struct(
        wifi.alias("Wi-Fi"),
        F.col("p_brand").alias("Brand"),
        F.lit("const").alias("konst"),
        F.when((key % 9) == 0, F.lit("x")).otherwise(F.lit(None).cast("string")).alias("rare"),
        F.when((key % 50) == 0, F.lit("a")).otherwise(F.lit("b")).alias("mostly"),
    )
    return _read(spark, sf_dir, "part").select(
        key.alias("business_id"),
        longitude.alias("longitude"),
        latitude.alias("latitude"),
        F.concat(F.lit("city_"), (key % 12).cast("string")).alias("city"),
        F.concat(F.lit("st_"), (key % 4).cast("string")).alias("state"),
        F.concat(F.array(F.col("p_type")), F.split(F.col("p_name"), " ")).alias("categories"),
        hrs.alias("hrs"),
        attributes.alias("attributes"),
    )


def hits(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Every tip or review: (user_id, business_id, kind, stars).

    Every line item is one visit by the order's customer: to the part of the
    customer's home region next to the item's part (some of these ids are no
    part, which exercises the NULL side of the location join), or, on line 7
    of every third customer's orders, a trip to the item's own part. Returned
    items are tips, the rest reviews; with ``kind`` only one of them is read,
    and that filter is on a stored column, so it reaches the Parquet scan."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    is_tip = F.col("l_returnflag") == "R"
    if kind == "tip":
        li = li.filter(is_tip)
    elif kind == "review":
        li = li.filter((F.col("l_returnflag") != "R") | F.col("l_returnflag").isNull())
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(od, li["l_orderkey"] == od["o_orderkey"])
    trip = (F.col("l_linenumber") == 7) & ((F.col("o_custkey") % 3) == 0)
    at_home = F.col("l_partkey") - F.col("l_partkey") % 4 + F.col("o_custkey") % 4
    return joined.select(
        F.col("o_custkey").alias("user_id"),
        F.when(trip, F.col("l_partkey")).otherwise(at_home).alias("business_id"),
        F.when(is_tip, F.lit("tip")).otherwise(F.lit("review")).alias("kind"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("stars"),
    )


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "tip").select("user_id", "business_id")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "review").select("user_id", "business_id", "stars")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: name, fans and the two 'funny' counters."""
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        (key % 4).alias("fans"),
        F.when((key % 7) == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey") % 3).alias("compliments_funny"),
        F.floor(F.col("c_acctbal")).alias("votes_funny"),
    )


@dataclass(frozen=True)
class StandIn:
    """The four review tables of one scale, all lazy."""

    business: DataFrame
    review: DataFrame
    tip: DataFrame
    user: DataFrame


def load(spark: SparkSession, sf_dir: str) -> StandIn:
    return StandIn(
        business=business(spark, sf_dir),
        review=reviews(spark, sf_dir),
        tip=tips(spark, sf_dir),
        user=users(spark, sf_dir),
    )
