"""Category lists to edges, restaurants and category flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homerange.functions import contains_ci, safe_name
from homerange.operators import patterns
from homerange.session import materialize

# Fixed value of the analysis: the category text that marks a restaurant.
RESTAURANT = "Restaurant"


def category_edges(businesses: DataFrame, list_col: str = "categories") -> DataFrame:
    """One row per (business, category).

    The list is joined with ", " and split on "," without trimming, as the
    analysis does, so a name holding a comma ("Beer, Wine & Spirits") gives
    two edges and every edge after the first keeps its leading space. An
    empty or missing list gives one edge with a NULL category."""
    text = F.when(F.size(list_col) > 0, F.concat_ws(", ", F.col(list_col)))
    return (
        businesses.select("business_id", F.explode_outer(F.split(text, ",")).alias("categories"))
        .distinct()
    )


def restaurants(edges: DataFrame, pattern: str = RESTAURANT) -> DataFrame:
    """Edges whose category contains ``pattern``, ignoring case."""
    return edges.filter(contains_ci("categories", pattern))


def co_categories(edges: DataFrame, pattern: str = RESTAURANT) -> DataFrame:
    """The other categories of businesses that have a restaurant
    category. A semi-join: a business with two restaurant categories does
    not get its other categories twice."""
    rest = restaurants(edges, pattern).select("business_id")
    return edges.join(rest, "business_id", "left_semi").filter(~contains_ci("categories", pattern))


def category_vocabulary(co: DataFrame) -> DataFrame:
    """The distinct co-categories, trimmed and lower-cased (matching
    ignores case, so names that differ only in case are one)."""
    return (
        co.select(F.lower(F.trim(F.col("categories"))).alias("category"))
        .filter(F.col("category").isNotNull() & (F.col("category") != ""))
        .distinct()
    )


def flag_name(term: str, prefix: str = "category_") -> str:
    return safe_name(prefix + term)


def _flag_column(term: Column, prefix: str = "category_") -> Column:
    """:func:`flag_name` as an expression."""
    return F.btrim(F.regexp_replace(F.concat(F.lit(prefix), term), "[^0-9A-Za-z]+", "_"), F.lit("_"))


def _vocabulary(co: DataFrame, terms: list[str] | None) -> DataFrame:
    if terms is None:
        return category_vocabulary(co)
    spark = co.sparkSession
    return spark.createDataFrame([(t.lower(),) for t in terms], "category string").distinct()


def category_hits(co: DataFrame, vocabulary: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """K21 in long form: (business_id, column_name) for every vocabulary term that any of the
    business' co-categories contains (ignoring case), or equals with ``exact=True``.

    Substring matching is the analysis' rule: "food" also flags "Seafood" and "Fast Food". The
    distinct categories meet the vocabulary through a q-gram index
    (:mod:`homerange.operators.patterns`), so there is no bound on the number of terms, no
    vocabulary on the driver and no nested loop. Terms whose column names coincide after
    :func:`safe_name` share a column."""
    terms = (category_vocabulary(co) if vocabulary is None else vocabulary).select("category")
    if exact:
        named = terms.select(F.col("category").alias("low"), _flag_column(F.col("category")).alias("column_name"))
        edges = co.select("business_id", F.lower(F.trim("categories")).alias("low"))
        return edges.join(named, "low").select("business_id", "column_name").distinct()
    table = terms.select("category", patterns.containing(F.col("category")).alias("pattern"))
    found = patterns.like_join(co, table, text_col="categories").join(table, "pattern")
    named = found.select(F.col("text").alias("categories"), _flag_column(F.col("category")).alias("column_name")).distinct()
    return co.select("business_id", "categories").join(named, "categories").select("business_id", "column_name").distinct()


def category_flags(co: DataFrame, terms: list[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per business, one 0/1 column per vocabulary term (see
    :func:`category_hits`), for the model.

    The names of the columns are the frame's schema; they are the only thing that reaches the
    driver, here and nowhere before."""
    vocabulary = materialize(_vocabulary(co, terms), "vocabulary")
    hits = category_hits(co, vocabulary, exact)
    names = sorted(r[0] for r in vocabulary.select(_flag_column(F.col("category"))).distinct().collect())
    businesses = co.select("business_id").distinct()
    if not names:
        return businesses
    wide = hits.groupBy("business_id").pivot("column_name", names).agg(F.first(F.lit(1)))
    flags = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in names]
    return businesses.join(wide, "business_id", "left").select("business_id", *flags)
