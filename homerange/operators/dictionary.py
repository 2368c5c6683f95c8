"""Dictionary coding of text columns on the executors.

A code table holds one row per (column, value): its number of rows and a dense code from
0 upwards. Values are counted with map-side partial sums, range partitioned by (column,
order) and sorted; a value's code is its place in its partition plus the number of the
column's values in the partitions before. So no task ranks a whole column, no label array
reaches the driver, and a column of many millions of values encodes like any other. The
offsets are one row per partition and column.

Codes are ordered by falling count, then value; or, with ``share_of``, by the share of a
column's rows with that value where the condition holds, then value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homerange.session import materialize


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def value_counts(df: DataFrame, columns: list[str], share_of: Column | None = None) -> DataFrame:
    """(column_name, value, n, hits) of the non-NULL values, as text; ``hits`` counts the rows
    where ``share_of`` holds."""
    hit = (F.lit(False) if share_of is None else F.coalesce(share_of, F.lit(False))).cast("long")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("value")) for c in columns])
    long = df.select(hit.alias("hit"), F.explode(pairs).alias("e")).select("e.column_name", "e.value", "hit")
    counted = long.filter("value is not null").groupBy("column_name", "value")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


def dictionary_codes(df: DataFrame, columns: list[str], share_of: Column | None = None) -> DataFrame:
    """(column_name, value, n, code) for the text columns ``columns``; the table is written."""
    counts = value_counts(df, columns, share_of)
    rank = -F.col("n") if share_of is None else F.col("hits") / F.col("n")
    order = ["column_name", "rank", "value"]
    placed = counts.withColumn("rank", rank).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select(
        "column_name", "value", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")
    )
    placed = materialize(placed, "dictionary_places")
    parts = placed.groupBy("column_name", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    code = (F.col("pos") - F.col("first") + F.col("offset")).cast("long")
    # one row per partition and column
    joined = placed.join(F.broadcast(parts.drop("size")), ["column_name", "part"])
    return materialize(joined.select("column_name", "value", "n", code.alias("code")), "dictionary")


def sizes(codes: DataFrame) -> DataFrame:
    """(column_name, size): distinct values per column."""
    return codes.groupBy("column_name").agg(F.count(F.lit(1)).alias("size"))


def encode(df: DataFrame, codes: DataFrame, size: dict[str, int], prefix: str = "") -> DataFrame:
    """I8: ``df`` with a column ``prefix + c`` of codes for every coded column c. A NULL or unknown
    value gets the first code that no value has. One left join a column; Catalyst broadcasts the
    dictionaries that are small by their written size, and AQE splits hot values of the others."""
    out = df
    for c, n in size.items():
        one = codes.filter(F.col("column_name") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        out = out.join(one, _q(c).cast("string") == F.col("__value"), "left").drop("__value")
        out = out.withColumn(prefix + c, F.coalesce("__code", F.lit(n).cast("long"))).drop("__code")
    return out
