"""Exact quantiles without one task holding every value.

A global exact percentile aggregate keeps all distinct values of the column
in one buffer in one task. Here the work is spread out:

1. distinct values with their counts (map-side combined, so a value held
   by a third of all rows is one row);
2. ``buckets - 1`` cut points from an approximate-quantile sketch of the
   distinct values (a bounded array, one scalar subquery), so buckets hold
   about equally many distinct values;
3. rows per bucket (at most ``buckets`` rows) and their running total --
   a window over that bounded table gives each bucket's offset;
4. inside each bucket a running count ordered by value (a window per
   bucket, balanced by step 2) gives every distinct value its global rank
   range [before, before + count).

The order statistics needed by each probability are then picked by a
filter on those ranges, so only a handful of rows survive. Interpolation is
the common default (R type 7): with h = (n - 1) p, value =
(1 - f) x[floor h] + f x[ceil h], f = h - floor h.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homerange.session import materialize


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], buckets: int = 256, name: str = "value"
) -> DataFrame:
    """Rows (prob, value) for each probability, over the non-NULL values of
    ``col``; no rows when there are none."""
    probs = [float(p) for p in probs]
    d = (
        df.select(F.col(col).cast("double").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    cut_probs = [i / buckets for i in range(1, buckets)]
    # one scalar subquery: the cut points and the number of values
    stats = d.select(
        F.struct(F.percentile_approx("v", cut_probs, 10 * buckets).alias("cuts"), F.sum("c").alias("n")).alias("s")
    ).scalar()
    n = stats.getField("n")
    # the cut array is projected first: a subquery may not sit inside the
    # higher-order function itself
    d = (
        d.withColumn("cuts", stats.getField("cuts"))
        .withColumn("bk", F.size(F.filter("cuts", lambda b: b < F.col("v"))))
        .drop("cuts")
    )
    per_bucket = d.groupBy("bk").agg(F.sum("c").alias("bc"))
    # bounded by ``buckets`` rows: a single-partition window is fine here
    before = Window.orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("bk", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("bk").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        d.join(F.broadcast(offsets), "bk")
        .withColumn("end", F.col("off") + F.sum("c").over(within))
        .withColumn("start", F.col("end") - F.col("c"))
    )
    # ranks are 0-based: value v covers ranks [start, end)
    targets = F.array(
        *[
            F.struct(
                F.lit(p).alias("prob"),
                F.floor((n - 1) * F.lit(p)).alias("lo"),
                F.ceil((n - 1) * F.lit(p)).alias("hi"),
                ((n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p))).alias("f"),
            )
            for p in probs
        ]
    )
    hits = ranked.select("v", "start", "end", F.explode(targets).alias("t")).filter(
        ((F.col("t.lo") >= F.col("start")) & (F.col("t.lo") < F.col("end")))
        | ((F.col("t.hi") >= F.col("start")) & (F.col("t.hi") < F.col("end")))
    )
    picked = hits.groupBy(F.col("t.prob").alias("prob")).agg(
        F.max(F.when((F.col("t.lo") >= F.col("start")) & (F.col("t.lo") < F.col("end")), F.col("v"))).alias("x_lo"),
        F.max(F.when((F.col("t.hi") >= F.col("start")) & (F.col("t.hi") < F.col("end")), F.col("v"))).alias("x_hi"),
        F.max("t.f").alias("f"),
    )
    value = F.when(F.col("x_hi") == F.col("x_lo"), F.col("x_lo")).otherwise(
        (F.lit(1.0) - F.col("f")) * F.col("x_lo") + F.col("f") * F.col("x_hi")
    )
    return picked.select("prob", value.alias(name))


def quantile_scalar(df: DataFrame, col: str, prob: float, buckets: int = 256) -> Column:
    """The ``prob`` quantile of ``col`` as a scalar subquery column."""
    return exact_quantiles(df, col, [prob], buckets).select("value").scalar()


def grouped_quantiles(
    df: DataFrame, groups: Sequence[str], col: str, probs: Sequence[float], name: str = "value"
) -> DataFrame:
    """D9 per group: rows (*groups, prob, value) of the exact quantiles of the non-NULL values of
    ``col``; a NULL group is a group, one without values has no rows.

    Distinct (group, value) pairs with their counts are range partitioned by group and value, so a
    hot group lies in as many partitions as it needs. Running counts are taken inside each
    partition, and a table of one row per partition and group (a group that lies in one partition
    has one) carries what stands before. No window holds a whole group but for that table."""
    probs = [float(p) for p in probs]
    key = F.struct(*[F.col(f"`{g}`").alias(g) for g in groups])
    d = (
        df.select(key.alias("g"), F.col(f"`{col}`").cast("double").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("g", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    placed = materialize(d.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "quantile_parts")
    parts = placed.groupBy("g", "part").agg(F.sum("c").alias("pc"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("g").alias("pg"),
        F.col("part").alias("pp"),
        F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("off"),
        F.sum("pc").over(Window.partitionBy("g")).alias("n"),
    )
    within = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        placed.withColumn("run", F.sum("c").over(within))
        .join(parts, F.col("g").eqNullSafe(F.col("pg")) & (F.col("part") == F.col("pp")))
        .select("g", "v", "n", (F.col("off") + F.col("run") - F.col("c")).alias("start"), (F.col("off") + F.col("run")).alias("end"))
    )
    rank = [(F.col("n") - 1) * F.lit(p) for p in probs]
    targets = F.array(
        *[F.struct(F.lit(p).alias("prob"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"), (h - F.floor(h)).alias("f")) for p, h in zip(probs, rank)]
    )

    def holds(t: Column) -> Column:
        return (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))

    hits = ranked.select("g", "v", "start", "end", F.explode(targets).alias("t")).filter(holds("t.lo") | holds("t.hi"))
    picked = hits.groupBy("g", F.col("t.prob").alias("prob")).agg(
        F.max(F.when(holds("t.lo"), F.col("v"))).alias("x_lo"),
        F.max(F.when(holds("t.hi"), F.col("v"))).alias("x_hi"),
        F.max("t.f").alias("f"),
    )
    value = F.when(F.col("x_hi") == F.col("x_lo"), F.col("x_lo")).otherwise(
        (F.lit(1.0) - F.col("f")) * F.col("x_lo") + F.col("f") * F.col("x_hi")
    )
    return picked.select(*[F.col("g")[g].alias(g) for g in groups], "prob", value.alias(name))
