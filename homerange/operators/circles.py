"""Many circles at once and a layout that lets scans skip (K9).

One circle is a filter; many are a join of points with circles on distance, which as such
compares every point with every circle. Here the plane is cut into square cells as wide as
the largest radius, so a circle reaches at most nine cells: circles are posted under these,
a point is in one, they meet by an equi-join on the cell, and the distance is verified once
per meeting pair.

For points that are stored and asked often, :func:`write_clustered` sorts them along a
Z-order curve before they are written. Neighbours in the plane end up in the same files and
row groups, whose minima and maxima then let a scan with a box pass over the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homerange.functions import planar_distance

#: Bits of each coordinate in the Z-order key: cells of 360 / 2**20 degrees.
BITS = 20


def within_circles(
    points: DataFrame, circles: DataFrame, lon: str = "longitude", lat: str = "latitude", circle_id: str = "circle_id"
) -> DataFrame:
    """The columns of ``points`` with ``circle_id`` and ``distance``, one row for every circle
    (``circle_id``, ``cx``, ``cy``, ``radius``) that a point lies strictly inside of."""
    wide = circles.agg(F.max("radius")).first()[0]
    if not wide or wide <= 0:  # no circle has an inside
        kind = circles.schema[circle_id].dataType
        return points.withColumn(circle_id, F.lit(None).cast(kind)).withColumn("distance", F.lit(0.0)).filter("false")
    side = F.lit(float(wide))

    def cell(c: Column) -> Column:
        return F.floor(c / side).cast("long")

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    posted = circles.select(circle_id, F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("radius").alias("__r"))
    posted = posted.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    posted = posted.withColumn("__x", cell(F.col("__cx")) + F.col("__dx")).withColumn("__y", cell(F.col("__cy")) + F.col("__dy"))
    at = points.withColumn("__x", cell(F.col(lon))).withColumn("__y", cell(F.col(lat)))
    met = at.join(posted, ["__x", "__y"])
    met = met.withColumn("distance", planar_distance(lon, lat, F.col("__cx"), F.col("__cy"))).filter("distance < __r")
    return met.select(*[F.col(f"`{c}`") for c in points.columns], circle_id, "distance")


def z_order(lon: Column, lat: Column, bits: int = BITS) -> Column:
    """Interleaved bits of the two coordinates: near points have near keys."""
    top = (1 << bits) - 1

    def grid(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((c + 180.0) / 360.0 * (top + 1)))).cast("long")

    def spaced(v: Column) -> Column:
        # each step doubles the distance between groups of bits
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spaced(grid(lon)).bitwiseOR(F.shiftleft(spaced(grid(lat)), 1))


def write_clustered(
    df: DataFrame, path: str, lon: str = "longitude", lat: str = "latitude", files: int | None = None
) -> None:
    """``df`` as Parquet along the Z-order curve; rows without coordinates come first."""
    key = z_order(F.col(lon), F.col(lat))
    keyed = df.withColumn("__z", key)
    dealt = keyed.repartitionByRange(files, "__z") if files else keyed.repartitionByRange("__z")
    dealt.sortWithinPartitions("__z").drop("__z").write.mode("overwrite").parquet(path)
