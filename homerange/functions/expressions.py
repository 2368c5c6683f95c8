"""Column expressions.

Everything here builds a ``Column`` from built-in functions so it stays in
whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def planar_distance(x: ColumnOrName, y: ColumnOrName, cx: ColumnOrName | float, cy: ColumnOrName | float) -> Column:
    """Euclidean distance in degrees, a degree of longitude counted like one
    of latitude (the analysis' metric). Kept as double: the analysis casts to
    decimal(10,8), which would overflow for far-away points."""
    cxc = cx if isinstance(cx, Column) else (F.lit(float(cx)) if not isinstance(cx, str) else F.col(cx))
    cyc = cy if isinstance(cy, Column) else (F.lit(float(cy)) if not isinstance(cy, str) else F.col(cy))
    return F.sqrt(F.pow(_col(x) - cxc, 2.0) + F.pow(_col(y) - cyc, 2.0))


def within_box(x: ColumnOrName, y: ColumnOrName, cx: float, cy: float, half: float) -> Column:
    """Axis-aligned box that contains the circle of radius ``half``.

    Implied by ``planar_distance < half``; it is a plain range predicate, so
    Parquet row-group statistics can skip data when it reaches the scan. The
    margin absorbs the last-bit rounding of ``sqrt``.
    """
    h = half * (1.0 + 1e-9)
    return _col(x).between(cx - h, cx + h) & _col(y).between(cy - h, cy + h)


def contains_ci(text: ColumnOrName, fragment: str | Column) -> Column:
    """Case-insensitive substring test: SQL ``text LIKE '%fragment%'`` in an
    engine whose LIKE ignores case, without wildcard escaping problems."""
    frag = F.lower(fragment) if isinstance(fragment, Column) else F.lit(fragment.lower())
    return F.lower(_col(text)).contains(frag)


def stdev_or_zero(c: ColumnOrName) -> Column:
    """Sample standard deviation that is 0 for a single value (the analysis'
    SQL extension) and NULL when there is no value."""
    return F.when(F.count(_col(c)) == 1, F.lit(0.0)).otherwise(F.stddev_samp(_col(c)))


def leading_number(c: ColumnOrName, width: int = 2) -> Column:
    """First ``width`` characters as a number, NULL when they are not one
    ("07:30" -> 7.0, "0" -> 0.0)."""
    return F.substring(_col(c).cast("string"), 1, width).try_cast("double")


_UNSAFE = re.compile(r"[^0-9A-Za-z]+")


def safe_name(name: str) -> str:
    """Column name with every run of non-alphanumerics turned into ``_``
    ("attributes.Wi-Fi" -> "attributes_Wi_Fi", "American (New)" ->
    "American_New")."""
    return _UNSAFE.sub("_", name).strip("_")


def exact_mean(c: ColumnOrName, units_per_degree: float = 1e10) -> Column:
    """Aggregate: mean of a coordinate, independent of summation order.

    Values are taken in whole units of 1/``units_per_degree`` (1e-10 degree,
    about 0.01 mm), summed exactly as decimals, and only the final sum is
    turned into a double and divided. A plain double average depends on the
    order in which partitions are added, so the same data could give
    centroids that differ in the last bit from run to run; this one cannot.
    NULLs are skipped, as in ``avg``."""
    scale = F.lit(float(units_per_degree))
    units = F.round(_col(c) * scale, 0).cast("decimal(20,0)")
    return (F.sum(units).cast("double") / scale) / F.count(_col(c))
