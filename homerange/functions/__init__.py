"""Column expressions shared by the operators (all JVM-side, no UDF)."""

from homerange.functions.expressions import (
    contains_ci,
    exact_mean,
    leading_number,
    planar_distance,
    safe_name,
    stdev_or_zero,
    within_box,
)

__all__ = [
    "contains_ci",
    "exact_mean",
    "leading_number",
    "planar_distance",
    "safe_name",
    "stdev_or_zero",
    "within_box",
]
