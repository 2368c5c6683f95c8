"""Joining a per-key aggregate back onto its rows without a hot-key straggler.

A plain ``rows JOIN per_key ON key`` (or a window partitioned by the key)
sends all rows of one key to one task; if one user holds a third of all rows,
that task does a third of the work. Here the keys whose row count is over
``split_rows`` are split: their rows get a random salt in
``[0, ceil(count / split_rows))`` and their aggregate row is copied once per
salt, so every (key, salt) group has about ``split_rows`` rows. Every copy
carries the same values, so the result does not depend on which salt a row
draws (retries that redraw salts give the same answer).

The hot-key list is broadcast. Its size is proven: keys over ``split_rows``
number at most rows / split_rows, and at most ``max_hot_keys`` of the largest
are taken (a top-k, one bounded heap per task); keys beyond that are joined
unsalted, which is still exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"
_SPLITS = "__splits"


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    count_col: str,
    how: str = "left",
    split_rows: int = 1_000_000,
    max_hot_keys: int = 10_000,
    seed: int = 17,
) -> DataFrame:
    """``rows JOIN per_key USING (key)`` with hot keys split.

    ``per_key`` has one row per key and ``count_col`` = number of rows of that
    key in ``rows`` (as produced by the aggregate that built it). The count
    column is not carried into the result."""
    hot = (
        per_key.filter(F.col(count_col) > split_rows)
        .select(key, F.ceil(F.col(count_col) / F.lit(split_rows)).cast("int").alias(_SPLITS), F.col(count_col))
        .orderBy(F.col(count_col).desc(), F.col(key))
        .limit(max_hot_keys)
        .drop(count_col)
    )
    hot_b = F.broadcast(hot)
    salted_rows = rows.join(hot_b, key, "left").withColumn(
        _SALT,
        F.when(F.col(_SPLITS).isNull(), F.lit(0)).otherwise(
            F.least(F.floor(F.rand(seed) * F.col(_SPLITS)).cast("int"), F.col(_SPLITS) - 1)
        ),
    ).drop(_SPLITS)
    copies = (
        per_key.drop(count_col)
        .join(hot_b, key, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SPLITS), F.lit(1)) - 1)))
        .drop(_SPLITS)
    )
    return salted_rows.join(copies, [key, _SALT], how).drop(_SALT)
