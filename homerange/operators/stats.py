"""Shares, user lookups and the 2x2 association test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the analysis: relative tolerance of the exact test when
# comparing table probabilities, and the name list of the user lookup.
FISHER_REL_ERR = 1 + 1e-7
LOOKUP_NAMES = ("Brian", "Ira", "Jeff", "Roger")


def share_of(df: DataFrame, cond: Column, among: Column | None = None, name: str = "share") -> DataFrame:
    """Share of rows meeting ``cond``; with ``among``, only rows where
    ``among`` holds count (e.g. rows that answered at all). One row."""
    hit = F.when(F.coalesce(cond, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    if among is not None:
        hit = F.when(F.coalesce(among, F.lit(False)), hit)
    return df.agg(F.avg(hit).alias(name))


def distinct_values(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    """The distinct values of one column (NULL included), as rows."""
    return df.select(F.col(col).alias(name)).distinct()


def find_users(
    users: DataFrame,
    min_funny: int = 10000,
    names: Sequence[str] | None = LOOKUP_NAMES,
    column: str = "votes_funny",
) -> DataFrame:
    """Users with more than ``min_funny`` in ``column`` and, when
    ``names`` is given, one of those names."""
    out = users.filter(F.col(column) > min_funny)
    if names is not None:
        out = out.filter(F.col("name").isin(list(names)))
    return out


def cross_2x2(df: DataFrame, row: Column, col: Column, by: Sequence[str] = ()) -> DataFrame:
    """The four cells per group. ``tl`` = row & not col, ``tr`` = row &
    col, ``bl`` = not row & not col, ``br`` = not row & col."""
    r, c = F.coalesce(row, F.lit(False)), F.coalesce(col, F.lit(False))

    def n(cond):
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")

    cells = [n(r & ~c).alias("tl"), n(r & c).alias("tr"), n(~r & ~c).alias("bl"), n(~r & c).alias("br")]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def fisher_exact(table: DataFrame, by: Sequence[str] = (), width_sd: float = 60.0, width_min: int = 100) -> DataFrame:
    """Two-sided Fisher exact p-value of each 2x2 row (tl, tr, bl, br).

    With the margins fixed, the top-left count x has a hypergeometric law;
    the p-value is the total probability of the values of x no more likely
    than the observed one (within a relative 1e-7). Per group the support is
    exploded to rows, log-probabilities come from a running sum of the
    log ratio P(x+1)/P(x) (a window ordered by x) and are normalised by their
    maximum, as the usual implementation does.

    Only x within ``width_sd`` standard deviations (+ ``width_min``) of the
    mode is generated: outside, probabilities relative to the mode are far
    below 1e-300 and contribute nothing in double precision. So a group of N
    rows yields O(sqrt N) support rows, not O(N). An observed x outside that
    band has p = 0 to that precision."""
    keys = list(by) or ["__g"]
    t = table if by else table.withColumn("__g", F.lit(0))
    # margins as doubles inside products: four of them overflow 64 bits early
    r1 = F.col("tl") + F.col("tr")
    r2 = F.col("bl") + F.col("br")
    c1 = F.col("tl") + F.col("bl")
    n = r1 + r2
    t = t.select(*keys, "tl", "tr", "bl", "br", r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), n.alias("n"))
    lo = F.greatest(F.lit(0), F.col("c1") - F.col("r2"))
    hi = F.least(F.col("r1"), F.col("c1"))
    d1, d2, dc, dn = (F.col(c).cast("double") for c in ("r1", "r2", "c1", "n"))
    mode = F.floor((d1 + 1) * (dc + 1) / (dn + 2))
    var = F.when(
        F.col("n") > 1,
        (d1 / dn) * (d2 / dn) * (dc / (dn - 1)) * (dn - dc),
    ).otherwise(F.lit(0.0))
    half = F.ceil(F.lit(width_sd) * F.sqrt(var)) + F.lit(width_min)
    t = t.withColumn("__lo", F.greatest(lo, mode - half).cast("long")).withColumn(
        "__hi", F.least(hi, mode + half).cast("long")
    )
    sup = t.withColumn("x", F.explode(F.sequence(F.col("__lo"), F.col("__hi"))))
    x = F.col("x")
    log_ratio = (
        F.log(F.col("r1") - x) - F.log(x + 1) + F.log(F.col("c1") - x) - F.log(F.col("r2") - F.col("c1") + x + 1)
    )
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sup = sup.withColumn("__L", F.coalesce(F.sum(log_ratio).over(upto), F.lit(0.0)))
    sup = sup.withColumn("__d", F.exp(F.col("__L") - F.max("__L").over(whole)))
    sup = sup.withColumn("__dobs", F.max(F.when(x == F.col("tl"), F.col("__d"))).over(whole))
    p = F.sum(F.when(F.col("__d") <= F.col("__dobs") * F.lit(FISHER_REL_ERR), F.col("__d"))) / F.sum("__d")
    res = sup.groupBy(*keys, "tl", "tr", "bl", "br").agg(F.coalesce(p, F.lit(0.0)).alias("p_value"))
    return res.drop("__g") if not by else res


def association_2x2(
    df: DataFrame,
    row_col: str = "fans",
    col_col: str = "compliments_funny",
    row_above: float = 1,
    col_above: float = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cross-tabulate ``row_col > row_above`` against ``col_col >
    col_above`` (missing values count as 0) and test independence. One row
    per group: tl, tr, bl, br, p_value."""
    row = F.coalesce(F.col(row_col), F.lit(0)) > F.lit(row_above)
    col = F.coalesce(F.col(col_col), F.lit(0)) > F.lit(col_above)
    return fisher_exact(cross_2x2(df, row, col, by), by)
