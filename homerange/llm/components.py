"""Connected components of a graph given by its edges.

Large-star and small-star rounds: every node links its larger neighbours, then its
smaller ones, to the smallest node it knows. Minima are aggregated before the
shuffle, so a node with very many neighbours costs no task more than its rows; its
rows' join back can be split. Each round is a written table, so a lost executor
costs a re-read and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homerange.session import discard, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another: root is the smallest
    node that can be reached, itself included. Null ends and loops count for nothing."""
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.filter("u <> v").distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low2, "u")
        pairs = small.select("u", F.col("low").alias("v")).unionByName(
            small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        nxt = materialize(pairs.distinct(), "edges")
        discard(e)
        e, old, state = nxt, state, _state(nxt)
        if old == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
