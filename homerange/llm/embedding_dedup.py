"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Cells. Directions of a bounded sample of vectors (``sample_rows``) are clustered by
spherical k-means; every vector belongs to the cell of its most similar centre. A
link crosses a cell border only if one of its ends lies near that border: for
vectors u in A and v in B with |u - v| <= delta, the gaps of u towards B and of v
towards A add up to at most delta |cA - cB|, so one of them is at most half of it. So
each vector also visits, as a guest, the cells whose border is that near, and every
link is found in the home cell of one of its ends: the search is exact, whatever the
centres are; good centres only make it cheaper.

Within a cell, rows meet in blocks: ``block_rows`` home rows against as many others and
against eight times as many guests, each pair of blocks a matrix product of its own, so a crowded cell becomes
many tasks. A block returns the number of links of each of its rows and a spanning
forest, never the pairs. Equal vectors are collapsed first and counted by weight.

Defined results. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing: n_links 0, their own component. Vectors of different
lengths do not link. Repeated rows are vectors of their own that link with each other.
A null id counts in n_links; component_id is the smallest non-null id that can be
reached. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import read, ship
from homerange.llm.components import components
from homerange.llm.simhash import forest
from homerange.session import materialize

MIN_COSINE = 0.95
#: Room for rounding: pairs this near the threshold are computed again on their own.
SLACK = 1e-9
#: Rows of one side that a product takes at a time.
PRODUCT_ROWS = 1024


def fit_centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on unit vectors: centres start at rows spread evenly over the
    sample; an empty cell takes the row that fits its own centre worst."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell, fit = np.empty(len(sample), np.int64), np.empty(len(sample))
        for a in range(0, len(sample), PRODUCT_ROWS):
            near = sample[a : a + PRODUCT_ROWS] @ centres.T
            cell[a : a + PRODUCT_ROWS] = near.argmax(axis=1)
            fit[a : a + PRODUCT_ROWS] = near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        if len(empty):
            worst = np.argsort(fit)[: len(empty)]
            sums[empty[: len(worst)]] = sample[worst]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, width)
    # a scale first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Cells:
    """Centres, and which cells a vector visits."""

    def __init__(self, centres: np.ndarray, min_cosine: float):
        self.centres = centres
        self.reach = 0.5 * np.sqrt(2 - 2 * (min_cosine - SLACK))

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(home cell, cells visited) of each vector. The distance of two centres comes from
        their product, so only rows in hand meet all centres; its rounding error (below 1e-7)
        goes into the margin."""
        home, visited = np.empty(len(unit), np.int64), []
        for a in range(0, len(unit), PRODUCT_ROWS):
            near = unit[a : a + PRODUCT_ROWS] @ self.centres.T
            mine = near.argmax(axis=1)
            home[a : a + PRODUCT_ROWS] = mine
            length = (self.centres * self.centres).sum(axis=1)
            apart = length[mine][:, None] + length - 2 * (self.centres[mine] @ self.centres.T)
            margin = self.reach * np.sqrt(np.maximum(apart, 0)) + 1e-7
            inside = near[np.arange(len(near)), mine][:, None] - near <= margin
            visited += [np.flatnonzero(row) for row in inside]
        return home, visited


@lru_cache(maxsize=1)
def _cells(raw: bytes, width: int, min_cosine: float) -> Cells:
    return Cells(np.frombuffer(raw, dtype=np.float64).reshape(-1, width), min_cosine)


def _meet(group: pa.Table, width: int, min_cosine: float) -> pa.Table:
    """Links between the rows of side 0 and those of side 1 of one block pair (between
    side 0 and itself if the block meets itself)."""
    cols = {c: group.column(c).combine_chunks() for c in ("node", "side", "home", "weight", "vector", "visits")}
    if isinstance(cols["vector"], pa.ChunkedArray):
        cols = {c: pa.concat_arrays(v.chunks) for c, v in cols.items()}
    cell = group.column("cell")[0].as_py()
    itself = group.column("i")[0].as_py() == group.column("j")[0].as_py() and group.column("j")[0].as_py() >= 0
    side = cols["side"].to_numpy()
    node, home, weight = (cols[c].to_numpy() for c in ("node", "home", "weight"))
    unit = _unit(cols["vector"], width)
    left = np.flatnonzero(side == 0)
    right = left if itself else np.flatnonzero(side == 1)
    links = np.zeros(len(node))
    # (row, cell) of all visits, as sorted numbers
    offsets = cols["visits"].offsets.to_numpy()
    cells = cols["visits"].values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    wide = max(int(cells.max(initial=0)), int(home.max(initial=0))) + 1
    visits = np.sort(np.repeat(np.arange(len(node)), np.diff(offsets)) * wide + cells)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs, one product at a time."""
        for a in range(0, len(right), PRODUCT_ROWS):
            part = right[a : a + PRODUCT_ROWS]
            close = unit[left] @ unit[part].T
            r, c = np.nonzero(close >= min_cosine - SLACK)
            x, y, value = left[r], part[c], close[r, c]
            border = np.flatnonzero(np.abs(value - min_cosine) <= SLACK)
            if len(border):
                value[border] = np.einsum("ij,ij->i", unit[x[border]], unit[y[border]])
            ok = value >= min_cosine
            if itself:
                ok &= node[x] < node[y]
            else:
                # a guest's pair is left to the guest's own cell if that comes first and the
                # host visits it
                early = np.flatnonzero(ok & (home[y] != cell) & (home[y] < cell))
                if len(early):
                    key = x[early] * wide + home[y[early]]
                    at = np.minimum(np.searchsorted(visits, key), len(visits) - 1)
                    ok[early[visits[at] == key]] = False
            x, y = x[ok], y[ok]
            nonlocal links
            links += np.bincount(x, weights=weight[y], minlength=len(node))
            links += np.bincount(y, weights=weight[x], minlength=len(node))
            if len(x):
                yield x, y

    label = forest(len(node), pairs())
    with_links = np.flatnonzero(links > 0)
    return pa.table(
        {
            "node": pa.array(node[with_links]),
            "root": pa.array(node[label[with_links]]),
            "links": pa.array(links[with_links].astype(np.int64)),
        }
    )


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    cell_rows: int = 2048,
    max_cells: int = 4096,
    sample_rows: int = 8192,
    block_rows: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (
        (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("vector")
    )
    # equal vectors once, with their number; -0.0 is 0.0
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(plain.cast("string"), 256)))
    all_rows = materialize(rows.select("id", "key"), "vector_keys")
    distinct = (
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
        .withColumn("width", F.size("vector"))
    )
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for r in nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():
        part = _search(nodes.filter(F.col("width") == r["width"]), r["width"], r["n"], min_cosine, cell_rows,
                       max_cells, sample_rows, block_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return all_rows.select(
            F.col("id").alias(id_col),
            F.lit(0).cast("long").alias("n_links"),
            F.col("id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    found = materialize(found, "vector_links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"), "node", "root")
    named = (
        nodes.select("key", "node", "first_id", "weight")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = named.groupBy("root").agg(F.min("first_id").alias("lowest"))
    named = named.join(lowest, "root").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "lowest"
    )
    out = all_rows.join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("lowest"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _search(
    nodes: DataFrame,
    width: int,
    n: int,
    min_cosine: float,
    cell_rows: int,
    max_cells: int,
    sample_rows: int,
    block_rows: int,
) -> DataFrame:
    """(node, root, links) from every block pair, for vectors of one length."""
    share = min(1.0, sample_rows / max(n, 1))
    drawn = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = drawn.orderBy(F.xxhash64("node")).limit(sample_rows).select("vector").toArrow()
    sample = _unit(drawn.column(0).combine_chunks(), width) if drawn.num_rows else np.eye(1, width)
    k = int(min(max(1, n // cell_rows), max_cells, len(sample)))
    centres = fit_centres(sample, k)
    raw = centres.tobytes()

    schema = T.StructType(
        [
            T.StructField("node", T.LongType()),
            T.StructField("weight", T.LongType()),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
            T.StructField("home", T.IntegerType()),
            T.StructField("visits", T.ArrayType(T.IntegerType())),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _cells(raw, width, min_cosine)
        for b in batches:
            if not b.num_rows:
                continue
            home, visited = cells.visits(_unit(b.column(2), width))
            lists = pa.array([r.astype(np.int32) for r in visited], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(home.astype(np.int32)), lists], names=schema.names
            )

    placed = materialize(nodes.select("node", "weight", "vector").mapInArrow(place, schema), "cells")
    # blocks of each cell's home rows, and of its guests
    each = placed.select("*", F.explode("visits").alias("cell")).withColumn(
        "side", (F.col("cell") != F.col("home")).cast("int")
    )
    sizes = placed.select("home", F.explode("visits").alias("cell")).groupBy("cell").agg(
        F.sum((F.col("cell") == F.col("home")).cast("long")).alias("hosts"),
        F.sum((F.col("cell") != F.col("home")).cast("long")).alias("guests"),
    )
    host_blocks = F.greatest(F.ceil(F.col("hosts") / block_rows), F.lit(1)).cast("int")
    guest_blocks = F.greatest(F.ceil(F.col("guests") / (8 * block_rows)), F.lit(1)).cast("int")
    h = F.xxhash64("node")
    each = each.join(F.broadcast(sizes), "cell")  # at most max_cells rows
    mine = F.pmod(h, F.when(F.col("side") == 0, host_blocks).otherwise(guest_blocks)).cast("int")
    each = each.withColumn("mine", mine)
    # host block i meets host block j >= i (j as second side) and guest block g, told
    # apart by j = -1 - g
    as_first = F.transform(F.sequence(F.col("mine"), host_blocks - 1), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"), F.lit(0).alias("as")))
    as_second = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("mine")), lambda i: i < F.col("mine")),
        lambda i: F.struct(i.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("as")),
    )
    with_guests = F.when(
        F.col("guests") > 0,
        F.transform(
            F.sequence(F.lit(0), guest_blocks - 1),
            lambda g: F.struct(F.col("mine").alias("i"), (F.lit(-1) - g).alias("j"), F.lit(0).alias("as")),
        ),
    ).otherwise(F.array().cast("array<struct<i:int,j:int,as:int>>"))
    as_guest = F.transform(
        F.sequence(F.lit(0), host_blocks - 1),
        lambda i: F.struct(i.alias("i"), (F.lit(-1) - F.col("mine")).alias("j"), F.lit(1).alias("as")),
    )
    meetings = F.when(F.col("side") == 0, F.concat(as_first, as_second, with_guests)).otherwise(as_guest)
    dealt = each.withColumn("m", F.explode(meetings)).select(
        "cell", "m.i", "m.j", F.col("m.as").alias("side"), "node", "home", "weight", "vector", "visits"
    )
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "root", "links")])
    return dealt.groupBy("cell", "i", "j").applyInArrow(lambda t: _meet(t, width, min_cosine), out)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: links and component of every vector of ``embeddings``."""
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
