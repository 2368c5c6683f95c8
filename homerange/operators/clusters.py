"""Area clusters of local users (K13): k-means of many k at once, as a fixed point.

The centres of all k are one small table (k, cluster, x, y): for k = 2..50 it has 1274
rows, whatever the number of users. A round is one scan of the points for all k
together: a task takes its points in Arrow batches, finds the nearest centre of each k
and leaves one partial sum per centre, and the partial sums of all tasks make the next
table. A k drops out when none of its centres has moved.

Points are dealt over the tasks along a Z-order curve, and a task takes :data:`BLOCK` of
them at a time. No point of a block is nearer to a centre than the block's box, nor farther
than its far corner (rounding keeps the order, so this holds to the last bit); most boxes
leave one centre possible, and the block's sums go there whole. Only points of the other
blocks are held against centres, and only against the possible ones.

Every step is defined to the last bit, so a plain SQL version gives the same centres:

* starts: distinct points are drawn in the order of the smallest md5(key, seed) that holds
  them, :data:`START_POINTS` at most; the first one drawn is the first start, and the next
  is always the one farthest from those before (of equals the first drawn). k starts from
  the first k of these (all, if there are fewer);
* distance: (x - cx)^2 + (y - cy)^2 in doubles; of equally near centres the first wins;
* new centre: coordinates are summed exactly in units of 1e-10 degrees, so the result
  depends neither on partitions nor on the order in which sums arrive;
* a centre that no point is near to stays where it is.

Points without both coordinates belong to no cluster.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homerange.operators.circles import z_order
from homerange.session import ship

# Fixed values of the analysis: six clusters, seed 1986, up to 1000 rounds.
K = 6
SEED = 1986
MAX_ITER = 1000

POINT = ("longitude_Centroid", "latitude_Centroid")
#: Drawn points that starts are picked from.
START_POINTS = 1000
#: Whole units of a coordinate, as in :func:`homerange.functions.exact_mean`.
UNITS = 1e10
#: Points between two partial sums of a task: 180 degrees in units, a million times, fit
#: a 64-bit integer.
SUM_ROWS = 1_000_000
#: Points that share a box, and points that a task looks at together.
BLOCK, HELD_ROWS = 32, 64_000

#: k -> coordinates of its centres, one row each.
Centres = dict[int, np.ndarray]


def _points(users: DataFrame, cols, key: str) -> DataFrame:
    x, y = (F.col(f"`{c}`").cast("double") for c in cols)
    points = users.select(F.col(f"`{key}`").alias("id"), x.alias("x"), y.alias("y"))
    return points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def starts(points: DataFrame, ks: Iterable[int], seed: int) -> Centres:
    """The first centres of every k; the drawn points only reach the driver."""
    draw = F.md5(F.concat_ws("#", F.col("id").cast("string"), F.lit(str(seed))))
    drawn = points.groupBy("x", "y").agg(F.min(draw).alias("draw")).orderBy("draw", "x", "y").limit(START_POINTS)
    held = np.array([(r["x"], r["y"]) for r in drawn.collect()], dtype=np.float64).reshape(-1, 2)
    picked, far = [], np.full(len(held), np.inf)
    while len(picked) < max(ks) and len(held) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        dx, dy = held[:, 0] - held[picked[-1], 0], held[:, 1] - held[picked[-1], 1]
        far = np.minimum(far, dx * dx + dy * dy)
    return {k: held[picked[:k]] for k in ks}


def _dealt(points: DataFrame) -> DataFrame:
    """Points dealt over the cores, near ones together, and held in memory."""
    parts = max(points.sparkSession.sparkContext.defaultParallelism, points.rdd.getNumPartitions())
    order = [z_order(F.col("x"), F.col("y"), 30), F.col("id")]
    return points.repartitionByRange(parts, *order).sortWithinPartitions(*order).persist(StorageLevel.MEMORY_AND_DISK)


class _Blocks:
    """Points in rows of :data:`BLOCK`, the last row filled up with its last point."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rows = len(x)
        wide = -(-self.rows // BLOCK) * BLOCK
        self.x, self.y = (np.concatenate([v, np.full(wide - self.rows, v[-1])]).reshape(-1, BLOCK) for v in (x, y))
        self.low, self.high = (np.stack([f(v, axis=1) for v in (self.x, self.y)]) for f in (np.min, np.max))
        self.real = (np.arange(wide) < self.rows).reshape(-1, BLOCK)

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The only possible centre of each block, or -1; the numbers of the other blocks; for their
        points the nearest centre (the first of equals) and the squared distance."""
        near = far = 0.0
        for a in (0, 1):
            c = centres[:, a]
            below, above = self.low[a][:, None] - c, c - self.high[a][:, None]
            gap, reach = np.maximum(np.maximum(below, above), 0.0), np.maximum(np.abs(below), np.abs(above))
            near, far = near + gap * gap, far + reach * reach
        possible = near <= far.min(axis=1)[:, None]
        many = possible.sum(axis=1)
        whole = np.where(many == 1, possible.argmax(axis=1), -1)
        mixed = np.flatnonzero(many > 1)
        of, c = np.nonzero(possible[mixed])
        rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(mixed)))[of]
        best = np.full((len(mixed), BLOCK), np.inf)
        which = np.zeros((len(mixed), BLOCK), np.int64)
        for r in range(int(many.max()) if len(mixed) else 0):
            at, to = of[rank == r], c[rank == r]
            dx = self.x[mixed[at]] - centres[to, 0][:, None]
            dy = self.y[mixed[at]] - centres[to, 1][:, None]
            d = dx * dx + dy * dy
            nearer = d < best[at]
            best[at] = np.where(nearer, d, best[at])
            which[at] = np.where(nearer, to[:, None], which[at])
        return whole, mixed, which, best


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[_Blocks]:
    """The points of a task, up to :data:`HELD_ROWS` and a batch at a time."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in some) >= HELD_ROWS:
            yield _Blocks(*(np.concatenate([b.column(a).to_numpy(zero_copy_only=False) for b in some]) for a in (0, 1)))
            some = []
    if some:
        yield _Blocks(*(np.concatenate([b.column(a).to_numpy(zero_copy_only=False) for b in some]) for a in (0, 1)))


def _names(centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """k and cluster of every centre, in order."""
    k = np.concatenate([np.full(len(c), k, np.int32) for k, c in centres.items()])
    return k, np.concatenate([np.arange(len(c), dtype=np.int32) for c in centres.values()])


def _round(points: DataFrame, centres: Centres) -> list:
    """Rows (k, cluster, n, sx, sy) over all points: one scan for all k."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> dict:
            return {k: [np.zeros(len(c), np.int64) for _ in range(3)] for k, c in centres.items()}

        def pack(sums: dict) -> pa.RecordBatch:
            whole = [np.concatenate([s[i] for s in sums.values()]) for i in range(3)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (*_names(centres), *whole)], names=["k", "cluster", "n", "sx", "sy"]
            )

        sums, rows = fresh(), 0
        for blocks in _held(batches):
            # half away from zero, as Spark and SQL round
            units = [
                np.where(blocks.real, np.copysign(np.floor(np.abs(v * UNITS) + 0.5), v), 0.0).astype(np.int64)
                for v in (blocks.x, blocks.y)
            ]
            each = [blocks.real.astype(np.int64), *units]
            total = [v.sum(axis=1) for v in each]
            for k, c in centres.items():
                whole, mixed, which, _ = blocks.nearest(c)
                sure = np.flatnonzero(whole >= 0)
                for s, of_points, of_blocks in zip(sums[k], each, total):
                    np.add.at(s, whole[sure], of_blocks[sure])
                    np.add.at(s, which.ravel(), of_points[mixed].ravel())
            rows += blocks.rows
            if rows >= SUM_ROWS:
                yield pack(sums)
                sums, rows = fresh(), 0
        if rows:
            yield pack(sums)

    parts = points.select("x", "y").mapInArrow(partial, "k int, cluster int, n long, sx long, sy long")
    exact = "decimal(38,0)"
    return parts.groupBy("k", "cluster").agg(*[F.sum(F.col(c).cast(exact)).alias(c) for c in ("n", "sx", "sy")]).collect()


def _costs(points: DataFrame, centres: Centres) -> dict[int, float]:
    """Sum of the squared distances to the nearest centres, per k: one scan for all k."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _held(batches):
            cost = []
            for c in centres.values():
                whole, mixed, _, best = blocks.nearest(c)
                sure = np.flatnonzero(whole >= 0)
                dx = blocks.x[sure] - c[whole[sure], 0][:, None]
                dy = blocks.y[sure] - c[whole[sure], 1][:, None]
                cost.append((dx * dx + dy * dy)[blocks.real[sure]].sum() + best[blocks.real[mixed]].sum())
            ks = pa.array(np.array(list(centres), np.int32))
            yield pa.RecordBatch.from_arrays([ks, pa.array(np.array(cost, np.float64))], names=["k", "cost"])

    parts = points.select("x", "y").mapInArrow(partial, "k int, cost double")
    return {r["k"]: r["cost"] for r in parts.groupBy("k").agg(F.sum("cost").alias("cost")).collect()}


def fixed_point(points: DataFrame, ks: Iterable[int], seed: int, max_iter: int) -> tuple[Centres, dict[int, float]]:
    """Centres and cost of every k after at most ``max_iter`` rounds. Centres only (their
    number is the sum of the k) pass through the driver. A k that still moves after the
    last round gives a warning."""
    ship(points.sparkSession)
    ks = sorted(set(ks))
    moving, done = starts(points, ks, seed), {}
    if not moving or not len(moving[ks[0]]):
        return {k: np.zeros((0, 2)) for k in ks}, {}
    for turn in range(max_iter + 1):
        after = {k: c.copy() for k, c in moving.items()}
        for r in _round(points, moving):
            if r["n"]:
                n = float(r["n"])
                after[r["k"]][r["cluster"]] = (float(r["sx"]) / UNITS / n, float(r["sy"]) / UNITS / n)
        still = {k for k, c in after.items() if not np.array_equal(c, moving[k])}
        done |= {k: c for k, c in moving.items() if k not in still or turn == max_iter}
        if turn == max_iter:
            for k in sorted(still):
                warnings.warn(f"k-means with k = {k} has not converged in {max_iter} rounds", stacklevel=3)
        moving = {k: after[k] for k in sorted(still)}
        if not moving or turn == max_iter:
            break
    return done, _costs(points, done)


def cluster_users(
    users: DataFrame, k: int = K, seed: int = SEED, max_iter: int = MAX_ITER, cols=POINT, key: str = "user_id"
) -> DataFrame:
    """Each user with its centroid and its cluster, 0 to k - 1 in the order of the
    starts. The assignment is one expression over the k centres."""
    points = _dealt(_points(users, cols, key))
    try:
        centres, _ = fixed_point(points, [k], seed, max_iter)
    finally:
        points.unpersist()
    x, y = (F.col(f"`{c}`").cast("double") for c in cols)
    placed = users.filter(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    far = [
        F.struct(((x - F.lit(cx)) * (x - F.lit(cx)) + (y - F.lit(cy)) * (y - F.lit(cy))).alias("d"), F.lit(c).alias("c"))
        for c, (cx, cy) in enumerate(centres[k].tolist())
    ]
    nearest = F.array_min(F.array(*far))["c"] if far else F.lit(None).cast("int")
    return placed.select(key, *cols, nearest.alias("cluster"))


def total_sse(users: DataFrame, cols=POINT) -> DataFrame:
    """Within-group sum of squares of a single cluster,
    (n - 1) * sum of the column variances. One row (k = 1, wss)."""
    n = F.count(F.lit(1))
    var_sum = sum((F.var_samp(c) for c in cols), F.lit(0.0))
    return users.agg((F.lit(1)).alias("k"), ((n - 1) * var_sum).alias("wss"))


def elbow(
    users: DataFrame,
    ks: Iterable[int] = range(2, 51),
    seed: int = SEED,
    max_iter: int = MAX_ITER,
    cols=POINT,
    key: str = "user_id",
) -> DataFrame:
    """Within-cluster sum of squares for each k (k = 1 from :func:`total_sse`). All k
    share each scan of the points; only centres and costs come back."""
    points = _dealt(_points(users, cols, key))
    try:
        _, cost = fixed_point(points, [k for k in ks if k >= 2], seed, max_iter)
    finally:
        points.unpersist()
    spark = SparkSession.getActiveSession() or users.sparkSession
    fitted = spark.createDataFrame(sorted(cost.items()), "k int, wss double")
    return total_sse(users, cols).unionByName(fitted)
