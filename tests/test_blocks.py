"""K-means rounds by blocks of near points: the centres of a point-by-point round, with less work."""

import random

import numpy as np

from homerange.operators import clusters


def test_blocks_find_the_first_nearest_centre_of_every_point():
    rng = np.random.default_rng(5)
    grid = rng.integers(-8, 8, (5000, 2)) * 0.25  # many equal distances
    free = rng.normal(0, 40, (4001, 2))
    for points in (grid, free, grid[:1], np.zeros((70, 2))):
        for order in (np.lexsort(points.T), np.arange(len(points))):
            x, y = points[order].T
            blocks = clusters._Blocks(x.copy(), y.copy())
            centres = np.concatenate([points[:: max(1, len(points) // 40)], rng.integers(-8, 8, (9, 2)) * 0.125])
            whole, mixed, which, best = blocks.nearest(centres)
            got = np.repeat(whole[:, None], clusters.BLOCK, axis=1)
            got[mixed] = which
            d = (x[:, None] - centres[:, 0]) ** 2 + (y[:, None] - centres[:, 1]) ** 2
            assert (got[blocks.real] == d.argmin(axis=1)).all()
            assert (best[blocks.real[mixed]] == d.min(axis=1)[np.isin(np.arange(len(x)) // clusters.BLOCK, mixed)]).all()


def test_most_points_meet_no_centre_and_every_core_has_points(spark):
    """a round's work must not be every point against every centre, nor one task's."""
    rng = random.Random(8)
    rows = [(i, rng.uniform(-112.0, -111.8), rng.uniform(33.3, 33.5)) for i in range(60_000)]
    one = spark.createDataFrame(rows, "user_id long, longitude_Centroid double, latitude_Centroid double").coalesce(1)
    points = clusters._dealt(clusters._points(one, clusters.POINT, "user_id"))
    sizes = [n for n in points.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 3 * len(rows) / len(sizes)
    held = points.select("x", "y").toPandas()
    points.unpersist()
    blocks = clusters._Blocks(held.x.to_numpy(), held.y.to_numpy())
    centres = np.array([(-112.0 + 0.2 * rng.random(), 33.3 + 0.2 * rng.random()) for _ in range(20)])
    whole, mixed, _, _ = blocks.nearest(centres)
    assert len(mixed) < 0.5 * len(whole)
