"""Trees of a two-class forest from counted cells instead of rows.

Trees see a row only through the bin of each of its features. Rows with equal bins are one
*cell*; a tree needs no more of them than how often each class was drawn. The draws of n
equal rows are one Poisson number of mean n, so cells give the same forest as their rows,
at a cost that follows the number of cells. Spark counts the cells, deals the trees over the
tasks and sums their votes; a task grows its trees a level at a time, all nodes of a level
in one pass, and every cell walks down with them, so no tree is kept.

A tree is what Spark's forest grows: Gini gain, nominal values in the order of their draws
of the last class in the node, a node with no gain is a leaf, a pair of leaves of one
prediction becomes one leaf, and a leaf votes with its share of each class. Draws and the
features tried at a node are functions of seed, tree and place in the tree, so neither
partitions nor retries change a vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homerange.session import ship

#: Whole units of a vote: sums of votes are exact.
UNITS = 1e12
#: Entries (tree, cell) that a task holds at a time, if a single tree has no more.
ENTRIES = 200_000


@dataclass(frozen=True)
class Cells:
    """The bins of each cell (cells x features), which features are nominal, and per bag the
    counted training rows: (cell, draws a row counts for, rows of class 0, rows of class 1)."""

    bins: np.ndarray
    nominal: np.ndarray
    bags: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(a + b, 1e-300)
    return 1.0 - (a / n) * (a / n) - (b / n) * (b / n)


def _best_cuts(node, bins, w0, w1, nodes: int, nominal: np.ndarray, width: int):
    """Best cut of every node by one feature each: its gain (-1 without a cut) and, per entry,
    whether it goes left. ``nominal`` tells it per node."""
    key = node * width + bins
    drawn = np.flatnonzero(w0 + w1 > 0)
    groups, at = np.unique(key[drawn], return_inverse=True)
    g0, g1 = np.bincount(at, w0[drawn], len(groups)), np.bincount(at, w1[drawn], len(groups))
    of = groups // width
    # values of a nominal feature in the order of their draws of the last class, others in their own
    order = np.lexsort((groups, np.where(nominal[of], g1, 0.0), of))
    l0, l1, of = g0[order], g1[order], of[order]
    first = np.searchsorted(of, np.arange(nodes))
    last = np.append(first[1:], len(of)) - 1
    c0, c1 = np.cumsum(l0), np.cumsum(l1)
    b0, b1 = (c0 - l0)[first], (c1 - l1)[first]  # every node has drawn rows
    t0, t1 = c0[last] - b0, c1[last] - b1
    l0, l1 = c0 - b0[of], c1 - b1[of]
    r0, r1 = t0[of] - l0, t1[of] - l1
    n = t0[of] + t1[of]
    gain = _gini(t0, t1)[of] - (l0 + l1) / n * _gini(l0, l1) - (r0 + r1) / n * _gini(r0, r1)
    gain[last] = -1.0  # all to the left is no cut
    best = np.maximum.reduceat(gain, first)
    place = np.arange(len(of))
    cut = np.minimum.reduceat(np.where(gain == best[of], place, len(of)), first)
    rank = np.empty(len(of), np.int64)
    rank[order] = place
    # values that the node has not drawn go right; numbers go by the cut's last bin on the left
    found = np.minimum(np.searchsorted(groups, key), len(groups) - 1)
    among = (groups[found] == key) & (rank[found] <= cut[node])
    return best, np.where(nominal[node], among, key <= groups[order][cut[node]])


def grow(cells: Cells, trees: np.ndarray, bag: int, seed: int, tried: int, max_depth: int) -> np.ndarray:
    """Votes (cells x 2, in units) of ``trees`` drawn from ``bag``, on every cell."""
    count, features = cells.bins.shape
    width = int(cells.bins.max(initial=0)) + 1
    cell, weight, n0, n1 = cells.bags[bag]
    draws = []
    for t in trees.tolist():
        rng = np.random.default_rng([seed, t])
        draws.append([np.bincount(cell, weight * rng.poisson(n), count) for n in (n0, n1)])
    w0, w1 = (np.concatenate([d[c] for d in draws]) for c in (0, 1))
    of_cell = np.tile(np.arange(count), len(trees))
    node = np.repeat(np.arange(len(trees)), count)
    place = _mixed(trees.astype(np.uint64) + _mixed(np.array([seed], np.uint64)))
    entry = np.arange(len(node))
    leaf = np.empty(len(node), np.int64)  # the node of all levels where an entry ends
    salt = _mixed(np.arange(features, dtype=np.uint64))
    levels, offset = [], 0
    for depth in range(max_depth + 1):
        nodes = len(place)
        s0, s1 = np.bincount(node, w0, nodes), np.bincount(node, w1, nodes)
        split = (s0 > 0) & (s1 > 0) & (depth < max_depth)
        best, left = np.zeros(nodes), np.zeros(len(node), bool)
        if split.any():
            number = np.cumsum(split) - 1
            open_ = np.flatnonzero(split[node])
            mine, b = number[node[open_]], cells.bins[of_cell[open_]]
            some = np.argsort(_mixed(place[split][:, None] ^ salt), axis=1, kind="stable")[:, :tried]
            top, goes = np.zeros(split.sum()), np.zeros(len(open_), bool)
            for j in range(some.shape[1]):
                feature = some[:, j]
                gain, to_left = _best_cuts(
                    mine, b[np.arange(len(mine)), feature[mine]].astype(np.int64), w0[open_], w1[open_], len(top), cells.nominal[feature], width
                )
                better = gain > top
                top = np.where(better, gain, top)
                goes = np.where(better[mine], to_left, goes)
            best[split], left[open_] = top, goes
        inner = best > 0
        number = np.cumsum(inner) - 1
        ends = ~inner[node]
        leaf[entry[ends]] = offset + node[ends]
        # (class counts, is it inner, number of its pair of children)
        levels.append((s0, s1, inner, number))
        on = ~ends
        child = 2 * number[node[on]] + np.where(left[on], 0, 1)
        place = _mixed((place[inner][:, None] << np.uint64(1)) ^ np.array([[0, 1]], np.uint64)).ravel()
        entry, of_cell, w0, w1, node = entry[on], of_cell[on], w0[on], w1[on], child
        offset += nodes
        if not len(place):
            break
    share = _leaf_shares(levels)[leaf]
    return np.rint(share * UNITS).astype(np.int64).reshape(len(trees), count, 2).sum(axis=0)


def _leaf_shares(levels: list) -> np.ndarray:
    """Class shares that each node of all levels votes with; where all leaves below a node have
    one prediction, that node's."""
    one, merged = np.zeros(0, np.int64), []  # the only prediction below each node, or -1
    for s0, s1, inner, _ in reversed(levels):
        own = (s1 > s0).astype(np.int64)
        both = np.where(one[0::2] == one[1::2], one[0::2], -1)
        own[inner] = both
        one = own
        merged.append(one >= 0)
    shares, above = [], None
    for (s0, s1, inner, _), whole in zip(levels, reversed(merged)):
        n = np.maximum(s0 + s1, 1e-300)
        mine = np.stack([s0 / n, s1 / n], axis=1)
        if above is not None:
            told, done = above
            mine = np.where(done[:, None], told, mine)
            whole = whole | done
        shares.append(mine)
        above = np.repeat(mine[inner], 2, axis=0), np.repeat(whole[inner], 2)
    return np.concatenate(shares)


def forest_votes(
    spark: SparkSession, cells: Cells, num_trees: int, bag_trees: int, seed: int, tried: int, max_depth: int
) -> DataFrame:
    """(bag, cell, v0, v1): the votes of all trees on every cell, in whole units; tree t is of
    bag ``t // bag_trees``. Trees are dealt over the tasks."""
    ship(spark)
    held = spark.sparkContext.broadcast(cells)
    parallel = spark.sparkContext.defaultParallelism
    at_once = max(1, min(bag_trees, ENTRIES // max(1, len(cells.bins)), num_trees // (4 * parallel)))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = held.value, {}
        for batch in batches:
            for bag, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trees = np.arange(start, min(start + at_once, (bag + 1) * bag_trees, num_trees))
                votes = grow(own, trees, bag, seed, tried, max_depth)
                sums[bag] = sums[bag] + votes if bag in sums else votes
        for bag, v in sums.items():
            n = len(v)
            columns = [pa.array(np.full(n, bag, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v[:, 0]), pa.array(v[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["bag", "cell", "v0", "v1"])

    bags = -(-num_trees // bag_trees)
    each = -(-bag_trees // at_once)
    tasks = min(bags * each, 4 * parallel)
    i = F.col("id")
    bag = F.floor(i / each).cast("int")
    start = bag * bag_trees + (i % each).cast("int") * at_once
    pieces = spark.range(0, bags * each, 1, tasks).select(bag.alias("bag"), start.alias("start")).filter(start < num_trees)
    votes = pieces.mapInArrow(grown, "bag int, cell int, v0 long, v1 long")
    return votes.groupBy("bag", "cell").agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
