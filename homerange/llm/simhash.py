"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of every run of four words; a bit is set if it is set
in over half of the hashes. Two fingerprints link at ``max_distance`` or fewer
differing bits.

Search. The 64 bits are cut into blocks; two fingerprints that differ in at most d
bits agree on some choice of (blocks - d) blocks. So the top nodes of the index are
the masked patterns of these choices: fingerprints with one pattern meet in one
bucket, and no link is lost. Within a bucket they are sorted by Gray rank, runs of
neighbours share a node that holds the bits all of them have in common, runs of nodes
share a node above, and so on. Two nodes are compared on the bits both hold; the
differences accumulate down the levels (each level adds only the bits it newly
shares), and a pair of nodes over the limit is dropped with everything below it.

Scale. Equal fingerprints are collapsed before anything is shuffled. More, smaller
buckets are made as fingerprints grow in number; a bucket of more than ``slice_rows``
is cut into slices that meet pair by pair. A task returns only a spanning forest of
its links, never the pairs, and the components are found by distributed rounds.

Defined results. A null text is an empty text; texts without words have fingerprint
zero, linked like any other. Repeated rows get the same component. component_id is
the smallest non-null id that can be reached, null if there is none. An empty table
gives an empty table. Other columns are not read by :func:`near_duplicates`;
:func:`keep_one` returns the rows of its input unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import append_columns, read, ship
from homerange.llm.components import components
from homerange.session import materialize

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
ALL = np.uint64(2**64 - 1)
FANOUT = 8
#: Rows that a search holds at a time, and node pairs it opens at a time.
CHUNK_ROWS, CHUNK_PAIRS = 100_000, 30_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (its columns ``keep``, if given) with simhash, the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([T.StructField("simhash", T.LongType())])

    def make():
        def fn(texts):
            found = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64)
            return [found.view(np.int64)]

        return fn

    return append_columns(docs, F.col(f"`{text_col}`").cast("string"), make, schema, keep)


def bucket_masks(n: int, max_distance: int, rows_wanted: int = 512) -> list[int]:
    """Masks such that any two words of 64 bits within ``max_distance`` agree under
    at least one; more and longer ones for more fingerprints."""
    for blocks in range(max_distance + 1, 65):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
        bits = 64 * (blocks - max_distance) // blocks
        if n / 2.0**bits <= rows_wanted or blocks >= max_distance + 4:
            return [sum(c) for c in combinations(parts, blocks - max_distance)]
    raise ValueError("max_distance must be under 64")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the order of the reflected Gray code."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank). A node holds
    the bits all its fingerprints share (``mask``) and their values (``bits``)."""

    def __init__(self, bucket: np.ndarray, prints: np.ndarray):
        self.prints = prints
        self.mask = [np.full(len(prints), ALL, dtype=np.uint64)]
        self.bits = [prints]
        self.first: list[np.ndarray] = []  # first[k]: where the nodes of level k + 1 begin in level k
        owner = bucket
        while True:
            n = len(owner)
            new = np.append(True, owner[1:] != owner[:-1]) if n else np.zeros(0, dtype=bool)
            if n == 0 or (self.first and new.all()):
                break
            start_of = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(start_of, np.diff(np.append(start_of, n)))
            first = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(self.bits[-1], first)
            either = np.bitwise_or.reduceat(self.bits[-1], first)
            mask = np.bitwise_and.reduceat(self.mask[-1], first) & ~(both ^ either)
            self.first.append(first)
            self.mask.append(mask)
            self.bits.append(both & mask)
            owner = owner[first]
        self.tops = len(owner)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of ``level``."""
        first = self.first[level - 1]
        end = np.append(first[1:], len(self.bits[level - 1]))
        return first[nodes], end[nodes] - first[nodes]

    def close_pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket within ``limit`` bits, in bounded portions."""
        if not self.tops:
            return
        top = len(self.first)
        x = np.arange(self.tops)
        todo = [(top, x, x, np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.uint64))]
        while todo:
            level, x, y, differ, seen = todo.pop()
            if len(x) > CHUNK_PAIRS:
                todo += [
                    (level, x[a : a + CHUNK_PAIRS], y[a : a + CHUNK_PAIRS], differ[a : a + CHUNK_PAIRS], seen[a : a + CHUNK_PAIRS])
                    for a in range(0, len(x), CHUNK_PAIRS)
                ]
                continue
            shared = self.mask[level][x] & self.mask[level][y]
            fresh = (self.bits[level][x] ^ self.bits[level][y]) & shared & ~seen
            differ = differ + np.bitwise_count(fresh)
            near = differ <= limit
            x, y, differ, shared = x[near], y[near], differ[near], shared[near]
            if level == 0:
                if len(x):
                    yield x, y
                continue
            ax, nx = self.children(level, x)
            ay, ny = self.children(level, y)
            pairs = nx * ny
            of = np.repeat(np.arange(len(x)), pairs)
            k = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            cx, cy = ax[of] + k // ny[of], ay[of] + k % ny[of]
            keep = cx < cy if level == 1 else cx <= cy  # each pair once; a row is no pair with itself
            todo.append((level - 1, cx[keep], cy[keep], differ[of][keep], shared[of][keep]))


def forest(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's component under the given pairs."""
    label = np.arange(n)
    for x, y in portions:
        while True:
            low = np.minimum(label[x], label[y])
            high = np.maximum(label[x], label[y])
            if (low == high).all():
                break
            np.minimum.at(label, high, low)  # hook roots to smaller ones
            while (label[label] != label).any():
                label = label[label]
    return label


def _search(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive in order: rows of (bucket key..., simhash)."""
    held: list[pa.Table] = []
    rows = 0

    def solve(t: pa.Table) -> pa.RecordBatch:
        prints = t.column("simhash").to_numpy().view(np.uint64)
        keys = [t.column(c).to_numpy() for c in ("choice", "pattern", "i", "j")]
        same = np.ones(max(t.num_rows - 1, 0), dtype=bool)
        for c in keys:
            same &= c[1:] == c[:-1]
        bucket = np.cumsum(np.append(0, ~same))[: t.num_rows]
        order = np.lexsort((gray_rank(prints), bucket))
        prints = prints[order]
        label = forest(len(prints), GrayIndex(bucket, prints).close_pairs(limit))
        linked = np.flatnonzero(label != np.arange(len(label)))
        ends = [prints[linked].view(np.int64), prints[label[linked]].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            t = pa.concat_tables(held).combine_chunks()
            # the last bucket may go on in the next batch
            cut = t.num_rows - 1
            last = [t.column(c)[cut].as_py() for c in ("choice", "pattern", "i", "j")]
            while cut and [t.column(c)[cut - 1].as_py() for c in ("choice", "pattern", "i", "j")] == last:
                cut -= 1
            if cut:
                yield solve(t.slice(0, cut))
            held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield solve(pa.concat_tables(held).combine_chunks())


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, slice_rows: int = 1024) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column
    simhash) in every bucket."""
    ship(prints.sparkSession)
    masks = bucket_masks(prints.count(), max_distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("choice"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("pattern"))
            for k, m in enumerate(signed)
        ]
    )
    rows = prints.select("simhash", F.explode(keys).alias("key")).select("simhash", "key.*")
    sizes = rows.groupBy("choice", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    met = (
        rows.join(sizes, ["choice", "pattern"])
        .withColumn("s", F.pmod(F.xxhash64("simhash"), slices).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), slices - 1)))
        .select("choice", "pattern", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "simhash")
    )
    key = ["choice", "pattern", "i", "j"]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    dealt = met.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(lambda it: _search(it, max_distance), schema)


def classes(prints: DataFrame, id_col: str, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(simhash, component_id) of every distinct fingerprint in ``prints`` (columns
    id and simhash)."""
    distinct = materialize(prints.groupBy("simhash").agg(F.min(id_col).alias("first_id")), "fingerprints")
    roots = components(links(distinct.select("simhash"), max_distance), "a", "b")
    roots = roots.select(F.col("node").alias("simhash"), "root")
    rooted = distinct.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("simhash", "root").join(lowest, "root").select("simhash", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(fingerprints(frame, "text", shingle_words, keep=["id"]), "simhash")
    found = classes(prints, "id", max_distance)
    return prints.join(found, "simhash").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The row with the smallest id of each class, as it is in ``docs``. Of rows with
    one id and class, one stays."""
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = materialize(fingerprints(frame, "text", shingle_words, keep=["id"]), "simhash")
    found = classes(prints, "id", max_distance)
    placed = prints.join(found, "simhash").withColumn("first", F.col("id").eqNullSafe(F.col("component_id")))
    # n: all rows of the id, so that one that comes more than once is settled row by row
    per_id = placed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first"))
    stays = materialize(per_id.filter("first").select("id", "n"), "kept")
    once = stays.filter("id is not null and n = 1").select(F.col("id").alias(id_col))
    kept = docs.join(once, id_col, "left_semi")
    again = stays.filter("id is not null and n > 1").select(F.col("id").alias(id_col))
    if again.limit(1).count():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = docs.join(again, id_col, "left_semi").select(whole)
        rows = rows.select("row", F.col("row")[text_col].alias("text"))
        rows = fingerprints(rows, "text", shingle_words, keep=["row"]).join(found, "simhash")
        rows = rows.withColumn("id", F.col("row")[id_col]).filter(F.col("id") == F.col("component_id"))
        kept = kept.unionByName(rows.dropDuplicates(["id", "root"]).select("row.*"))
    nameless = stays.filter("id is null").limit(1).count()
    if nameless:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        lost = docs.filter(F.col(f"`{id_col}`").isNull()).select(row)
        lost = lost.select("row", F.col("row")[text_col].alias("text"))
        only = found.filter("component_id is null").select("simhash", "root")
        extra = fingerprints(lost, "text", shingle_words, keep=["row"]).join(only, "simhash").dropDuplicates(["root"])
        kept = kept.unionByName(extra.select("row.*"))
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and near-duplicate class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
