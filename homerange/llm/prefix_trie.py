"""Conversation prefix trie: member intervals by range minima over sorted LCPs.

Every conversation is the sequence of its turns' digests. All conversations are sorted
by sequence (range partitioned, so a hot prefix spans as many blocks as it needs); the
members of a trie node are then an interval, and neighbours' longest common prefixes
(LCPs) say where it ends. In each block a sparse table of LCP minima is built, and every
candidate prefix (the depths at which a row leaves its predecessor) finds the ends of
its interval by a binary search of its own, to the right for its members, to the left
for its parent. No stack, no order among candidates: whole arrays at a time.

What a node reports are sums over its interval. ``saved`` needs no tree either: with
bytes counted along each member, the sum of (members - 1) x bytes over a subtree is the
bytes of all members below the node less the bytes of the subtree's distinct nodes.

A prefix that spans blocks leaves a piece in each of them; a block knows the last row
before and the first row behind it, so pieces add up exactly. They are at most one per
block and depth shared with a neighbour, and are merged by key as a stream (the ids of
an end group come in chunks, in order), so neither a hot prefix nor a large group of
copies is held in memory. SHA-256 of such a group's ids is sequential by definition.

Defined results. A null role or text is empty. Turns are ordered by turn (null first),
equal turns by the digest of role and text. Repeated rows are turns of their own. Rows
with a null conversation id belong to no conversation and are left out. Conversations
without turns are members of the root only. An empty table has no members, so no root
and no rows. Columns other than the four named are not read. A conversation is one row
of 20 bytes a turn (its texts do not travel).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homerange.llm.common import read, ship
from homerange.llm.conversation_repair import crc32_sql
from homerange.session import discard, materialize

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids of an end group in one row of a piece.
CHUNK_IDS = 10_000

_OUT = (
    "key binary, block int, chunk int, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
)
_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, steps) of every conversation; a step is (digest, bytes of its text)."""
    role = F.coalesce(F.col(f"`{role_col}`"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    step = F.struct(F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), step.alias("step"))
    rows = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return rows.select("conv_id", F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["size"].alias("size"))).alias("steps"))


def rebuilt(found: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then
    c's own behind its first h; h = crc32(c) % 9."""
    base = found.select(F.col("conv_id").alias("base"), F.slice("steps", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    joined = own.join(base, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("steps", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, tail).alias("steps"))


class Minima:
    """Sparse table: minima of every run of 2**k values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of values[start..end], both included."""
        k = np.frexp((end - start + 1).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for level in np.unique(k):
            at = k == level
            row = self.rows[level]
            out[at] = np.minimum(row[start[at]], row[end[at] + 1 - (1 << int(level))])
        return out

    def right(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row of each interval: the largest r with values[i + 1..r] >= depth."""
        r, n = i.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            fits = r + (1 << k) < n
            fits[fits] = self.rows[k][r[fits] + 1] >= depth[fits]
            r[fits] += 1 << k
        return r

    def left(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row of each interval: the smallest l with values[l + 1..i] >= depth."""
        lo = i.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = lo - (1 << k) >= 0
            fits[fits] = self.rows[k][lo[fits] - (1 << k) + 1] >= depth[fits]
            lo[fits] -= 1 << k
        return lo


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two key arrays."""
    m = min(len(a), len(b))
    differs = np.flatnonzero((a[:m] != b[:m]).any(axis=1))
    return int(differs[0]) if len(differs) else m


def _prefixes(keys: np.ndarray, depth: int) -> list[bytes]:
    """Keys of the prefixes of 0..depth turns."""
    h, out = hashlib.sha256(), []
    out.append(h.digest())
    for d in range(depth):
        h.update(keys[d].tobytes())
        out.append(h.digest())
    return out


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of the lists of a column and their values end to end."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths))), lengths, lists.flatten()


def block_nodes(table: pa.Table, block: int) -> pa.Table:
    """Nodes and pieces of one block: its rows in order (kind 0), the last row before it
    (kind -1) and the first row behind it (kind 1), where there are such."""
    table = table.sort_by([("kind", "ascending"), ("pos", "ascending")])
    kind = table["kind"].to_numpy()
    offset, length, flat = _flat(table["keys"])
    raw = b"".join(flat.to_pylist())
    keys = np.frombuffer(raw, "<u8").reshape(-1, 2)
    first = int(np.searchsorted(kind, 0))
    n = int((kind == 0).sum())

    def path(row: int) -> np.ndarray:
        return keys[offset[row] : offset[row + 1]]

    before = _common(path(0), path(first)) if first else -1
    behind = _common(path(first + n - 1), path(first + n)) if first + n < len(kind) else -1
    first_path, last_path = path(first), path(first + n - 1)

    # own rows only from here on
    conv = table["conv_id"].to_numpy()[first : first + n].astype(np.int64)
    start, size = offset[first : first + n], length[first : first + n]
    sizes = table["sizes"].slice(first, n).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = start - start[0]
    keys = keys[offset[first] : offset[first + n]]
    held = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))

    def along(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the first ``depth`` turns of a row (none below 0)."""
        return held[start[row] + np.maximum(depth, 0)] - held[start[row]]

    # LCP of each row with the one before
    lcp = np.empty(n + 1, np.int64)
    lcp[0], lcp[n] = before, behind
    shared = np.minimum(size[1:], size[:-1])
    if shared.sum():
        ends = np.cumsum(shared)
        j = np.arange(ends[-1]) - np.repeat(ends - shared, shared)
        a, b = np.repeat(start[1:], shared) + j, np.repeat(start[:-1], shared) + j
        j[(keys[a] == keys[b]).all(axis=1)] = np.iinfo(np.int64).max
        some = shared > 0
        low = np.zeros(n - 1, np.int64)
        low[some] = np.minimum.reduceat(j, (ends - shared)[some])
        lcp[1:n] = np.minimum(low, shared)
    else:
        lcp[1:n] = 0
    inner = lcp[:n].copy()
    inner[0] = -1
    minima, least_id = Minima(inner), Minima(conv)

    # candidates: of each row the depths it does not share; of the first row all
    rows = np.arange(n)
    base = inner + 1
    many = size - base + 1
    many = np.maximum(many, 0)
    where = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))
    i = np.repeat(rows, many)
    d = np.arange(where[-1]) - np.repeat(where[:-1], many) + base[i]
    r = minima.right(i, d)
    begun = (i > 0) | (d > before)
    open_ = ~begun | ((r == n - 1) & (d <= behind))

    n_convs = r - i + 1
    smallest = least_id.least(i, r)
    leaf = np.concatenate((np.zeros(1, np.int64), np.cumsum(lcp[1:] < size)))
    whole = along(rows, size)
    new = whole - along(rows, lcp[:n])
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(whole)))
    fresh = np.concatenate((np.zeros(1, np.int64), np.cumsum(new)))
    distinct = fresh[r + 1] - fresh[i] - np.where(begun, along(i, d - 1) - along(i, lcp[i]), 0)
    saved = total[r + 1] - total[i] - n_convs * along(i, d - 1) - distinct

    inner_node = d > 0
    up = np.full(len(i), -1, np.int64)
    left = minima.left(i[inner_node], d[inner_node] - 1)
    up[inner_node] = where[left] + (d[inner_node] - 1 - base[left])
    children = np.bincount(up[inner_node & begun], minlength=len(i))

    # rows that end at a node: the run of equal rows that begins its interval
    same = np.zeros(n + 1, bool)
    same[1:n] = (lcp[1:n] == size[1:]) & (lcp[1:n] == size[:-1])
    run_end = np.append(np.flatnonzero(~same[1:]), n - 1)
    run_end = run_end[np.searchsorted(run_end, rows)]
    ends_here = d == size[i]

    paths = {False: _prefixes(first_path, before) if before >= 0 else [], True: _prefixes(last_path, behind) if behind >= 0 else []}

    def key_of(x: int) -> bytes:
        return paths[False][d[x]] if d[x] <= before and i[x] == 0 else paths[True][d[x]]

    out = {c.split()[0]: [] for c in _OUT.split(", ")}

    def put(x: int, key, chunk: int, sha, ends, lead: bool) -> None:
        parent = up[x]
        unknown = parent >= 0 and open_[parent]
        out["key"].append(key)
        out["block"].append(block)
        out["chunk"].append(chunk)
        out["parent_key"].append(key_of(parent) if unknown else None)
        out["conv_id"].append(int(smallest[x]))
        out["depth"].append(int(d[x]))
        out["parent_conv_id"].append(None if parent < 0 or unknown else int(smallest[parent]))
        out["n_convs"].append(int(n_convs[x]) if lead else 0)
        out["n_children"].append(int(children[x]) if lead else 0)
        out["n_leaves"].append(int(leaf[r[x] + 1] - leaf[i[x]]) if lead else 0)
        out["saved_tokens"].append(int(saved[x]) if lead else 0)
        out["ends_sha256"].append(sha)
        out["ends"].append(ends)

    for x in range(len(i)):
        ids = conv[i[x] : run_end[i[x]] + 1] if ends_here[x] else conv[:0]
        if not open_[x]:
            sha = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else NO_ENDS
            put(x, None, 0, sha, None, True)
            continue
        key = key_of(x)
        for chunk, at in enumerate(range(0, max(len(ids), 1), CHUNK_IDS)):
            put(x, key, chunk, None, ",".join(map(str, ids[at : at + CHUNK_IDS].tolist())).encode(), chunk == 0)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({c: pa.array(out[c], type=types[t]) for c, t in (f.split() for f in _OUT.split(", "))})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, block, chunk), one node each key."""
    names = ["key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
    now, h, any_ids, done = None, None, False, []

    def flush() -> None:
        now[-1] = h.hexdigest()
        done.append(tuple(now))

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names
        )

    for b in batches:
        columns = [b.column(c).to_pylist() for c in (*names[:-1], "ends")]
        for key, parent, conv, depth, n, kids, leaves, saved, ends in zip(*columns, strict=True):
            if now is None or now[0] != key:
                if now is not None:
                    flush()
                now, h, any_ids = [key, parent, conv, depth, 0, 0, 0, 0, None], hashlib.sha256(), False
            now[2] = min(now[2], conv)
            for at, value in zip(range(4, 8), (n, kids, leaves, saved), strict=True):
                now[at] += value
            if ends:
                h.update(b"," + ends if any_ids else ends)
                any_ids = True
        if len(done) > 1000:
            yield pack()
            done.clear()
    if now is not None:
        flush()
    if done:
        yield pack()


def trie(found: DataFrame, block_turns: int = 500_000) -> DataFrame:
    """All nodes of the trie of (conv_id, steps): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A block
    holds about ``block_turns`` turns."""
    spark = found.sparkSession
    ship(spark)
    held = materialize(
        found.select("conv_id", F.col("steps.key").alias("keys"), F.col("steps.size").alias("sizes")), "trie_rows"
    )
    work = held.agg(F.sum(F.size("keys") + F.lit(1)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(work) // block_turns))
    placed = held.repartitionByRange(blocks, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    placed = placed.withColumn("block", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    placed = materialize(placed, "trie_blocks")
    discard(held)
    # each block's first and last row; block numbers only (one a partition) reach the driver
    row = F.struct("pos", "conv_id", "keys", "sizes")
    edges = materialize(placed.groupBy("block").agg(F.min_by(row, "pos").alias("head"), F.max_by(row, "pos").alias("tail")), "trie_edges")
    numbers = sorted(r["block"] for r in edges.select("block").collect())
    pairs = list(zip(numbers, numbers[1:]))
    rows = placed.select("block", F.lit(0).alias("kind"), "pos", "conv_id", "keys", "sizes")
    if pairs:
        next_to = spark.createDataFrame(pairs, "a int, b int")
        after = edges.join(F.broadcast(next_to), F.col("block") == F.col("a")).select(F.col("b").alias("block"), F.lit(-1).alias("kind"), "tail.*")
        ahead = edges.join(F.broadcast(next_to), F.col("block") == F.col("b")).select(F.col("a").alias("block"), F.lit(1).alias("kind"), "head.*")
        rows = rows.unionByName(after).unionByName(ahead)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return block_nodes(table, int(key[0].as_py()))

    out = materialize(rows.groupBy("block").applyInArrow(run, _OUT), "trie_nodes")
    pieces = out.filter("key is not null").repartition("key").sortWithinPartitions("key", "block", "chunk")
    merged = materialize(pieces.mapInArrow(_merge, f"key binary, parent_key binary, {_NODE}"), "trie_spanning")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    settled = out.filter("key is null and parent_key is null").select(*columns)
    below = out.filter("key is null and parent_key is not null").select("parent_key", *[c for c in columns if c != "parent_conv_id"])
    below = below.unionByName(merged.drop("key"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return settled.unionByName(below.join(above, "parent_key", "left").select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the prefix trie of the rebuilt ``conversations``."""
    return trie(rebuilt(sequences(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))))


ORACLE_SQL = f"""WITH steps AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    strlen(coalesce(text, ''))::BIGINT AS b
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'b': b}} ORDER BY turn NULLS FIRST, k) AS s FROM steps GROUP BY conv_id),
cut AS (SELECT *, ({crc32_sql("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.s, 1, c.h), []), coalesce(list_slice(c.s, c.h + 1, len(c.s)), [])) AS s
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (
  SELECT conv_id, len(s) AS n, d, list_transform(list_slice(s, 1, d), lambda x: x.k) AS p, s[d].b AS b
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, coalesce(min(b), 0) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends
  FROM members GROUP BY d, p),
children AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT u AS d, list_slice(p, 1, u) AS p, sum(leaf)::BIGINT AS n_leaves, sum((n - 1) * b)::BIGINT AS saved
  FROM (SELECT x.*, unnest(range(x.d + 1)) AS u, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf
        FROM nodes x LEFT JOIN children c ON c.d = x.d AND c.p = x.p)
  GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs,
  coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves, s.saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below s ON s.d = x.d AND s.p = x.p
LEFT JOIN children c ON c.d = x.d AND c.p = x.p
LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = list_slice(x.p, 1, x.d - 1)"""
