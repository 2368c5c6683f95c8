"""Exact duplicate passages of at least ``min_bytes`` bytes, across documents.

A byte goes if it lies in a string of ``min_bytes`` bytes (a window) that also starts
in a document with a smaller id. All steps are exact; none looks at a prefix or a
sample.

1. Chunks. Texts are cut where a hash of the next 24 bytes hits a pattern, so equal
   passages are cut alike. A chunk with the bytes of the windows that start in it is
   looked up by its 128-bit digest: if a smaller document holds the same, all of its
   windows go at once. Copies of any number thus cost one row each and are searched
   no further; only the first document of each chunk's content keeps it *live*.
2. Anchors. In every window the smallest hash among its 24-byte strings names an
   anchor, so equal windows have an anchor in common. Anchors of live chunks that
   occur in one document only are dropped after an aggregation.
3. Index. The places of a shared anchor, each with the bytes a window around it can
   reach, are suffixes that start alike. Sorted by what follows, they form one
   interval; extending it to the left, byte by byte, splits it: the new order is a
   stable sort by the preceding bytes (the last column of the Burrows-Wheeler
   transform), level by level, and the runs of an interval that also agree on enough
   bytes to the right are the equal windows of that level. Intervals with one place
   left are closed at once; the extension stops where windows no longer reach the
   anchor. The smallest document of each run tells which windows go.

Defined results. A null text is an empty text (0 bytes, digest of the empty string).
Rows with the same id are one document as far as matches go: nothing is removed
between them. A row with a null id is left as it is and takes nothing from others.
An empty table gives an empty table. Other columns are not read by
:func:`removals`; :func:`cleaned` passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import append_columns, read, ship
from homerange.operators.skew import join_per_key
from homerange.session import materialize

MIN_BYTES = 50
#: Rows of one chunk or window that a join leaves in one task; more are split.
SPLIT_ROWS = 20_000
#: Bytes of an anchor, and one chunk in how many positions ends (a power of two).
ANCHOR, CHUNK = 24, 256
_MULTIPLIER = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a polynomial hash."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchor_hashes(b: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on (doubling the length
    each step)."""
    if len(b) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(b) - size + 1, dtype=np.uint64)
    for a in range(0, len(out), _BLOCK):  # blocks stay in the processor's cache
        part = b[a : a + _BLOCK + size - 1]
        level, done, power = part.astype(np.uint64) + np.uint64(1), 1, _MULTIPLIER
        total, covered = None, 0
        left = size
        while left:
            if left & 1:
                n = len(part) - size + 1
                piece = level[covered : covered + n]
                if total is None:
                    total = piece.copy()
                else:
                    total = total * np.uint64(power) + piece
                covered += done
            left >>= 1
            if left:
                level = level[: len(level) - done] * np.uint64(power) + level[done:]
                power = power * power % (1 << 64)
                done *= 2
        out[a : a + _BLOCK] = _mixed(total)
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """Minimum or maximum over each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchor_places(h: np.ndarray, min_bytes: int = MIN_BYTES) -> np.ndarray:
    """Whether each position is the smallest of some window's positions."""
    width = min_bytes - ANCHOR + 1
    if len(h) < width:
        return np.zeros(len(h), dtype=bool)
    low = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    reach = _slide(np.concatenate([pad, low, pad]), width, np.maximum)
    return h == reach


class Chunks:
    """The chunks of one text: ``starts`` and ``ends`` (of the windows' starts), and
    ``digest(k)`` of a chunk with all bytes of its windows."""

    def __init__(self, text: str | None, min_bytes: int):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.raw, self.bytes = raw, np.frombuffer(raw, dtype=np.uint8)
        self.min_bytes = min_bytes
        self.windows = max(len(raw) - min_bytes + 1, 0)
        self.hashes = anchor_hashes(self.bytes) if self.windows else np.zeros(0, dtype=np.uint64)
        cuts = np.flatnonzero((self.hashes[: self.windows] & np.uint64(CHUNK - 1)) == 0)
        bounds = np.concatenate([[0], cuts[cuts > 0], [self.windows]]) if self.windows else np.zeros(1, dtype=np.int64)
        self.starts, self.ends = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)

    def digests(self) -> list[bytes]:
        over, raw = self.min_bytes - 1, self.raw
        return [
            xxhash.xxh3_128_digest(raw[a : e + over])
            for a, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)
        ]


def _live_anchors(c: Chunks, live: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the live chunks' windows."""
    if not c.windows or not live:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    width = c.min_bytes - ANCHOR + 1
    if len(live) == len(c.starts):
        at = np.flatnonzero(anchor_places(c.hashes, c.min_bytes))
        return at, c.hashes[at]
    # runs of live chunks, each with all positions its windows can name
    parts = []
    order = np.sort(np.array(live))
    runs = np.split(order, np.flatnonzero(np.diff(order) > 1) + 1)
    for r in runs:
        a, e = int(c.starts[r[0]]), int(c.ends[r[-1]]) + width - 1
        parts.append(a + np.flatnonzero(anchor_places(c.hashes[a:e], c.min_bytes)))
    at = np.unique(np.concatenate(parts))
    return at, c.hashes[at]


def windows_held_before(
    doc: np.ndarray, left: list[bytes], right: list[bytes], min_bytes: int = MIN_BYTES
) -> np.ndarray:
    """For places of shared anchors: a number whose bit j is set if the window that
    starts j bytes before the anchor also starts in a document with a smaller id.
    ``left``: the bytes before the anchor, ``right``: the anchor and the bytes after."""
    side, n = min_bytes - ANCHOR, len(doc)
    removed = np.zeros(n, dtype=np.int64)
    if not n:
        return removed
    n_left = np.fromiter(map(len, left), dtype=np.int64, count=n)
    n_right = np.fromiter(map(len, right), dtype=np.int64, count=n)
    before = np.frombuffer(b"".join([x.rjust(side, b"\0") for x in left]), dtype=np.uint8).reshape(n, side)
    after = np.frombuffer(b"".join([x.ljust(min_bytes, b"\0") for x in right]), dtype=np.uint8).reshape(n, min_bytes)
    # the suffixes from the anchors on in order, and how many bytes neighbours share
    order = np.lexsort((n_right, after.view(f"S{min_bytes}").ravel()))
    same = after[order[1:]] == after[order[:-1]]
    shared = np.where(same.all(axis=1), min_bytes, same.argmin(axis=1))
    shared = np.minimum(shared, np.minimum(n_right[order[1:]], n_right[order[:-1]]))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    # breadth first: `now` lists the places in the order of the strings that start j
    # bytes before the anchors, `opens` marks where an interval begins
    now, opens = order, np.append(True, shared < ANCHOR)
    for j in range(side + 1):
        alone = opens & np.append(opens[1:], True)
        now, opens = now[~alone], opens[~alone]
        if not len(now):
            break
        # runs of an interval that agree on the rest of the window to the right
        run = np.cumsum(np.append(False, shared < min_bytes - j))[place[now]]
        starts = np.flatnonzero(opens | np.append(True, run[1:] != run[:-1]))
        lowest = np.minimum.reduceat(doc[now], starts)
        held = np.repeat(lowest, np.diff(np.append(starts, len(now)))) < doc[now]
        removed[now[held]] |= np.int64(1) << np.int64(j)
        if j == side:
            break
        # backward step: a stable sort by the preceding byte keeps each interval's
        # parts in order, which are the intervals of the next level
        interval = np.cumsum(opens)
        further = n_left[now] > j
        now, interval = now[further], interval[further]
        byte = before[now, side - 1 - j]
        step = np.argsort(byte, kind="stable")
        now, byte, interval = now[step], byte[step], interval[step]
        opens = np.append(True, (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1]))[: len(now)]
    return removed


_KEY = ["id", "print"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, text): rows with equal id and text share the key (id, print)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def _dead_chunks(frame: DataFrame, min_bytes: int) -> DataFrame:
    """(id, print, dead): the chunks (first and end of their windows' starts) whose windows
    a smaller document holds, all of them."""

    def make():
        def fn(texts):
            each = [Chunks(t, min_bytes) for t in texts]
            return [[c.digests() for c in each], [np.append(c.starts, c.ends[-1:]) for c in each]]

        return fn

    schema = _field(("digests", T.ArrayType(T.BinaryType())), ("bounds", T.ArrayType(T.LongType())))
    rows = append_columns(frame, F.col("text"), make, schema, keep=_KEY)
    rows = rows.select(*_KEY, "bounds", F.posexplode("digests").alias("k", "digest"))
    start, end = F.get("bounds", F.col("k")), F.get("bounds", F.col("k") + 1)
    chunks = materialize(rows.select(*_KEY, start.alias("start"), end.alias("end"), "digest"), "chunks")
    n = F.count(F.lit(1)).alias("n")
    first = chunks.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), n).filter("first < last")
    first = materialize(first.select("digest", "first", "n"), "first_chunks")
    dead = join_per_key(chunks, first, "digest", "n", "inner", SPLIT_ROWS).filter(F.col("id") > F.col("first"))
    return materialize(dead.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "end")).alias("dead")), "dead_chunks")


def _documents_of(docs: pa.Table, notes: pa.Table, min_bytes: int) -> Iterator[tuple[int, int, Chunks, np.ndarray, np.ndarray]]:
    """(id, print, chunks, positions, hashes) of the live anchors of a batch's texts."""
    dead: dict[tuple[int, int], list[dict]] = {}
    for i, p, gone in zip(*(notes.column(c).to_pylist() for c in (*_KEY, "dead")), strict=True):
        if gone is not None:
            dead[i, p] = gone
    ids, prints, texts = docs.column("id"), docs.column("print"), docs.column("text")
    for r in range(docs.num_rows):
        i, p = ids[r].as_py(), prints[r].as_py()
        c = Chunks(texts[r].as_py(), min_bytes)
        gone = {x["start"] for x in dead.get((i, p), ())}
        at, h = _live_anchors(c, [k for k, a in enumerate(c.starts.tolist()) if a not in gone])
        yield i, p, c, at, h


def _batch_hashes(docs: pa.Table, notes: pa.Table, min_bytes: int) -> pa.Table:
    """The anchors of a batch, once each, twice if two of its documents hold it."""
    hashes, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for i, _, _, _, h in _documents_of(docs, notes, min_bytes):
        u = np.unique(h)
        hashes.append(u)
        owners.append(np.full(len(u), i, dtype=np.int64))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    starts = np.flatnonzero(new)
    twice = owner[starts] != owner[np.append(starts[1:], len(h)) - 1] if len(h) else new
    out = np.concatenate([h[starts], h[starts][twice]])
    batch = docs.column("batch")[0].as_py() if docs.num_rows else 0
    return pa.table({"anchor": pa.array(out.view(np.int64)), "batch": pa.array(np.full(len(out), batch, dtype=np.int64))})


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, batch) in the order of the anchor, those whose anchor comes
    more than once."""
    held = np.zeros((2, 0), dtype=np.int64)
    ended = False
    it = iter(batches)
    while not ended:
        b = next(it, None)
        ended = b is None
        if b is not None:
            held = np.concatenate([held, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])], axis=1)
        anchor = held[0]
        # all but the last anchor's rows, which may go on
        cut = len(anchor) if ended else int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        done, held = held[:, :cut], held[:, cut:]
        if cut:
            a = done[0]
            equal = a[1:] == a[:-1]
            many = np.append(False, equal) | np.append(equal, False)
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in done], names=["anchor", "batch"])


def _places(docs: pa.Table, notes: pa.Table, min_bytes: int) -> pa.Table:
    """The places of the shared anchors in a batch, with the bytes around them."""
    lists = [np.frombuffer(x, dtype=np.uint64) for x in notes.column("anchors").to_pylist() if x]
    wanted = np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64)
    side = min_bytes - ANCHOR
    out: dict[str, list] = {c: [] for c in ("anchor", "id", "print", "at", "left", "right")}
    for i, p, c, at, h in _documents_of(docs, notes, min_bytes) if len(wanted) else ():
        hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
        here, raw = at[hit].tolist(), c.raw
        out["anchor"] += h[hit].view(np.int64).tolist()
        out["id"] += [i] * len(here)
        out["print"] += [p] * len(here)
        out["at"] += here
        out["left"] += [raw[max(a - side, 0) : a] for a in here]
        out["right"] += [raw[a : a + min_bytes] for a in here]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, type=k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def _index(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Places in the order of their anchor -> (id, print, at, removed)."""
    held, rows = [], 0

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc = t.column("id").to_numpy()
        removed = windows_held_before(doc, t.column("left").to_pylist(), t.column("right").to_pylist(), min_bytes)
        hit = removed != 0
        cols = [pa.array(t.column(c).to_numpy()[hit]) for c in ("id", "print", "at")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(removed[hit])], names=["id", "print", "at", "removed"])

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= 100_000:
            t = pa.concat_tables(held).combine_chunks()
            cut = int(np.searchsorted(a := t.column("anchor").to_numpy(), a[-1]))
            if cut:
                yield solve(t.slice(0, cut))
            held, rows = [t.slice(cut)], t.num_rows - cut
    if rows:
        yield solve(pa.concat_tables(held).combine_chunks())


def _field(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _removal_notes(frame: DataFrame, min_bytes: int, batch_bytes: int, hot_places: int) -> DataFrame:
    """(id, print, starts, ends, at, removed): what is known to go in each document: the
    windows that start in chunks, and those around the places of anchors."""
    spark = frame.sparkSession
    ship(spark)
    frame = frame.filter("id is not null")
    dead = _dead_chunks(frame, min_bytes)
    total = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, int(total // batch_bytes))
    batch = F.pmod(F.xxhash64(*_KEY), F.lit(n_batches)).alias("batch")
    texts = frame.select(batch, *_KEY, "text")
    noted = dead.select(batch, *_KEY, "dead", F.lit(None).cast("binary").alias("anchors"))

    hashes = (
        texts.groupBy("batch")
        .cogroup(noted.groupBy("batch"))
        .applyInArrow(lambda d, n: _batch_hashes(d, n, min_bytes), _field(("anchor", T.LongType()), ("batch", T.LongType())))
    )
    repeated = (
        hashes.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_repeated, _field(("anchor", T.LongType()), ("batch", T.LongType())))
    )
    # each batch's shared anchors, some thousand in a row
    packed = repeated.groupBy("batch", F.pmod(F.col("anchor"), F.lit(64)).alias("part")).agg(
        F.collect_set("anchor").alias("anchors")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.array(x, dtype=np.int64).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, type=pa.binary())], names=["batch", "anchors"])

    lists = packed.select("batch", "anchors").mapInArrow(pack, _field(("batch", T.LongType()), ("anchors", T.BinaryType())))
    notes = noted.unionByName(
        lists.select(
            "batch",
            F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("long").alias("print"),
            F.lit(None).cast(dead.schema["dead"].dataType).alias("dead"),
            "anchors",
        )
    )
    place = _field(
        ("anchor", T.LongType()),
        ("id", T.LongType()),
        ("print", T.LongType()),
        ("at", T.LongType()),
        ("left", T.BinaryType()),
        ("right", T.BinaryType()),
    )
    places = materialize(
        texts.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(lambda d, n: _places(d, n, min_bytes), place),
        "places",
    )
    hot = materialize(
        places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_places).select("anchor"),
        "hot_anchors",
    )
    found = _field(("id", T.LongType()), ("print", T.LongType()), ("at", T.LongType()), ("removed", T.LongType()))
    usual = places.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    removed = usual.mapInArrow(lambda it: _index(it, min_bytes), found)
    if hot.limit(1).count():
        removed = removed.unionByName(_hot_windows(places.join(hot, "anchor", "left_semi"), min_bytes))
    by_place = removed.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "removed")).alias("places"))
    return by_place.join(dead, _KEY, "full").select(
        *_KEY,
        F.col("dead.start").alias("starts"),
        F.col("dead.end").alias("ends"),
        F.col("places.at").alias("at"),
        F.col("places.removed").alias("removed"),
    )


def _hot_windows(places: DataFrame, min_bytes: int) -> DataFrame:
    """The same verdicts for the few anchors with so many places that no task should
    hold them: each window by itself, the smallest document by an aggregation that
    starts before the shuffle."""
    side = min_bytes - ANCHOR
    whole = F.concat("left", "right")
    n_left = F.octet_length("left")
    each = (
        places.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(n_left, F.lit(side)))))
        .withColumn("window", F.substring(whole, n_left - F.col("j") + 1, F.lit(min_bytes)))
        .filter(F.octet_length("window") == min_bytes)
        .select(*_KEY, "at", "j", "window")
    )
    n = F.count(F.lit(1)).alias("n")
    low = each.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high"), n).filter("low < high")
    low = materialize(low.select("window", "low", "n"), "hot_windows")
    hit = join_per_key(each, low, "window", "n", "inner", SPLIT_ROWS).filter(F.col("id") > F.col("low"))
    bit = F.expr("shiftleft(1L, j)")
    return hit.groupBy(*_KEY, "at").agg(F.bit_or(bit).alias("removed"))


def remaining(r: dict, min_bytes: int) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes, removed bytes, maximal removed runs) of one text with
    its notes."""
    raw = (r["text"] or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not r["starts"] and not r["at"]:
        return raw, n, 0, 0
    change = np.zeros(n + 1, dtype=np.int64)
    if r["starts"]:
        np.add.at(change, np.array(r["starts"]), 1)
        np.add.at(change, np.array(r["ends"]) + min_bytes - 1, -1)
    if r["at"]:
        bits = np.array(r["removed"])[:, None] >> np.arange(min_bytes - ANCHOR + 1) & 1
        place, j = np.nonzero(bits)
        first = np.array(r["at"])[place] - j
        np.add.at(change, first, 1)
        np.add.at(change, first + min_bytes, -1)
    gone = np.cumsum(change[:n]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), n, int(gone.sum()), spans


_NOTES = ["starts", "ends", "at", "removed"]
_NEW = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


def _finish(min_bytes: int, with_text: bool):
    def make():
        def fn(rows):
            out = []
            for r in rows:
                kept, n, removed, spans = remaining(r, min_bytes)
                text = kept.decode("utf-8", "ignore") if with_text else None
                out.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), text))
            return list(zip(*out, strict=True))

        return fn

    return make


def removals(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    batch_bytes: int = 8 << 20,
    hot_places: int = 1 << 15,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    frame = _keyed(docs, id_col, text_col)
    notes = materialize(_removal_notes(frame, min_bytes, batch_bytes, hot_places), "removals")
    joined = frame.join(notes, _KEY, "left")
    out = append_columns(joined, F.struct("text", *_NOTES), _finish(min_bytes, False), _NEW, keep=["id"])
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cleaned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    batch_bytes: int = 8 << 20,
    hot_places: int = 1 << 15,
) -> DataFrame:
    """``docs`` with the remaining bytes as the text (bytes of a character that lost
    some of its bytes are left out)."""
    frame = _keyed(docs, id_col, text_col)
    notes = materialize(_removal_notes(frame, min_bytes, batch_bytes, hot_places), "removals")
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    of = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    keyed = whole.select("row", F.col("row")[id_col].cast("long").alias("id"), F.xxhash64(of).alias("print"))
    joined = keyed.join(notes, _KEY, "left")
    value = F.struct(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text"), *_NOTES)
    out = append_columns(joined, value, _finish(min_bytes, True), _NEW, keep=["row"])
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept_text")).alias(text_col)
    return out.select(*[text if c == text_col else F.col("row")[c].alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what goes from every document, and the digest of what stays."""
    return removals(read(spark, sf_dir, "documents", "doc_id", "text"))
