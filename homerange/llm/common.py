"""Helpers shared by the training-data operators.

Operators take a DataFrame and the names of the columns they read. They look at
no other column, so extra columns (whatever their names) neither clash nor
matter. :func:`append_columns` is the one way Python code is attached to rows:
the input row travels as one untouched struct next to the new columns.
"""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW, VALUE = "_row", "_value"
#: Characters of text that one step of a Python task holds at a time.
STEP_CHARS = 4_000_000


class Memo:
    """What a task has worked out for the keys seen lately: two generations of about
    ``size`` keys each. When the younger one is full it becomes the older one; keys
    that come again move over, so frequent ones stay and memory stays bounded."""

    def __init__(self, size: int):
        self.size = size
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, keys: set) -> list:
        """The keys not known yet; the others are in ``now`` after this call."""
        if len(self.now) > self.size:
            self.before, self.now = self.now, {}
        new = keys.difference(self.now)
        old = self.before
        if old:
            back = [k for k in new if k in old]
            self.now.update((k, old[k]) for k in back)
            new.difference_update(back)
        return list(new)


_held: dict = {}


def worker_object(key: Hashable, make: Callable):
    """An object that a Python worker keeps for its next tasks (its memo serves them
    too). One at a time: a worker that turns to another operator lets go of it."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors through the session's own file service,
    once per application, so that Python tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="homerange-")) / "homerange_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one table; the scan reads no other column."""
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def steps(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of texts (or of structs with a field ``text``) of about
    :data:`STEP_CHARS` bytes, so that a task's memory does not follow the length of an
    Arrow batch's texts."""
    texts = values.field("text") if pa.types.is_struct(values.type) else values
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(held):
        end = min(int(np.searchsorted(held, done + STEP_CHARS)) + 1, len(held))
        yield start, end
        start, done = end, int(held[end - 1])


def append_columns(
    df: DataFrame, value: Column, make: Callable[[], Callable], schema: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """``df`` (its columns ``keep``, if given) with the columns of ``schema`` computed
    from ``value``.

    ``make()`` runs once per task and returns ``fn(values) -> list of columns``
    (one list, numpy array or Arrow array per field). The rows of ``df`` are
    returned under their own names, followed by the new columns; on a clash of
    names the new column replaces the old one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    names = df.columns if keep is None else keep
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(ROW), value.alias(VALUE))
    out_schema = T.StructType([T.StructField(ROW, inner.schema[ROW].dataType), *schema.fields])
    new = list(to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            values = batch.column(1)
            rows = batch.column(0)
            for a, b in steps(values):
                got = fn(values.slice(a, b - a).to_pylist())
                cols = [pa.array(x, type=f.type) for x, f in zip(got, new, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *cols], names=[ROW, *(f.name for f in new)])

    out = inner.mapInArrow(run, out_schema)
    kept = [F.col(ROW)[c].alias(c) for c in names if c not in set(schema.names)]
    return out.select(*kept, *[F.col(n) for n in schema.names])
