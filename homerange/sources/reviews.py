"""Readers for the review data set (newline-delimited JSON) and nested-record
flattening (K33), plus profile extracts (K32).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.sources import schemas


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line. With a schema nothing is inferred (no extra
    pass over the files); without one Spark samples the files to infer it."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _quote(path: list[str]) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in path)


def flatten(df: DataFrame, sep: str = ".", recursive: bool = True) -> DataFrame:
    """Nested structs become top-level columns named by their path
    (``attributes.Parking.lot``). Arrays and maps stay as they are.

    It is one ``select`` over the schema, so Catalyst prunes the nested
    fields that later steps do not read."""
    cols = []

    def walk(field_type: T.DataType, path: list[str]) -> None:
        if isinstance(field_type, T.StructType) and (recursive or len(path) == 1):
            for f in field_type.fields:
                walk(f.dataType, path + [f.name])
        else:
            cols.append(F.col(_quote(path)).alias(sep.join(path)))

    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                walk(f.dataType, [field.name, f.name])
        else:
            cols.append(F.col(_quote([field.name])).alias(field.name))
    return df.select(*cols)


def read_reviews_dataset(spark: SparkSession, root: str, flat: bool = True) -> dict[str, DataFrame]:
    """The four tables of the review data set under ``root``
    (``business.json``, ``review.json``, ``tip.json``, ``user.json``; each may
    also be a folder of part files), read with explicit schemas and
    flattened."""
    out = {}
    for name, schema in schemas.REVIEW_DATASET.items():
        df = read_ndjson(spark, f"{root.rstrip('/')}/{name}.json", schema)
        out[name] = flatten(df) if flat else df
    return out


def sample_head(df: DataFrame, key: str | list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by ``key``. Spark has no row order of its own, so the
    order is explicit; the plan is a top-k (TakeOrderedAndProject), one
    bounded heap per task."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header. Arrays and structs are written as JSON text (CSV has
    no nested types)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    df.select(*out).write.mode(mode).option("header", True).csv(path)
