"""JSON records of unknown or drifting shape.

Lines are parsed once into VARIANT values: nothing is inferred beforehand, a new attribute
costs no schema change, and a line that is not JSON is not lost in a row of NULLs but goes
to a quarantine table that can be counted and looked at. The shape of all records (every
attribute leaf with its merged type) is one aggregate over the parsed column, and the flat
table is one ``select`` of typed paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, source): the text lines of the files under ``path`` with their file."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def parse(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with ``record``: the line as VARIANT, NULL where it is not a JSON object."""
    record = F.try_parse_json(F.col(f"`{line_col}`"))
    is_object = F.schema_of_variant(record).startswith("OBJECT")
    return lines.withColumn("record", F.when(is_object, record))


def quarantine(parsed: DataFrame, line_col: str = "line") -> DataFrame:
    """The lines that are no record; blank ones are none either, but nothing is wrong with them."""
    line = F.col(f"`{line_col}`")
    return parsed.filter(F.col("record").isNull() & (F.trim(line) != "")).drop("record")


def shape(parsed: DataFrame) -> T.StructType:
    """The merged type of all records. One aggregate; its single row, as long as the set of
    attributes, is what reaches the driver. Types that contradict each other, and attributes
    that are always null, become text."""
    found = parsed.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType()
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found)
    ddl = re.sub(r"(: |ARRAY<)(VOID|VARIANT)\b", r"\1STRING", ddl)
    return T.StructType.fromDDL(f"record {ddl}").fields[0].dataType


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """(path, type) of every attribute that is no object itself."""
    out = []
    for f in schema.fields:
        inner = isinstance(f.dataType, T.StructType)
        out += leaves(f.dataType, (*path, f.name)) if inner else [((*path, f.name), f.dataType)]
    return out


def _get(path: tuple[str, ...], kind: T.DataType) -> Column:
    """The value at a path. Path text knows no escapes, so a name with both kinds of quotes is
    looked up in its object as a map."""
    value, steps = F.col("record"), "$"
    for p in path:
        if "'" in p and '"' in p:
            held = value if steps == "$" else F.try_variant_get(value, steps, "variant")
            value, steps = held.try_cast("map<string,variant>").getItem(p), "$"
        else:
            steps += f'["{p}"]' if "'" in p else f"['{p}']"
    return F.try_variant_get(value, steps, kind.simpleString())


def spread(parsed: DataFrame, schema: T.StructType | None = None, sep: str = ".") -> DataFrame:
    """One column per attribute leaf of the records, named by its path; a value of another type
    than the leaf's is NULL. Without a schema the shape of the records is used."""
    schema = shape(parsed) if schema is None else schema
    records = parsed.filter("record is not null")
    return records.select(*[_get(p, t).alias(sep.join(p)) for p, t in leaves(schema)])


def leaf_counts(parsed: DataFrame, sep: str = ".") -> DataFrame:
    """(path, n): in how many records each attribute leaf has a value; one pass for all leaves."""
    found = leaves(shape(parsed))
    if not found:
        return parsed.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("n")).limit(0)
    names = [sep.join(p) for p, _ in found]
    counts = parsed.agg(*[F.count(_get(p, t)).alias(f"c{i}") for i, (p, t) in enumerate(found)])
    pairs = F.array(*[F.struct(F.lit(x).alias("path"), F.col(f"c{i}").alias("n")) for i, x in enumerate(names)])
    return counts.select(F.explode(pairs).alias("e")).select("e.path", "e.n")
