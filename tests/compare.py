"""Run a registered query in Spark and its SQL in DuckDB; compare exactly.

Used by the tests and by hand: ``python tests/compare.py SF_DIR [names...]``.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "smallint": "SMALLINT",
    "float": "FLOAT",
}


def check(spark, sf_dir: str, name: str, query, sql: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    con.sql(f"CREATE OR REPLACE TEMP VIEW checked AS {sql}")  # as a driver may store it
    rel = con.sql("SELECT * FROM checked")
    d_cols = rel.columns
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    s_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = dict(zip(d_cols, (str(t) for t in rel.types)))
    if s_types != d_types:
        diff = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
        return False, f"types differ (spark, duck): {diff}"
    perm = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in perm) for r in d_rows]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        return False, f"values differ: spark-only={only_s} duck-only={only_d}"
    return True, f"{len(s_rows)} rows"


if __name__ == "__main__":
    import time

    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from homerange import get_spark

    sf_dir = sys.argv[1]
    spark = get_spark()
    qs, sqls = E.queries(), E.oracle_sql()
    names = sys.argv[2:] or list(qs)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in sqls:
            t = time.time()
            cnt = qs[n](spark, sf_dir).count()
            print(f"ROWS {n}: {cnt} rows ({time.time()-t:.1f}s)")
            continue
        t = time.time()
        ok, msg = check(spark, sf_dir, n, qs[n], sqls[n], con)
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {n}: {msg} ({time.time()-t:.1f}s)", flush=True)
    print("failures:", bad)
