"""Quantiles per group, many circles, Z-order layout and JSON of unknown shape."""

import json
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from homerange.operators.circles import within_circles, write_clustered, z_order
from homerange.operators.quantiles import grouped_quantiles
from homerange.sources import variant


def test_grouped_quantiles_match_numpy(spark):
    rng = random.Random(8)
    rows = [("hot", 1, rng.random() * 100) for _ in range(4000)]  # one group has most rows
    rows += [("ties", 2, float(rng.randrange(3))) for _ in range(500)]
    rows += [(None, None, float(i)) for i in range(10)] + [("one", 1, 7.5), ("none", 1, None), ("hot", 2, -1.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(9)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.h, r.prob): r.value for r in grouped_quantiles(df, ["g", "h"], "x", probs).collect()}
    held = {}
    for g, h, x in rows:
        if x is not None:
            held.setdefault((g, h), []).append(x)
    want = {(*k, p): np.quantile(v, p) for k, v in held.items() for p in probs}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert grouped_quantiles(df.filter("false"), ["g"], "x", probs).count() == 0


def test_circles_match_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(500)] + [(900, None, 1.0), (901, 0.0, None), (902, 1.5, 0.0)]
    rings = [(c, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.0, 0.1, 0.7, 1.3])) for c in range(40)]
    rings += [(99, 0.5, 0.0, 1.0), (98, None, 0.0, 1.0)]  # 902 lies on the edge of 99
    p = spark.createDataFrame(pts, "id long, longitude double, latitude double")
    c = spark.createDataFrame(rings, "circle_id long, cx double, cy double, radius double")
    out = within_circles(p, c)
    got = [(r.circle_id, r.id) for r in out.collect()]
    want = {
        (k, i)
        for k, cx, cy, radius in rings
        for i, x, y in pts
        if None not in (cx, x, y) and math.sqrt((x - cx) ** 2 + (y - cy) ** 2) < radius
    }
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert within_circles(p, c.filter("false")).count() == within_circles(p, c.filter("radius = 0")).count() == 0


def test_clustered_files_let_a_box_skip(spark, tmp_path):
    n = 100
    grid = spark.range(n * n).select(
        (F.lit(-112.0) + (F.col("id") % n) * 0.01).alias("longitude"), (F.lit(33.0) + F.floor(F.col("id") / n) * 0.01).alias("latitude")
    )
    z = z_order(F.col("longitude"), F.col("latitude"))
    assert grid.select(z.alias("z")).distinct().count() == n * n
    path = str(tmp_path / "clustered")
    write_clustered(grid, path, files=16)
    hit = 0
    files = sorted((tmp_path / "clustered").glob("*.parquet"))
    for f in files:
        stats = [pq.ParquetFile(f).metadata.row_group(0).column(i).statistics for i in (0, 1)]
        hit += stats[0].min <= -111.9 and stats[0].max >= -112.0 and stats[1].min <= 33.1 and stats[1].max >= 33.0
    assert len(files) >= 8 and hit <= len(files) / 3
    box = spark.read.parquet(path).filter("longitude <= -111.9 and latitude <= 33.1")
    assert box.count() == grid.filter("longitude <= -111.9 and latitude <= 33.1").count() > 0


def test_json_of_unknown_shape(spark, tmp_path):
    good = [
        {"id": 1, "attributes": {"Wi-Fi": "free", "Parking": {"lot": True}}},
        {"id": 2, "attributes": {"Wi-Fi": None, "Parking": {"lot": False, "it's": 3}}, "new": [1, 2]},
        {"id": 3, "attributes": {"Price Range": 2, "Parking": {"lot": "maybe"}, "both ' and \"": {"in": 4}}},
        {},
    ]
    bad = ['{"id": 9, "attributes": {"Wi-Fi": "fr', "not json", "[1, 2]", "7"]
    lines = [json.dumps(g) for g in good] + bad + ["", "  "]
    (tmp_path / "part1.json").write_text("\n".join(lines[:5]))
    (tmp_path / "part2.json").write_text("\n".join(lines[5:]))
    parsed = variant.parse(variant.read_lines(spark, str(tmp_path)))
    out = variant.quarantine(parsed)
    assert sorted(r.line for r in out.collect()) == sorted(bad)
    assert {r.source.rsplit("/", 1)[-1] for r in out.collect()} == {"part1.json", "part2.json"}
    flat = variant.spread(parsed)
    assert set(flat.columns) == {"id", "new", "attributes.Wi-Fi", "attributes.Price Range", "attributes.Parking.lot", "attributes.Parking.it's", "attributes.both ' and \".in"}
    rows = {r["id"]: r for r in flat.collect()}
    assert set(rows) == {1, 2, 3, None}
    assert (rows[1]["attributes.Wi-Fi"], rows[2]["attributes.Parking.it's"], rows[3]["attributes.Price Range"]) == ("free", 3, 2)
    assert [rows[i]["attributes.Parking.lot"] for i in (1, 2, 3)] == ["true", "false", "maybe"]
    assert rows[3]["attributes.both ' and \".in"] == 4
    counts = {r.path: r.n for r in variant.leaf_counts(parsed).collect()}
    assert counts["attributes.Parking.lot"] == 3 and counts["attributes.Wi-Fi"] == 1 and counts["id"] == 3
    none = variant.parse(spark.createDataFrame([], "line string"))
    assert variant.spread(none).columns == [] and variant.leaf_counts(none).count() == 0
