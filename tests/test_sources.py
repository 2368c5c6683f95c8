"""NDJSON reading with nested records (K33), head extracts and CSV.
Fixture files are written by the test into a temporary folder."""

import csv
import glob
import json
import os

from pyspark.sql import functions as F

from homerange.sources import flatten, read_ndjson, read_reviews_dataset, sample_head, write_csv


def _write(path, records):
    with open(path, "w") as fh:
        for r in records:
            fh.write(json.dumps(r) + "\n")


def test_read_dataset_and_flatten(spark, tmp_path):
    root = str(tmp_path)
    _write(
        f"{root}/business.json",
        [
            {
                "business_id": "b1",
                "city": "Tempe",
                "state": "AZ",
                "longitude": -111.9,
                "latitude": 33.4,
                "categories": ["Restaurants", "Seafood"],
                "hours": {"Monday": {"open": "08:00", "close": "17:00"}},
                "attributes": {"Wi-Fi": "free", "Price Range": 2, "Parking": {"lot": True}, "BYOB/Corkage": "no"},
                "ignored": 1,
            },
            {"business_id": "b2", "categories": [], "attributes": {}},
        ],
    )
    _write(f"{root}/review.json", [{"user_id": "u1", "business_id": "b1", "stars": 5, "text": "x"}])
    _write(f"{root}/tip.json", [{"user_id": "u1", "business_id": "b2"}])
    _write(f"{root}/user.json", [{"user_id": "u1", "name": "Ira", "fans": 3, "votes": {"funny": 12000}}])
    t = read_reviews_dataset(spark, root)
    b = t["business"]
    assert "attributes.Parking.lot" in b.columns and "hours.Monday.open" in b.columns
    assert "attributes.BYOB/Corkage" in b.columns
    r = {x.business_id: x for x in b.collect()}
    assert r["b1"]["attributes.Wi-Fi"] == "free" and r["b1"]["attributes.Price Range"] == "2"
    assert r["b1"]["attributes.Parking.lot"] == "true" and r["b1"]["hours.Monday.open"] == "08:00"
    assert r["b2"]["categories"] == [] and r["b2"]["attributes.Wi-Fi"] is None
    u = t["user"].first()
    assert u["votes.funny"] == 12000 and u["compliments.funny"] is None
    assert t["review"].first().stars == 5.0 and t["tip"].count() == 1


def test_flatten_depth_and_separator(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "id int, a struct<b:int, c:struct<d:int>>")
    assert flatten(df).columns == ["id", "a.b", "a.c.d"]
    assert flatten(df, sep="_").columns == ["id", "a_b", "a_c_d"]
    assert flatten(df, recursive=False).columns == ["id", "a.b", "a.c"]


def test_inferred_read(spark, tmp_path):
    p = f"{tmp_path}/x.json"
    _write(p, [{"a": 1, "n": {"m": "z"}}])
    assert flatten(read_ndjson(spark, p)).columns == ["a", "n.m"]


def test_head_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(i, [str(i)], f"n{i}") for i in range(30, 0, -1)], "id int, tags array<string>, name string")
    head = sample_head(df, "id", 10)
    assert [r.id for r in head.collect()] == list(range(1, 11))
    out = f"{tmp_path}/head_csv"
    write_csv(head, out)
    lines = []
    for f in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(f) as fh:
            lines += list(csv.DictReader(fh))
    assert len(lines) == 10 and lines[0]["tags"].startswith("[")
    assert {int(x["id"]) for x in lines} == set(range(1, 11))
    assert head.select(F.col("name")).count() == 10
