"""Forests grown from counted cells: the forest of the rows, at a cost that follows the cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from homerange.operators import cells, model

SCHEMA = "business_id long, Highly_Liked string, hours double, wifi string, brand string"


def noisy(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hours, wifi, brand = float(rng.randrange(12)), rng.choice(["free", "no", None]), rng.choice("abcdefgh")
        liked = rng.random() < 0.2 + 0.4 * (hours > 5 and brand in "ace") + 0.2 * (wifi == "free")
        rows.append((i, "Y" if liked else "N", hours, wifi, brand))
    return rows


def refuse(*args, **kw):
    raise AssertionError("a forest was grown from the rows")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(noisy(1500, 5), SCHEMA)


def shares(frame, train, test, trees, seed):
    """Share of the last class in the votes of ``trees`` trees, per row."""
    encoder = model.fit_encoder(train)
    known = model._training_rows(train, encoder, "Highly_Liked", "business_id")
    cuts = model._cuts(known, encoder, 32)
    one = [F.lit(0).alias("bag"), F.lit(1).alias("weight")]
    drawn = model._binned(known, encoder, cuts).select("__bins", "__label", *one)
    judged = model._binned(encoder.transform(test, "business_id"), encoder, cuts)
    votes = model._cell_votes(encoder, drawn, judged, trees, trees, seed)
    return {r.business_id: r.v1 / cells.UNITS / trees for r in judged.join(votes, "__bins").collect()}


def test_votes_are_those_of_a_forest_of_the_rows(spark, frame):
    train, test = frame.filter("business_id < 1000"), frame.filter("business_id >= 1000")
    mine = shares(frame, train, test, 150, 3)
    fitted = [model.fit_forest(train, num_trees=150, seed=s) for s in (3, 4)]
    plain = []
    for f in fitted:
        rows = model._votes(f, f.encoder.transform(test, "business_id"), "business_id").collect()
        plain.append({r.business_id: float(r["__v"][1]) / 150 for r in rows})
    ids = sorted(mine)
    a, b, c = (np.array([d[i] for i in ids]) for d in (mine, *plain))
    noise = np.abs(b - c).mean()  # of two seeds
    assert len(ids) == 500 and np.abs(a - b).mean() < 1.5 * noise and abs(a.mean() - b.mean()) < 0.02
    # another deal of the rows is the same forest, to the last bit
    assert shares(frame, train.repartition(7), test.repartition(3), 150, 3) == mine


def test_the_whole_forest_needs_no_row_per_tree(spark, frame, monkeypatch):
    """5000 trees over many rows of few cells: no tree sees a row."""
    many = frame.crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    many = many.withColumn("business_id", F.col("business_id") * 40 + F.col("copy")).drop("copy")
    monkeypatch.setattr(model, "forest_estimator", refuse)
    scored = model.grow_and_score(many.filter("business_id % 5 > 1"), many.filter("business_id % 5 < 2"))
    assert scored.count() == 24_000
    counts = {(r.Highly_Liked, r.prediction): r.n for r in model.confusion(scored).collect()}
    rates = model.confusion_rates(scored, positive="N").first()
    assert sum(counts.values()) == rates.n == 24_000 and rates.tp == counts["N", "N"]
    assert rates.accuracy > 0.65


def test_more_cells_than_tasks_hold_grow_from_rows(spark, frame, monkeypatch):
    kw = {"num_trees": 60, "max_depth": 5, "seed": 3}
    by_cells = {r.business_id: r.prediction for r in model.grow_and_score(frame, frame, **kw).collect()}
    monkeypatch.setattr(model, "HELD_NUMBERS", 0)
    by_rows = {r.business_id: r.prediction for r in model.grow_and_score(frame, frame, **kw).collect()}
    assert set(by_rows) == set(by_cells)
    assert sum(by_rows[i] == by_cells[i] for i in by_rows) > 0.9 * len(by_rows)
    monkeypatch.setattr(model, "forest_estimator", refuse)
    with pytest.raises(AssertionError, match="from the rows"):
        model.grow_and_score(frame, frame, **kw)


def test_numbers_with_more_values_than_bins_and_null_keys(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i if i % 10 else None, "Y" if (i * 7919) % 1000 > 600 else "N", float((i * 7919) % 1000), rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "business_id long, Highly_Liked string, x double, t string")
    monkeypatch.setattr(model, "forest_estimator", refuse)
    kw = {"features_per_split": "2"}
    got = model.grow_and_score(df, df.withColumn("t", F.lit("new")), num_trees=2000, **kw)
    keyed = got.filter("business_id is not null")
    assert keyed.count() == 2700 and keyed.filter("prediction = Highly_Liked").count() > 2600
    assert got.filter("business_id is null").count() == 2  # a row per label


def test_out_of_bag_needs_no_row_per_tree(spark, frame, monkeypatch):
    """A bag's rows count as often as it drew them, and only rows it left out are judged."""
    kw = {"num_trees": 40, "bag_trees": 8, "max_depth": 6, "seed": 7}
    by_cells = {r.business_id: (r.votes, r.prediction) for r in model.out_of_bag(frame, **kw).collect()}
    monkeypatch.setattr(model, "HELD_NUMBERS", 0)
    by_rows = {r.business_id: (r.votes, r.prediction) for r in model.out_of_bag(frame, **kw).collect()}
    assert {i: v for i, (v, _) in by_cells.items()} == {i: v for i, (v, _) in by_rows.items()}
    assert sum(by_rows[i] == by_cells[i] for i in by_rows) > 0.85 * len(by_rows)
    monkeypatch.setattr(model, "HELD_NUMBERS", 4_000_000)
    monkeypatch.setattr(model, "forest_estimator", refuse)
    assert model.out_of_bag_error(model.out_of_bag(frame, **kw)).first().n_judged > 1200


def test_equal_leaves_become_one():
    # a root with two leaves of one prediction votes as a whole, other pairs by leaf
    root = (np.array([6.0, 5.0]), np.array([2.0, 5.0]), np.array([True, True]), np.array([0, 1]))
    leaves = (np.array([4.0, 2.0, 4.0, 1.0]), np.array([2.0, 0.0, 1.0, 4.0]), np.zeros(4, bool), np.zeros(4, int))
    share = cells._leaf_shares([root, leaves])
    assert share[2].tolist() == share[3].tolist() == [0.75, 0.25]
    assert share[4].tolist() == [0.8, 0.2] and share[5].tolist() == [0.2, 0.8]
