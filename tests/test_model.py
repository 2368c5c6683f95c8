"""Clusters and elbow against a plain version, dictionary codes, forest (rows-only: its
trees are not comparable with other implementations)."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from homerange.operators import clusters, dictionary, model


@pytest.fixture(scope="module")
def points(spark):
    data = []
    for c, (x, y) in enumerate([(-112.0, 33.4), (-111.7, 33.3), (-111.9, 33.6)]):
        for i in range(30):
            data.append((f"u{c}_{i}", x + (i % 5) * 0.001, y + (i % 7) * 0.001))
    return spark.createDataFrame(data, "user_id string, longitude_Centroid double, latitude_Centroid double")


def test_kmeans_and_elbow(spark, points):
    cl = clusters.cluster_users(points, k=3, seed=1986)
    assert cl.count() == 90 and cl.select("cluster").distinct().count() == 3
    # points of one blob share a cluster
    per_blob = cl.withColumn("blob", F.substring("user_id", 1, 2)).groupBy("blob").agg(F.countDistinct("cluster").alias("n"))
    assert {r.n for r in per_blob.collect()} == {1}
    curve = {r.k: r.wss for r in clusters.elbow(points, ks=[2, 3, 4]).collect()}
    assert curve[1] >= curve[2] >= curve[3] >= curve[4] - 1e-12
    arr = np.array([(r.longitude_Centroid, r.latitude_Centroid) for r in points.collect()])
    assert curve[1] == pytest.approx(((arr - arr.mean(0)) ** 2).sum())


def plain_kmeans(rows, k, seed, rounds=1000):
    """(cluster per id, cost): Lloyd rounds from farthest-first starts in draw order."""
    draw = {}
    for i, x, y in rows:
        h = hashlib.md5(f"{i}#{seed}".encode()).hexdigest()
        draw[x, y] = min(h, draw.get((x, y), h))
    sample = [p for p, _ in sorted(draw.items(), key=lambda e: (e[1], e[0]))][: clusters.START_POINTS]
    centres = sample[:1]
    while len(centres) < min(k, len(sample)):
        centres.append(max(sample, key=lambda p: min((p[0] - a) ** 2 + (p[1] - b) ** 2 for a, b in centres)))
    for _ in range(rounds):
        near = [min(range(len(centres)), key=lambda c: ((x - centres[c][0]) ** 2 + (y - centres[c][1]) ** 2, c)) for _, x, y in rows]
        after = []
        for c, old in enumerate(centres):
            mine = [r for r, n in zip(rows, near) if n == c]
            sums = [sum(int(np.copysign(np.floor(abs(r[a] * 1e10) + 0.5), r[a])) for r in mine) for a in (1, 2)]
            after.append(tuple(float(v) / 1e10 / len(mine) for v in sums) if mine else old)
        if after == centres:
            break
        centres = after
    cost = sum((x - centres[n][0]) ** 2 + (y - centres[n][1]) ** 2 for (_, x, y), n in zip(rows, near))
    return {i: n for (i, _, _), n in zip(rows, near)}, cost


def test_all_k_share_one_exact_fixed_point(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([-112.0, -111.5, 0.25]) + rng.randrange(40) * 0.01, rng.randrange(60) * 0.013 - 0.3) for i in range(400)]
    rows += [(500 + i, 7.0, 7.0) for i in range(100)]  # a fifth in one place
    extra = [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0)]
    users = spark.createDataFrame(rows + extra, "user_id long, longitude_Centroid double, latitude_Centroid double")
    jobs = []
    real = clusters._round
    monkeypatch.setattr(clusters, "_round", lambda points, centres: jobs.append(sorted(centres)) or real(points, centres))
    ks = [2, 3, 7, 20]
    curve = {r.k: r.wss for r in clusters.elbow(users, ks=ks, seed=5).filter("k > 1").collect()}
    alone = {}
    for k in ks:
        placed, cost = plain_kmeans(rows, k, 5)
        assert curve[k] == pytest.approx(cost, abs=1e-9)
        alone[k] = placed
    # one scan a round, whatever the number of k; a k that has settled is out
    assert jobs[0] == ks and all(set(b) <= set(a) for a, b in zip(jobs, jobs[1:]))
    got = {r.user_id: r.cluster for r in clusters.cluster_users(users.repartition(7), k=7, seed=5).collect()}
    assert got == alone[7]


def test_kmeans_of_little(spark):
    schema = "user_id long, longitude_Centroid double, latitude_Centroid double"
    none = spark.createDataFrame([], schema)
    assert clusters.cluster_users(none, k=3).count() == 0
    assert [r.k for r in clusters.elbow(none, ks=[2]).collect()] == [1]
    two = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 3.0, 4.0)], schema)
    assert {r.cluster for r in clusters.cluster_users(two, k=6).collect()} == {0, 1}
    assert {r.k: r.wss for r in clusters.elbow(two, ks=[6]).collect()}[6] == 0.0


def test_dictionary_codes(spark):
    rng = random.Random(9)
    data = [(i, rng.choice("aaabbc") if i % 9 else None, f"v{rng.randrange(300)}") for i in range(3000)]
    df = spark.createDataFrame(data, "id long, few string, many string").repartition(6)
    for share in (None, F.col("id") % 3 == 0):
        got = {(r.column_name, r.value): (r.n, r.code) for r in dictionary.dictionary_codes(df, ["few", "many"], share).collect()}
        for name, at in (("few", 1), ("many", 2)):
            rows = {}
            for d in data:
                if d[at] is not None:
                    n, hits = rows.get(d[at], (0, 0))
                    rows[d[at]] = (n + 1, hits + (d[0] % 3 == 0))
            order = sorted(rows, key=lambda v: ((-rows[v][0]) if share is None else rows[v][1] / rows[v][0], v))
            assert {v: got[name, v] for v in order} == {v: (rows[v][0], c) for c, v in enumerate(order)}
    codes = dictionary.dictionary_codes(df, ["few"])
    out = dictionary.encode(df, codes, {"few": 3}, "x_").collect()
    lookup = {r.value: r.code for r in codes.collect()}
    assert {(r.few, r.x_few) for r in out} == {(v, lookup.get(v, 3)) for v in ("a", "b", "c", None)}


def test_a_column_of_very_many_values_encodes_and_trains(spark):
    n = 300_000
    df = spark.range(n, numPartitions=8).select(
        F.col("id").alias("business_id"),
        F.concat(F.lit("value "), F.col("id").cast("string")).alias("wide"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("t"),
        F.when(F.col("id") % 3 == 0, "Y").otherwise("N").alias("Highly_Liked"),
    )
    codes = dictionary.dictionary_codes(df, ["wide"])
    r = codes.agg(F.count("*").alias("n"), F.countDistinct("code").alias("d"), F.min("code").alias("lo"), F.max("code").alias("hi")).first()
    assert (r.n, r.d, r.lo, r.hi) == (n, n, 0, n - 1)
    small = df.filter("business_id < 3000")
    encoder = model.fit_encoder(small)
    assert encoder.nominal == {"t"} and encoder.sizes == {"wide": 3000, "t": 2}
    scored = model.score(model.fit_forest(small, num_trees=5, max_depth=4), small)
    assert scored.filter("prediction = Highly_Liked").count() == 3000


def test_one_class_and_unseen_values(spark):
    rows = [(i, "N", float(i), "a") for i in range(6)]
    schema = "business_id long, Highly_Liked string, x double, t string"
    one = spark.createDataFrame(rows, schema)
    assert {r.prediction for r in model.grow_and_score(one, one, num_trees=3).collect()} == {"N"}
    train = spark.createDataFrame([(i, "Y" if i % 2 else "N", None, "p" if i % 2 else "q") for i in range(40)], schema)
    test = spark.createDataFrame([(100, None, 1.0, "new"), (101, "Z", None, None), (102, "Y", 0.0, "p")], schema)
    got = {r.business_id: (r.Highly_Liked, r.prediction) for r in model.score(model.fit_forest(train, num_trees=5), test).collect()}
    assert got[102] == ("Y", "Y") and got[100][0] is None and set(got) == {100, 101, 102}


def test_forest_scores(spark):
    data = [(i, "Y" if i % 3 == 0 else "N", float(i % 3), "a" if i % 3 == 0 else "b") for i in range(90)]
    df = spark.createDataFrame(data, "business_id long, Highly_Liked string, x double, t string")
    s = model.stratified_split(df, p=0.6, seed=1)
    train = s.filter("split = 'train'").drop("split")
    test = s.filter("split = 'test'").drop("split")
    fitted = model.fit_forest(train, num_trees=10, max_depth=4, seed=3)
    scored = model.score(fitted, test)
    assert scored.count() == test.count()
    conf = model.confusion(scored)
    assert sum(r.n for r in conf.collect()) == test.count()
    r = model.confusion_rates(scored, positive="N").first()
    assert r.accuracy == pytest.approx(1.0)


def test_forest_in_batches_and_whole_registered_jobs(spark):
    from homerange import registry

    p = registry.PARAMS
    assert p.elbow_ks == tuple(range(2, 51))
    assert (p.num_trees, p.max_depth) == (model.NUM_TREES, 30)
    data = [(i, "Y" if i % 3 == 0 else "N", float(i % 3), "a" if i % 3 == 0 else "b") for i in range(60)]
    df = spark.createDataFrame(data, "business_id long, Highly_Liked string, x double, t string")
    scored = model.grow_and_score(df, df, num_trees=7, max_depth=4, seed=3, batch_trees=3)
    got = {r.business_id: r.prediction for r in scored.collect()}
    assert got == {i: y for i, y, _, _ in data}


def test_elbow_warns_of_a_fit_that_has_not_converged(spark, points):
    with pytest.warns(UserWarning, match="k = 5"):
        clusters.elbow(points, ks=[5], max_iter=1)


def test_out_of_bag_votes_match_plain_bags(spark):
    rng = random.Random(12)
    data = [(i, "Y" if (i % 4 == 0) ^ (rng.random() < 0.2) else "N", float(i % 4), rng.choice("abc")) for i in range(160)]
    df = spark.createDataFrame(data, "business_id long, Highly_Liked string, x double, t string")
    kw = {"num_trees": 24, "bag_trees": 4, "max_depth": 5, "seed": 7}
    got = {r.business_id: (r.votes, r.prediction) for r in model.out_of_bag(df, **kw).collect()}

    def draws(i, bag):
        h = int(hashlib.md5(f"{i}#7#{bag}".encode()).hexdigest()[:12], 16)
        return sum(h >= c for c in model.BAG_CUTS)

    sizes = {r.bag: (r.n_in, r.n_out, r.draws) for r in model.bag_sizes(df, 6, seed=7).collect()}
    for bag in range(6):
        d = [draws(i, bag) for i in range(160)]
        assert sizes[bag] == (sum(x > 0 for x in d), sum(x == 0 for x in d), sum(d))
        assert 0.5 < sizes[bag][0] / 160 < 0.8
    encoder = model.fit_encoder(df)
    rows = encoder.transform(df, "business_id", "Highly_Liked")
    rows = rows.withColumn("__label", (F.col("Highly_Liked") == "Y").cast("double"))
    assert encoder.labels == ("N", "Y")
    weight = F.udf(lambda i, b: float(draws(i, b)), "double")
    votes = {i: np.zeros(2) for i in range(160)}
    seen = dict.fromkeys(range(160), 0)
    for bag in range(6):
        bagged = rows.withColumn("__weight", weight("business_id", F.lit(bag))).repartition(8).persist()
        trees = model.forest_estimator(encoder, num_trees=4, max_depth=5, seed=7 + bag).setWeightCol("__weight")
        fitted = trees.fit(bagged.filter("__weight > 0"))
        for r in fitted.transform(bagged.filter("__weight = 0")).collect():
            votes[r.business_id] += r.rawPrediction.toArray()
            seen[r.business_id] += 4
    # each row is judged by the trees of the bags that never drew it, and by no other
    assert {i: v for i, (v, _) in got.items()} == seen
    sure = [i for i in votes if abs(votes[i][0] - votes[i][1]) > 0.5 * max(1, seen[i])]
    same = sum(got[i][1] == ("Y" if votes[i][1] > votes[i][0] else "N") for i in sure)
    assert len(sure) > 60 and same >= 0.95 * len(sure)
    e = model.out_of_bag_error(model.out_of_bag(df, **kw)).first()
    assert (e.n, e.n_judged) == (160, sum(v > 0 for v in seen.values()))
    wrong = sum(p is not None and p != data[i][1] for i, (_, p) in got.items())
    assert e.n_wrong == wrong and e.error == pytest.approx(wrong / e.n_judged)
    assert e.error < 0.45
