"""Train/test split, random forest and confusion matrix."""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.operators import cells, dictionary
from homerange.session import materialize

# Fixed values of the analysis: 60 % of each class for training, the seeds
# of the split and of the forest, and the forest size.
SPLIT_P = 0.6
SPLIT_SEED = 1900
FOREST_SEED = 1950
NUM_TREES = 5000
#: Trees grown at a time by Spark's own forest in :func:`grow_and_score`: the driver holds no more.
BATCH_TREES = 500
#: Batches grown side by side: while one waits for its driver, another has the executors.
BATCHES_AT_ONCE = 2
#: Trees of an out-of-bag estimate, and trees that share a bag.
OOB_TREES, OOB_BAG_TREES = 500, 50

_BUCKET_HEX = 5  # 16**5 = 1,048,576 hash buckets per class
#: Most numbers (8 bytes each) of a table of cells that tasks hold whole. With more cells, Spark's own
#: forest grows from the rows.
HELD_NUMBERS = 4_000_000
#: Widest text feature that trees split by sets of values; wider ones are ordered by label share.
NOMINAL_VALUES = 1000


def split_hash(key: str, seed: int) -> F.Column:
    """md5 of "<key>#<seed>" as hex text; its order is the draw order."""
    return F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(
    df: DataFrame,
    label: str = "Highly_Liked",
    p: float = SPLIT_P,
    seed: int = SPLIT_SEED,
    key: str = "business_id",
) -> DataFrame:
    """Exactly ceil(p * n_c) rows of each class c go to "train", the
    rest to "test" (column ``split``); rows without a label are left out; the draw is the order of
    md5(key, seed), so it is reproducible and independent of partitioning.

    Without a window over a whole class (one task per class): rows are
    hashed into 2**20 buckets per class; bucket counts (a bounded table)
    give the bucket holding each class' cut row; a window over (class,
    bucket) -- about n / 2**20 rows each -- ranks rows inside buckets.
    ``key`` must be unique (ties in the draw are broken by it)."""
    h = split_hash(key, seed)
    rows = df.filter(F.col(label).isNotNull()).withColumn("__h", h).withColumn(
        "__b", F.conv(F.substring("__h", 1, _BUCKET_HEX), 16, 10).cast("int")
    )
    buckets = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_class = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_class = Window.partitionBy(label)
    frac = F.lit(f"{p:.12f}").cast(T.DecimalType(20, 12))
    cum = (
        buckets.withColumn("__cum", F.sum("__n").over(by_class))
        .withColumn("__k", F.ceil(frac * F.sum("__n").over(per_class)).cast("long"))
        .withColumn("__before", F.col("__cum") - F.col("__n"))
    )
    # One row per class: the bucket where the class' k-th row lies.
    cut = cum.filter((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__cum"))).select(
        label, F.col("__b").alias("__cut_b"), "__before", "__k"
    )
    in_bucket = Window.partitionBy(label, "__b").orderBy("__h", key)
    ranked = rows.withColumn("__r", F.row_number().over(in_bucket))
    j = ranked.join(F.broadcast(cut), label, "left")
    train = F.when(F.col("__k").isNull(), F.lit(False)).otherwise(
        (F.col("__b") < F.col("__cut_b"))
        | ((F.col("__b") == F.col("__cut_b")) & (F.col("__before") + F.col("__r") <= F.col("__k")))
    )
    out_cols = [F.col(f"`{c}`") for c in df.columns]
    return j.select(*out_cols, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split"))


@dataclass(frozen=True)
class Encoder:
    """How rows become feature vectors: text columns through their dictionary (a table, see
    :mod:`homerange.operators.dictionary`), numbers as they are, 0 where missing."""

    features: tuple[str, ...]
    codes: DataFrame | None
    sizes: dict[str, int]
    nominal: frozenset[str]
    labels: tuple[str, ...]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` and ``__features``."""
        out = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *self.features])])
        if self.codes is not None:
            out = dictionary.encode(out, self.codes, self.sizes, "__idx_")
        inputs = []
        for c in self.features:
            name = f"__idx_{c}" if c in self.sizes else c
            # a missing number is 0, as the analysis fills its frame
            value = F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(0.0)), F.lit(0.0))
            if c in self.nominal:
                # one more value than the dictionary has: values not seen in training
                attribute = {"ml_attr": {"type": "nominal", "num_vals": self.sizes[c] + 1, "name": name}}
                out = out.withColumn(name, value.alias(name, metadata=attribute))
            else:
                out = out.withColumn(name, value)
            inputs.append(name)
        vectors = VectorAssembler(inputCols=inputs, outputCol="__features", handleInvalid="keep").transform(out)
        return vectors.select(*keep, "__features")

    def widest(self) -> int:
        return max((self.sizes[c] + 1 for c in self.nominal), default=2)


def fit_encoder(
    train: DataFrame,
    label: str = "Highly_Liked",
    exclude=("business_id", "split"),
    nominal_values: int = NOMINAL_VALUES,
) -> Encoder:
    """Dictionaries of the text features, and the classes (their number, not the data's,
    bounds what reaches the driver). A column of up to ``nominal_values`` values is nominal: a
    tree may send any set of them left. A forest needs a bin per nominal value, so a wider
    column is coded in the order of its values' share of the last class, and the trees cut that
    order; for two classes the best cut of a node's values is one of the order by share."""
    features = tuple(f.name for f in train.schema.fields if f.name not in exclude and f.name != label)
    text = [f.name for f in train.schema.fields if f.name in features and isinstance(f.dataType, T.StringType)]
    labels = tuple(r[0] for r in train.select(label).distinct().filter(F.col(label).isNotNull()).orderBy(label).collect())
    if not text:
        return Encoder(features, None, {}, frozenset(), labels)
    codes = dictionary.dictionary_codes(train, text)
    sizes = dict.fromkeys(text, 0) | {r["column_name"]: r["size"] for r in dictionary.sizes(codes).collect()}
    wide = [c for c in text if sizes[c] > nominal_values]
    if wide:
        last = F.col(label) == F.lit(labels[-1]) if labels else F.lit(False)
        ordered = dictionary.dictionary_codes(train, wide, share_of=last)
        codes = codes.filter(~F.col("column_name").isin(wide)).unionByName(ordered)
    return Encoder(features, codes, sizes, frozenset(text) - frozenset(wide), labels)


def _histogram_mb(spark: SparkSession) -> int:
    """Memory for a round of split statistics: an eighth of the smaller of the driver's and an
    executor's, 256 to 2048 MB."""

    def size(key: str) -> float:
        m = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key, "1g").lower())
        return int(m[1]) * {"k": 2**-10, "": 2**-20, "m": 1, "g": 2**10, "t": 2**20}[m[2]] if m else 1024

    local = spark.sparkContext.master.startswith("local")
    held = size("spark.driver.memory")
    return int(min(2048, max(256, (held if local else min(held, size("spark.executor.memory"))) / 8)))


def forest_estimator(
    encoder: Encoder,
    num_trees: int = NUM_TREES,
    max_depth: int = 30,
    seed: int = FOREST_SEED,
    features_per_split: str | None = None,
    max_bins: int = 32,
    histogram_mb: int = 256,
) -> RandomForestClassifier:
    """The forest over encoded rows. ``max_depth`` 30 is Spark's cap (the analysis grows
    trees fully). Node ids are kept per row, so a round does not walk the trees again."""
    return RandomForestClassifier(
        labelCol="__label",
        featuresCol="__features",
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=max(max_bins, encoder.widest()),
        # the whole part of the square root, at least 1 (Spark's "sqrt" rounds up)
        featureSubsetStrategy=features_per_split or str(max(1, math.isqrt(max(1, len(encoder.features))))),
        seed=seed,
        maxMemoryInMB=histogram_mb,
        cacheNodeIds=True,
    )


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the cores by key, in key order, and held in memory. The deal is the same
    every time (a forest's sampling goes by place), and a lost executor costs a re-read."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


def _training_rows(train: DataFrame, encoder: Encoder, label: str, key: str) -> DataFrame:
    """Encoded labelled rows, prepared once for all trees."""
    number = F.array_position(F.array(*[F.lit(x) for x in encoder.labels]), F.col(label)) - 1
    rows = encoder.transform(train.filter(F.col(label).isNotNull()), key, label)
    rows = rows.select(key, label, number.cast("double").alias("__label"), "__features")
    return materialize(rows, "forest_rows")


def _cuts(known: DataFrame, encoder: Encoder, max_bins: int) -> dict[int, list[float]]:
    """Where trees may cut each number: between any two of its values, or at ``max_bins`` quantiles
    if it has more values than bins."""
    numbers = [i for i, c in enumerate(encoder.features) if c not in encoder.nominal]
    if not numbers:
        return {}
    each = known.select(F.posexplode(vector_to_array("__features")).alias("feature", "v"))
    values = each.filter(F.col("feature").isin(numbers)).distinct()
    counted = {r["feature"]: r["count"] for r in values.groupBy("feature").count().collect()}
    few = [i for i in numbers if counted.get(i, 0) <= max_bins]
    held: dict[int, list[float]] = {i: [] for i in numbers}
    for r in values.filter(F.col("feature").isin(few)).collect() if few else []:
        held[r["feature"]].append(r["v"])
    cuts = {i: [(a + b) / 2 for a, b in zip(sorted(held[i]), sorted(held[i])[1:])] for i in few}
    if wide := [i for i in numbers if i not in cuts]:
        columns = known.select(vector_to_array("__features").alias("v")).select(*[F.get("v", F.lit(i)).alias(f"v{i}") for i in wide])
        quantiles = columns.approxQuantile(columns.columns, [j / max_bins for j in range(1, max_bins)], 1e-3)
        cuts |= {i: sorted(set(q)) for i, q in zip(wide, quantiles)}
    return cuts


def _binned(rows: DataFrame, encoder: Encoder, cuts: dict[int, list[float]]) -> DataFrame:
    """``rows`` with ``__bins`` in place of ``__features``: the code of a nominal value, the number of
    cuts below a number."""

    def of(i: int, c: str) -> Column:
        v = F.get("__values", F.lit(i))
        if c in encoder.nominal:
            return v.cast("int")
        if not cuts[i]:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[i]]), lambda t: t < v))

    bins = F.array(*[of(i, c) for i, c in enumerate(encoder.features)]).cast("array<int>")
    out = rows.withColumn("__values", vector_to_array("__features")).withColumn("__bins", bins)
    return out.drop("__values", "__features")


def _cell_votes(
    encoder: Encoder,
    drawn: DataFrame,
    judged: DataFrame,
    num_trees: int,
    bag_trees: int,
    seed: int,
    max_depth: int = 30,
    features_per_split: str | None = None,
) -> DataFrame | None:
    """(bag, __bins, v0, v1): votes of all trees on each cell of ``drawn`` and ``judged``, or None
    where cells do not serve: with other than two classes, or more cells than :data:`HELD_NUMBERS`
    lets tasks hold. ``drawn`` has (__bins, __label, bag, weight) per training row and bag."""
    tried = features_per_split or str(max(1, math.isqrt(max(1, len(encoder.features)))))
    if len(encoder.labels) != 2 or not encoder.features or not tried.isdigit():
        return None
    rows = [F.count(F.when(F.col("__label") == c, 1)).alias(f"n{c}") for c in (0, 1)]
    counted = materialize(drawn.groupBy("bag", "__bins", "weight").agg(*rows), "forest_cells")
    every = materialize(counted.select("__bins").union(judged.select("__bins")).distinct(), "forest_bins")
    numbers = every.count() * (len(encoder.features) + 4) + counted.count() * 5
    if numbers > HELD_NUMBERS:
        return None
    # bounded: a single-partition window is fine here
    place = (F.row_number().over(Window.orderBy("__bins")) - 1).alias("cell")
    numbered = materialize(every.select("__bins", place), "forest_bins")
    bins = numbered.orderBy("cell").select("__bins").toArrow()["__bins"].combine_chunks().flatten()
    groups = counted.join(numbered, "__bins").select("bag", "cell", "weight", "n0", "n1").orderBy("bag", "cell", "weight")
    table = {c: v.to_numpy() for c, v in zip(("bag", "cell", "weight", "n0", "n1"), groups.toArrow().columns)}
    of = {b: table["bag"] == b for b in range(-(-num_trees // bag_trees))}
    held = cells.Cells(
        bins.to_numpy().reshape(-1, len(encoder.features)),
        np.array([c in encoder.nominal for c in encoder.features]),
        {b: tuple(table[c][mine] for c in ("cell", "weight", "n0", "n1")) for b, mine in of.items()},
    )
    votes = cells.forest_votes(drawn.sparkSession, held, num_trees, bag_trees, seed, int(tried), max_depth)
    return materialize(votes.join(numbered, "cell").select("bag", "__bins", "v0", "v1"), "forest_votes")


@dataclass(frozen=True)
class Forest:
    """A fitted forest with its encoder."""

    encoder: Encoder
    trees: RandomForestClassificationModel | None


def fit_forest(train: DataFrame, label: str = "Highly_Liked", key: str = "business_id", **kw) -> Forest:
    """Encode and fit in one piece (for forests whose trees fit the driver; see
    :func:`grow_and_score`). With fewer than two classes there is nothing to fit."""
    encoder = fit_encoder(train, label)
    if len(encoder.labels) < 2:
        return Forest(encoder, None)
    rows = _spread(_training_rows(train, encoder, label, key), key)
    try:
        return Forest(encoder, forest_estimator(encoder, histogram_mb=_histogram_mb(train.sparkSession), **kw).fit(rows))
    finally:
        rows.unpersist()


def _votes(forest: Forest, rows: DataFrame, *keep: str) -> DataFrame:
    """Votes per class of encoded rows, as exact decimals so that sums do not depend on order."""
    raw = vector_to_array("rawPrediction")
    return forest.trees.transform(rows).select(*keep, F.transform(raw, lambda v: v.cast("decimal(28,12)")).alias("__v"))


def _winner(encoder: Encoder, votes: Column) -> Column:
    """Of equal votes the first label, as in the forest's own prediction."""
    place = F.array_position(votes, F.array_max(votes))
    return F.element_at(F.array(*[F.lit(x) for x in encoder.labels]), place.cast("int"))


def score(forest: Forest, test: DataFrame, label: str = "Highly_Liked", key: str = "business_id") -> DataFrame:
    """Predicted label per held-out row (``prediction`` as the label text; the only label
    there is, or NULL, where nothing was fitted). The true label is no input."""
    if forest.trees is None:
        only = F.lit(forest.encoder.labels[0] if forest.encoder.labels else None).cast("string")
        return test.select(key, label, only.alias("prediction"))
    scored = _votes(forest, forest.encoder.transform(test, key, label), key, label)
    return scored.select(key, label, _winner(forest.encoder, F.col("__v")).alias("prediction"))


def grow_and_score(
    train: DataFrame,
    test: DataFrame,
    label: str = "Highly_Liked",
    key: str = "business_id",
    num_trees: int = NUM_TREES,
    seed: int = FOREST_SEED,
    batch_trees: int = BATCH_TREES,
    batches_at_once: int = BATCHES_AT_ONCE,
    **kw,
) -> DataFrame:
    """Predicted label per held-out row by a forest of ``num_trees`` trees. Rows are encoded
    once, and trees grow from their counted cells (:mod:`homerange.operators.cells`), so the time
    does not follow the product of rows and trees. Where cells do not serve, Spark's own forest grows
    from the rows, ``batch_trees`` trees at a time (batch i with seed ``seed + i``),
    ``batches_at_once`` batches side by side. Either way only votes per class are kept, whose sums
    are the whole forest's. ``key`` must be unique."""
    encoder = fit_encoder(train, label)
    if len(encoder.labels) < 2:
        return score(Forest(encoder, None), test, label, key)
    known = _training_rows(train, encoder, label, key)
    unseen = materialize(encoder.transform(test, key, label), "forest_unseen")
    max_bins = max(kw.get("max_bins", 32), encoder.widest())
    cuts = _cuts(known, encoder, max_bins)
    drawn = _binned(known, encoder, cuts).select("__bins", "__label", F.lit(0).alias("bag"), F.lit(1).alias("weight"))
    judged = _binned(unseen, encoder, cuts)
    one_bag = {k: v for k, v in kw.items() if k != "max_bins"}
    votes = _cell_votes(encoder, drawn, judged, num_trees, num_trees, seed, **one_bag)
    if votes is not None:
        both = F.array(*[F.col(v).cast("decimal(28,0)") for v in ("v0", "v1")]).alias("__v")
        return _tally(judged.join(votes.select("__bins", both), "__bins"), encoder, label, key)
    known = _spread(known, key)
    histogram_mb = max(256, _histogram_mb(train.sparkSession) // batches_at_once)

    def grow(i: int) -> DataFrame:
        trees = min(batch_trees, num_trees - i * batch_trees)
        estimator = forest_estimator(encoder, num_trees=trees, seed=seed + i, histogram_mb=histogram_mb, **kw)
        return materialize(_votes(Forest(encoder, estimator.fit(known)), unseen, key, label), "forest_votes")

    try:
        with ThreadPoolExecutor(batches_at_once) as pool:
            grown = list(pool.map(grow, range(-(-num_trees // batch_trees))))
    finally:
        known.unpersist()
    votes = grown[0]
    for more in grown[1:]:
        votes = votes.unionByName(more)
    return _tally(votes, encoder, label, key)


def _tally(votes: DataFrame, encoder: Encoder, label: str, key: str) -> DataFrame:
    """(key, label, prediction) from rows with votes per class in ``__v``."""
    sums = [F.sum(F.get("__v", F.lit(c))).alias(f"__{c}") for c in range(len(encoder.labels))]
    total = votes.groupBy(key, label).agg(*sums)
    each = F.array(*[F.col(f"__{c}") for c in range(len(encoder.labels))])
    return total.select(key, label, _winner(encoder, each).alias("prediction"))


#: A row's number of draws in a bag: how many of these its 48-bit hash reaches. They are the
#: cumulative chances of 0, 1, 2, ... draws when n rows are drawn n times (Poisson, mean 1).
BAG_CUTS = tuple(
    int(2**48 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(9)
)


def bag_weight(key: str, bag: int | Column, seed: int = FOREST_SEED) -> Column:
    """How often the row ``key`` is drawn into a bag: a pure function of key, bag and seed. Nothing
    is stored to know later which rows a bag never saw, and a bag that is built again after a lost
    executor, or with other partitions, is the same bag."""
    number = bag if isinstance(bag, Column) else F.lit(bag)
    text = F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)), number.cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return sum((F.when(h >= F.lit(cut), F.lit(1)).otherwise(F.lit(0)) for cut in BAG_CUTS[1:]), F.when(h >= F.lit(BAG_CUTS[0]), F.lit(1)).otherwise(F.lit(0)))


def bag_sizes(rows: DataFrame, bags: int, key: str = "business_id", seed: int = FOREST_SEED) -> DataFrame:
    """(bag, n_in, n_out, draws) of every bag over ``rows``."""
    each = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"))
    w = bag_weight(key, F.col("bag"), seed)
    each = each.select("bag", w.cast("long").alias("w"))
    return each.groupBy("bag").agg(
        F.count(F.when(F.col("w") > 0, 1)).alias("n_in"), F.count(F.when(F.col("w") == 0, 1)).alias("n_out"), F.sum("w").alias("draws")
    )


def _row_votes(
    rows: DataFrame, encoder: Encoder, label: str, key: str, bags: int, bag_trees: int, seed: int, batches_at_once: int, **kw
) -> DataFrame:
    """Votes ``__v`` of each bag on the rows it never drew, by Spark's own forest from the rows."""
    rows = _spread(rows, key)
    histogram_mb = max(256, _histogram_mb(rows.sparkSession) // batches_at_once)

    def grow(bag: int) -> DataFrame:
        drawn = rows.withColumn("__weight", bag_weight(key, bag, seed).cast("double"))
        estimator = forest_estimator(encoder, num_trees=bag_trees, seed=seed + bag, histogram_mb=histogram_mb, **kw)
        trees = estimator.setWeightCol("__weight").fit(drawn.filter("__weight > 0"))
        return materialize(_votes(Forest(encoder, trees), drawn.filter("__weight = 0"), key, label), "forest_votes")

    try:
        with ThreadPoolExecutor(batches_at_once) as pool:
            grown = list(pool.map(grow, range(bags)))
    finally:
        rows.unpersist()
    votes = grown[0]
    for more in grown[1:]:
        votes = votes.unionByName(more)
    return votes


def out_of_bag(
    train: DataFrame,
    label: str = "Highly_Liked",
    key: str = "business_id",
    num_trees: int = OOB_TREES,
    bag_trees: int = OOB_BAG_TREES,
    seed: int = FOREST_SEED,
    batches_at_once: int = BATCHES_AT_ONCE,
    **kw,
) -> DataFrame:
    """(key, label, votes, prediction) of the labelled rows by the trees that never saw them.

    Trees are grown in bags of ``bag_trees``; a bag's trees draw their samples from the rows with a
    :func:`bag_weight` above 0, by weight, and vote on the rows with weight 0. ``votes`` is the
    number of trees that voted on a row; without any its prediction is NULL. Bags do not depend on
    each other: any may be grown again, or side by side. Trees grow from counted cells, as in
    :func:`grow_and_score`. ``key`` must be unique."""
    encoder = fit_encoder(train, label)
    labelled = train.filter(F.col(label).isNotNull())
    if len(encoder.labels) < 2:
        return score(Forest(encoder, None), labelled, label, key).select(key, label, F.lit(0).cast("long").alias("votes"), "prediction")
    rows = _training_rows(train, encoder, label, key)
    bags = -(-num_trees // bag_trees)
    cuts = _cuts(rows, encoder, max(kw.get("max_bins", 32), encoder.widest()))
    binned = _binned(rows, encoder, cuts)
    each = binned.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    each = each.withColumn("weight", bag_weight(key, F.col("bag"), seed))
    per_bag = {k: v for k, v in kw.items() if k != "max_bins"}
    told = _cell_votes(encoder, each.filter("weight > 0"), binned, bags * bag_trees, bag_trees, seed, **per_bag)
    if told is not None:
        both = F.array(*[F.col(v).cast("decimal(28,0)") for v in ("v0", "v1")]).alias("__v")
        votes = each.filter("weight = 0").join(told.select("bag", "__bins", both), ["bag", "__bins"])
    else:
        votes = _row_votes(rows, encoder, label, key, bags, bag_trees, seed, batches_at_once, **kw)
    classes = range(len(encoder.labels))
    total = votes.groupBy(key).agg(
        *[F.sum(F.get("__v", F.lit(c))).alias(f"__{c}") for c in classes], F.count(F.lit(1)).alias("bags")
    )
    each = F.array(*[F.col(f"__{c}") for c in classes])
    told = total.select(key, (F.col("bags") * bag_trees).alias("votes"), _winner(encoder, each).alias("prediction"))
    return labelled.select(key, label).join(told, key, "left").select(
        key, label, F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "prediction"
    )


def out_of_bag_error(scored: DataFrame, label: str = "Highly_Liked") -> DataFrame:
    """One row: rows, rows that trees voted on, wrong votes among these and their share."""
    judged = F.col("prediction").isNotNull() & (F.col("votes") > 0)
    wrong = judged & (F.col("prediction") != F.col(label))
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(judged, 1)).alias("n_judged"), F.count(F.when(wrong, 1)).alias("n_wrong")
    )
    return counts.withColumn("error", F.when(F.col("n_judged") > 0, F.col("n_wrong") / F.col("n_judged")))


def confusion(scored: DataFrame, label: str = "Highly_Liked", prediction: str = "prediction") -> DataFrame:
    """Counts per (truth, prediction)."""
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_rates(
    scored: DataFrame,
    positive: str = "N",
    label: str = "Highly_Liked",
    prediction: str = "prediction",
) -> DataFrame:
    """One row of counts and rates for ``positive`` as the positive
    class: accuracy, sensitivity (recall), specificity, positive and
    negative predictive value. ``published_*`` are the two rates with truth
    and prediction swapped, as the analysis passed them (its "sensitivity"
    is the precision of the positive class)."""
    t, p = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)

    def n(cond):
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")

    counts = scored.agg(
        n(t & p).alias("tp"), n(t & ~p).alias("fn"), n(~t & p).alias("fp"), n(~t & ~p).alias("tn")
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))

    def ratio(a, b):
        return F.when(b > 0, a / b)

    return counts.select(
        (tp + fn + fp + tn).alias("n"),
        "tp",
        "fn",
        "fp",
        "tn",
        ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(tp, tp + fp).alias("published_sensitivity"),
        ratio(tn, tn + fn).alias("published_specificity"),
    )
