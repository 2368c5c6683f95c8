"""Toxicity: maximum-scoring segments of token log-odds.

Learning. From labelled texts (``max_labelled`` at most, drawn by a hash of the
text) the documents that hold each token, and each token's leading four to six
letters, are counted by label. The log-odds of a feature under both labels are
smoothed with a Dirichlet prior in proportion to its frequency; features whose
log-odds stand ``min_z`` standard errors from zero are kept. Those above it add their
log-odds, those below it cost theirs besides the drift that every other token costs.

Scoring. One linear scan over a text's tokens finds all maximal segments of the
running score (no segment can be made better by a longer or shorter one). A segment's
score is set against the extreme-value law of the best segment of a clean text of the
same length, S' = lambda S - ln(K n); the segments that clean text would be expected to
hold ``significance`` times or less are the toxic passages. The sum over the segments
that stand out, passed through a logistic curve fitted to the training labels, is the
document's score. The curve allows for a share of wrong labels on either side: were they
fitted as well, a few texts marked toxic without one toxic word, or clean in spite of
long passages, would flatten it for all.

Defined results. A null text or one without letters has no tokens: no segments, the
lowest score. Without usable labels every score is 0. Repeated rows are scored one by
one; a repeated label row counts twice; an empty table gives an empty table. Columns
other than the text are passed on (one named like a result column is replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import Memo, append_columns, fold, read, worker_object
from homerange.session import materialize

TOKEN = re.compile(r"[^\W\d_]+")
#: Leading letters that count as features besides the whole token.
PREFIXES = (6, 5, 4)
#: Distinct tokens that a Python worker remembers (see Memo).
MEMO = 100_000


@dataclass(frozen=True)
class Settings:
    """``prior``: weight of the Dirichlet prior as a share of the documents learned
    from. ``cost``: what a token without evidence takes off the running score.
    ``max_score``: what a feature's log-odds count at most, either way. The k-th
    occurrence of a token in a passage adds a k-th of its score, so that one word said
    over and over does not decide alone; what stands before a passage does not count
    for that. ``max_labelled`` and ``max_features`` bound the sample learned from and
    the size of the model; ``significance`` is an expected number of segments."""

    max_labelled: int = 40_000
    max_features: int = 20_000
    prior: float = 0.03
    min_z: float = 3.0
    min_docs: int = 3
    cost: float = 2.0
    max_score: float = 6.0
    significance: float = 0.05


@dataclass(frozen=True)
class Model:
    """``scores``: feature -> score, below zero for tokens that speak against toxicity;
    features of k leading letters are written with a trailing ``*``. ``lam``, ``k``: of
    the extreme-value law; ``a``, ``b``: of the logistic curve."""

    scores: tuple[tuple[str, float], ...] = ()
    cost: float = 2.0
    lam: float = 1.0
    k: float = 0.1
    a: float = -50.0
    b: float = 0.0
    settings: Settings = field(default_factory=Settings)


def maximal_segments(positions: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence in which the
    tokens at ``positions`` have the given ``scores`` and every other token -``cost``.
    Linear: each candidate is joined to or covered by a later one at most once."""
    found: list[list[float]] = []  # first, last, sum before it, sum at its end
    total, at = 0.0, -1
    for p, s in zip(positions, scores, strict=True):
        total -= cost * (p - at - 1)
        left, total, at = total, total + s, p
        if s <= 0:
            continue
        first = p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append([first, p, left, total])
                break
            first, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(f), int(e), r - l) for f, e, l, r in found]


def damped_segments(
    words: list[str], positions: list[int], scores: list[float], cost: float
) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(scores as they count, segments). Inside each maximal segment the k-th occurrence
    of a token counts a k-th; counting starts anew where the running score has come down
    to zero, so that nothing before a passage, nor another passage, takes from its tokens."""
    counted, found, k = [], [], 0
    for first, last, _ in maximal_segments(positions, scores, cost):
        while positions[k] < first:
            counted.append(scores[k])
            k += 1
        total, before, seen, start = 0.0, first - 1, {}, k
        while k < len(positions) and positions[k] <= last:
            total -= cost * (positions[k] - before - 1)
            before = positions[k]
            if total <= 0:
                total, seen = 0.0, {}
            s = scores[k]
            if s > 0:
                w = words[before]
                seen[w] = n = seen.get(w, 0) + 1
                s /= n
            total += s
            counted.append(s)
            k += 1
        at = [p - first for p in positions[start:k]]
        found += [(first + x, first + y, s) for x, y, s in maximal_segments(at, counted[start:k], cost)]
    return counted + scores[k:], found


class Scorer:
    """``scan(text)`` -> (number of tokens, scores of those with evidence, segments)."""

    def __init__(self, model: Model):
        self.model = model
        self.features = dict(model.scores)
        self.memo = Memo(MEMO)

    def token(self, w: str) -> float:
        if w in self.features:
            return self.features[w]
        return max((self.features.get(w[:k] + "*", 0.0) for k in PREFIXES if len(w) > k), default=0.0)

    def scan(self, text: str | None) -> tuple[int, list[float], list[tuple[int, int, float]]]:
        words = TOKEN.findall(text.lower()) if text else []
        new = self.memo.missing(set(words))
        memo = self.memo.now
        memo.update((w, self.token(w)) for w in new)
        scores = list(map(memo.__getitem__, words))
        positions = [i for i, s in enumerate(scores) if s]
        hits = [scores[i] for i in positions]
        return len(words), *damped_segments(words, positions, hits, self.model.cost)

    def above(self, n: int, score: float) -> float:
        """The normalised score: minus the logarithm of how many segments of that score
        or higher a clean text of ``n`` tokens is expected to hold."""
        return self.model.lam * score - math.log(self.model.k * max(n, 1) + 1.0)

    def evidence(self, n: int, segments: list[float]) -> float:
        """Sum of the segments' normalised scores, as long as they stand out."""
        best = self.above(n, max(segments, default=0.0))
        return max(best, sum(x for x in (self.above(n, s) for s in segments) if x > 0))

    def score(self, text: str | None) -> tuple[float, int, list]:
        n, _, segments = self.scan(text)
        x = self.model.a + self.model.b * self.evidence(n, [s for _, _, s in segments])
        p = 1.0 / (1.0 + math.exp(-min(max(x, -700.0), 700.0))) if self.model.scores else 0.0
        least = -math.log(self.model.settings.significance)
        return p, n, [{"first": a, "last": b, "score": s} for a, b, s in segments if self.above(n, s) >= least]


def worker_scorer(model: Model) -> Scorer:
    return worker_object(model, lambda: Scorer(model))


def _features(text_col: str):
    """The distinct tokens of a text and their leading letters."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), 1))
    long = [
        F.array_distinct(
            F.transform(
                F.filter(tokens, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))
            )
        )
        for k in PREFIXES
    ]
    return F.concat(tokens, *long)


def _fit_law(n: int, hits: list[tuple[float, int]], segments: list[tuple[float, int]], cost: float) -> tuple[float, float]:
    """lambda and K of the extreme-value law from clean texts of ``n`` tokens in all,
    with (score, how often) of their tokens with evidence and of their segments: lambda
    solves E[exp(lambda s)] = 1 for the score s of a token, and K n exp(-lambda S) is
    then the number of segments that reach their median score."""
    if not n or not any(h > 0 for h, _ in hits) or not segments:
        return 1.0, 1e-3
    score, often = (np.array(c, dtype=float) for c in zip(*hits, strict=True))
    rest = 1 - often.sum() / n
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        value = rest * math.exp(-mid * cost) + float((often * np.exp(np.minimum(mid * score, 600))).sum()) / n
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    lam = max(lo, 1e-2)
    reached, half = 0, sum(c for _, c in segments) / 2
    for median, c in sorted(segments, reverse=True):
        reached += c
        if reached >= half:
            break
    return lam, min(max(reached / (n * math.exp(-lam * median)), 1e-6), 1.0)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with a small ridge so that separable labels
    give a finite one."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = p * (1 - p) + 1e-9
        ga, gb = (y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b
        haa, hab, hbb = w.sum() + 1e-3, (w * x).sum(), (w * x * x).sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + scale * da, b + scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return float(a), float(b)


def _fit_noisy_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logistic curve of the labels behind the given ones, of which a share of the
    0s and of the 1s is marked the other way. By turns, each label's chance of being what
    it says is worked out, and curve and shares are fitted to that. In the result both
    labels weigh the same: at 0.5 a text is as likely among the 1s as among the 0s."""
    a, b = _fit_curve(x, y)
    wrong0 = wrong1 = 0.01
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        as1 = p * np.where(y == 1, 1 - wrong1, wrong1)
        as0 = (1 - p) * np.where(y == 1, wrong0, 1 - wrong0)
        truth = as1 / np.maximum(as1 + as0, 1e-300)
        wrong0 = min(float((y * (1 - truth)).sum() / max((1 - truth).sum(), 1e-9)), 0.4)
        wrong1 = min(float(((1 - y) * truth).sum() / max(truth.sum(), 1e-9)), 0.4)
        a, b = _fit_curve(x, truth)
    return a + math.log(max((1 - truth).sum(), 1.0) / max(truth.sum(), 1.0)), b


def _often(rows: DataFrame, column: str, bins: float = 100.0) -> list[tuple[float, int]]:
    """(number, how often) over the lists of a column, in steps of 1 / ``bins``. Every
    batch is counted where it is; the scores are bounded, so are the rows that reach the
    driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            found, n = np.unique(np.round(numbers * bins).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["bin", "n"])

    each = rows.select(column).mapInArrow(count, "bin long, n long")
    return [(r["bin"] / bins, r["n"]) for r in each.groupBy("bin").agg(F.sum("n").alias("n")).collect()]


def learn(labelled: DataFrame, text_col: str, label_col: str, s: Settings | None = None) -> Model:
    """The model of rows with a text and a 0/1 label; other labels are left out."""
    s = s or Settings()
    rows = labelled.select(
        F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("y")
    ).filter(F.col("text").isNotNull() & F.col("y").isin(0, 1))
    n_all = rows.count()
    if n_all > s.max_labelled:
        share = int(s.max_labelled / n_all * (1 << 30))
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= share)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(settings=s, cost=s.cost)
    toxic_docs = F.sum(F.col("y").cast("long")).alias("n1")
    counts = (
        rows.select("y", F.explode(_features("text")).alias("feature"))
        .groupBy("feature")
        .agg(toxic_docs, F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= s.min_docs)
    )
    # Dirichlet prior in proportion to the feature's share of all documents
    strength = s.prior * (n1 + n0)
    alpha = F.lit(strength) * F.col("n") / F.lit(float(n1 + n0)) + F.lit(0.01)
    y1, y0 = F.col("n1") + alpha, F.col("n") - F.col("n1") + alpha
    odds1 = F.log(y1 / (F.lit(n1 + strength) - y1 + F.lit(0.01)))
    odds0 = F.log(y0 / (F.lit(n0 + strength) - y0 + F.lit(0.01)))
    for_it = (F.col("z") >= s.min_z) & (F.col("delta") > s.cost) & (F.col("n1") >= s.min_docs)
    # whole tokens only: a prefix is looked up where the token itself says nothing
    against = (F.col("z") <= -s.min_z) & ~F.col("feature").endswith("*")
    strong = (
        counts.select("feature", "n1", (odds1 - odds0).alias("delta"), F.sqrt(1 / y1 + 1 / y0).alias("se"))
        .withColumn("z", F.col("delta") / F.col("se"))
        .filter(for_it | against)
        .orderBy(F.desc(F.abs("z")), "feature")
        .limit(s.max_features)
    )
    scores = tuple(
        sorted(
            (r["feature"], min(d, s.max_score) if (d := r["delta"]) > 0 else max(d, -s.max_score) - s.cost)
            for r in strong.collect()
        )
    )
    model = Model(scores=scores, cost=s.cost, settings=s)

    # segments of the training texts: extreme-value law, then the curve
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("hits", numbers),
            T.StructField("segments", numbers),
        ]
    )

    def make():
        scorer = worker_scorer(model)

        def fn(texts):
            got = [scorer.scan(t) for t in texts]
            return [[n for n, _, _ in got], [h for _, h, _ in got], [[x[2] for x in seg] for _, _, seg in got]]

        return fn

    seen = append_columns(rows, F.col("text"), make, schema, keep=["y"]).select("y", "n", "hits", "segments")
    seen = materialize(seen, "segments")
    clean = seen.filter("y = 0")
    tokens = clean.agg(F.sum("n")).first()[0] or 0
    lam, k = _fit_law(tokens, _often(clean, "hits"), _often(clean, "segments"), s.cost)
    model = replace(model, lam=lam, k=k)

    def weigh():
        scorer = worker_scorer(model)
        return lambda rows: [[scorer.evidence(r["n"], r["segments"]) for r in rows]]

    one = T.StructType([T.StructField("evidence", T.DoubleType())])
    # two numbers a row, of max_labelled rows at most; the texts themselves are not needed again
    measures = F.struct(F.lit("").alias("text"), "n", "segments")
    weighed = append_columns(seen, measures, weigh, one, keep=["y"]).select("y", "evidence").collect()
    a, b = _fit_noisy_curve(
        np.array([r["evidence"] for r in weighed]), np.array([r["y"] for r in weighed], dtype=float)
    )
    return replace(model, a=a, b=b)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, if given) with score (0 to 1), n_tokens and passages (first and last token and
    score of every significant segment)."""
    passage = T.StructType(
        [
            T.StructField("first", T.LongType()),
            T.StructField("last", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("score", T.DoubleType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("passages", T.ArrayType(passage)),
        ]
    )

    def make():
        scorer = worker_scorer(model)
        return lambda texts: list(zip(*map(scorer.score, texts), strict=True))

    return append_columns(docs, F.col(f"`{text_col}`").cast("string"), make, schema, keep)


def learn_tables(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    """The model from ``docs`` and the ``labels`` table, without the held-out fold. The
    labels used are ``max_labelled`` at most (those with the least hashes of the id), so
    they can be sent to every task and no text is shuffled to find its label."""
    s = s or Settings()
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(s.max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    return learn(materialize(rows, "labelled"), "text", "toxic", s)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the toxicity of every document, learned from the other folds' labels."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = learn_tables(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
