"""Quality classifier: supervised subword embeddings.

Every text is a bag of hashed features: character n-grams (over word and line borders
too), words, and pairs of neighbouring words. A pair's hash is the exclusive or of its
two words' hashes, so a word followed by itself is one and the same feature whatever the
word. Each of ``2 ** bits`` buckets has a learned vector; a document is the average of
its features' vectors (every occurrence counts), a softmax layer turns it into the
probabilities of the labels, and plain stochastic gradient descent in numpy learns both.

Learning takes at most ``max_labelled`` labelled documents, drawn by a hash of their id
(a documented bound on fitting rows; every text of them is read whole). Their features
are worked out on the executors; one task runs the descent over the bounded sample, and
only the learned table reaches the driver. As the softmax layer is linear, a bucket's
share in the logit is one number, so scoring adds up one table entry per feature.

Hashing works on whole arrays of code points. Texts over :data:`PIECE_CHARS` characters
are worked through in pieces cut behind white space (features do not reach over a cut),
so memory does not follow the length of a text; a word longer than that is one piece.

Defined results. A null or empty text has no features but the one that every text has
(its end mark), and gets that one's score. Without usable labels, or with one label
only, every score is 0.5 or the share that this label stands for (0 or 1). Repeated rows
are scored one by one and alike; repeated label rows count once; of a document labelled
both ways both rows count. Rows with a null id can be scored but teach nothing. Equal
draw hashes are ordered by id. An empty table gives an empty table. Other columns are
passed on; one named like a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import append_columns, fold, read, ship

PIECE_CHARS = 1_000_000
#: Lengths of character n-grams.
CHAR_GRAMS = (3, 4)
_SPACE = re.compile(r"[ \t-\r]")
_BORDER = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray, bits: int, kind: int) -> np.ndarray:
    """Bucket of each hash; bucket 0 is left to the end mark."""
    x = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(64 - bits)) % np.uint64((1 << bits) - 1) + np.uint64(1)).astype(np.int32)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about :data:`PIECE_CHARS`, cut behind white space."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        m = _SPACE.search(text, start + PIECE_CHARS)
        end = m.end() if m else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def features(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all features of the texts, one pair of arrays per kind.

    The texts lie in one array of code points with a border between them. Word hashes
    are differences of prefix sums of ``c * r**i``, taken back to ``r**0``."""
    n = len(texts)
    yield np.arange(n), np.zeros(n, np.int32)
    joined = "\0" + "\0".join(t.replace("\0", "\1") for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    border = c == _BORDER
    owner = np.cumsum(border) - 1
    space = border | (c == 32) | ((c >= 9) & (c <= 13))
    c[space & (c != 10)] = 32
    for size in CHAR_GRAMS:
        m = len(c) - size + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        inside = np.ones(m, bool)
        for j in range(size):
            h = h * _ODD + c[j : j + m]
            if 0 < j < size - 1:
                inside &= ~border[j : j + m]
        # a gram may start or end at a border, but not hold one
        inside &= ~(border[:m] & border[size - 1 :])
        yield owner[:m][inside], _spread(h[inside], bits, size)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    power = np.full(len(c) + 1, _ODD, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(c) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * power[:-1])))
    word = (sums[ends] - sums[starts]) * inverse[starts]
    at = owner[starts]
    yield at, _spread(word, bits, 1)
    same = at[1:] == at[:-1]
    yield at[1:][same], _spread((word[1:] ^ word[:-1])[same], bits, 2)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of the texts, about :data:`PIECE_CHARS` characters at a time, with the
    number of the text each belongs to."""
    numbers, held, chars = [], [], 0
    for i, t in enumerate(texts):
        for piece in pieces(t or ""):
            numbers.append(i)
            held.append(piece)
            chars += len(piece) + 1
            if chars >= PIECE_CHARS:
                yield numbers, held
                numbers, held, chars = [], [], 0
    if held:
        yield numbers, held


@dataclass(frozen=True)
class Model:
    """A bucket's share in the logit of label 1 against label 0, and the bias."""

    table: bytes
    bias: float
    bits: int

    def scorer(self):
        table = np.frombuffer(self.table, "<f8")

        def score(texts: list[str | None]) -> list[np.ndarray]:
            total = np.zeros(len(texts))
            count = np.zeros(len(texts))
            for numbers, held in _groups(texts):
                which = np.asarray(numbers)
                for at, bucket in features(held, self.bits):
                    total += np.bincount(which[at], table[bucket], len(texts))
                    count += np.bincount(which[at], minlength=len(texts))
            return [1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))]

        return score


def descend(
    labels: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], bits: int, dim: int, epochs: int, rate: float, seed: int
) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (buckets, counts) of the documents, one document
    a step, the rate falling to zero. Returns the bucket table and the bias of the
    logit. A document's vector is the average over its features; a bucket's step is its
    share in the average times the square root of the number of distinct buckets, which
    keeps steps of short and long documents alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0, 1.0, (1 << bits, dim)) / dim
    out, bias = np.zeros((2, dim)), np.zeros(2)
    shares = [counts / counts.sum() for _, counts in docs]
    norms = [1.0 / max(float(s @ s), 1e-12) for s in shares]
    target = np.eye(2)[labels]
    step, steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1.0 - step / steps)
            step += 1
            ids, share = docs[i][0], shares[i]
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = target[i] - p
            back = g @ out
            out += lr * np.outer(g, hidden)
            bias += 0.1 * lr * g
            vectors[ids] += (lr * np.sqrt(norms[i])) * np.outer(share, back)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 4000,
    bits: int = 16,
    dim: int = 8,
    epochs: int = 5,
    rate: float = 1.0,
    seed: int = 12,
) -> Model:
    """A model of ``label_col`` (0 or 1) from the texts of the labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    drawn = usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    # at most max_labelled rows: bounded, so the texts are not shuffled
    held = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = held.join(F.broadcast(drawn), "id").select("id", "label", "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = []
                for _, texts in _groups([b.column(2)[i].as_py()]):
                    found += [bucket for _, bucket in features(texts, bits)]
                ids, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([ids.astype("<i4").tobytes()]),
                     pa.array([counts.astype("<i4").tobytes()])],
                    names=["id", "label", "buckets", "counts"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, bags = [], []
        for b in batches:
            y += b.column(1).to_pylist()
            bags += [
                (np.frombuffer(i, "<i4"), np.frombuffer(n, "<i4"))
                for i, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            ]
        if len(set(y)) < 2:
            table, bias = np.zeros(1 << bits), (100.0 * (2 * y[0] - 1) if y else 0.0)
        else:
            table, bias = descend(np.asarray(y), bags, bits, dim, epochs, rate, seed)
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.astype("<f8").tobytes()]), pa.array([float(bias)])], names=["table", "bias"]
        )

    id_type = held.schema["id"].dataType.simpleString()
    bags = sample.mapInArrow(bag, f"id {id_type}, label int, buckets binary, counts binary")
    # the bounded sample in one task, in an order of its own, so the fit can be repeated
    one = bags.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", F.md5("buckets"), F.md5("counts"))
    r = one.mapInArrow(fit, "table binary, bias double").first()
    return Model(bytes(r["table"]), float(r["bias"]), bits) if r else Model(np.zeros(1 << bits).tobytes(), 0.0, bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``score``, the probability of label 1."""
    schema = T.StructType([T.StructField("score", T.DoubleType())])
    return append_columns(docs, F.col(f"`{text_col}`"), model.scorer, schema, keep=keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: quality of every whole text of ``documents``."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    known = docs.filter(~held_out)
    model = learn(known, read(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
