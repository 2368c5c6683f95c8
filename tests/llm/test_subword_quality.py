"""The quality classifier: features against a plain version, accuracy, defined results."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from homerange.llm import subword_quality as quality
from tests.conftest import SF_CHECK

from . import cases

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def plain_features(text: str, bits: int) -> Counter:
    def bucket(h: int, kind: int) -> int:
        x = (h + kind) * 0xD6E8FEB86659FD93 & MASK
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
        return (x >> (64 - bits)) % ((1 << bits) - 1) + 1

    white = " \t\n\x0b\x0c\r"
    c = [0] + [10 if ch == "\n" else 32 if ch in white else ord(ch) if ch != "\0" else 1 for ch in text] + [0]
    c[0], c[-1] = 32, 32
    out = Counter([0])
    for n in (3, 4):
        for i in range(len(c) - n + 1):
            if n >= len(c) and len(c) == n:
                continue  # from border to border
            h = 0
            for x in c[i : i + n]:
                h = (h * ODD + x) & MASK
            out[bucket(h, n)] += 1
    words = cases.WORD.findall(text.replace("\0", "\1"))
    hashes = [sum(ord(ch) * pow(ODD, j, 1 << 64) for j, ch in enumerate(w)) & MASK for w in words]
    out.update(bucket(h, 1) for h in hashes)
    out.update(bucket(a ^ b, 2) for a, b in zip(hashes, hashes[1:]))
    return out


def test_features_match_plain_version():
    texts = [t or "" for t in cases.texts()] + ["ab", "a b", "x\0y z\nq", "  nb", "again again again"]
    got = [Counter() for _ in texts]
    for at, bucket in quality.features(texts, 12):
        for a, b in zip(at.tolist(), bucket.tolist()):
            got[a][b] += 1
    for t, g in zip(texts, got):
        assert g == plain_features(t, 12), t[:40]


def test_a_repeated_word_is_one_feature_whatever_the_word():
    pairs = [[b for _, b in quality.features([f"{w} {w}"], 16)][-1] for w in ("one", "Ünï", "zebra")]
    assert len({int(p[0]) for p in pairs}) == 1


def test_pieces_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(quality, "PIECE_CHARS", 10)
    for text in ("", "a" * 95, "word " * 40, "\n".join(["line of words"] * 9)):
        assert "".join(quality.pieces(text)) == text
    table = np.random.default_rng(0).normal(size=1 << 10)
    model = quality.Model(table.tobytes(), 0.1, 10)
    texts = ["word " * 40, None, "b" * 300, ""]
    together = model.scorer()(texts)[0]
    assert np.allclose(together, [model.scorer()([t])[0][0] for t in texts])
    assert together[1] == together[3]


def test_megabytes_of_text():
    model = quality.Model(np.full(1 << 10, 0.01).tobytes(), 0.0, 10)
    long = cases.PROSE * 30_000
    got = model.scorer()([long, "x" * 2_500_000, "short"])[0]
    assert got.shape == (3,) and np.allclose(got, 1 / (1 + np.exp(-0.01)))


def test_held_out_accuracy(spark):
    rows = quality.query(spark, SF_CHECK).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in judged if y == 1]
    bad = [p for y, p in judged if y == 0]
    assert len(judged) > 20 and sum(good) >= 0.95 * len(good)
    assert sum(p == 0 for p in bad) >= 0.6 * len(bad)


def labelled(spark):
    docs = [(i, (f"calm words of number {i} stand here " if i % 2 else f"### buy !!! {i} ### now !!! ") * 4) for i in range(80)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, i % 2) for i, _ in docs] + [(3, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int"),
    )


def test_learning_is_repeatable_and_edges(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels, bits=10)
    assert model == quality.learn(docs.repartition(5), labels.repartition(3), bits=10)
    awkward = cases.rows(spark)
    out = quality.score(awkward, model)
    assert out.count() == awkward.count() and out.columns.count("score") == 1
    by_id = {r.doc_id: r.score for r in out.collect()}
    assert by_id[0] == by_id[1]
    assert quality.score(cases.empty(spark), model).count() == 0


@pytest.mark.parametrize("wanted, score", [(None, 0.5), (1, 1.0), (0, 0.0)])
def test_few_labels(spark, wanted, score):
    docs, labels = labelled(spark)
    some = labels.filter("false") if wanted is None else labels.filter(f"quality = {wanted}")
    model = quality.learn(docs, some, bits=8)
    got = {round(r.score, 6) for r in quality.score(docs, model).collect()}
    assert got == {score}
