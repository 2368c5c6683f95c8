"""The operators against brute force, the libraries, or an exact round trip."""

import random
import zlib

import duckdb
import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from homerange.llm import embedding_dedup, packing, quality_rules, sentence_pieces, simhash, suffix_dedup, token_counts
from homerange.llm.token_counts import PrefixCounter, vocabulary_path

from . import cases

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghij THE'strelvm  \n\t.,!?123éßñ😀日▁<|>"


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def samples(n=200, seed=3):
    r = random.Random(seed)
    own = ["", " ", "don't we'll they've 're 'r x", "a<|endoftext|>b <|endo", "\n\n x  y ", "x" * 200, "İ ŉ. (Word),"]
    return own + ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 50))) for _ in range(n)]


def test_token_count_of_every_prefix():
    path = vocabulary_path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = samples()
    for t, got in zip(texts, PrefixCounter(path).counts(texts), strict=True):
        want = [len(library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert list(got) == want, t


def test_sentence_pieces_are_the_librarys():
    path = vocabulary_path(sentence_pieces.VOCABULARY)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Codec(path)
    texts = samples() + [t for _, t in documents()[:60]]
    for t, got in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == library.encode(t)
        assert codec.decode(got) == codec.decode_words([got])[0] == library.decode(ids)


def test_packing(spark):
    library = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    docs = documents() + [(10_000 + k, t) for k, t in enumerate(samples())]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by_doc: dict = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and 2**r.bucket == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}


def test_simhash_classes(spark):
    docs = documents()[:150] + [(900, "a b c d e f g h"), (901, "a b c d e f g h i"), (902, None), (903, "")]
    prints = [cases.fingerprint(t) for _, t in docs]
    want = cases.classes(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, _) in enumerate(docs):
        assert got[i].fingerprint == format(prints[k], "016x")
        assert got[i].component_id == docs[want[k]][0]


def test_gray_index_finds_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (40, 6, 3)).astype(np.uint64)
    prints = np.unique(np.concatenate([base, (base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel()]))
    bucket = np.zeros(len(prints), dtype=np.int64)
    prints = prints[np.argsort(simhash.gray_rank(prints))]
    got = {tuple(sorted(p)) for x, y in simhash.GrayIndex(bucket, prints).close_pairs(4) for p in zip(x.tolist(), y.tolist())}
    n = len(prints)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if int(prints[a] ^ prints[b]).bit_count() <= 4}
    assert got == want


def test_hot_buckets_are_sliced_without_loss(spark):
    prints = [(v << 40 | 7) for v in range(300)]
    frame = spark.createDataFrame([(p,) for p in prints], "simhash long")
    want = cases.classes(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    from homerange.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(frame, slice_rows=16), "a", "b").collect()}
    assert [got.get(p, p) for p in prints] == [prints[k] for k in want]


def test_passages(spark, monkeypatch):
    docs = documents()[:80] + [(500 + k, t) for k, t in enumerate(cases.texts())] + [(700, "\0" * 80), (701, "\0" * 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = cases.passages(docs)
    for kw in ({}, {"batch_bytes": 20_000, "hot_places": 3}):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removals(frame, **kw).collect()}
        assert got == want
        monkeypatch.setattr(suffix_dedup, "SPLIT_ROWS", 2)  # the second time with split keys


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    data = [*base, *(base[:30] + r.normal(size=(30, 16)) * 0.08), *base[:5], *(3 * base[:3])]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    unit = np.array(data) / np.linalg.norm(data, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    want = cases.classes(len(data), lambda a, b: close[a, b])
    for kw in ({}, {"cell_rows": 10, "block_rows": 4}):
        got = {x.vec_id: x for x in embedding_dedup.near_duplicates(frame, **kw).collect()}
        assert [got[k].n_links for k in range(len(data))] == close.sum(axis=1).tolist()
        assert [got[k].component_id for k in range(len(data))] == want
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)


def test_quality_measures(spark):
    docs = documents() + [(5000 + k, t) for k, t in enumerate(cases.texts())]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = cases.WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if cases.WORD.search(x)]
        runs = [tuple(w[a : a + 8]) for a in range(len(w) - 7)]
        again = {a + k for a, g in enumerate(runs) if runs.count(g) > 1 for k in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(w),
            sum(map(len, w)),
            len(lines) - len(set(lines)),
            len(again),
        )
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_checksum_of_the_query(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op3_packing"](spark, SF).limit(1).collect()[0]
    text = dict(documents())[got.doc_id]
    library = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert got.ids_crc32 == zlib.crc32(ids[got.start : got.start + got.length].tobytes())
