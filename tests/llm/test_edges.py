"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest

from homerange.llm import (
    html_text,
    language_id,
    packing,
    quality_rules,
    sentence_pieces,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)
from homerange.llm.embedding_dedup import near_duplicates as vector_duplicates

from . import cases


def toxic_model(spark):
    data = [(f"{cases.PROSE} zork{'' if k % 2 else ' vile vile'} w{k}", (k + 1) % 2) for k in range(60)]
    return toxicity.learn(spark.createDataFrame(data, "text string, y int"), "text", "y")


def languages(spark):
    words = {"en": "the river bank and the house ", "de": "der fluss und das haus mit garten "}
    data = [(w * (k % 5 + 2), lang) for lang, w in words.items() for k in range(20)]
    return language_id.learn(spark.createDataFrame(data, "text string, lang string"), "text", "lang")


ROW_WISE = {
    "language": lambda s, d: language_id.predict(d, languages(s)),
    "toxicity": lambda s, d: toxicity.score(d, toxic_model(s)),
    "quality": lambda s, d: quality_rules.judge(d),
    "counts": lambda s, d: token_counts.count_tokens(d, store=True),
    "pieces": lambda s, d: sentence_pieces.decode(sentence_pieces.encode(d)),
    "html": lambda s, d: html_text.extract(d, html_text.Weights(), "text"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "passages": lambda s, d: suffix_dedup.removals(d),
    "cleaned": lambda s, d: suffix_dedup.cleaned(d),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_every_row_comes_back(spark, name):
    docs = cases.rows(spark)
    out = ROW_WISE[name](spark, docs)
    assert out.count() == docs.count()
    assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", ROW_WISE)
def test_empty_table(spark, name):
    assert ROW_WISE[name](spark, cases.empty(spark)).count() == 0


def test_empty_tables_of_the_others(spark):
    none = cases.empty(spark)
    assert packing.pack(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert vector_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_learning_from_nothing(spark):
    docs = cases.rows(spark)
    assert language_id.learn(cases.empty(spark), "text", "score") == {}
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    model = toxicity.learn(spark.createDataFrame([], "text string, y int"), "text", "y")
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert html_text.learn(cases.empty(spark), "text") == html_text.Weights()


def test_defined_results(spark):
    docs = cases.rows(spark)
    q = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert (q[0].n_words, q[0].base_failed, q[0].kept, q[0].clean_text) == (0, True, False, "")
    c = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    assert (c[0].n_bytes, c[0].n_tokens, c[0].over_limit) == (0, 0, False)
    p = [r for r in packing.pack(docs).collect() if r.doc_id == 0]
    assert [(r.start, r.length, r.doc_tokens) for r in p] == [(0, 1, 1)]
    lang = {r.doc_id: r for r in language_id.predict(docs, languages(spark)).collect()}
    assert lang[0].lang_pred == lang[1].lang_pred == "und" and lang[4].lang_pred == "en"


def test_one_row_of_each_class_stays(spark):
    docs = cases.rows(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # the row without an id is the only one of its class
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert kept.filter("doc_id is null").count() == 1
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(ids) == sorted({v for v in found.values() if v is not None})


def test_boilerplate_phrases_fill_their_line(spark):
    clean = [
        "The new design in the old hall was shown to all guests on a bright spring morning last year.",
        "\n".join(["We bake ten cookies for every child in the village school.", "Her book treats copyright law since the first printed maps."] * 2),
        "They design up to nine boats and spread more butter on the warm bread while they wait for rain to stop.",
    ]
    junk = ["Sign in", "Copyright 2020 Example Inc. All rights reserved.", "Click here to read more", "Cookie Policy | Terms of use"]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(clean)] + [(9, "\n".join([clean[0], *junk, clean[2]]))], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in quality_rules.judge(docs, rules=quality_rules.Rules(min_words=10)).collect()}
    assert all(got[i].clean_text == t for i, t in enumerate(clean))
    assert got[9].clean_text == "\n".join([clean[0], clean[2]])
    assert got[0].kept and got[2].kept


def test_repeated_ids_with_other_texts_keep_one_row_a_class(spark):
    a = " ".join(f"alpha{i}" for i in range(60))
    b = " ".join(f"beta{i}" for i in range(60))
    c = " ".join(f"gamma{i}" for i in range(60))
    data = [(1, a), (1, b), (1, a), (2, c), (3, a), (3, c), (4, b), (3, "some words of its own stand here")]
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([data[0], data[1], data[3], data[7]])


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 100_000 + "</i>x" * 100_000,
        "<div class=note>" * 100_000 + "some words " * 50,
        "<li><ul>" + "<i>" * 100_000 + "<li>y</li>" * 100_000,
        "".join(f"<x{k}>word " for k in range(100_000)),
        "<p>" * 100_000 + "</div>" * 100_000,
    ],
    ids=["stray ends", "deep named", "list items", "distinct names", "paragraphs"],
)
def test_broken_pages_take_time_in_proportion(page):
    import time

    start = time.perf_counter()
    html_text.main_text(page, html_text.Weights())
    html_text.counts(page)
    assert time.perf_counter() - start < 40


def test_page_without_any_content_mark():
    story = " ".join(f"word{k} stands in the story." for k in range(40))
    page = (
        "<html><body><div class='nav'><a href=/>Home</a> <a href=/x>More</a></div>"
        f"<div><h1>The title</h1><div>{story}</div><div>{story} Second part.</div></div>"
        "<div class='footer'>Copyright of this site</div></body></html>"
    )
    got = html_text.main_text(page, html_text.Weights())
    assert got == f"The title\n\n{story}\n\n{story} Second part."
