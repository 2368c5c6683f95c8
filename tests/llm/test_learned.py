"""Held-out accuracy, extraction fixtures, the scan, the pipeline."""

import hashlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from homerange.llm import html_text, packing, simhash, suffix_dedup, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = [r for r in entry.queries()["op1_language_id"](spark, SF).collect() if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_copies_do_not_crowd_out_training_texts(spark):
    from homerange.llm import language_id

    word = ["ka", "lo", "mi", "re", "su"]
    texts = [" ".join(word[(i // 5**k) % 5] for k in range(4)) for i in range(40)]
    data = [("xx", t) for t in texts] + [("xx", "the same line")] * 4000
    model = language_id.learn(
        spark.createDataFrame(data, "lang string, text string"), "text", "lang", language_id.Settings(sample_docs=30)
    )
    assert len(model["xx"].split(b"\n")) == 30


def test_toxicity_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold six toxic held-out documents
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in entry.queries()["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    bad = [r.score for r in rows if toxic[r.doc_id]]
    good = [r.score for r in rows if not toxic[r.doc_id]]
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good)
    assert wins >= 0.9 * len(bad) * len(good)


def best_sum(scores):
    return max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)


def test_maximal_segments_hold_the_best_one():
    scores = [2, -1, 3, -9, 4, -1, -1, 1, -1, 5, -2, 2]
    positions = [i for i, s in enumerate(scores) if s > 0]
    # the scan knows one cost for all other tokens
    plain = [s if s > 0 else -1 for s in scores]
    found = toxicity.maximal_segments(positions, [float(scores[i]) for i in positions], 1.0)
    assert max(s for _, _, s in found) == best_sum(plain)
    for a, b, s in found:
        assert s == sum(plain[a : b + 1])
        assert all(sum(plain[a:k]) > 0 for k in range(a + 1, b + 1))
        assert all(sum(plain[k : b + 1]) > 0 for k in range(a, b + 1))


def test_early_hits_do_not_hide_a_late_passage():
    bad = ["vile", "scum", "filth", "rot", "dung"]
    scorer = toxicity.Scorer(toxicity.Model(scores=tuple((w, 5.0) for w in sorted(bad)), cost=2.0))
    calm = ["calm"] * 60
    early = [x for w in bad for _ in range(4) for x in [w, *calm]]
    dense = [*bad, *bad]
    text = " ".join([*early, *dense, *calm, *dense, *calm, *dense])
    n, _, segments = scorer.scan(text)
    # the second occurrence of a word in a passage counts half
    full = [(a, b) for a, b, s in segments if s == 37.5]
    start = len(early)
    assert full == [(start + k * 70, start + k * 70 + 9) for k in range(3)] and n == start + 150
    # one word over and over adds ever less within a passage
    assert [s for _, _, s in scorer.scan("vile " * 50)[2]] == [pytest.approx(sum(5.0 / k for k in range(1, 51)))]
    # two passages so close that the running score stays above zero
    near = " ".join([*dense, *["calm"] * 20, *bad])
    assert [s for _, _, s in scorer.scan(near)[2]] == [37.5, 25.0]


def plain_segments(scores):
    """By definition: the best run, no longer than need be, then the same on either side."""
    runs = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    top = max(runs, key=lambda r: (r[0], r[1] - r[2], -r[1]), default=(0,))
    if top[0] <= 0:
        return []
    _, a, b = top
    right = [(b + x, b + y, s) for x, y, s in plain_segments(scores[b:])]
    return [*plain_segments(scores[:a]), (a, b - 1, top[0]), *right]


def test_toxicity_scores_against_brute_force():
    import math
    import random

    rng = random.Random(5)
    odds = {"vile": 5.25, "scum": 4.0, "rotten": 2.5, "dear": -3.5, "kind": -2.75}
    model = toxicity.Model(scores=tuple(sorted(odds.items())), cost=1.5, lam=0.8, k=0.3, a=-2.0, b=0.5)
    scorer = toxicity.Scorer(model)
    for _ in range(200):
        words = rng.choices([*odds, "calm", "sea"], weights=[2, 2, 2, 1, 1, 6, 6], k=rng.randrange(40))
        found = []
        for first, last, _ in plain_segments([odds.get(w, -1.5) for w in words]):
            run, at, seen, total = words[first : last + 1], [], {}, 0.0
            for w in run:
                plain = odds.get(w, -1.5)
                if plain > 0:
                    if total <= 0:
                        seen = {}
                    seen[w] = seen.get(w, 0) + 1
                    plain /= seen[w]
                else:
                    seen = seen if total + plain > 0 else {}
                total = max(total, 0.0) + plain
                at.append(plain)
            found += [(first + x, first + y, s) for x, y, s in plain_segments(at)]
        n = len(words)
        above = [0.8 * s - math.log(0.3 * max(n, 1) + 1) for _, _, s in found]
        x = max([max(above, default=-math.log(0.3 * max(n, 1) + 1)), sum(v for v in above if v > 0)])
        p, count, passages = scorer.score(" ".join(words))
        assert count == n and p == pytest.approx(1 / (1 + math.exp(2 - 0.5 * x)))
        want = [(a, b) for (a, b, _), v in zip(found, above, strict=True) if v >= math.log(20)]
        assert [(q["first"], q["last"]) for q in passages] == want


def test_wrong_labels_do_not_flatten_the_toxicity_curve():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-4, 1, 900), rng.normal(8, 2, 100)])
    y = np.concatenate([np.zeros(900), np.ones(100)])
    y[:15], y[900:905] = 1, 0
    a, b = toxicity._fit_noisy_curve(x, y)
    assert b > 0 and -2 < -a / b < 5  # between the two heaps
    steep, flat = b, toxicity._fit_curve(x, y)[1]
    assert steep > 1.5 * flat


PAGE = """<html><head><title>No</title></head><body><div class="top menu"><a href=x>Home</a> <a>About</a></div>
<div class="cookie-notice"><p>We use cookies</p></div>%s<div id="sidebar">Side words here</div>
<div class="comments"><p>First!</p></div><footer><p>&copy; us</p></footer><script>var x="</p><p>bad";</script></body>"""
BODY = "<h1>A  title</h1><p>One <b>two</b> &amp; three four five six seven.<p>Eight&nbsp;nine ten eleven twelve<br>thirteen."
TEXT = "A title\n\nOne two & three four five six seven.\n\nEight nine ten eleven twelve thirteen."


def test_main_text():
    for body in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div class=content>{BODY}</div>"):
        assert html_text.main_text(PAGE % body, html_text.Weights()) == TEXT
    inner = BODY.replace("<p>Eight", '<div class="ad">Buy it</div><form>Mail <input></form><p>Eight')
    assert html_text.main_text(PAGE % f"<article>{inner}</article>", html_text.Weights()) == TEXT
    for odd in (None, "", "<!-- open", "<p", "<nav>only menu</nav>"):
        assert html_text.main_text(odd, html_text.Weights()) in ("", "<p")


def test_a_class_alone_does_not_void_the_story():
    def got(page):
        return html_text.main_text(page, html_text.Weights())

    for wrapper in (
        '<div class="layout has-sidebar">%s</div>',
        '<div class="widget">%s</div>',
        '<main class="no-sidebar">%s</main>',
        '<article class="post comments-open category-social">%s</article>',
        '<div role="main" id="discussion">%s</div>',
    ):
        assert got(PAGE % (wrapper % BODY)) == TEXT
    inner = '<section id="discussion"><h2 id="related-work">Others</h2><p class="legal">Courts agree on this.</p></section>'
    assert got(PAGE % f"<article>{BODY}{inner}</article>") == TEXT + "\n\nOthers\n\nCourts agree on this."
    beside = '<div class="sidebar">Read these</div><div id="comments"><p>First of all.</p></div><p class="site-footer">Us</p>'
    assert got(PAGE % f'<div class="content">{BODY}</div>{beside}') == TEXT


def test_marks_do_not_hide_the_story():
    def got(page):
        return html_text.main_text(page, html_text.Weights())

    card = "<article><h3>Next</h3><p>Short card.</p></article>"
    rest = "</div>".join(["<div class=grid>" + "<hr>" * 20, card, card])
    assert got(PAGE % f'<div class="post">{BODY}</div>{rest}') == TEXT
    inside = got(PAGE % f"<main><div>{BODY}</div>{'<hr>' * 80}{card}{card}</main>")
    assert inside.startswith(TEXT) and inside.count("Short card.") == 2
    for open_tag in ("<audio src=x>", "<video>", "<canvas>", "<svg viewBox=x>", "<iframe src=x>", "<object data=x>", "<math>"):
        assert got(PAGE % f"<article>{open_tag}{BODY}</article>") == TEXT
    kept = got(PAGE % f"<article>{BODY}<p>So <math><mi>e</mi><mo>=</mo><mn>2</mn></math> holds <object>truly</object>.</p></article>")
    assert kept == TEXT + "\n\nSo e=2 holds truly."
    for open_tag in ("<script>", "<style>", "<textarea>", "<title>"):
        page = f"<article>{BODY}</article><p>{open_tag} x y"
        assert got(page) == TEXT


def test_pages_of_the_table(spark):
    rows = entry.queries()["op9_html_text"](spark, SF).collect()
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text and r.n_chars == len(r.text)
        assert "track(" not in r.text and "margin:0" not in r.text


def test_pipeline_stages(spark):
    documents = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    original = dict(documents)
    before = kept["quality"]
    # what stays of a text are lines of it, in their order
    for i, t in before.items():
        lines = iter(original[i].split("\n"))
        assert all(line in lines for line in t.split("\n"))
        assert 2 * len(t) >= len(original[i])
    assert any(original[i] != t for i, t in before.items())
    ids = sorted(before)
    prints = [cases.fingerprint(before[i]) for i in ids]
    want = cases.classes(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert set(kept["near_dedup"]) == {ids[k] for k in want}
    removed = cases.passages(list(kept["near_dedup"].items()))
    for i, t in kept["near_dedup"].items():
        rest = kept["passages"][i]
        if not removed[i][1]:
            assert rest == t
        elif t.isascii():
            assert hashlib.sha256(rest.encode()).hexdigest() == removed[i][3]
    assert any(r[1] for r in removed.values())
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(ids[k] for k in want)
    assert suffix_dedup.MIN_BYTES == 50 and simhash.MAX_DISTANCE == 4 and packing.MAX_TOKENS == 4096
