"""Quality, language and main text: held-out accuracy and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import html_text, language_id, quality

SF = "/root/testdata/sf0.01"
ROWS = "doc_id long, text string, score string, lang_pred string"


def test_language_held_out(spark):
    got = language_id.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score"), F.max("score"), F.count("*")).first()
    assert r["a"] > 0.98 and 0 <= r[1] <= r[2] <= 1 and r[3] > 100


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, fit_rows=300)
    rows = [(1, None, "x", "y"), (2, "", None, None), (3, "123 !?", None, None), (4, "the and of with that", None, None), (None, "the and of with that", None, None), (4, "the and of with that", None, None), (5, "der und die " * 200_000, None, None)]
    got = language_id.identify(spark.createDataFrame(rows, ROWS), model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", "en", "de"]
    assert [r["score"] for r in got[:3]] == [0, 0, 0]
    empty = spark.createDataFrame([], "text string, lang string")
    assert language_id.fit(empty)[0] == []
    assert language_id.identify(spark.createDataFrame(rows[:4], ROWS), language_id.fit(empty)).first()["lang_pred"] == "und"


def test_language_is_multinomial_naive_bayes():
    langs, matrix = ["a", "b"], np.log(np.random.default_rng(0).dirichlet(np.ones(language_id.BUCKETS), 2).T).astype(np.float32)
    texts = ["Hello there", "x", "long text " * 300_000]
    found, _ = language_id.predict_texts(texts, langs, matrix)
    for t, f in zip(texts, found):
        h, _ = language_id.ngram_buckets([t.lower()])
        assert f == langs[int(matrix[h.ravel()].sum(0, dtype=np.float64).argmax())]
    assert language_id.predict_texts(["x"], langs, matrix, np.log([1e-9, 1]))[0] == ["b"] and language_id.predict_texts(["x"], langs, matrix, np.log([1, 1e-9]))[0] == ["a"]


def test_copies_of_a_text_are_sampled_by_key(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "one text in most rows", "en") for k in range(4_000)] + [(5_000 + k, f"rare {k}", "xx") for k in range(40)], "doc_id long, text string, lang string")
    langs, _, prior = language_id.fit(docs, fit_rows=400)
    assert "en" in langs
    assert 0.9 < np.exp(prior[langs.index("en")]) <= 1


def test_language_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word", f"l{i % 3}") for i in range(12)], "doc_id long, text string, lang string")
    assert np.allclose(np.exp(language_id.fit(docs)[2]), 1 / 3)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(docs)


def test_quality_held_out(spark):
    got = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 1)], "doc_id long, quality int")
    rows = [(1, "plain words of prose. " * 40, "x", "y"), (2, "Bad!! BAD!! " * 60, None, None), (3, None, None, None), (4, "", None, None), (None, "x", None, None), (4, "", None, None), (5, "word " * 250_000, None, None)]
    docs = spark.createDataFrame(rows, ROWS)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] > got[1]["score"] and got[2]["score"] == pytest.approx(got[3]["score"]) == pytest.approx(got[5]["score"])
    untrained = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, untrained).collect()} == {0.5}
    assert quality.score(docs.limit(0), untrained).collect() == []


def test_attention_gradient():
    """Each derivative against a central difference, in doubles."""
    rng = np.random.default_rng(1)
    x, size, y, weight = rng.normal(size=(9, 5)), np.array([3, 1, 2, 3]), np.array([1, 0, 1, 0]), rng.uniform(0.5, 2, 4)
    model = quality.Model(rng.normal(size=5), rng.uniform(0.5, 2, 5), hidden=4, gate=3)
    model.p = {k: a.astype(np.float64) + 0.1 * rng.normal(size=a.shape) for k, a in model.p.items()}
    _, grad = model.gradients(x, size, y, weight)
    assert set(grad) == {"E", "e", "V", "U", "w", "c", "b"}
    for name, a in model.p.items():
        for at in np.ndindex(a.shape):
            old, both = a[at], []
            for step in (1e-5, -1e-5):
                a[at] = old + step
                both.append(model.gradients(x, size, y, weight)[0])
            a[at] = old
            assert grad[name][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-5, abs=1e-8), (name, at)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    x, of, y = rng.normal(size=(9, 5)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1, 0, 1, 0])
    model = quality.Model(np.zeros(5, np.float32), np.ones(5, np.float32), hidden=4, gate=3)
    loss = lambda: model.gradients(x, np.bincount(of), y, np.ones(4))[0]
    before = loss()
    model.train(x, of, y, epochs=100, batch=4)
    assert loss() < 0.6 * before


def test_documents_that_do_not_fit_are_left_out(spark):
    texts = [("word and more. " * (40_000 if k % 7 == 0 else 40), 1) if k % 2 else ("Bad!! BAD!! | * " * 40, 0) for k in range(1, 60)]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, (t, _) in enumerate(texts)], ROWS)
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int")
    seen = []

    class Watched(quality.Model):
        def train(self, x, of, y, **more):
            seen.append((x.nbytes // 2, sorted(y.tolist())))

    was, quality.Model = quality.Model, Watched
    try:
        quality.fit(docs, labels, fit_bytes=100_000)
    finally:
        quality.Model = was
    assert seen[0][0] <= 100_000 and len(seen[0][1]) == sum(len(t) < 100_000 for t, _ in texts) and set(seen[0][1]) == {0, 1}


def test_a_long_text_is_one_bag(spark):
    long = "word and more. " * 160_000  # several groups of passages
    docs = spark.createDataFrame([(1, long, "x", "y"), (2, "Bad!! " * 90, None, None), (3, None, None, None)], ROWS)
    seen = []

    class Watched(quality.Model):
        def train(self, x, of, y, **more):
            seen.append(np.bincount(of).tolist())

    was, quality.Model = quality.Model, Watched
    try:
        quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int"))
    finally:
        quality.Model = was
    assert seen == [[-(-len(long) // quality.PASSAGE), 2, 1]]


PAGES = {
    "article": ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/a">A</a></nav><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p>One  two\n three<br>four.</p><p><b>Bold</b> and plain, which is a longer sentence.</p><p>Short.</p></article><footer>&copy; x</footer></body></html>', "Head & tail\n\nOne two three four.\n\nBold and plain, which is a longer sentence.\n\nShort."),
    "unclosed": ("<body><article><p><b>A long first paragraph of the page, unclosed.<br><p>Second one.</article><footer>f", "A long first paragraph of the page, unclosed.\n\nSecond one."),
    "no article": ('<body><header><h1>Site</h1></header><div class="content"><h2>Title</h2><p>Some long paragraph of prose that goes on and on, as prose does.</p><ul><li>item one<li>item two</ul></div><div id="sidebar">links</div><div class="comments"><p>A reader writes a very long comment about this page, too long.</p></div><form><p>Sign up</p></form></body>', "Title\n\nSome long paragraph of prose that goes on and on, as prose does.\n\nitem one\n\nitem two"),
    "script": ("<body><main><script>var a='<p>no</p>'</script><noscript>no</noscript><p>Yes, this is it &lt;b&gt; &#233;.</p></main>", "Yes, this is it <b> é."),
    "nothing": ("<html><body><nav>x</nav></body></html>", ""),
    "text": ("just words, no tags", "just words, no tags"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert html_text.main_text(html) == want


LONG = "A long paragraph of the page, which is all that it has to say."
WRAPPED = {
    "open head": f"<head><title>x</title><body><article><p>{LONG}</p></article>",
    "head without body": f"<head><meta charset=utf-8><title>x</title><p>{LONG}</p>",
    "words in the head": f"<head><title>x</title>{LONG}",
    "with-sidebar": f'<div class="content with-sidebar"><p>{LONG}</p></div><div class="sidebar-left"><p>Links</p></div>',
    "has-banner": f'<div class="has-banner"><p>{LONG}</p></div>',
    "search-results": f'<div class="search-results"><p>{LONG}</p></div>',
    "comments-open": f'<article class="post comments-open"><p>{LONG}</p></article><div id="comments"><p>{LONG} {LONG} So says a reader.</p></div>',
    "wrapper": f'<div class="sidebar-right"><article><p>{LONG}</p></article></div><div class="related"><article><p>Read on</p></article></div>',
    "form": f'<body><form id="aspnet"><nav>x</nav><div><p>{LONG}</p></div><div class="footer"><p>Terms</p></div></form></body>',
    "forms": f'<body><form role="form"><p>{LONG}</p></form><form><p>Name</p></form><form class="newsletter"><p>Sign up</p></form></body>',
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_are_not_skipped(name):
    assert LONG in (got := html_text.main_text(WRAPPED[name]))
    assert not any(x in got for x in ("Links", "reader", "Read on", "Terms", "Sign up"))


LOST = {
    "form around": (f'<form id=aspnetForm><div class=menu><a href=x>Menu</a></div><article><p>{LONG}</p></article><p>Terms</p></form>', LONG),
    "related-work": (f"<div class='intro'><p>{LONG}</p><p>{LONG}</p></div><div class='related-work'><p>{LONG} Work.</p></div>", f"{LONG} Work."),
    "unclosed nav": (f"<nav><a href=x>Home</a><a href=y>Two</a><div class=content><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    "notice-of-award": (f"<article><p>{LONG} {LONG}</p><section id='notice-of-award'><p>{LONG} Award.</p></section></article>", f"{LONG} Award."),
    "social-science": (f"<article><p>{LONG} {LONG}</p><div class='social-science'><p>{LONG} Science.</p></div></article>", f"{LONG} Science."),
    "formula": ("<article><p>We have <math><mi>x</mi></math> as the value of the thing that we look for here.</p></article>", "We have x as the value of the thing that we look for here."),
    "script in a sentence": ("<article><p>We have <script>x()</script>it, the value of the thing that we look for here.</p></article>", "We have it, the value of the thing that we look for here."),
}


@pytest.mark.parametrize("name", LOST)
def test_articles_are_not_lost(name):
    html, want = LOST[name]
    got = html_text.main_text(html).split("\n\n")
    assert want in got and not {"Menu", "Home", "Two", "Terms"} & set(got)


def test_listed_words_still_drop():
    words = ("ad", "cookie-banner", "sidebar-left", "newsletter_signup", "site-footer", "share", "related")
    html = f"<article><p>{LONG} {LONG}</p>" + "".join(f'<div class="{w}"><p>{LONG} {w}</p></div>' for w in words) + "<nav>n</nav></article><footer>f</footer>"
    assert html_text.main_text(html) == f"{LONG} {LONG}"


COMMENTED = {
    "compound class": f'<article><p>{LONG}</p><ol class="commentlist"><li><p>first!</p></li><li><p>second of all</p></li></ol></article>',
    "thread behind": f'<div class="post"><p>{LONG}</p><p>{LONG}</p></div><div class="discussion-thread"><p>I do not agree with this at all, said a reader.</p></div>',
    "thread inside": f'<article><p>{LONG}</p><div class="discussion-thread"><p>I do not agree with this at all, said a reader.</p></div></article>',
    "unlisted names": f'<article><p>{LONG}</p><h3>2 responses</h3><div class="q7"><div class="z1"><span class="user">Ann</span><p>I think so as well, and so does my dog.</p></div><div class="z1"><span class="user">Bob</span><p>Me too, and then some.</p></div></div></article>',
    "advert": f'<article><p>{LONG}</p><div class="dfp-slot-1"><p>Buy the best shoes of the whole town today.</p></div></article>',
    "side column": f'<div class="post"><p>{LONG}</p><p>{LONG}</p></div><div class="rail"><h4>More</h4><p>Some other story that is told at length.</p></div>',
    "cookie bar": f'<div><p>We use cookies to improve this site. Accept all</p></div><div class="post"><p>{LONG}</p><p>{LONG}</p></div>',
}


@pytest.mark.parametrize("name", sorted(COMMENTED))
def test_comments_adverts_and_bars_go(name):
    assert set(html_text.main_text(f"<html><body>{COMMENTED[name]}</body></html>").split("\n\n")) == {LONG}


def test_like_elements_of_an_article_stay():
    steps = "".join(f'<div class="step"><h3>Step {i}</h3><p>{LONG} {i}</p></div>' for i in range(3))
    talk = f'<p>{LONG}</p>' + "".join(f'<blockquote class="said"><p>{LONG} {i}</p></blockquote>' for i in range(3))
    for inner in (steps, talk, f"<p>{LONG}</p><p>The recipe uses no cookies, only bread, as I agree.</p>"):
        assert html_text.main_text(f"<article>{inner}</article>").count(LONG) == inner.count(LONG)
    assert "no cookies" in html_text.main_text(f"<article><p>{LONG}</p><p>The recipe uses no cookies, only bread, as I agree.</p></article>")


def test_ratio_rule_against_a_plain_one():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 60):
        sizes, tags = rng.integers(0, 300, n).tolist(), rng.integers(0, 9, n).tolist()
        ratio = [a / max(1, b) for a, b in zip(sizes, tags)]
        mean = sum(ratio) / n
        bound = html_text.THRESHOLD * (sum((r - mean) ** 2 for r in ratio) / n) ** 0.5
        want = []
        for i in range(n):
            w = {j: np.exp(-0.5 * (i - j) ** 2) for j in range(max(0, i - 2), min(n, i + 3))}
            want.append(sum(ratio[j] * x for j, x in w.items()) / sum(w.values()) >= bound - 1e-12)
        assert html_text.dense(sizes, tags).tolist() == want


def test_pages(spark):
    rows = [(i, "u", h, "t", "n") for i, (h, _) in enumerate(PAGES.values())]
    frame = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, n_chars string")
    got = html_text.extract(frame).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [PAGES["article"][1], *(w for _, w in PAGES.values())]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(frame.limit(0)).collect() == []
    big = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    assert len(html_text.main_text(big)) == 999_999


def test_smoothing_is_a_normalised_gaussian():
    assert np.allclose(html_text.smoothed(np.full(7, 3.0)), 3.0)
    one = html_text.smoothed(np.array([0, 0, 0, 1.0, 0, 0, 0]))
    assert one.argmax() == 3 and np.allclose(one, one[::-1])
