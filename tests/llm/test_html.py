"""Pages with odd markup, named parts and small articles; ratios, smoothing and clusters against their definitions."""

import math
import random

import numpy as np
import pytest

from pulseloom.llm import html

TEXT = "Many words of a long paragraph stand here and go on. " * 12
PIECES = [
    "<", "!", "[", "]", "-", "--", ">", "/", "p", "div", "<!", "<![", "<![CDATA[", "]]>", "</", "&", "&#", "&#x", "x", "a href='", '"', "'", " ", "<script>", "</script>", "<!DOCTYPE", "<?", "?>",
    "\n", "é", "<style>", "<textarea>", "<title>", "&amp;", "<p", "=", "\0", "<!-", "<!---->", "-->", "<svg>", "<![if", "<plaintext>", "<table>", "<td>", "</p>", "<article>", "<li>",
]


def test_no_markup_stops_a_page():
    assert html.main_text("<![foo]><p>x</p>") == "x"
    assert html.main_text("<![>") == "" and html.main_text("a<![CDATA[ b ]]>c") == "ac"
    r = random.Random(1)
    for _ in range(20_000):
        html.main_text("".join(r.choice(PIECES) for _ in range(r.randint(1, 16))))


@pytest.mark.parametrize("name", "comments comment-list comments-area comment-section commentList share-buttons related-posts ad-slot cookie-banner newsletter-signup nav-links post-comments comment-12".split())
def test_named_parts_of_an_article_go(name):
    page = f'<body><article><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p><div class="x {name}"><p>Not of it, though {TEXT[:90]}</p></div></article></body>'
    assert html.main_text(page).split("\n") == ["T", TEXT.strip(), TEXT.strip()]


@pytest.mark.parametrize("name", ["post category-social", "content no-sidebar", "post comments-open", "content-area", "comments-area", "cookie-policy"])
def test_what_holds_the_text_stays(name):
    page = f'<body><div class="{name}"><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p></div></body>'
    assert html.main_text(page).split("\n") == ["T", TEXT.strip(), TEXT.strip()]


def test_marked_words_of_a_sentence_stay():
    page = f"""<article><p>{TEXT}</p><p>See our <a class="register">fish register</a> for more.</p><p>Press the <label>Start</label> and <button>OK</button> key</p>
    <p><span class="share">Share</span> </p><p><button>Go</button></p><form><p>{TEXT}</p><label>Name</label></form></article>"""
    assert html.main_text(page).split("\n") == [TEXT.strip(), "See our fish register for more.", "Press the Start and OK key"]


def test_small_articles_stay():
    small = "A much shorter article, of a single sentence, that stands beside it."
    page = f"<body><article><p>{TEXT * 3}</p></article><article><p>{small}</p></article></body>"
    assert html.main_text(page).split("\n") == [(TEXT * 3).strip(), small]


def test_ratios_smoothing_and_clusters():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 40):
        ratios = r.exponential(30, n)
        weights = [math.exp(-d * d / 2) for d in range(-2, 3)]
        slow = [sum(w * ratios[min(n - 1, max(0, i + d))] for d, w in zip(range(-2, 3), weights)) / sum(weights) for i in range(n)]
        assert np.allclose(html.smoothed(ratios), slow)
        lines = [("x" * int(10 * q), html.Line(None, tags=10)) for q in ratios]
        exact = [len(t) / 10 for t, _ in lines]
        smooth = [sum(w * exact[min(n - 1, max(0, i + d))] for d, w in zip(range(-2, 3), weights)) / sum(weights) for i in range(n)]
        mean = sum(exact) / n
        limit = min(math.sqrt(sum((q - mean) ** 2 for q in exact) / n), max(smooth))
        assert html._clusters(lines).tolist() == [q >= limit for q in smooth]


def test_a_very_long_page_and_repeated_rows(spark):
    long = f"<body><nav><a href=x>Menu</a></nav><article>{f'<p>{TEXT}</p>' * 4000}</article></body>"
    assert len(long) > 2_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "v", "<p>One.</p>"), (2, "v", "<p>One.</p>")], "page_id long, url string, html string")
    got = html.extract(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 4000 * (len(TEXT.strip()) + 1) - 1), (2, 4), (2, 4)]
