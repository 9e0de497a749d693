from __future__ import annotations

import random
import time

from skysift.llm import html_extract as H

WEIGHT = H.to_weights({("words:word", True): 900, ("words:word", False): 20, ("words:aside", False): 300, ("p", True): 80, ("p", False): 2, ("a", False): 90, ("li", False): 90, ("div", False): 10, ("article", True): 10, ("nav", False): 10})
BODY = "<h1>Title of it</h1><p>First &amp; best <b>words</b> of this long text here.<br>more <p>Second part with\n\t white&nbsp;space &lt;x&gt;</p>"
WANT = "Title of it\nFirst & best words of this long text here. more\nSecond part with white space <x>"
AROUND = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- c --><div class="ad top">Buy now please</div>',
    '<section class="comments"><p>Nice text, friend</p></section><aside>Side text</aside><form><p>Sign up now</p></form><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>',
)


def test_marked_and_unmarked_pages():
    for a, b in (("<article>", "</article>"), ("<div>", "</div>"), ("<main>", "</main>"), ('<div class="post">', "</div>")):
        assert H.main_text(AROUND[0] + a + BODY + b + AROUND[1], WEIGHT) == WANT


def test_parts_inside_the_article_are_left_out():
    page = AROUND[0] + "<article>" + BODY + '<div class="advert">Buy this</div><aside>By the way</aside><p>Last</p><ul class="related"><li>Other</li></ul></article>' + AROUND[1]
    assert H.main_text(page, WEIGHT) == WANT + "\nLast"


def test_defined_results():
    assert H.main_text(None, WEIGHT) == H.main_text("", WEIGHT) == H.main_text("<nav><a>x</a></nav>", WEIGHT) == ""
    assert H.main_text("just text", WEIGHT) == "just text"
    assert H.main_text("<p>a<!-- open", WEIGHT) == "a"
    assert H.main_text("<article><p>cut &am", WEIGHT) == "cut &am"
    assert H.main_text("<p>" + "word " * 50000, WEIGHT) == ("word " * 50000).strip()


def test_over_a_table(spark):
    rows = [(i, AROUND[0] + "<article>" + BODY + "</article>" + AROUND[1], "old") for i in range(20)] + [(30, None, ""), (31, "", ""), (32, AROUND[0] + "<div>" + BODY + "</div>" + AROUND[1], "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    weight = H.weights(pages)
    assert weight["words:word"] > 0 > weight["li"]
    got = {r.page_id: r.text for r in H.extract(pages, weight).collect()}
    assert got[30] == got[31] == "" and all(got[i] == WANT for i in (*range(20), 32))
    assert H.extract(pages.limit(0), H.weights(pages.limit(0))).count() == 0


def test_main_text_outside_of_the_mark():
    for card in ("<article><p>Read on</p></article>", '<article class="card"><a href="/x">Other story</a></article>'):
        got = H.main_text(AROUND[0] + card + "<ul>" + '<li><a href="/b">more</a></li>' * 9 + "</ul><div>" + BODY + "</div>" + AROUND[1], WEIGHT)
        assert got == WANT


def test_custom_elements_and_names_of_content():
    page = AROUND[0] + "<article><p>First part of it</p><svg-icon></svg-icon><title-bar>x</title-bar><p>Second part of it</p>" + '<div class="social-history"><p>Third part of it</p></div><div class="social share-box"><p>Share it</p></div></article>' + AROUND[1]
    assert H.main_text(page, WEIGHT) == "First part of it\nx\nSecond part of it\nThird part of it"


def test_region_same_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -0.5, 0, 1, 2, 5]) for _ in range(rng.randint(0, 14))]
        start, end = H.region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0) and (best > 0 or start == end)


def test_the_weights_decide():
    page = AROUND[0] + "<div>" + BODY + "</div><table><tr><td>cell</td></tr></table><p>Far away words</p>" + AROUND[1]
    near = {**WEIGHT, "table": -0.1, "tr": -0.1, "td": -0.1, "div": -0.1, "p": -0.1}
    far = {**near, "table": -200.0}
    assert H.main_text(page, near) == WANT + "\ncell\nFar away words" and H.main_text(page, far) == WANT
    learned = H.to_weights(H.tag_counts("<body><p>a b</p><table><tr><td>x y z</td></tr></table><article><p>c d e f</p></article></body>"))
    assert learned["table"] < learned["p"] < 0 < learned["words:word"]


def test_deep_and_unclosed_pages_take_linear_time():
    for some in ("<div>", "<b>", "<p><td>", "<div><b>", "<li>", "<p>x<b>", "</p>"):
        began = time.process_time()
        page = some * (100_000 // len(some.split("<")[1:])) + "<hr>" * 50_000 + "last words here"
        assert H.main_text(page, {**H.to_weights({}), "words:word": 1e9}).endswith("last words here")
        assert time.process_time() - began < 20
