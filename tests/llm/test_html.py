import time

import pytest

from auditspark.llm.html import extract, main_text

LONG = "This is a paragraph of some length, with commas, and it goes on for a while so that it counts."

CASES = {
    "template": (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a>"
        f"</ul></nav><!-- ad --><div class=\"ad\">Buy now.</div><article><h1>Title &amp; more</h1><p><b>Bold.<br><p>{LONG}</p><p>x<i>y</i>z</p>"
        "</article><footer>&copy; 2024</footer></body></html>",
        f"Title & more Bold. {LONG} xyz",
    ),
    "divs": (
        f"<div class=sidebar>{LONG}</div><div id=main><p>{LONG}</p><p>Second</p></div><div class='comments'><p>{LONG}</p></div>",
        f"{LONG} Second",
    ),
    "links": (f"<div><p><a href=x>{LONG}</a></p><p><a href=x>{LONG}</a></p></div><section><p>{LONG}</p></section>", LONG),
    "header inside": ("<article><header><h1>Head</h1></header><p>a\n  b\tc</p><form>f</form><aside>s</aside><ul><li>one<li>two</ul></article>", "Head a b c one two"),
    "hidden": (f"<main><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div><div role=navigation>no</div></main>", LONG),
    "comment tail": (f"<article><p>{LONG}</p></article><!-- unclosed <p>nothing</p>", LONG),
    "cut tag": (f"<article><p>{LONG}</p><p class=\"x", LONG),
    "cut reference": (f"<article><p>{LONG} a &am", f"{LONG} a &am"),
    "plain": ("no markup at all", "no markup at all"),
    "less than": (f"<article><p>1 < 2, {LONG}</p></article>", f"1 < 2, {LONG}"),
    "only scripts": ("<script>a()</script><style>b{}</style>", ""),
    "empty": ("", ""),
    "stray ends": (f"</div></p><article></span><p>{LONG}</b></p></article></html>", LONG),
    "reader comments": (f"<article><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p></article></section></article>", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, wanted = CASES[name]
    assert main_text(source) == wanted


def test_table(spark):
    rows = [(1, "u", CASES["template"][0], 1), (2, None, None, 1), (None, "u", "plain", 1), (2, "u", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    text = CASES["template"][1]
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (None, "u", "plain", 5), (2, "u", "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_very_long_page():
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(5000))
    assert len(main_text(f"<nav>n</nav><article>{body}</article>").split()) == 5000 * (len(LONG.split()) + 1)


def test_deep_nesting():
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG


@pytest.mark.parametrize("attributes", [
    'class="content has-sidebar"', 'class="post comments-open"', 'id="content" class="with-nav no-comments"',
    'class="entry social"', 'class="no-sidebar"', 'class="page-sidebar-left"',
])
def test_wrappers_named_by_layout_are_read(attributes):
    assert main_text(f"<body><div {attributes}><p>{LONG}</p><div class=site-footer>Foot</div></div></body>") == LONG


@pytest.mark.parametrize("name", ["site-footer", "comment-text", "sidebar", "share-buttons", "post-comments"])
def test_names_of_what_is_no_article_are_set_aside(name):
    assert main_text(f"<body><section><p>{LONG}</p></section><div class={name}><p>{LONG}</p></div></body>") == LONG


def test_short_blocks_beside_the_best_are_kept():
    page = f"<div><h2>Head</h2><section><p>{LONG}</p><p>{LONG}</p></section><p>The end.</p><ul><li>one<li>two</ul><p><a href=x>more</a></p></div>"
    assert main_text(page) == f"Head {LONG} {LONG} The end. one two"


ARTICLE = "".join(f"<p>Sentence {k} of the article, with a comma, and so long that it counts as a paragraph.</p>" for k in range(6))
WANT = " ".join(f"Sentence {k} of the article, with a comma, and so long that it counts as a paragraph." for k in range(6))
OTHER = "<p>Something else entirely, with a comma, long enough to be scored like a paragraph.</p>"


@pytest.mark.parametrize("name", ["footer-container", "nav-wrapper", "comments-container", "sidebar-left", "page-footer",
                                  "cookie-notice-container", "share-wrapper"])
def test_set_aside_names_with_a_shell_word(name):
    aside = f'<div class="{name}">{OTHER * 8}</div>'
    nested = f"<html><body><div>{ARTICLE}{aside}</div></body></html>"
    beside = f"<html><body><div>{ARTICLE}</div>{aside}</body></html>"
    assert main_text(nested) == WANT and main_text(beside) == WANT


@pytest.mark.parametrize("name", ["content-wrapper", "main-container", "has-sidebar", "comments-open", "page-with-sidebar"])
def test_names_that_hold_the_article(name):
    assert main_text(f'<body><div class="{name}">{ARTICLE}</div></body>') == WANT


@pytest.mark.parametrize("page", ["<a" * 500_000, "<a " * 300_000, "<div>" * 60_000 + "deep text " + ARTICLE,
                                  "".join(f"<div>text {k} " for k in range(60_000)), "<p x" + "y" * 500_000 + ">t</p>",
                                  "<div>" * 20_000 + "</b>" * 50_000 + ARTICLE, "<b>" * 30_000 + "<hr>" * 30_000])
def test_broken_and_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 20
