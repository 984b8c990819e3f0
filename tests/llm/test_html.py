"""Cuts against enumeration; pages against their known article."""

import itertools
import random

import pytest

from seriesloom.llm.html import blocks_of, content_blocks, extract_text, main_text, minimum_cut, sample_page, trained


def cost(side, prefer, edges):
    return sum(max(p, 0) for s, p in zip(side, prefer) if not s) + sum(max(-p, 0) for s, p in zip(side, prefer) if s) + sum(c for a, b, c in edges if side[a] != side[b])


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 8)
        prefer = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(rng.randint(0, 14))]
        edges = [e for e in edges if e[0] != e[1]]
        best = min(cost(s, prefer, edges) for s in itertools.product([False, True], repeat=n))
        assert cost(minimum_cut(prefer, edges), prefer, edges) == best


def test_held_out_pages():
    rng, right, total = random.Random(123), 0, 0
    for _ in range(200):
        html, labels = sample_page(rng)
        found = blocks_of(html)
        kept = {b.text for b in content_blocks(html, trained())}
        right += sum((b.text in kept) == bool(y) for b, y in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>One<li><a href=b>Two</ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Big &amp; small&nbsp;news</h1></header><p>First <b>bold
 text.<br><p>Second &lt;b&gt; one.</p><div class="ad">Buy now!</div><form><label>Mail</label><input></form>
<blockquote>Quoted words here.</blockquote><ul><li>Item one.<li>Item two.</ul></article>
<section id="comments"><p>Great article, thanks for it.</p></section><aside><p>Related things</p></aside><footer>&copy; site</footer>"""


def test_page(spark):
    want = "Big & small news\nFirst bold text.\nSecond <b> one.\nQuoted words here.\nItem one.\nItem two."
    assert main_text(PAGE, trained()) == want
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "", None), (3, "u", "<", None), (4, "u", "<p>" * 3000 + "a", None)]
    got = {(r.page_id, r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert {(1, want, len(want)), (2, "", 0), (3, "", 0)} <= got


def shown(html):
    return [b.text for b in blocks_of(html)]


def test_scripts_are_cut_at_their_end_tag():
    assert shown("<script>for(i=0;i<n;i++){f(i)}</script><p>Text</p>") == ["Text"]
    assert shown("<p>A</p><script>if(a<b)s='<!-- it\\'s';</SCRIPT ><p>It's one.</p><p>It's two.</p>") == ["A", "It's one.", "It's two."]
    assert shown("<p>A</p><style>a<b{content:\"'\"}</style><p>B</p><textarea>x<y '</p></textarea><p>C's</p>") == ["A", "B", "C's"]
    assert shown("<noscript><script>a<b</script><p>No</p></noscript><p>B</p><script>no</scripts></script><p>C</p>") == ["B", "C"]
    assert shown("<p>A</p><script>document.write('<p>B</p>')") == ["A"]


def test_head_without_end():
    assert shown("<html><head><meta charset=utf-8><title>T</title><script>a<b</script><link rel=x><p>One</p><p>Two</p>") == ["One", "Two"]
    assert shown("<head><title>T</title><body><p>One</p>") == ["One"] and shown("<head><style>p{}</style>Bare text") == ["Bare text"]


def test_unclosed_elements_do_not_hide_the_rest():
    for tag in ("button", "select", "svg", "noscript", "object", "iframe", "video", "title", "textarea", "template"):
        assert shown(f"<div><p>A</p><{tag}>Menu</div><p>One</p><p>Two</p>") == ["A", "One", "Two"], tag
        assert shown(f"<p>A</p><{tag}>Menu<p>One</p><div><{tag}>no</{tag}></div><p>Two</p>") == (["A", "Two"] if tag in ("title", "textarea") else ["A", "One", "Two"]), tag
    assert shown("<svg><svg>a</svg><text>b</text></svg><p>One</p><button><div>no</div></button><p>Two</p></svg>") == ["One", "Two"]
    assert shown("<button><svg>a</button><p>One</p><svg>b</svg><p>Two</p>") == ["One", "Two"]


ONE = "The river rose in the night and the village was cut off from the road for two days."
TWO = "Boats brought bread and water, and the school was used as a store by the people."
WHOLE = f"<article><p>{ONE}</p><p>{TWO}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><script>for(var i=0;i<n;i++)go(i);</script>{WHOLE}</body></html>",
        f"<html><body><article><p>{ONE}</p><script>for(var i=0;i<n;i++)go(i);</script><p>{TWO}</p></article></body></html>",
        f"<html><body><script>var s='<!--';</script>{WHOLE}</body></html>",
        f"<html><body><style>a<b{{}}</style>{WHOLE}</body></html>",
        f"<html><body><button>Go{WHOLE}</body></html>",
        f"<html><head><title>T</title><p>{ONE}</p><p>{TWO}</p></html>",
        f"<title>T</title>{WHOLE}",
        f"<html><body><article><p title=John's>{ONE}</p><p>{TWO}</p></article></body></html>",
        f"<html><body><article><p title='a > b' data-x=\"c>d\">{ONE}</p><p>{TWO}</p></article></body></html>",
        f"<html><body><div class='post tag-news'><p>{ONE}</p><p>{TWO}</p></div></body></html>",
    ],
)
def test_no_markup_costs_an_article(page):
    assert main_text(page, trained()) == f"{ONE}\n{TWO}"


def test_formulas_are_text():
    assert main_text(f"<article><p>{ONE} <math><mi>x</mi></math> ends.</p><p>{TWO}</p></article>", trained()) == f"{ONE} x ends.\n{TWO}"


WORDS = "Rain fell on the town all night and the river rose over its banks by morning."
NAMES = "content-with-sidebar has-sidebar post_comments-open entry_share-enabled story_legal-news page_search-results widget-content social-story banner-story single-post_alert meta-article".split()


@pytest.mark.parametrize("name", NAMES)
def test_an_article_under_a_name_of_boilerplate(name):
    body = "".join(f"<p>{WORDS} ({i})</p>" for i in range(5))
    page = f'<body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="{name.replace("_", " ")}"><h1>High water</h1>{body}<div class="comments"><p>First comment here.</p></div></div><footer><p>&copy; us</p></footer>'
    assert main_text(page, trained()) == "High water\n" + "\n".join(f"{WORDS} ({i})" for i in range(5))


def test_a_page_within_one_form():
    body = "".join(f"<p>{WORDS} ({i})</p>" for i in range(5))
    page = f"<body><form action=x><nav><ul><li><a href=a>One</a></ul></nav><div><h1>High water</h1>{body}</div><footer><p>&copy; us</p></footer></form>"
    assert main_text(page, trained()) == "High water\n" + "\n".join(f"{WORDS} ({i})" for i in range(5))


def test_many_comments_are_no_article():
    talk = "".join(f"<div class=comment-body><p>{WORDS} ({i})</p></div>" for i in range(20))
    page = f"<body><article><h1>High water</h1><p>{WORDS}</p></article><section id=comments class=comments-content><h2>Comments</h2>{talk}</section>"
    assert main_text(page, trained()) == f"High water\n{WORDS}"


def test_comments_end_as_in_a_browser():
    for c in ("<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->"):
        assert shown(f"<p>A</p>{c}<p>B</p>") == ["A", "B"]
    assert shown("<p>A</p><!-- x <p>B</p>") == ["A"]


def test_pages_in_linear_time():
    import time

    for page in ("<a " * 350_000, "<div>" * 20_000 + "</p>" * 20_000, "<p>x</p>" + "<a b=" * 200_000, "<" * 500_000):
        began = time.process_time()
        blocks_of(page)
        assert time.process_time() - began < 6
