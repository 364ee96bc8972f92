"""Whole articles and nothing else: pages whose parts are known, put together from marked pieces."""

from __future__ import annotations

import itertools

import pytest

from cloudloom.llm import html

LONG = "This is a long paragraph, with commas, and with enough words to be taken for the body of an article, as it is one indeed. " * 4
MORE = "Another paragraph follows the first, it is long too, and it has commas, words and full stops, as bodies of articles have. " * 3
GONE = "Someone says something at great length, with commas, and with many words, which is not part of the article at all. " * 12


def words(text: str) -> str:
    return " ".join(text.split())


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>{body}<footer>Foot</footer></body></html>"


FURNITURE = [
    f'<div class="user-comments"><p>{GONE}</p></div>', f'<div class="comment-thread"><div class="comment-body"><p>{GONE}</p></div></div>', f'<section id="comments"><article class="comment"><p>{GONE}</p></article></section>',
    '<div class="cookie-message">We use cookies, as all do, and ask you to accept them now, please.</div>', f'<aside><p>{GONE}</p></aside>', f'<div class="article-comments"><p>{GONE}</p></div>', f'<div id="disqus_thread"><p>{GONE}</p></div>',
    '<div class="share-buttons">Share this page, if you like, with all your friends and family today.</div>', '<form><p>Your name, your mail, and your message to us.</p></form>', '<div class="newsletter-signup">Sign up, it is free, to get our letters each week.</div>',
]


@pytest.mark.parametrize("furniture", FURNITURE)
@pytest.mark.parametrize("wrap", ["<article>{}</article>{}", "<main><article>{}</article>{}</main>", "<div id='content'><div class='post'>{}</div>{}</div>", "<div class='text'>{}</div>{}"])
def test_comments_and_notices_are_never_returned(furniture, wrap):
    body = f"<h2>A heading</h2><p>{LONG}</p><p>{MORE}</p>"
    assert html.main_text(page(wrap.format(body, furniture)))[0] == words(f"A heading {LONG} {MORE}")


WHOLE = {
    "short last part": (f'<div class="part"><p>{LONG}</p></div><div class="part"><h2>Last</h2><ul><li>one</li><li>two</li></ul></div>', f"{LONG} Last one two"),
    "two articles": (f"<article><p>{LONG}</p></article><article><p>Short one.</p></article>", f"{LONG} Short one."),
    "figure and table": (f"<div class='wrap'><div class='text'><p>{LONG}</p></div><figure><img src='x'><figcaption>A caption</figcaption></figure><table><tr><td>a</td><td>b</td></tr></table></div>", f"{LONG} A caption a b"),
    "title in a header": (f"<main><header><h1>The title</h1></header><div><p>{LONG}</p></div></main>", f"The title {LONG}"),
    "title before": (f"<h1>The title</h1><div><div><p>{LONG}</p><p>{MORE}</p></div></div>", f"The title {LONG} {MORE}"),
    "text of its own": (f"<div id='w'>Straight into it. <div><p>{LONG}</p></div> And out.</div>", f"Straight into it. {LONG} And out."),
    "state names": (f'<div class="post comments-open has-sidebar"><p>{LONG}</p></div>', LONG),
    "program text": (f'<article><p>{LONG}</p><pre><span class="comment"># a comment</span> x = 1</pre></article>', f"{LONG} # a comment x = 1"),
    "related work": (f'<article><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>{MORE}</p></section></article>', f"{LONG} Related work {MORE}"),
    "nested sections": (f"<main><section><h2>a</h2><p>{LONG}</p></section><section><h2>b</h2><p>short</p></section></main>", f"a {LONG} b short"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_no_part_of_an_article_is_lost(name):
    body, want = WHOLE[name]
    assert html.main_text(page(body))[0] == words(want)


def test_pages_put_together_from_known_parts():
    """Every order of two content blocks with furniture between them; the expected text is that of the blocks alone."""
    blocks = [(f"<p>{LONG}</p>", LONG), (f"<h2>Title</h2><p>{MORE}</p>", f"Title {MORE}"), ("<ul><li>a point, made</li><li>another</li></ul>", "a point, made another"), (f"<blockquote>{MORE}</blockquote>", MORE)]
    for (a, ta), (b, tb) in itertools.permutations(blocks, 2):
        for f in FURNITURE[:5]:
            got = html.main_text(page(f"<article><p>{LONG}</p>{a}{f}{b}</article>"))[0]
            assert got == words(f"{LONG} {ta} {tb}")
