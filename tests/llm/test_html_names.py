"""Words of class and id on containers: they raise a doubt, and don't take the article away."""

import pytest

from dossier.llm.html_text import main_text

P = [
    "The first paragraph of the article tells, at some length, what happened on the day in question, and to whom.",
    "A second paragraph goes on from there, with details, names, places, and a number of further remarks on it all.",
    "The third one ends the matter, as far as it can be ended, and thanks all those who have read up to this point.",
]
TEXT = "\n".join(P)
BODY = "".join(f"<p>{p}</p>" for p in P)
COMMENT = "<p>I have read this, and I must say that I don't agree with any of it, not even with the date and the place given.</p>"
LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Another page, number {k}</a></li>' for k in range(8)) + "</ul>"

CONTAINERS = [
    '<div class="layout has-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<div class="content no-ads">{}</div>',
    '<div id="page-login-article">{}</div>', '<div class="site sidebar-right"><div class="main-col">{}</div></div>',
    '<body class="with-cookie-banner modal-open"><div>{}</div></body>', '<div class="menu-page"><div class="nav-wrapper">{}</div></div>',
    '<div class="subscribe-enabled"><section id="newsletter-archive">{}</section></div>', '<div class="footerless page-footer-wrap">{}</div>',
    '<section class="commentary">{}</section>',
]


@pytest.mark.parametrize("container", CONTAINERS)
def test_a_container_named_like_boilerplate(container):
    assert main_text(container.format(BODY)) == TEXT
    around = f'<nav>{LINKS}</nav><div class="sidebar">{LINKS}</div>{{}}<div class="footer">All rights reserved.</div>'
    assert main_text(around.format(container.format(BODY))) == TEXT


#: Ten layouts of common site templates: the article, and what is around and within it.
TEMPLATES = [
    '<div id="page" class="hfeed site has-sidebar"><header id="masthead"><h1>Site</h1></header><div id="content"><article class="post type-post">{b}</article>'
    '<div id="comments" class="comments-area">{c}</div></div><div id="secondary" class="widget-area sidebar">{l}</div></div>',
    '<div class="layout-container"><div class="region region-header">{l}</div><main><div class="node node--type-article comments-enabled">{b}</div></main></div>',
    '<div class="container"><div class="row"><div class="col-md-8 blog-main">{b}</div><aside class="col-md-4 blog-sidebar">{l}</aside></div></div>',
    '<div class="wrapper no-nav"><div class="post-content">{b}<div class="ad-slot"><p>Buy one of these, and get another one for nothing, only today and only here.</p></div></div></div>',
    '<div class="page sidebar-left"><div class="sidebar">{l}</div><div class="story">{b}</div><div class="story-comments">{c}{c}{c}{c}{c}{c}{c}{c}</div></div>',
    '<div class="login-layout"><div class="cookie-consent"><p>We use cookies, as everybody does, to make all this work, and you may accept or refuse them.</p></div>{b}</div>',
    '<table class="nav-frame"><tr><td class="menu">{l}</td><td class="text">{b}</td></tr></table>',
    '<div class="article-page"><div class="breadcrumbs">{l}</div><div itemprop="articleBody">{b}</div><div class="pagination">{l}</div><div class="newsletter-signup"><p>Sign up to get a letter from us, every week.</p></div></div>',
    '<div class="modal-open"><div class="modal"><p>Please sign in to go on, or make an account, it takes no more than a minute or two of your time.</p></div><section>{b}</section></div>',
    '<div id="sidebar-page"><div class="post">{b}</div><div class="commentlist">{c}{c}{c}{c}{c}{c}{c}{c}{c}{c}</div></div>',
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates_give_the_article_alone(template):
    assert main_text(template.format(b=BODY, c=COMMENT, l=LINKS)) == TEXT


def test_boilerplate_stays_out_beside_a_short_article():
    assert main_text(f"<article><p>{P[0]}</p></article><div class='comments'>{COMMENT * 30}</div>") == P[0]
    assert main_text(f"<div><p>{P[0]} <span class='ad'>Buy!</span> On.</p></div><div class='ads'>{BODY}</div>") == f"{P[0]} On."
    assert main_text(f'<div class="nav-wrapper"><p>{P[0]} <span class="share">Share!</span></p></div>') == P[0]


def test_no_page_of_prose_is_empty():
    from dossier.llm.html_text import VAGUE, WORDS

    for word in sorted(WORDS | VAGUE):
        for page in ('<div class="{w}">{b}</div>', '<div id="x-{w}-y"><div class="{w}">{b}</div></div>', '<div class="{w}"><p class="{w}">x</p>{b}</div>'):
            assert TEXT in main_text(page.format(w=word, b=BODY * 2)), (word, page)


def test_many_nested_doubts_take_linear_time():
    import time

    began = time.time()
    for n in (2_000, 20_000):
        page = "<div class='nav'>" * n + BODY + "</div>" * n
        assert main_text(page) == TEXT
    assert time.time() - began < 20
