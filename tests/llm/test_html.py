import time

import pytest

from loamgrid.llm import htmltext

TREE = htmltext.train_tree()
P = "<p>" + "Many words of the article stand here in a paragraph that is long enough. " * 4 + "</p>"
Q = "<p>" + "A reader wrote this remark of some length below the text, as readers do. " * 9 + "</p>"
SIDE = '<div class="sidebar"><a href="/x">Other page</a> <a href="/y">Next page</a></div>'
ONE = " ".join(P[3:-4].split())


def text(page):
    return htmltext.main_text(page, TREE)


@pytest.mark.parametrize("frame", ['div class="content-with-sidebar"', 'div class="two-col sidebar-left"', 'article class="tag-social"', 'div id="page-promo"', 'div class="has-comments"', 'main class="no-sidebar"'])
def test_frames_keep_their_article_and_lose_what_is_beside_it(frame):
    name = frame.split()[0]
    assert text(f"<body><{frame}>{P}{P}{SIDE}</{name}></body>") == f"{ONE} {ONE}"


@pytest.mark.parametrize("readers", ['section class="comments"', 'div id="disqus_thread"', 'div class="replies"', "aside", "footer", 'div style="display: none"'])
def test_long_other_matter_is_no_frame(readers):
    name = readers.split()[0]
    assert text(f"<body><div>{P}</div><{readers}>{Q}{Q}{Q}</{name}></body>") == ONE
    assert text(f"<body><article>{P}</article><{readers}>{Q}{Q}{Q}</{name}></body>") == ONE


def test_short_paragraphs_and_headings_of_an_article_stay():
    links = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul>'
    assert text(f"<body><article>{P}<p>Short.</p>{links}</article></body>") == f"{ONE} Short."
    assert text(f'<body><article><h2 id="search">Search</h2>{P}</article></body>') == f"Search {ONE}"


def test_nested_other_matter_in_a_frame_goes():
    inner = f'<div class="promo-frame"><article>{P}{P}<div class="share">Share this now</div></article>{SIDE}</div>'
    assert text(f"<body>{inner}</body>") == f"{ONE} {ONE}"


def test_open_headers_and_asides_take_linear_time():
    def seconds(n):
        began = time.process_time()
        htmltext.blocks("<header>x" * n)
        htmltext.blocks('<div class="sidebar">x' * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(32_000) < 24 * max(seconds(4000), 0.01)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></p>", "<article>" * 50, "<!-- " + P, "<svg/>" + P])
def test_broken_pages(page):
    assert isinstance(text(page), str)
