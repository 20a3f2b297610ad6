"""HTML whose names contradict its text: ratios decide."""

import random

import pytest

from populace.llm import html_text

rng = random.Random(1)
SAY = [" ".join(rng.choices("the quick brown fox jumps over a lazy dog and runs far away from here".split(), k=40)).capitalize() + "." for _ in range(6)]
PARAS = "".join(f"<p>{s}</p>" for s in SAY)
MENU = "<div class='menu'><a href='/'>Home</a> <a href='/x'>News</a> <a href='/y'>Sport</a></div>"
WANT = "\n\n".join(SAY)


@pytest.mark.parametrize("page", [
    f"<html><body><form id='aspnetForm' method='post'>{MENU}<div id='content'>{PARAS}</div><div class='footer'>Contact us</div></form></body></html>",
    f"<body>{MENU}<div class='share-price-report'>{PARAS}</div><div class='sidebar'><p>Ten tips.</p></div></body>",
    f"<body>{MENU}<div class='header-image-layout'>{PARAS}</div></body>",
    f"<body>{MENU}<article>{PARAS.replace(f'<p>{SAY[4]}</p>', f'<section class=related-work><p>{SAY[4]}</p></section>')}</article></body>",
    f"<body>{MENU}<div class='sidebar'><div class='promo'><p>Buy now.</p></div></div><div class='widget'>{PARAS}</div></body>",
])
def test_text_outvotes_names(page):
    assert html_text.extract(page) == WANT


@pytest.mark.parametrize("extra", [
    f"<div class='cookie-notice'><p>{SAY[0]}</p></div>", f"<div id='ad-slot-3'>{SAY[1]}</div>", "<div class='related-stories'><a href='a'>One</a> <a href='b'>Two</a> <a href='c'>Three</a></div>",
    f"<form><p>{SAY[2]}</p><input></form>", f"<div class='comments-of-the-week'><p>{SAY[3]}</p></div>", f"<form class='x'><div class='newsletter'><p>{SAY[5]}</p></div></form>",
])
def test_names_still_drop_what_is_beside_an_article(extra):
    for page in (f"<body>{MENU}<article>{PARAS}</article>{extra}</body>", f"<body>{extra}<article>{PARAS}{extra}</article></body>", f"<body>{MENU}<div>{PARAS}{extra}</div></body>"):
        assert html_text.extract(page) == WANT


def test_ratios_change_what_names_do():
    """Without ratios names that say other things too are never believed, in articles as well."""
    page = f"<body><article>{PARAS}<div class='related-reading-ideas'><ul>{'<li><b>Go</b> <i>on</i> <em>now</em></li>' * 4}</ul></div></article></body>"
    assert html_text.extract(page) == WANT and html_text.extract(page, ratios=False) != WANT


def test_comments_alone_and_nothing_else():
    assert html_text.extract(f"<body><div class='comments'>{PARAS}</div></body>") == ""
    assert html_text.extract("<form></form>") == "" and html_text.extract("<form>Search</form><article></article>") == ""
