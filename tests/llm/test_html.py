"""Attributes are read one after the other, and names alone do not decide over long text."""

from __future__ import annotations

import pytest

from evalforge.llm.html_extract import main_text

LONG = "A sentence of the article, with commas, of some length, that says a thing or two about its subject, and then goes on for a while longer, as articles do."
OTHER = "Another paragraph, also of some length, which the page has beside the first one, so that there is prose elsewhere, as there mostly is on a page."


@pytest.mark.parametrize("page, want", [
    (f'<body><div style="overflow: hidden"><p>{LONG}</p><p>{OTHER}</p></div></body>', f"{LONG}\n\n{OTHER}"),
    (f'<body style="overflow: hidden"><p>{LONG}</p></body>', LONG),
    (f'<div><p title="the hidden life">{LONG}</p><p data-x="a role=search b">{OTHER}</p></div>', f"{LONG}\n\n{OTHER}"),
    (f"<div><p data-y='class=\"comments\"'>{LONG}</p><p data-hidden>{OTHER}</p></div>", f"{LONG}\n\n{OTHER}"),
    (f'<article><div class="popular-science"><p>{LONG}</p></div><div><p>{OTHER}</p></div></article>', f"{LONG}\n\n{OTHER}"),
    (f'<article><div class="legal-analysis"><p>{LONG}</p></div><div id="search-results-discussion"><p>{OTHER}</p></div></article>', f"{LONG}\n\n{OTHER}"),
    (f'<article><p>{LONG}</p><div class="search-results"><p>{OTHER}</p></div></article>', f"{LONG}\n\n{OTHER}"),
    (f"<article><p>{LONG}</p><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds in all of these cases.</p><address>12 Long Street, Town</address></article>", f"{LONG}\n\nSo a=2 holds in all of these cases.\n\n12 Long Street, Town"),
])
def test_text_that_a_name_or_a_value_must_not_hide(page, want):
    assert main_text(page) == want


def test_references_stay_and_menus_go():
    item = "Author, A. and Writer, B. (2011). A long title of a paper on some subject. Journal of Results, 12, 3-45."
    refs = "".join(f'<li><a href="#{i}">{item}</a></li>' for i in range(3))
    menu = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(9))
    got = main_text(f"<article><p>{LONG}</p><ol>{refs}</ol><ul>{menu}</ul></article>")
    assert got == "\n\n".join([LONG, item, item, item])


@pytest.mark.parametrize("attr", ['hidden', 'aria-hidden="true"', 'role=search', 'class="comments-list"', 'class="cookie-notice"', 'id=ad-slot-3', 'class="popular"', "data-a='x' hidden", 'class="site-search box"'])
def test_what_is_outside_still_goes(attr):
    short = "Some words that are no article."
    text = OTHER if "comments" in attr or "hidden" in attr or "role" in attr else short
    assert main_text(f"<article><p>{LONG}</p><div {attr}><p>{text}</p></div></article>") == LONG
