"""Text in formulas and fallback text of embedded elements is text of the article."""

import pytest

from quernstone.llm import html_extract


@pytest.mark.parametrize("tag", ["math", "object", "video", "audio", "canvas"])
def test_text_of_embedded_elements_stays(tag):
    page = f"<article><p>The sum of both <{tag}><b>a</b> + b</{tag}> is known to all readers.</p></article>"
    assert html_extract.extract(page) == "The sum of both a + b is known to all readers."


@pytest.mark.parametrize(
    "element", ['div class="side-effects"', 'section class="related-work"', 'p class="share-price"', 'p class="form-factor"', 'p class="comment-on-text"', 'p id="reply"', 'div class="promotional-history"', 'div class="has-sidebar"', 'h2 id="comments"', 'div class="header-files notes"'],
)
def test_a_name_counts_word_by_word(element):
    tag = element.split()[0]
    page = f"<article><p>One long opening sentence of the article stands here.</p><{element}>This belongs to the text and stays in it.</{tag}><p>And the last sentence of all stands here.</p></article>"
    assert "This belongs to the text and stays in it." in html_extract.extract(page).split("\n")


@pytest.mark.parametrize("name", ["ad", "ad-slot", "ad-300x250", "google_ads", "cookie-banner", "newsletter-signup-form", "related-posts", "share-buttons", "social-links", "sidebar-left", "post-comments", "comment-list", "site-footer", "sponsored"])
def test_foreign_boxes_go(name):
    page = f'<article><p>One long opening sentence of the article stands here.</p><div class="x {name}">Buy these things now.</div><p>And the last sentence of all stands here.</p></article>'
    assert html_extract.extract(page) == "One long opening sentence of the article stands here.\nAnd the last sentence of all stands here."


def test_a_button_in_a_sentence_is_text():
    page = "<article><p>Press <button>Save</button> to keep what you have written so far.</p><button>Subscribe</button></article>"
    assert html_extract.extract(page) == "Press Save to keep what you have written so far."
