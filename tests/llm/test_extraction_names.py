"""Main text: parts that compound names, changed case and plurals mark, and names that only look like it."""

import pytest

from lexgraph.llm import extraction

STORY = "word " * 60


@pytest.mark.parametrize("mark", [
    'class="reader-comments"', 'id="user-comments"', 'class="commentList"', 'class="newsletter-signup"', 'class="related-articles"', 'class="advert-slot"', 'id="ReaderComments"', 'class="post_comments_section"', 'class="adSlot"',
    'class="alert"', 'id="cookieConsent"', 'class="recommendedStories"', 'class="breadcrumbs-trail"', 'id="SIDEBAR"', 'class="userComment"', 'class="sponsored-by-acme"',
])
def test_left_out(mark):
    for tag in ("div", "section"):
        assert extraction.main_text(f"<article><p>{STORY}</p><{tag} {mark}><p>not this, however long it may be</p></{tag}><p>End.</p></article>") == f"{STORY.strip()}\nEnd."


@pytest.mark.parametrize("mark", ['class="no-comments"', 'id="comments-on-the-theory"', 'class="with-sidebar"', 'class="story"', 'class="news-article"', 'class="user-zone"', 'id="related-work"', 'class="has-newsletter"', 'class="commentary"', 'class="addition"', 'class="articleBody"'])
def test_kept(mark):
    assert extraction.main_text(f"<article><p>{STORY}</p><div {mark}><p>this, too</p></div></article>") == f"{STORY.strip()}\nthis, too"
