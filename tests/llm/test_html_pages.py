"""Hand-made pages whose markup is unlike that of the tables."""

import time

import pytest

from larkspur.llm.html import main_text

TEXT = "The text of it is here and it is long enough."
PAGES = {
    "a wrapper that has a sidebar": (f'<div class="layout has-sidebar"><article><p>{TEXT}</p></article></div>', TEXT),
    "a wrapper without a footer": (f'<div class="page no-footer"><main><p>{TEXT}</p></main></div>', TEXT),
    "names that mention parts of a page": (f'<body class="x"><div class="sidebar-layout header-fixed"><article><p>{TEXT}</p></article></div>', TEXT),
    "a form around the page": (f'<form action="/x"><div id="header">menu</div><article><p>{TEXT}</p></article></form>', TEXT),
    "an anchor that is named like a search": (f'<article><section id="search"><p>{TEXT}</p></section><h2 id="notices">Notices</h2></article>', TEXT + "\nNotices"),
    "a list of references": (f'<article><p>{TEXT}</p><ul><li><a href="/a">One reference</a></li><li><a href="/b">Another one</a></li></ul></article>', TEXT + "\nOne reference\nAnother one"),
    "an apostrophe in a bare value": (f"<article><p title=it's>One.</p><p>{TEXT}</p></article>", "One.\n" + TEXT),
    "a stray quote after a value": (f'<article><p>One <a href="x"">link</a> more.</p><p>{TEXT}</p></article>', "One link more.\n" + TEXT),
    "a stray quote in a name": (f'<article><p>One.<img alt="5" tall"> More.</p><p>{TEXT}</p></article>', "One. More.\n" + TEXT),
    "blanks around the equals sign, and none before a slash": (f'<article><p class = "x" >One.</p><br/><p data-a=1/>{TEXT}</article>', "One.\n" + TEXT),
    "an angle bracket in a value": (f'<article><p title="a > b">{TEXT}</p></article>', TEXT),
    "a real sidebar, comments and teasers": (
        f'<div class="left-sidebar"><article class="teaser"><p>Teaser.</p></article></div><article><p>{TEXT}</p></article><section id="comments"><article class="comment">'
        "<p>First comment!</p></article></section><aside><article>Read next</article></aside><footer>foot</footer>", TEXT),
    "notices inside an article": (f'<article><p>{TEXT}</p><div class="share-buttons">Share this</div><div class="cookie-notice">We use cookies.</div><form>Your name</form><p>{TEXT}</p></article>', TEXT + "\n" + TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_broken_markup_takes_no_long():
    for page in ("<a " + "x=" * 200_000, "<p " + "'" * 200_000, '<p a="' * 50_000, "<" * 200_000, "<p a= " * 50_000):
        start = time.time()
        main_text(page)
        assert time.time() - start < 5
