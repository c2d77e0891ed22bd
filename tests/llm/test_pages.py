"""Marks, the tree's part in marked pages, and precision and recall on pages labelled by hand."""

import pytest

from chainloom.llm import html_text

TEXT = "real text here for the story that goes on for a good while"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single has-sidebar"><article><p>{TEXT}</p></article></body>',
        f'<body class="no-sidebar"><article><p>{TEXT}</p></article></body>',
        f'<div class="layout-with-sidebar"><article><p>{TEXT}</p></article></div>',
        f'<article class="post comments-open"><p>{TEXT}</p></article>',
        f'<article class="post tags-music"><p>{TEXT}</p></article>',
        f'<article class="shop-review"><p>{TEXT}</p></article>',
        f'<body data-id="share"><article data-class="comment"><p>{TEXT}</p></article></body>',
        f'<article aria-label="the hidden truth" title="display: none"><p>{TEXT}</p></article>',
    ],
)
def test_names_that_only_look_like_asides(page):
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("row", ["<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>", "<div><a>one</a> <a>two</a> <a>three</a></div>"])
def test_a_row_of_links_goes_from_a_marked_article(row):
    assert html_text.main_text(f"<main><p>{TEXT}</p>{row}<p>The end.</p></main>") == f"{TEXT} The end."
    assert html_text.main_text(f"<main><p>{TEXT}</p><p><a>All of it a link</a></p><p>The end.</p></main>") == f"{TEXT} All of it a link The end."


def test_the_tree_changes_marked_pages():
    words = "plain words of the story " * 24
    outside = f"<article><p>A teaser.</p></article><div><p>{words}</p><p>{words}</p><p>{words}</p><p>{words}</p></div>"
    assert html_text.main_text(outside).count("story") > 48
    page = f"<main><p>{TEXT}</p><ul><li><a>one</a><li><a>two</a></ul></main>"
    by_mark = [b.main for b in html_text.blocks(page)]
    by_tree = [html_text.decide(html_text.tree(), f) for f in html_text.block_features(html_text.blocks(page))]
    assert by_mark == [1, 1, 1] and by_tree == [1, 0, 0]


#: Pages of other builds than the table's: every block that is main text holds the word "yes", every other one "no".
LABELLED = [
    '<body><div id="top"><a>no</a> <a>no</a></div><div class="story"><h1>yes headline</h1><p>yes a</p><p>yes and some more words of it</p></div><div id="comments"><p>no I think not</p></div></body>',
    '<header><h1>no site</h1></header><main role="main"><h2>yes title</h2><p>yes one two three</p><blockquote>yes they said</blockquote><nav><a>no</a></nav></main><footer>no</footer>',
    '<div class="wrapper"><div class="col"><h1>yes a longer headline of a story</h1>' + "".join(f"<p>yes {'word ' * 30}</p>" for _ in range(4)) + '</div><div class="col2"><a>no more</a><br><a>no less</a></div></div>',
    '<article><header><h1>yes</h1><ul class="social-links"><li><a>no</a></ul></header><p>yes text</p><figure><figcaption>yes a picture</figcaption></figure><div class="newsletter-box"><p>no sign up now for all of our news</p></div><p>yes end</p></article>',
    '<div role="navigation"><p>no menu</p></div><div role="main"><p>yes</p><table><tr><td>yes 1</td><td>yes 2</td></tr></table></div><div role="complementary"><p>no beside</p></div>',
    '<div id="cookieConsent"><p>no we use cookies to make this site a better place for all of us, do you agree?</p></div><main><p>yes short</p><p>yes <a>some link</a> in a sentence of words</p></main>',
    '<article><p>yes story words here</p><ul><li><a>no also read</a></li><li><a>no and this</a></li><li><a>no and that</a></li></ul></article><p class="copyright">no all rights</p>',
    '<table><tr><td><a>no</a></td><td><a>no</a></td></tr></table><div><h1>yes headline here</h1>' + "".join(f"<p>yes {'text ' * n}</p>" for n in (20, 60, 35, 18)) + "</div><p>no contact</p>",
    '<section class="post-content"><p>yes entry</p><p style="display:none">no hidden</p><p>yes more</p></section><section class="related"><p>no look at this as well</p></section>',
    '<main><article><h1>yes</h1><p>yes</p></article><article class="comment"><p>no reader says</p></article><form><p>no leave a reply</p></form></main>',
]


def test_precision_and_recall_on_labelled_pages():
    right = kept = main = 0
    for page in LABELLED:
        found = html_text.blocks(page)
        for block, row in zip(found, html_text.block_features(found), strict=True):
            yes, got = block.text.startswith("yes"), html_text.decide(html_text.tree(), row)
            right, kept, main = right + (yes and got), kept + got, main + yes
    assert main == 30
    assert right / kept >= 0.95 and right / main >= 0.95, (right, kept, main)
