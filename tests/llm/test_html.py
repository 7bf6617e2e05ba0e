import html
import re
import time

import pytest

from lexiloom.llm import html_extract
from lexiloom.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def weights():
    return html_extract.trained()


def test_cut_mends_what_the_classifier_alone_gets_wrong(weights):
    """On made pages that training never saw: the cut changes labels, and more for the better than for the worse."""
    blocks = flipped = right = wrong = wrong_alone = 0
    for page, labels in labelled_pages(200, 99, 2.0):
        for block, kept, alone in zip(*html_extract.label_blocks(page, weights)):
            if block.text in labels:
                blocks += 1
                flipped += kept != alone
                right += kept != alone and kept == labels[block.text]
                wrong += kept != labels[block.text]
                wrong_alone += alone != labels[block.text]
    assert flipped >= 0.002 * blocks and right >= 0.7 * flipped
    assert wrong < wrong_alone and wrong <= 0.015 * blocks


def test_pages_of_the_table_against_their_articles(spark, weights):
    """Brute force: in these pages the article element holds the text, its blocks are its headings and paragraphs."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        parts = [re.sub(r"<br>", "\n", x) for x in re.split(r"</?(?:p|h1)>", article)]
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert got[row.page_id] == "\n\n".join(x for x in texts if x)


LONG = "A long sentence about things, and what they are, that goes on for a while. " * 3


@pytest.mark.parametrize("page,want", [
    ("<article><h1>On sums</h1><p>Let <math><mi>x</mi></math> be a number, and so on, as it is said.</p></article>", "On sums\n\nLet x be a number, and so on, as it is said."),
    ("<article><p>A picture <svg><text>of it</text></svg> and <object data=x>its fallback</object> <noscript>follow</noscript> here.</p></article>", "A picture of it and its fallback follow here."),
    (f"<form><div id=main><h1>Title here</h1><p>{LONG}</p><p>More of it, of the same kind, follows here.</p></div><input></form>", f"Title here\n\n{LONG.strip()}\n\nMore of it, of the same kind, follows here."),
    (f'<div class="essay comments"><p>{LONG}</p><p>{LONG}It ends.</p></div>', f"{LONG.strip()}\n\n{LONG}It ends."),
    (f'<div class="essay"><h1>One</h1><p>{LONG}</p></div><div class="comments"><p>I think so too, and say so.</p><p>Me too.</p></div>', f"One\n\n{LONG.strip()}"),
    ("<article><p>One &amp; two&nbsp;&#51; <b>bold</b>\n text &lt;p&gt;.</p><table><tr><td>a<td>b</table></article>", "One & two 3 bold text <p>.\n\na\n\nb"),
    (f'<article><p>{LONG}</p><div class="ad-slot"><p>Buy now cheap shoes.</p></div><p>{LONG}</p></article>', f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f'<article><h1>One</h1><p>{LONG}</p><aside class="advertisement">Many other things, today only, for little.</aside><p>{LONG}</p></article>', f"One\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><button>Share</button><label>Name</label><p>{LONG}</p></article>", f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<div><h1>One</h1><p>{LONG}</p><h3>3 Comments</h3><div><b>Bob</b><p>I think so too, and say so.</p></div><div><b>Ann</b><p>Me too.</p></div></div>", f"One\n\n{LONG.strip()}"),
    (f"<article><h1>One</h1><p>{LONG}</p></article><section><h3>Comments (2)</h3><p>I think so too, and say so.</p></section>", f"One\n\n{LONG.strip()}"),
    (f"<article><h1>One</h1><p>{LONG}</p><h2>Results</h2><p>{LONG}</p><h3>Comments on the method</h3><p>{LONG}</p></article>", f"One\n\n{LONG.strip()}\n\nResults\n\n{LONG.strip()}\n\nComments on the method\n\n{LONG.strip()}"),
    ("Just some text, that stands here without any tags. It goes on.", "Just some text, that stands here without any tags. It goes on."),
    ("<nav><a href=/>Home</a></nav><footer>all rights reserved</footer>", ""),
])
def test_small_pages(weights, page, want):
    assert html_extract.extract(page, weights)[0] == want


@pytest.mark.parametrize("page", [
    "<p>" + "<span>" * 100_000 + "x</b>" * 100_000, "<b>" * 40_000 + "<span>" * 40_000 + "</b>" * 40_000, '<a "' * 100_000, "<a href='\">" * 50_000,
    "<a><p>" * 40_000 + "</a>" * 40_000, "<" * 300_000, "<!--" * 100_000, "<style>x</style" * 60_000, "<ul><li>w " * 30_000, "<tr><td>w " * 30_000,
])
def test_unbalanced_pages_take_linear_time(weights, page):
    start = time.process_time()
    html_extract.extract(page, weights)
    assert time.process_time() - start < 5


def test_comments_end_at_the_next_heading(weights):
    blocks, _ = html_extract.parse_blocks(f"<div><h1>a</h1><p>b</p><h3>2 Replies</h3><p>c</p><div><p>d</p></div><h2>e</h2><p>f</p></div><p>g</p>")
    assert html_extract.under_comments_heading(blocks) == [False, False, True, True, True, False, False, False]
    blocks, _ = html_extract.parse_blocks("<section><h2>Comments</h2><p>a</p><h3>b</h3></section><p>c</p>")
    assert html_extract.under_comments_heading(blocks) == [True, True, True, False]
