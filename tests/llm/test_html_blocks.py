"""Blocks that an article ends with, and comments around it, with weights learned from the smallest pages."""

import pytest

from paceline.llm import htmlregion

SF = "/root/testdata/sf0.001"
TEXT = "The council met on Monday and agreed on the new plan for the old harbour."


@pytest.fixture(scope="module")
def model(spark):
    return htmlregion.learn(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("block, text", [
    ("<table><tr><td>one</td><td>two</td></tr><tr><td>three</td><td>four</td></tr></table>", ["one", "two", "three", "four"]),
    ("<dl><dt>term</dt><dd>what it says</dd></dl>", ["term", "what it says"]),
    ("<figure><img src=x><figcaption>cap</figcaption></figure>", ["cap"]),
    ("<x-note>odd</x-note>", ["odd"]),
])
def test_closing_blocks_of_an_article_stay(model, block, text):
    page = f"<html><body><nav><a href=a>Home</a></nav><article><h1>Plan</h1><p>{TEXT}</p>{block}</article><footer>Imprint</footer></body></html>"
    assert model.extract(page).split("\n") == ["Plan", TEXT, *text]


@pytest.mark.parametrize("page", [
    f"<body><article><p>{TEXT}</p></article><section id='comments-area'><p>I liked this plan very much indeed, thanks.</p></section></body>",
    f"<body><article><p>{TEXT}</p><section class='reader-comments'><p>I liked this plan very much indeed, thanks.</p></section></article></body>",
    f"<body><div class='content'><p>{TEXT}</p></div><section class='reader-comments'><p>I liked it very much indeed, thanks.</p></section></body>",
    f"<body><article><p>{TEXT}</p></article><ol class='comment_list'><li>I liked this plan very much indeed, thanks.</li></ol></body>",
])
def test_comments_are_left_out(model, page):
    assert model.extract(page) == TEXT
