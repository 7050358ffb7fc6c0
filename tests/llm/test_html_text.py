import html
import re
import time
from collections import Counter

import pytest

from quarry.llm.html_text import extract, labels, main_text, op6_html_extraction
from tests.conftest import SF_MID

STORY = "It was the best of the days and all of the people of the town were in the square to see what had come. "


def test_boilerplate_containers_go():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><p>{STORY * 3}</p></header>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">{STORY * 3}</div>
    <main><h1>Head line</h1><p>{STORY * 3}</p><p>Short &amp; sweet.</p><div id="sidebar"><p>{STORY * 3}</p></div>
    <p>{STORY}<b>in</b>side&nbsp;it &#233;</p><script>var a = "</p>";</script><form><p>{STORY}</p></form>
    <section class="comments"><p>{STORY * 4}</p></section></main><footer>{STORY * 3}</footer></body></html>"""
    story = STORY.strip()
    assert main_text(page) == f"Head line {' '.join([story] * 3)} Short & sweet. {story} inside it é"


def test_ambiguous_blocks_take_their_neighbours_label():
    good, short, links = (STORY * 4, 0, False, False), ("Tiny one", 0, False, False), ("Home About", 10, False, False)
    assert labels([good, short, good]) == [True, True, True]
    assert labels([good, short, links]) == [True, False, False]
    assert labels([links, short]) == [False, False] and labels([short, good]) == [True, True]


def test_without_article_element():
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{STORY * 3}</div><div>Brief line</div><div>{STORY * 3}</div>"
    assert main_text(page) == f"{(STORY * 3).strip()} Brief line {(STORY * 3).strip()}"


def test_broken_markup():
    assert main_text(None) == "" and main_text("") == "" and main_text("<article") == "" and main_text("<<<>>> <") == ""
    assert main_text(f"<article><p>{STORY}<br><p>{STORY}&am") == f"{STORY}{STORY}&am"
    assert main_text(f"<article><p>{STORY}</p><script>never closed <p>x") == STORY.strip()
    assert main_text(f"<ARTICLE><P>{STORY}<!-- a > b --></P></ARTICLE><FOOTER>x") == STORY.strip()


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<a '", "<!--", "<![CDATA[", "<script>", "<button>", "<svg>", "</p", "<p class= \"", "<"])
def test_time_is_linear(unit):
    """Five megabytes of items that never end, with one open quote after them."""
    page = f"<p>{STORY * 4}</p>" + unit * (5_000_000 // len(unit)) + '"'
    begin = time.process_time()
    got = main_text(page)
    assert got.startswith(STORY.strip()) and time.process_time() - begin < 20


def test_open_quotes_lose_no_text():
    story = (STORY * 3).strip()
    assert main_text(f"<p class=it's>{STORY * 3}</p><p>{STORY * 3} it's</p>") == f"{story} {story} it's"
    assert main_text(f"<p class=\"a>{STORY * 3}</p>") == story
    assert main_text(f"<p title='a > b' class = \"x\">{STORY * 3}</p>") == story


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "canvas", "map", "audio", "video", "math"])
def test_unclosed_elements_keep_the_article(tag):
    story = (STORY * 3).strip()
    assert main_text(f"<article><p>{STORY * 3}</p><{tag}>Press<p>{STORY * 3}</p></article>") == f"{story} {story}"
    assert main_text(f"<article><p>{STORY * 3}</p><{tag}>Press</{tag}><p>{STORY * 3}</p></article>") == f"{story} {story}"


def test_button_closed_by_a_later_one():
    story = (STORY * 3).strip()
    page = f"<article><button>One<p>{STORY * 3}</p><button><div>Two</div></button><p>{STORY * 3}</p></article>"
    assert main_text(page) == f"{story} {story}"


def test_short_pages_and_other_languages():
    assert main_text("<nav><a href=x>Home</a></nav><p>One short line about a small town.</p><footer>Imprint</footer>") == \
        "One short line about a small town."
    line = "Сегодня утром жители маленького города собрались на площади и долго говорили о новой дороге. "
    page = f"<div class=menu><a href=x>Дом</a></div><div>{line * 4}</div><div><a href=y>{line}</a></div><p>{line * 3}</p>"
    assert main_text(page) == f"{(line * 4).strip()} {(line * 3).strip()}"
    han = "今天早上小镇的居民聚集在广场上讨论新的道路" * 12
    assert main_text(f"<nav>菜单</nav><p>{han}</p>") == han


def test_pages_without_their_article_element(spark):
    """The two passes alone find nearly all words of the articles, and hardly any others."""
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").collect()
    found = wanted = extra = 0
    for p in pages:
        want = main_text(p.html).split()
        got = main_text(re.sub(r"</?(article|main)\b[^>]*>", "", p.html)).split()
        both = sum((Counter(want) & Counter(got)).values())
        found, wanted, extra = found + both, wanted + len(want), extra + len(got) - both
    assert found > 0.95 * wanted and extra < 0.05 * wanted


def test_query(spark):
    got = {r.page_id: r for r in op6_html_extraction(spark, SF_MID).collect()}
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|br|h1)\b[^>]*(>|$)", " ", re.sub(r"</?b>", "", body))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x" * 9, "b"), (1, None, None, "a")],
                               "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in extract(df).collect()] == [(1, "", 0), (None, "", 0), (1, "", 0)]
    assert extract(df.limit(0)).count() == 0
    big = spark.createDataFrame([(2, "u", f"<article><p>{STORY * 5000}</p></article>")], "page_id long, url string, html string")
    assert extract(big).first().n_chars == len(STORY) * 5000 - 1
