import html
import re

from weatherloom.llm import extraction
from weatherloom.llm.shared import table

PARA = "A paragraph of prose, with commas, that is long enough to count for something."
PAGE = f"""<!DOCTYPE html><html><head><title>No title</title><style>p{{x:"</p>"}}</style></head><body class="page sidebar-left">
<header><h1>Site name</h1></header><div id="main-menu"><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></div>
<div class="cookie-notice"><p>{PARA}</p></div>
<div class="wrap"><div class="story"><h2>Title &amp; more</h2><p>{PARA}</p><div><p>Second&nbsp; <b>bo</b>ld&#33;<br>line</p></div>
<ul><li>one<li>two</ul><div class="advert"><p>{PARA}</p></div><form><p>{PARA}</p><input></form></div>
<aside><p>{PARA}</p></aside><section id="comments"><p>{PARA}</p></section></div>
<footer><p>{PARA}</p></footer><script>if (a<b) x = "<p>no</p>"</script><!-- <p>no</p> --></body></html>"""


def test_main_text_without_the_rest():
    assert extraction.main_text(PAGE) == f"Title & more {PARA} Second bold! line one two"


def test_article_is_kept_whole():
    page = f"<nav>menu</nav><article><header><h1>Head</h1></header><p>{PARA}<p>short<div><p>{PARA}</div><div class=share>share</div></article><div>tail</div>"
    assert extraction.main_text(page) == f"Head {PARA} short {PARA}"


def test_odd_pages():
    assert [extraction.main_text(p) for p in (None, "", "<nav>a</nav>", "plain  text", "<p>x", "<a b=\"c", "<script>x")] == ["", "", "", "plain text", "x", "", ""]
    assert extraction.main_text("<div>" * 30_000 + PARA) == PARA
    assert extraction.main_text("</p></b>" * 20_000 + f"<b><p>{PARA}") == PARA
    assert len(extraction.main_text("<article>" + f"<p>{PARA}</p>" * 20_000)) == 20_000 * (len(PARA) + 1) - 1


def test_generated_names_inside_an_article():
    page = f"""<article><div class='article-header'><h1 class='post-header'>Head</h1></div><p id='notice-of-death'>{PARA}</p>
<h2 id='social-impact'>Impact</h2><ul><li id='search-methods'>methods</ul><section id='discussion'><h2>Discussion</h2><p>Short.</p></section>
<section class='discussion'><p>{PARA}</p></section><p>see <span class='related-term'>terms</span></p>
<div id='related'><h4>More</h4><p><a href=/x>{PARA}</a></p></div><div class='social'>Tell others</div><div class='comments'><p>{PARA}</p></div></article>"""
    assert extraction.main_text(page) == f"Head {PARA} Impact methods Discussion Short. {PARA} see terms"


def test_short_sections_beside_the_longest():
    long, short = f"{PARA} " * 8, "Words of a second section that has one paragraph only, without any more. " * 4
    links = "<p><a href=/x>a link to follow</a></p>" * 5
    page = f"<body><div><div><h2>One</h2>{f'<p>{long}</p>' * 6}</div><div><h2>Two</h2><p>{short}</p></div><div>{links}</div></div></body>"
    assert extraction.main_text(page) == " ".join(["One", *[long.strip()] * 6, "Two", short.strip()])


def test_links_do_not_make_main_text():
    links = "<div class=x>" + "".join(f"<p><a href=/{i}>{PARA}</a></p>" for i in range(30)) + "</div>"
    assert extraction.main_text(f"<body>{links}<div><p>{PARA}</p><p>{PARA}</p></div></body>") == f"{PARA} {PARA}"


def test_tables_of_pages(spark, sf_dir):
    rows = extraction.extract(table(spark, sf_dir, "pages")).select("html", "text", "n_chars").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(h1|p|ul|li|div)[^>]*>", "\0", inner).replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in inner.split("\0"))
        assert r.text == " ".join(filter(None, blocks)) and r.n_chars == len(r.text)
    empty = spark.createDataFrame([(1, None, "x")], "page_id long, html string, text string")
    assert [tuple(r) for r in extraction.extract(empty).select("text", "n_chars").collect()] == [("", 0)]
    assert extraction.extract(empty.limit(0)).count() == 0
