import html as lib
import re

import pytest

from tracelode.llm import html, queries


def test_tables(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.html_text(spark, sf).collect():
        a = pages[r["page_id"]]
        a = re.split(r"</article>|<footer>", a[a.index("<article>") :])[0]
        a = re.sub(r"<[/!?a-zA-Z][^<>]*\Z", "", a)
        blocks = [" ".join(lib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<article>", a.replace("<br>", " "))]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


ARTICLE = "<p>" + "A long enough first paragraph of the article. " * 4 + "</p><p>Short.</p><p>Ends &amp; stops &lt;here&gt;.</p>"
WANT = "\n\n".join([" ".join(("A long enough first paragraph of the article. " * 4).split()), "Short.", "Ends & stops <here>."])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a>Home</a><a>More</a></nav><article>{ARTICLE}</article><footer>Foot text that is quite long, really, and goes on.</footer></body>",
        f"<body><header><h1>Site</h1></header><main>{ARTICLE}<section id=comments><p>Nice comment by a reader, long as it may be, with words.</p></section></main><aside>Side</aside></body>",
        f"<div class='menu'><a>x</a></div><div id=content>{ARTICLE}</div><div class='cookie-notice'>We use cookies and so on and on and on.</div><form><p>Sign up now</p></form>",
        f"<article>{ARTICLE}<div class=ad>Buy this!</div><script>var a='</p>';</script><style>p{{}}</style></article><p",
        f"<article class='post'>{ARTICLE}</article><article class='comment'><p>{'A comment. ' * 40}</p></article>",
    ],
)
def test_regions(page):
    assert html.main_text(page) == WANT


LONG = "A sentence of the text that goes on for a while. " * 3
TEXT = " ".join(LONG.split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id=content><p>One. {LONG}</p><section><p>Two. {LONG}</p></section><blockquote>Three. {LONG}</blockquote></div>", [f"One. {TEXT}", f"Two. {TEXT}", f"Three. {TEXT}"]),
        (f"<body><article><p>One. {LONG}</p></article><article><p>Two. {LONG * 3}</p></article><article><p>Short.</p></article></body>", [f"One. {TEXT}", f"Two. {' '.join((LONG * 3).split())}", "Short."]),
        (f"<body><div id=a><section><p>{LONG * 20}</p></section><section><p>{LONG}</p><p>Short.</p></section></div></body>", [" ".join((LONG * 20).split()), TEXT, "Short."]),
        (f"<body><div><a>Home</a><ul><li><a>More</a></li></ul></div><div><h2>Title</h2><p>{LONG}</p></div><div><p>{LONG}</p></div></body>", ["Title", TEXT, TEXT]),
        (f"<body><div><a>Home</a></div><div><p>{LONG}</p></div></body>", [TEXT]),
        (f"<main><p>Lead of the page.</p><article><p>{LONG}</p></article></main>", ["Lead of the page.", TEXT]),
    ],
)
def test_text_of_several_containers(page, want):
    assert html.main_text(page) == "\n\n".join(want)


def test_odd_pages(spark):
    odd = [None, "", "   ", "<", "<p", "plain text", "<p>a&am", "<![bad", "<nav>x</nav>", "<p>" * 2000 + "deep", "<p>a b\n c</p>"]
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in enumerate(odd)], "page_id int, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html.extract(df, ["page_id", "url"]).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == got[8] == "" and got[5] == "plain text" and got[6] == "a&am" and got[9] == "deep" and got[10] == "a b c"
    assert html.extract(df.limit(0), ["page_id"]).count() == 0


P = "<p>" + "</p><p>".join(f"{i}. {LONG}" for i in range(3)) + "</p>"
SAID = [f"{i}. {TEXT}" for i in range(3)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='layout has-sidebar'><article>{P}</article></div>", SAID),
        (f"<div class='no-comments single-post'><article>{P}</article></div>", SAID),
        (f"<div class='sidebar layout'><nav><a>x</a></nav><article>{P}</article><div class=sidebar><p>{LONG}</p></div></div>", SAID),
        (f"<form id=aspnetForm><div class=header><h1>Site</h1></div><div>{P}</div></form>", SAID),
        (f"<div class='discussion page'><article>{P}</article><div class=comments><article><p>{LONG * 9}</p></article></div></div><footer>{LONG}</footer>", SAID),
        (f"<article>{P}</article><div class=comments><article><p>{LONG * 9}</p></article></div>", SAID),
        (f"<article>{P}</article><div class=related><article><p>{LONG}</p></article></div>", SAID),
        (f"<article><p>Tiny.</p></article><div class=ad>{LONG}</div><footer>{LONG * 5}</footer>", ["Tiny."]),
        (f"<div class=ad>Buy!</div><div class=footer>{LONG}</div>", []),
        (f"<div class='sidebarLayout'><div>{P}</div></div>", SAID),
        (f"<div>{P}<p>A word <span class=ad>Buy</span> and<wbr>more.</p></div>", [*SAID, "A word andmore."]),
        (f"<ul><li><a>Home</a></li><li><a>More</a></li></ul>{P}", SAID),
        (f"<div id=content>{P}</div><ul><li><a>Next</a></li></ul><div><p>Contact us.</p></div>", SAID),
        ("<article><p><a>Only a link</a></p></article>", ["Only a link"]),
    ],
)
def test_names_mark_leaves_only(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(want)


def test_threshold_decides(monkeypatch):
    page = f"<body><div>{P}</div><ul><li><a>Next</a></li></ul><div><p>Contact us.</p></div></body>"
    assert html.main_text(page) == "\n\n".join(SAID)
    monkeypatch.setattr(html, "threshold", lambda values: -1.0)
    assert html.main_text(page) == "\n\n".join([*SAID, "Contact us."])
    monkeypatch.setattr(html, "threshold", lambda values: 1e9)
    monkeypatch.setattr(html, "PROSE", 1e9)
    assert html.main_text(page) == html.main_text(f"<article>{P}</article>") == ""


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 5000 + f"<p>{LONG}</p>") == TEXT
    assert html.main_text("<div class=ad>" * 3000 + f"<article>{P}</article>") == "\n\n".join(SAID)


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"<p>caf\xe9 bar</p>"))], "page_id int, html binary")
    assert [tuple(r) for r in html.extract(df, ["page_id"]).collect()] == [(1, "caf� bar", 8)]


PROSE = "A paragraph of prose that belongs to the article and says something over a hundred characters, as it should be."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}</p><section id='related-work'><p>{PROSE}</p></section></article>", [TEXT, PROSE]),
        (f"<article><p>{LONG}</p><div class='social-science'><p>{PROSE}</p></div></article>", [TEXT, PROSE]),
        (f"<article><p>{LONG}</p><div id='search-theory'><p>{PROSE}</p></div></article>", [TEXT, PROSE]),
        (f"<article><p>{LONG}</p><div class='alert-history'><p>{PROSE}</p></div></article>", [TEXT, PROSE]),
        (f"<body><div class=post><p>{LONG}</p><table><tr><td>1</td><td>2</td></tr></table></div></body>", [TEXT, "1", "2"]),
        (f"<body><table><tr><td><a>x</a></td><td><p>{LONG}</p><p>{PROSE}</p></td></tr></table></body>", [TEXT, PROSE]),
        (f"<article><p>{LONG}</p></article><ul class='feedback-list'><li>{PROSE}</li></ul><div class='related-posts'><p>{PROSE}</p></div><div class='ad-box-2'>{PROSE}</div>", [TEXT]),
    ],
)
def test_names_that_say_something_else(page, want):
    assert html.main_text(page) == "\n\n".join(want)


def neutral(page):
    """The page without any name that tells what an element is."""
    page = re.sub(r"<(/?)(nav|header|footer|aside|form|section|article|main)\b", r"<\1div", page)
    return re.sub(r' (class|id|role)="[^"]*"', "", page)


def test_the_method_finds_the_text_without_names(spark, sf, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    named = [html.main_text(p) for p in pages]
    bare = [html.main_text(neutral(p)) for p in pages]
    assert sum(a != b for a, b in zip(named, bare, strict=True)) < 0.05 * len(pages)
    monkeypatch.setattr(html, "core_lines", lambda ratios, box: ratios > 0)  # all lines with text outside links
    assert sum(html.main_text(neutral(p)) != b for p, b in zip(pages, bare, strict=True)) > 0.5 * len(pages)
