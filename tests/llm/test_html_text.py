import html
import random
import re

import pytest

from relrank.llm.html_text import extract_text, main_text, parse
from relrank.llm.queries import QUERIES


def plain(page):
    """The article element of the sample pages, cut at block tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|li)\b[^>]*>", body)
    blocks = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n\n".join(filter(None, blocks))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sample_pages(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").collect()}
    rows = QUERIES["op4_html_text"](spark, f"/root/testdata/{folder}").collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


PARAGRAPH = "This is a sentence of the article, long enough to count, with a second part; and a third one."


def page(*parts):
    return "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


NOISE = [
    '<nav><a href="/">Home</a> <a href="/b">More</a></nav>', "<header><h2>The Daily</h2></header>", "<footer>&copy; us</footer>",
    '<aside><p>Beside the point, at some length, and then a bit more of it.</p></aside>', '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>',
    '<div id="sidebar"><ul><li><a href="/x">Other story one</a></li></ul></div>', '<form><label>Name</label><input name="n"><button>Send</button></form>',
    "<script>var a = '<p>no</p>' < 3;</script>", "<style>p { margin: 0 }</style>", "<!-- <p>hidden</p> -->", '<div class="ad">Buy this fine thing now, it is cheap.</div>',
    '<section class="comments"><h3>Comments</h3><p>First! I have read all of it and I agree with every word of it.</p></section>',
    '<div style="display:none">not shown</div>', "<noscript>Turn it on</noscript>", '<ul class="share"><li><a href="#">Share</a></li></ul>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div><div><section>{}</section></div></div>"])
def test_other_parts_go(wrap):
    draw = random.Random(len(wrap))
    for _ in range(40):
        before, after = (draw.sample(NOISE, draw.randrange(len(NOISE))) for _ in range(2))
        inside = draw.sample(NOISE, 3) if "article" in wrap else []
        inside = [n for n in inside if not n.startswith("<header")]
        count = draw.randrange(2, 6)
        body = "".join(f"<p>{PARAGRAPH}\n  {i} &amp; {i}</p>" + (inside.pop() if inside and i == 1 else "") for i in range(count))
        text = main_text(page(*before, wrap.format(f"<h1>The  title</h1>{body}"), *after))
        assert text == "\n\n".join(["The title"] + [f"{PARAGRAPH} {i} & {i}" for i in range(count)])


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="content">{}</div>'])
@pytest.mark.parametrize(
    "name", ['section id="discussion"', 'div id="Related_work"', 'div id="navigation-systems"', 'div class="social-history"', 'section id="comments-on-method"']
)
def test_parts_of_the_article_stay_whatever_their_names(wrap, name):
    own = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(4))
    part = f'<{name}><h2 id="Related_work">Part <span id="Social_structure">two</span></h2><p>{PARAGRAPH} 4</p></{name.split()[0]}>'
    text = main_text(page(NOISE[0], wrap.format(own + part + NOISE[10] + NOISE[5]), NOISE[11]))
    assert text == "\n\n".join([*(f"{PARAGRAPH} {i}" for i in range(4)), "Part two", f"{PARAGRAPH} 4"])


@pytest.mark.parametrize("around", ['form action="x.aspx"', 'div class="widget"'])
def test_a_part_with_most_of_the_text_stays(around):
    own = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(4))
    text = main_text(page(f"<{around}>", NOISE[0], f"<div>{own}</div>", NOISE[10], f"</{around.split()[0]}>"))
    assert text == "\n\n".join(f"{PARAGRAPH} {i}" for i in range(4))


@pytest.mark.parametrize("sizes", [(10, 8), (3, 9, 5), (2, 2)])
@pytest.mark.parametrize("wrap", ["{}", "<div><div>{}</div></div>"])
def test_an_article_in_several_wrappers(sizes, wrap):
    groups = [[f"{PARAGRAPH} {k}.{i}" for i in range(n)] for k, n in enumerate(sizes)]
    parts = ["<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>" for own in groups]
    text = main_text(page(NOISE[0], wrap.format((NOISE[10] + '<img src="x.png">').join(parts)), NOISE[5], NOISE[11]))
    assert text == "\n\n".join(x for own in groups for x in own)


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""), ("   ", ""), ("just text", "just text"), ("a &lt; b &#233;&eacute;&nbsp;c", "a < b éé c"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p>a<p>b<ul><li>c<li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<p><b>one.<br><p>two", "one.\n\ntwo"), ("<p>x<i>y</i>z</p></div></p>", "xyz"),
        ("<p>a<!-- x", "a"), ("<p>a<div", "a"), ("<script>never ends", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<p title='a > b'>c</p>", "c"), ("<article></article>", ""), ("<br><hr>", ""), ("<P>Big</P>", "Big"),
    ],
)
def test_bad_markup(source, text):
    assert main_text(source) == text


def test_any_text_is_a_page():
    draw = random.Random(1)
    pieces = ["<", ">", "</", "<p", "<div>", "</div>", "<a href='x>", "&", "&#x;", "<!--", "-->", "<![CDATA[", "x y", "<script>", "</script>", '"', "<td>", "<li>"]
    for _ in range(2000):
        main_text("".join(draw.choice(pieces) for _ in range(draw.randrange(30))))
    assert len(parse("<div>" * 50_000)) == 50_001
    assert main_text("<div>" * 20_000 + "deep") == "deep"


def test_hard_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<p>" + "long text " * 50_000), (3, "w", "<p>same"), (3, "w", "<p>same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as n_chars")
    found = extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in found) == [
        (0, "v", 499_999, 499_999), (1, "", 0, 0), (2, "u", 0, 0), (3, "w", 4, 4), (3, "w", 4, 4)
    ]
    assert extract_text(pages.where("false")).count() == 0


def paragraphs(draw, n):
    letters = "abcdefghij"
    return [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(draw.randrange(25, 60))) + "." for _ in range(n)]


@pytest.mark.parametrize("name", ['class="discussion"', 'id="reply-guide"', 'class="comments"', 'id="respond"', 'class="x17"', ""])
@pytest.mark.parametrize("footer", ["<div>Copyright of the house, all rights reserved.</div>", "<div>Terms of use apply to all readers of these pages.</div>", ""])
def test_names_that_mislead(name, footer):
    """No article element, a name like that of comments or none, and a footer without a name."""
    draw = random.Random(f"{name}{footer}")
    menu = "<nav><a href='/'>home</a> <a href='/x'>more of this</a></nav>"
    for n in (3, 8, 20):
        text = paragraphs(draw, n)
        body = "".join(f"<p>{t}</p>" for t in text)
        assert main_text(f"<html><body>{menu}<div {name}>{body}</div>{footer}</body></html>") == "\n\n".join(text)


def test_comments_beside_the_article_go():
    """However long they are, with an article element; without one while the article has a fifth of the text."""
    draw = random.Random(12)
    text, said = paragraphs(draw, 6), paragraphs(draw, 14)
    comments = '<div class="comments">' + "".join(f'<div class="comment"><p>{t}</p></div>' for t in said) + "</div>"
    body = "".join(f"<p>{t}</p>" for t in text)
    assert main_text(f"<body><article>{body}</article>{comments * 3}</body>") == "\n\n".join(text)
    assert main_text(f"<body><div>{body}</div>{comments}</body>") == "\n\n".join(text)


def test_generated_pages_without_known_names():
    """The article is the one dense subtree; menus, teasers and footers have names of no meaning."""
    draw = random.Random(21)
    for _ in range(60):
        text = paragraphs(draw, draw.randrange(2, 15))
        links = "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(draw.randrange(3, 30)))
        teasers = "".join(f'<div class="q{i}"><a href="/t{i}">teaser {i}</a></div>' for i in range(draw.randrange(0, 12)))
        blocks = "".join(draw.choice(["<p>{}</p>", '<p class="k">{}</p>', "<p><b></b>{}</p>"]).format(t) for t in text)
        shell = draw.choice(["<div>{}</div>", '<div id="a9"><div>{}</div></div>', "<section>{}</section>"])
        page = f'<body><div class="z1"><ul>{links}</ul></div>{shell.format(blocks)}<div class="z2">{teasers}</div><div class="z3">All rights reserved 2020</div></body>'
        assert main_text(page) == "\n\n".join(text)
