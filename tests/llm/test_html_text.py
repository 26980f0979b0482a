import pytest
from awkward import plain

from logtel.llm import html_text

PAGE = """<!DOCTYPE html><html><body class="page has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies.</div><main><div class="post">
<h2>Title &amp; more</h2><p>A first paragraph with <a href=x>a link</a> and a good deal of text in it.<p>Second   para
over lines.<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><aside>Related</aside><form><input><label>Name</label></form></div>
<section id="comments"><p>Nice post!</p></section></main><div class='ad'>Buy</div><footer>&copy; x</footer><script>var t="</p>";</script></body></html>"""
TEXT = "Title & more\nA first paragraph with a link and a good deal of text in it.\nSecond para over lines.\none\ntwo\nc1\nc2"

CASES = [
    (PAGE, TEXT),
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("just text &lt; more <b>bold</b>", "just text < more bold"),
    ("<article><h1>T</h1><p><b>open<br><p>next</p><p>cut o", "T\nopen\nnext\ncut o"),
    ("<article><p>a</p><p cla", "a"),
    ("<p title='x>y'>a</p>b", "a\nb"),
    ("<article><p>&eacute;&#233;&amp;amp;&nbsp;x</p></article>", "éé&amp; x"),
    ("<article>a<style>p{}</style>b<!-- c -->d<script>e</script></article><div>f</div>", "abd"),
    ("<div hidden><p>no</p></div><p>yes", "yes"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_cases(html, text):
    assert html_text.main_text(html or "") == text


def test_density_finds_the_text_without_an_article_element():
    menu = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(30))
    text = [f"Paragraph {i} says something at some length, with commas, and without any link at all." for i in range(8)]
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><ul>{menu}</ul></div></body>"
    assert html_text.main_text(page) == "\n".join(text)


@pytest.mark.parametrize(
    "attributes",
    [
        'href="/wiki/Hidden_Markov_model"', 'title="the hidden truth"', 'href="/v?id=search"', "href=/v?class=ad", "title='a role=menu'", 'alt = "style=display:none"',
        'data-id="search"', 'data-hidden="no"', "x-class=ad", 'title="" data-role="banner"', 'lang="en" title="hidden"/',
    ],
)
def test_attributes_are_known_by_their_whole_names(attributes):
    for name in ("a", "p", "div"):
        assert html_text.main_text(f"<body><{name} {attributes}>Some words of the text.</{name}></body>") == "Some words of the text."


@pytest.mark.parametrize("attributes", ["hidden", "title='x' hidden", 'HIDDEN=""', "title=x aria-hidden = 'true'", 'a="b"id="search"', "a/class=ad", 'href="/x" STYLE="display: none"'])
def test_attributes_behind_others_count(attributes):
    assert html_text.main_text(f"<body><div {attributes}>no</div><p>yes</p></body>") == "yes"


LONG = "A sentence of the article that is long enough, without any link in it. " * 3
POST = f"<h1>Headline of it</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
POST_TEXT = "\n".join(["Headline of it", *[LONG.strip()] * 3])
MENU = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(9))
MARKED = ["class='content has-sidebar'", "class=elementor-widget-container", 'id="post-with-comments"', "class=no-banner", "id=related class=pageSocial", "role=banner", "class=widget"]


@pytest.mark.parametrize("mark", MARKED)
@pytest.mark.parametrize("inner", [POST, f"<article>{POST}</article>", f"<div class=widget>{POST}</div>", f"<main><div id=discussion-page>{POST}</div></main>"])
def test_marked_wrappers_keep_the_article(mark, inner):
    side = f"<ul class=menu>{MENU}</ul>"
    for page in (f"<div {mark}>{inner}</div>", f"{side}<div {mark}>{inner}</div><div class=sidebar><p>Some other text.</p></div>", f"<div {mark}>{inner}{side}<div class=ad>Buy this</div></div>"):
        assert html_text.main_text(f"<body>{page}</body>") == POST_TEXT


@pytest.mark.parametrize("name", ["article-header", "post-header", "entryHeader"])
def test_the_top_of_an_article_stays(name):
    rest = POST.replace("<h1>Headline of it</h1>", "")
    top = f'<div class="{name}"><h1>Headline of it</h1></div>'
    assert html_text.main_text(f"<body><article>{top}{rest}</article></body>") == POST_TEXT
    assert html_text.main_text(f"<body><div class=site-header><p>Site</p></div><article>{top}{rest}</article></body>") == POST_TEXT


def test_text_in_several_marked_elements_stays():
    parts = "".join(f"<div class=elementor-widget><div class=elementor-widget-container><p>{LONG}</p></div></div>" for _ in range(5))
    assert html_text.main_text(f"<body><div>{parts}</div><div class=ad>Buy</div></body>") == "\n".join([LONG.strip()] * 5)


def test_comments_and_related_articles_beside_the_article_are_cut():
    comments = "".join(f"<li class=comment><article class=comment-body><p>Comment {i}. {LONG}</p></article></li>" for i in range(9))
    for part in (f"<div id=comments class=comments-area><ol>{comments}</ol></div>", f"<div class=comments>{comments.replace('article', 'div')}</div>"):
        assert html_text.main_text(f"<body><main><article>{POST}</article>{part}</main></body>") == POST_TEXT
        assert html_text.main_text(f"<body><article>{POST}</article>{part}</body>") == POST_TEXT
        assert html_text.main_text(f"<body><main>{POST}{part}</main></body>") == POST_TEXT
    related = "<article><h3>Other</h3><p>A teaser.</p></article>" * 3
    assert html_text.main_text(f"<body><main><article>{POST}</article><div class=related>{related}</div></main></body>") == POST_TEXT
    assert html_text.main_text(f"<body><main>{POST}<div class=related>{related}</div></main></body>") == POST_TEXT


@pytest.mark.parametrize("mark", ["ad", "sidebar", "newsletter", "comments"])
def test_an_article_shorter_than_what_is_beside_it(mark):
    page = f"<body><div class={mark}><p>{LONG}</p></div><article><h1>Short</h1><p>An article of some few words, no more than that.</p></article></body>"
    assert html_text.main_text(page) == "Short\nAn article of some few words, no more than that."


def test_a_teaser_beside_a_marked_wrapper():
    page = f"<body><div class=widget>{POST}</div><article><p>More to read.</p></article></body>"
    assert html_text.main_text(page).startswith(POST_TEXT)


@pytest.mark.parametrize("part", ["<div class=ad>", "<div class=ad>x", "<p class=ad>x</p>", "<article><div class=ad>x", "<div class=has-", "<div a=' '"])
def test_long_marked_pages_take_linear_time(part):
    html_text.main_text(part * 20_000)


@pytest.mark.parametrize("part", ["<div>", "<p a='", "<p>hello ", "<script>", "<b>x", "<a '>", "<!--", "<", "</p>", "<td>x", "&amp;", "<nav>"])
def test_long_pages_take_linear_time(part):
    html_text.main_text(part * 20_000)


def test_rows(spark):
    rows = [(i, f"u{i}", html, "own") for i, (html, _) in enumerate(CASES)] + [(None, None, PAGE, None), (0, "u0", PAGE, "own")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string"))
    want = [(i, f"u{i}", text) for i, (_, text) in enumerate(CASES)] + [(None, None, TEXT), (0, "u0", TEXT)]
    assert plain(got) == sorted(want, key=repr)
    assert html_text.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []
