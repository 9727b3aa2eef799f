"""Pages whose frames have telling names, pages built from known articles, and odd pages in linear time."""

import random
import time

import pytest

from codequarry.llm import html

BODY = "<h1>Title</h1><p>" + "words of the article " * 20 + "</p><p>the second paragraph</p>"
TEXT = "Title\n" + " ".join(["words of the article"] * 20) + "\nthe second paragraph"
ARTICLE = f"<article>{BODY}</article>"


@pytest.mark.parametrize("page", [
    f'<body class="has-sidebar single">{ARTICLE}</body>', f'<body class="nav-open"><nav>menu</nav>{ARTICLE}</body>',
    f'<div class="overflow-hidden">{ARTICLE}</div>', f'<div id="page" class="header-fixed">{ARTICLE}<div class="sidebar"><p>no</p></div></div>',
    f'<main class="content with-sidebar">{BODY}</main>', f'<form id="aspnetForm"><input name=x>{ARTICLE}<form class=find>q</form></form>',
    f'<div class="search-page">{ARTICLE}</div>', ARTICLE.replace("<article>", '<article class="search-result">'),
    f'<article><div class="share-wide hidden-print">{BODY}</div><div class="share">like</div></article>',
    f'<div class="page-header">{BODY}</div><div class="menu">a b c</div>',
    f'{ARTICLE}<div class="related"><article><p>teaser</p></article></div>',
    f'<div class="overflow-hidden">{ARTICLE}<div class="comments"><p>{"reader " * 200}</p></div></div>',
])
def test_frames_keep_their_article(page):
    assert html.extract(page, set()) == TEXT


def test_names_of_inline_elements_and_readers():
    page = '<article><p>see <a class="related-link">linked words</a> now</p><ol class="commentlist"><li><p>reader</p></li></ol></article>'
    assert html.extract(page, set()) == "see linked words now"
    assert html.extract('<div class="nav-open"><article>no<br>paragraphs</article></div><div class="sidebar">x</div>', set()) == "no paragraphs"


def test_pages_built_from_known_articles():
    draw = random.Random(4)
    names = ["has-sidebar", "nav-open", "overflow-hidden", "header-fixed", "search-page", "site", "wrap", "no-banner", "with-menu", ""]
    noise = [
        "<nav><a href=x>Home</a></nav>", "<div class='sidebar'><p>side text</p></div>", "<footer><p>legal</p></footer>", "<script>var a='<p>';</script>",
        "<div class=\"comments\"><p>I agree</p></div>", "<form action=/q><input name=q><label>Find</label></form>", "<!-- <p>gone</p> -->",
        "<aside><p>aside</p></aside>", "<div role=navigation>menu</div>", "<style>p{}</style>", "<div hidden>secret</div>",
    ]
    for _ in range(200):
        words = lambda n: " ".join(draw.choice(["ein", "tä&amp;x", "a&lt;b", "long", "word", "été"]) for _ in range(n))
        blocks = [words(draw.randrange(12, 40)) for _ in range(draw.randrange(2, 7))]
        inner = draw.choice(["\n", "", " "]).join(
            (f"<p>{b}</p>" if draw.random() < 0.7 else f"<p class='x'>{b.replace(' ', '  <b>', 1)}</b></p>") + (draw.choice(noise) if draw.random() < 0.3 else "")
            for b in blocks)
        page = draw.choice(["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>"]).format(inner)
        for _ in range(draw.randrange(4)):
            page = f"{draw.choice(noise)}<div class='{draw.choice(names)}'>{page}</div>{draw.choice(noise)}"
        page = f"<html><head><title>T</title></head><body class='{draw.choice(names)}'>{page}</body></html>"
        expected = "\n".join(b.replace("&amp;", "&").replace("&lt;", "<") for b in blocks)
        assert html.extract(page, set()) == expected, page


@pytest.mark.parametrize("one", [
    '<div class="content">', "<a ", "</b>", "<b>", "<a '", '<a "', "<li><div><i>", "<p>x", "<!-", "<![", "<script>", "<script></script>", "<x <", "<b></i>",
    "&", "<", "<td><b>", "<a b='>'>",
])
def test_odd_pages_take_time_in_proportion(one):
    seconds = []
    for size in (50_000, 200_000):
        start = time.process_time()
        html.extract(one * (size // len(one)), set())
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * max(seconds[0], 0.1), seconds


def test_deep_stray_tags():
    start = time.process_time()
    html.extract("<b>" * 60_000 + "</i>" * 60_000 + "<div>" * 20_000 + "<p>x</p>" * 20_000, set())
    assert time.process_time() - start < 20
