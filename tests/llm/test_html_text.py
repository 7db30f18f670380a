import re
from html import unescape

import pytest

from acadspark.llm.html_text import extract, main_text

CHROME = "<html><head><title>T</title><script>x='<p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>{}<footer>&copy; 2020 all rights reserved</footer></body></html>"
LONG = "a fairly long sentence of an article that says something about the world, " * 3


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Title</h1><p>" + LONG + "<p>Be.</article>", "Title\n" + LONG.strip() + "\nBe."),
    ("<div class=ad>Buy " + LONG + "</div><article><p>One.</p></article>", "One."),
    ("<main><h1>a&nbsp;b</h1><p>x &lt; y &amp;amp; z<br>more <b>bo</b>ld</p></main>", "a b\nx < y &amp; z more bold"),
    ("<article><p>" + LONG + "</p><form><p>Subscribe</p><input></form><section id='comments'><p>first! " + LONG + "</p></section></article>",
     LONG.strip()),
    ("<div id=content><h1>T1</h1><p>" + LONG + "</p><p>short</p><p>" + LONG + "</p></div><div class='sidebar'><p>" + LONG + "</p></div>",
     "T1\n" + LONG.strip() + "\nshort\n" + LONG.strip()),
    ("<article><p>" + LONG + "</p><aside>Related</aside><p>end</p><article class=comment><p>me too</p></article></article>",
     LONG.strip() + "\nend"),
    ("<div class='cookie-notice'>We use cookies</div><article><p>x<span hidden>no <span>no</span></span> y</p></article>", "x y"),
    ("<article><p>one\n   two\t three</p><style>p{}</style><noscript>js</noscript><p>four</p></article>", "one two three\nfour"),
    ("<article><p>cut short", "cut short"),
    ("<article><p>cut in a tag <a href='x", "cut in a tag"),
])
def test_main_text(body, text):
    page = CHROME.format(body)
    if body.startswith("<article><p>cut"):
        page = page[:page.index(body) + len(body)]
    assert main_text(page) == text


@pytest.mark.parametrize("body, text", [
    ("<div class='layout has-sidebar'><article><p>" + LONG + "</p></article><div class=sidebar>" + LONG * 3 + "</div></div>", LONG.strip()),
    ("<div class='layout sidebar-right'><article><p>One.</p></article><div class=sidebar>" + LONG + "</div></div>", "One."),
    ("<div class='content with-menu'><h1>T</h1><p>" + LONG + "</p></div>", "T\n" + LONG.strip()),
    ("<div id=no-sidebar><main><p>" + LONG + "</p></main></div>", LONG.strip()),
    ("<div class='page widget'><p>" + LONG + "</p><p>" + LONG + "</p></div><div class=cookie-notice>Cookies?</div>", LONG.strip() + "\n" + LONG.strip()),
    ("<form><div id=a><p>" + LONG + "</p><p>" + LONG + "</p><input><button>Go</button></div></form>", LONG.strip() + "\n" + LONG.strip()),
    ("<form><div class='social page'><article><p>One.</p><form>Mail</form></article></div></form>", "One."),
    ("<main><h1>T</h1><div class=widget><p>" + LONG + "</p></div></main>", "T\n" + LONG.strip()),
    ("<span class='page menu'><div><p>" + LONG + "</p></div></span>", LONG.strip()),
    ("<div class='post comments-open'><p>" + LONG + "</p></div>", LONG.strip()),
    # what names rightly mark stays out
    ("<main><article><p>" + LONG + "</p></article><div class=related><article>teaser</article></div></main>", LONG.strip()),
    ("<div id=content><p>" + LONG + "</p></div><section id=comments><article>" + LONG * 2 + "</article></section>", LONG.strip()),
    ("<div class=layout><article><p>" + LONG + "<span class=ad>Buy</span></p></article></div>", LONG.strip()),
])
def test_wrappers_with_boilerplate_names(body, text):
    assert main_text(CHROME.format(body)) == text


INTRO, TEXT = ("intro " * 34).strip(), ("text " * 600).strip()


@pytest.mark.parametrize("body, text", [
    ("<div id=content><h1>Title</h1><div class=intro>" + INTRO + "</div><div class=text>" + TEXT + "</div></div>", "Title\n" + INTRO + "\n" + TEXT),
    ("<div id=content><h1>Title</h1><div class=intro>" + INTRO + "</div><div class=text>" + "".join(f"<p>{LONG}</p>" for _ in range(12)) + "</div></div>",
     "\n".join(["Title", INTRO, *[LONG.strip()] * 12])),
    ("<div id=top><a href=/a>First</a> <a href=/b>Second</a></div><div id=content><div><p>" + LONG * 9 + "</p></div><div><p>" + LONG + "</p></div></div>",
     (LONG * 9).strip() + "\n" + LONG.strip()),
    ("<div id=a><div><p>" + LONG + "</p></div><div><p>" + LONG + "</p><p>" + LONG + "</p><p>" + LONG + "</p><p>" + LONG + "</p></div></div>",
     "\n".join([LONG.strip()] * 5)),
    ("<main><h1>Title</h1><p>lead</p><article>" + "".join(f"<p>{LONG}</p>" for _ in range(5)) + "</article></main>",
     "\n".join(["Title", "lead", *[LONG.strip()] * 5])),
    ("<div><article>" + "".join(f"<p>{LONG}</p>" for _ in range(5)) + "</article><hr><hr><hr><article><p>a</p><p>b</p><p>c</p><p>end</p></article></div>",
     "\n".join([*[LONG.strip()] * 5, "a", "b", "c", "end"])),
    ("<main><div><article><p>" + LONG * 5 + "</p></article></div><div><article><p>a</p><p>b</p><p>c</p><p>d</p></article></div></main>",
     "\n".join([(LONG * 5).strip(), "a", "b", "c", "d"])),
    ("<main><article><p>" + LONG * 5 + "</p></article></main><div><h2>More</h2><ul><li><a href=/x>m</a><li><a href=/y>n</a></ul><article><a href=/z>teaser</a></article></div>",
     (LONG * 5).strip()),
])
def test_articles_split_over_containers(body, text):
    assert main_text(CHROME.format(body)) == text


def test_pages_without_chrome_or_text():
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == main_text("<p>  </p>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("</div></p><p>stray") == "stray"
    many = "<article>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(3000)) + "</article>"
    assert len(main_text(many).split("\n")) == 3000


def test_teasers_beside_the_article():
    main = "<article><p>" + LONG + "</p></article>"
    assert main_text(CHROME.format("<div>" + main + "<article>Other teaser</article></div>")) == LONG.strip()
    links = "".join(f"<p><a href=/{i}>Read {i}</a></p>" for i in range(9))
    assert main_text(CHROME.format("<div>" + main + "<article>" + links + "</article></div>")) == LONG.strip()


@pytest.mark.parametrize("piece", ["<div>some words here ", "<div class=menu>some words ", "<article>words <section>",
                                   "<span class=ad>x", "<b><i>x", "<p>a<li>b"])
def test_deep_pages_take_linear_memory(piece):
    import tracemalloc
    peak = []
    for n in (4000, 16000):
        tracemalloc.start()
        main_text(piece * n)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 6 * peak[0], peak
    text = main_text("<div>some words here " * 45_000 + "</section>" * 10_000)  # a megabyte of elements that nothing ends
    assert text.split("\n") == ["some words here"] * 45_000


NEVER = "head|title|script|style|noscript|template|nav|footer|aside|button|select|textarea|iframe|object|svg|form"
INLINE = "a|abbr|b|bdi|cite|code|em|i|kbd|mark|q|s|small|span|strong|sub|sup|time|u|img|wbr"
MARKED = r"[^<>]*\b(?:class|id)=[\"']?[^<>\"']*\b(?:ad|advert|comments?|cookie|menu|notice|sidebar)\b[^<>]*"


def slowly(html):
    """The text of a well-formed page with one article, by replacing patterns in the source: no parser, no ratios."""
    html = re.sub(r"<!--.*?-->", "", html or "", flags=re.S)
    html = re.sub(r"<(script|style)\b.*?</\1\s*>", "", html, flags=re.S | re.I)
    inside = re.search(r"<(article|main)\b[^>]*>(.*?)(</\1\s*>|$)", html, flags=re.S | re.I)
    html = inside[2] if inside else html
    for pattern in (rf"<({NEVER})\b[^>]*>(?:(?!<\1\b).)*?</\1\s*>", rf"<(div|section|p|ul)\b{MARKED}>(?:(?!<\1\b).)*?</\1\s*>"):
        before = None
        while before != html:  # the innermost go first
            before, html = html, re.sub(pattern, "<div>", html, flags=re.S | re.I)
    html = re.sub(rf"</?(?:{INLINE})\b[^>]*>", "", html, flags=re.I)
    html = re.sub(r"<br\b[^>]*>", " ", html, flags=re.I)
    blocks = [" ".join(unescape(x).split()) for x in re.split(r"<[/!a-zA-Z][^>]*>", html)]
    return "\n".join(x for x in blocks if x)


def test_pages_against_a_slow_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = sorted((r.page_id, r.url, slowly(r.html)) for r in pages.collect())
    got = sorted((r.page_id, r.url, r.text) for r in extract(pages).collect())
    assert len(want) > 100 and all(text for *_, text in want)
    assert [g for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(None, None, None, 1), (5, "u", "", 2), (5, "u", "<article>x</article>", 3), (5, "u", "<article>x</article>", 3)],
                                "page_id long, url string, html string, text int")
    got = extract(pages.select("page_id", "url", "html")).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)
    assert sorted((r.page_id or 0, r.text) for r in extract(odd).collect()) == [(0, ""), (5, ""), (5, "x"), (5, "x")]
    assert extract(odd.limit(0)).count() == 0
