import random
import re

from candlewick.llm import html_text as H

TREE = H.grow(*H.labelled())


def text(page):
    return H.main_text(page, TREE)


def test_tree_learns_its_table():
    rows, main = H.labelled()
    assert sum(H.decide(TREE, r) == m for r, m in zip(rows, main, strict=True)) >= 0.95 * len(main)


def test_parts_that_are_no_article():
    long = "word " * 40
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="menu">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies {long}</div><div class='ad'>Buy</div>
    <article><h1>Head &amp; line</h1><p>First {long}<p>One<br>two &lt;b&gt; &#233; &eacute;
    x</p><p><b>Bold<br></p><div class="share-buttons"><a href="#">Share</a></div></article>
    <aside>{long}</aside><form><p>{long}</p></form><section id="comments"><p>{long}</p></section><footer>{long}</footer></body></html>"""
    assert text(page) == "\n".join(["Head & line", "First " + long.strip(), "One", "two <b> é é x", "Bold"])


def test_broken_pages():
    assert text("") == "" and text("<p") == "" and text("<!-- x") == "" and text("<script>x") == ""
    assert text("<article><p>a b c d e f<p>g h</article") == "a b c d e f\ng h"
    assert text("</div></p>plain words here that go on and on &am") == "plain words here that go on and on &am"
    assert text('<article><p title="a>b">x y z<a href=u>w</a> 1 < 2</p></article>') == "x y zw 1 < 2"


LONG = "word " * 40
NAV = "<a href='/'>Home</a>", "<a href='/n'>All news</a>"


def test_marks_are_no_verdict():
    """Parts whose tag or class speaks of boilerplate, but which hold the article or its headline."""
    head, p = "<h1>Headline of the day here</h1>", f"<p>{LONG}</p><p>{LONG}</p>"
    want = "\n".join(["Headline of the day here", LONG.strip(), LONG.strip()])
    nav, foot = f"<nav><ul><li>{NAV[0]}</li><li>{NAV[1]}</li></ul></nav>", "<footer>Copyright 2020 by us</footer>"
    for page in (
        f'<body>{nav}<main class="with-sidebar">{head}{p}</main>{foot}</body>',
        f'<body>{nav}<article><div class="entry-header">{head}</div>{p}</article>{foot}</body>',
        f'<body>{nav}<div class="post"><div class="entry-header">{head}</div><div class="entry-content">{p}</div></div>{foot}</body>',
        f"<body>{nav}<article><header>{head}</header>{p}</article>{foot}</body>",
        f'<body><svg class="logo"/>{nav}<article>{head}<svg><text>no</text></svg>{p}</article>{foot}</body>',
        f"<body>{nav.replace('</nav>', '')}<article>{head}{p}</article>{foot}</body>",
        f'<body>{nav}<div id="page-with-sidebar">{head}{p}</div>{foot}</body>',
        f'<body><form id="f">{nav}{head}{p}</form></body>',
    ):
        assert text(page) == want, page


def test_time_is_linear():
    import time

    def took(n):
        began = time.perf_counter()
        H.main_text("<p><article>" + "<div>" * n + "</p>" * n + "<b>x" * n, TREE)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.5


def made(draw):
    """A page of another template than the labelled ones, and its main text."""
    some = lambda n: " ".join(draw.choice(["ab", "cd", "efg", "h"]) for _ in range(n))

    def linked(n):
        words = some(n).split()
        for k in draw.sample(range(n), n // 8):
            words[k] = f"<a href='/{k}'>{words[k]}</a>"
        return " ".join(words)

    main = [linked(draw.randint(20, 90)) for _ in range(draw.randint(2, 9))]
    menu = "".join(f"<li><a href='/{i}'>{some(draw.randint(1, 3))}</a></li>" for i in range(draw.randint(3, 9)))
    wrap = draw.choice(["<main>{}</main>", "<div class='content'>{}</div>", "<article class='post'>{}</article>", "<table><tr><td>{}</td></tr></table>", "<div class='page with-sidebar'>{}</div>"])
    body = wrap.format("".join(f"<p>{m}</p>" for m in main))
    head = draw.choice([f"<div id='top-nav'><ul>{menu}</ul></div>", f"<ul>{menu}</ul>", f"<div><div>{menu}</div></div>"])
    foot = draw.choice([f"<div class='footer'>{some(30)}</div>", f"<div>{some(8)}</div>", f"<aside>{some(25)}</aside>", f"<section id='comments'>{some(12)}</section>"])
    return f"<body>{head}{body}<ul>{menu}</ul>{foot}</body>", "\n".join(re.sub("<[^>]*>", "", m) for m in main)


def _right(pages, tree):
    return sum(H.main_text(p, tree) == want for p, want in pages)


def test_held_out_pages_and_what_decides():
    """The tree on pages unlike its table, and trees that lack some features: counts and densities carry the most."""
    draw = random.Random(6)
    pages = [made(draw) for _ in range(300)]
    assert _right(pages, TREE) >= 270
    rows, main = H.labelled()

    def without(*names):
        at = [H.FEATURES.index(n) for n in names]
        blind = [[0.0 if k in at else v for k, v in enumerate(r)] for r in rows]
        return H.grow(blind, main)

    no_marks = _right(pages, without("mark", "share"))
    no_text = _right(pages, without("words", "density", "before_words", "before_density", "after_words", "after_density", "beside"))
    assert no_text < 0.8 * no_marks and no_marks <= _right(pages, TREE)


def test_comments_outweigh_no_article():
    page = f"<body><article><h1>Head line</h1><p>{LONG}</p></article><div id='comments'>" + f"<p>{LONG} {LONG}</p>" * 20 + "</div></body>"
    assert text(page) == "Head line\n" + LONG.strip()


def test_parts_of_unknown_classes_beside_an_article():
    """Comments and notices outside of an article are none of it, whatever their class is called; held out: no class is known."""
    names = "commentlist user-reviews disqus_thread respond kommentare comentarios thread opinions cookiebar adsense relatedposts topbar leftcol werbung xyz".split()
    for name in names:
        part = f"<div class='{name}'><p>{'said ' * 30}</p><p>{'told ' * 12}</p><p>{'once ' * 60}</p><p>Reply now</p></div>"
        for before, after in ((part, ""), ("", part), (part, part)):
            page = f"<body><nav>{NAV[0]}</nav>{before}<article><h1>Head line</h1><p>{LONG}</p><p>{LONG}</p></article>{after}<footer>by us</footer></body>"
            assert text(page) == f"Head line\n{LONG.strip()}\n{LONG.strip()}", name


def test_short_lines_between_long_ones():
    page = f"<body><nav>{NAV[0]}</nav><div><h1>Head line</h1><p>{LONG}</p><p>Yes.</p><p>No shame.</p><p>{LONG}</p></div><ul><li>{NAV[1]}</li></ul><footer>by us</footer></body>"
    assert text(page) == f"Head line\n{LONG.strip()}\nYes.\nNo shame.\n{LONG.strip()}"


def test_against_a_plain_reading(spark):
    """Whole tables against the articles cut out by pattern: their pages have one form."""
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in H.extract(pages).select("page.html", "text").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        lines = (" ".join(h.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body))
        assert r.text == "\n".join(x for x in lines if x)


def test_rows(spark):
    rows = [(1, "u", "<article><p>one two three four</p></article>", 1), (2, None, None, 1), (3, "u", "", 1), (1, "u", "<article><p>one two three four</p></article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page.page_id, r.text) for r in H.extract(pages).collect())
    assert got == [(1, "one two three four")] * 2 + [(2, ""), (3, "")]
    assert H.extract(pages.limit(0)).count() == 0
