"""Main text of made-up pages, and what hosts repeat against a plain count."""

import random

import pytest

from winledger.llm import pages as pg

ARTICLE = "<h1>Title &amp; more</h1><p>First  para<br>graph\n one.<p><b>Bo</b>ld &eacute;t&#233;</p><ul><li>a<li>b</ul>"
TEXT = "Title & more First para graph one. Bold été a b"
EXTRAS = [
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav>", "<header><h1>Site</h1><p>slogan</p></header>",
    "<footer>&copy; host</footer>", "<aside class=x>side</aside>", "<div class='ad'><div>buy</div> now</div>",
    "<div id='cookie-notice'>We use cookies</div>", "<form><label>q</label><input name=q> go<button>Go</button></form>",
    "<script>var t='</p><article>no</article>';</script>", "<style>p{}</style>", "<!-- <article>no</article> -->",
    "<section class='comments'><article><p>nice post</p></article></section>", "<noscript>enable</noscript>",
    "<div class=\"side-bar sidebar\"><p>links > here</p></div>", "<div role=navigation>crumbs</div>",
    "<div hidden>secret</div>", "<template><p>t</p></template>",
]


def read(page):
    return pg.article_text(pg.blocks_of(page))


@pytest.mark.parametrize("extra", EXTRAS)
def test_furniture(extra):
    body = f"<!DOCTYPE html><html><head><title>t</title></head><body class='has-sidebar'>{extra}"
    assert read(f"{body}<article>{ARTICLE}</article>{extra}</body></html>") == TEXT
    inner = "" if "header" in extra else extra  # an article's own header keeps its headings
    assert read(f"{body}<div class='content has-comments'><article>{ARTICLE}{inner}<p>end</article></div>{extra}") == TEXT + " end"
    if "article" not in extra:
        assert read(f"{body}<main>{extra}{ARTICLE}{extra}</main>") == TEXT
        assert read(f"{body}<div>{ARTICLE}</div>{extra}") == TEXT


def test_odd_pages():
    assert read("") == read("<html>") == read("<script>x") == read("<!-- x") == ""
    assert read("plain a &lt; b") == "plain a < b"
    assert read("<article><header><h2>Head</h2><span>by me</span></header><p>x</article>") == "Head x"
    assert read("<article><p>1 < 2 and <b>3</b></div> > 2</p></article>") == "1 < 2 and 3 > 2"
    assert read("<ARTICLE><P TITLE='a>b'>x&nbsp;y</P></ARTICLE>") == "x y"
    assert read("<article>a" + "<p>w w" * 40_000 + "</article>") == "a" + " w w" * 40_000
    assert read("<article>a<div><p>b</article><article>c</article><p>d") == "a b c"


def test_host_runs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(3):
        top, foot = line(9), line(8)
        for i in range(6):
            body = [line(rng.randrange(3, 30)) for _ in range(3)]
            page = 10 * h + i
            rows.append((page, f"http://h{h}.example/{i}", f"<body><div>{top}</div>" + "".join(f"<p>{b}" for b in body)
                         + f"</p><div>{foot}</div></body>"))
            want[page] = " ".join(body)
    one = line(9)  # on one page twice, and on two hosts: no boilerplate
    rows += [(100, "http://x.example/", f"<p>{one}</p><p>{one}</p>"), (101, "http://y.example/", f"<p>{one}")]
    rows += [(102, None, None), (103, "", ""), (104, "u", "<article>x</article>"), (104, "u", "<article>x</article>")]
    rows += [(None, "http://z.example/", f"<p>{one}")]
    want |= {100: f"{one} {one}", 101: one, 102: "", 103: "", 104: "x", None: one}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS a")
    got = pg.extract(frame).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert pg.extract(frame.limit(0)).count() == 0


def test_data(spark, sf_dir):
    """The test pages against their one simple markup."""
    import html
    import re
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in pg.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        inside = re.sub(r"</?(?:p|h1|br)>", " ", inside)
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?b>", "", inside)).split())


def _line(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))


def _got(spark, rows):
    return {r.page_id: r.text for r in pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copied_pages(spark):
    """Mirrors of a page without an article, a quoted paragraph, and a block that is half boilerplate."""
    rng, rows, want = random.Random(3), [], {}
    top, quote = _line(rng, 9), _line(rng, 20)
    for i in range(10):
        body = _line(rng, 25)
        own = _line(rng, 8)
        more = f" {quote}" if i < 2 else ""
        html = f"<div>{top}</div><p>{body}{more}<p>{top} {own}"
        want[i] = f"{body}{more} {own}"
        rows.append((i, f"http://h.example/{i}", html))
        if i == 4:
            for k in range(6):  # more copies than the host has share
                rows.append((100 + k, f"http://h.example/{i}?ref={k}", html))
                want[100 + k] = want[i]
    alone = _line(rng, 30)
    rows += [(200 + k, f"http://m.example/{k}", f"<p>{alone}") for k in range(5)]
    want |= {200 + k: alone for k in range(5)}
    assert _got(spark, rows) == want


def test_runs_beside_articles(spark):
    """Marks in scripts, a body in main beside an article card, and boilerplate without a telling class."""
    rng, rows, want = random.Random(4), [], {}
    top, card = _line(rng, 9), _line(rng, 8)
    for i in range(6):
        body = _line(rng, 25)
        rows += [(i, f"http://s.example/{i}", f"<script>'<article >'</script><!-- <main> --><div>{top}</div><p>{body}"),
                 (10 + i, f"http://m.example/{i}", f"<main><div>{top}</div><p>{body}</p><article>{card}</article></main>"),
                 (20 + i, f"http://a.example/{i}", f"<div>{top}</div><article><p>{body}</article><div>{top}</div>")]
        want |= {i: body, 10 + i: f"{body} {card}", 20 + i: body}
    assert _got(spark, rows) == want


def test_runs_inside_articles(spark):
    """A notice without a telling class in most articles of a host goes; a quoted paragraph and an article's versions stay."""
    rng, rows, want = random.Random(8), [], {}
    notice, quote, own, half = _line(rng, 9), _line(rng, 12), _line(rng, 40), _line(rng, 10)
    for i in range(8):
        body, more = _line(rng, 25), f"<p>{quote}</p>" if i < 3 else ""
        rows.append((i, f"http://h.example/{i}", f"<article><p>{body}</p><div class='q7'>{notice}</div>{more}</article>"))
        want[i] = f"{body} {quote}" if i < 3 else body
        rows.append((20 + i, f"http://v.example/{i}", f"<article><p>{own}</p><p>{_line(rng, 3)} {i}</p></article>"))
        want[20 + i] = f"{own} {rows[-1][2].split('<p>')[2].split('</p>')[0]}"
        rows.append((40 + i, f"http://m.example/{i}", f"<div>{_line(rng, 9)}</div><article><p>{half} x</p><p>{own}</article>"))
        want[40 + i] = f"{half} x {own}"  # one article on many pages counts once
        rows.append((60 + i, f"http://s.example/{i}", f"<article><p>{body}</p><h2>Short heading</h2><p>{notice} {i}</article>"))
        want[60 + i] = f"{body} Short heading {notice} {i}"
    assert _got(spark, rows) == want


BODY = "<h1>Head</h1><p>" + "the body of the page goes on and on " * 12 + "</p>"
BODY_TEXT = "Head " + " ".join(["the body of the page goes on and on"] * 12)


@pytest.mark.parametrize("page", [
    f"<body><article>{BODY}</article><div class='x'>buy this now</div><div>another story to read</div>",
    f"<body><div class='x'>buy this now</div><main>{BODY}</main><div>another story to read</div>",
    f"<body><div class='search-results'>{BODY}</div>", f"<body><div class='post social-science'>{BODY}</div>",
    f"<body><div class='widget-area content'>{BODY}</div>",
    f"<body><div class='post-header-image article-body'>{BODY}</div>",
    f"<body><div class='menu'><a href=x>one</a> <a href=y>two</a></div><div class='sidebar-wrapper'>{BODY}</div>",
    f"<body><div class='top-nav'><a href=x>one</a></div><div class='main-menu site-search'>find</div><div>{BODY}</div>",
])
def test_whole_class_tokens(page):
    """An article or main alone; a class counts by whole tokens, and not for what is most of the page."""
    assert read(page) == BODY_TEXT == pg.unique_text(pg.unpacked(pg.packed(pg.blocks_of(page))), [])


def test_quotation_in_article():
    assert read(f"<article>{BODY}<blockquote class='related-work'>said so</blockquote></article>") == BODY_TEXT + " said so"


def plain_runs(pages, run):
    """The texts by comparing every run of every page with all others."""
    read_ = {i: (pg._host(url), pg.blocks_of(h or "")) for i, url, h in pages}
    runs = {i: [tuple(t[k:k + run]) for k in range(len(t) - run + 1)] for i, (_, b) in read_.items() for t in [pg._outside(b)]}
    out = {}
    for i, (host, blocks) in read_.items():
        others = {tuple(w for t, _, _ in b for w in t.split()): set(runs[j]) for j, (h, b) in read_.items() if h == host}
        least = max(pg.PAGES, min(pg.SHARE * len(others), pg.ROOT * len(others) ** 0.5))
        places = [k for k, r in enumerate(runs[i]) if sum(r in found for found in others.values()) >= least]
        out[i] = pg.unique_text(blocks, places, run)
    return out


def test_runs_against_plain(spark):
    """Hosts of one to four hundred pages, where a share of the host asks for more pages than its root does."""
    rng, rows = random.Random(6), []
    for h, n in enumerate((1, 2, 5, 40, 400)):
        common = [_line(rng, rng.randrange(4, 12)) for _ in range(6)]
        for i in range(n):
            parts = [f"<div>{c}</div>" for k, c in enumerate(common) if rng.random() < (0.05, 0.15, 0.22, 0.28, 0.6, 1)[k]]
            parts.insert(rng.randrange(len(parts) + 1), f"<p>{_line(rng, rng.randrange(3, 15))}")
            if i % 7 == 3:
                parts = [f"<main>{parts[0]}</main>", *parts[1:], f"<article>{_line(rng, 4)}</article>"]
            rows.append((1000 * h + i, f"https://h{h}.example/{i}", "".join(parts)))
    assert _got(spark, rows) == plain_runs(rows, pg.RUN)
