import random
import time
from collections import defaultdict
from math import ceil

import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_extract
from cadenza.llm.html_extract import PAGES, RUN, SHARE, blocks, extract


def text(page):
    return "\n".join(t for k, t in blocks(page) if k == "main")


def test_article_alone():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>'
        '<!-- ad --><div class="ad">buy</div><article><header><h1>Head <i>line</i></h1><span>by me</span></header><p><b>One &amp; two\n  three &quot;q&quot;<br><p>Four&nbsp;five</p>'
        '<aside>side</aside><div class="share-bar">share</div><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>y</td></tr></table>'
        '<form><input>name</form><section class="comments"><article>reader</article></section></article><footer>&copy; host</footer></body></html>'
    )
    assert text(page) == 'Head line\nOne & two three "q"\nFour five\na\nb\nx y'


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post comments-open">A<p>b</article>',
        '<article class="post has-sidebar">A<p>b</article>',
        '<main class="site-main search-results">A<p>b</main>',
        '<div class="page-wrapper has-cookie-banner"><article>A<p>b</article></div>',
        '<article>A<section id="related-work">b</section></article>',
        '<article>A<div class="content ad-free">b</div></article>',
        '<article><div class="entry-header"><h1>A</h1></div>b</article>',
        '<article><p>A</p><p><a class="share-link" href="x">b</a></p></article>',
        # marks that would leave nothing: around the article, on it, and inside
        '<div class="widget"><article>A<p>b</article></div>',
        '<article class="related">A<p>b</article>',
        '<article><div class="promo">A<p>b</div></article>',
        '<div role="dialog"><main><div id="search">A<p>b</div></main></div>',
    ],
)
def test_articles_stay_whatever_their_classes_say(page):
    assert text(page) == "A\nb"


@pytest.mark.parametrize(
    "part",
    [
        '<div class="comments">x</div>', '<ol class="comment-list"><li>x</li></ol>', '<div id="comments">x</div>', '<section class="post-comments"><article class="comment">x</article></section>', '<div class="cookie-banner">x</div>',
        '<div class="sidebar-left">x</div>', '<div class="site-footer">x</div>', '<div class="ad-slot-2">x</div>', '<div class="related-posts">x</div>', '<div class="newsletter_signup">x</div>', '<div class="site-header">x</div>', '<div role="navigation">x</div>',
        '<div class="big ad">x</div>', '<nav>x</nav>', '<aside><article>x</article></aside>',
    ],
)
def test_other_parts_go_inside_and_outside_of_articles(part):
    assert text(f"{part}<article>A{part}<p>b</p>{part}</article>{part}") == "A\nb"


def test_broken_pages():
    assert text(None) == "" and text("") == ""
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("<article><p>cut off <a href='x") == "cut off"
    assert text("<article>1 < 2 <p>b</article>") == "1 < 2\nb"
    assert text("<nav><ul><li>x<article><p>y</p></article>") == "y"
    assert len(text("<article>" + "<p>word</p>" * 20000)) == 20000 * 5 - 1


def test_open_elements_in_linear_time():
    began = time.perf_counter()
    assert blocks("<div>" * 100_000 + "end") == [("open", "end")]
    assert len(blocks("<div><b>" * 50_000 + "x</b></i>" * 50_000)) > 0
    assert time.perf_counter() - began < 5


def test_open_pages_lose_host_boilerplate(spark):
    banner = "<div>welcome to our site please enjoy your stay here</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{banner}<div>page {i} says {'unique%d ' % i * 8}</div></body>") for i in range(6)]
    rows += [(10, "http://other.example/", f"<body>{banner}<p>only one</p></body>"), (11, None, None), (12, "x", "<article>a<p>b</article>"), (12, "x", "<article>a<p>b</article>")]
    # headlines that an open page shares with others stay
    rows += [(40 + i, f"http://titles.example/{i}", f"<h1>the very same long headline of all pages</h1><div>text number {i}</div>") for i in range(3)]
    # one open page among marked ones: their menus and footers tell what is boilerplate
    rows += [(20 + i, f"http://marked.example/{i}", f"<nav>home news sport weather travel contact us</nav><article>text of page {i}</article>") for i in range(3)]
    rows += [(30, "http://marked.example/open", "<div>home news sport weather travel contact us</div><div>what it says itself</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("open", "text", "k", "host", "stream", "kinds")})
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect())
    want = [(i, f"page {i} says {' '.join(['unique%d' % i] * 8)}") for i in range(6)]
    want += [(10, "welcome to our site please enjoy your stay here\nonly one"), (11, ""), (12, "a\nb"), (12, "a\nb")]
    want += [(20 + i, f"text of page {i}") for i in range(3)] + [(30, "what it says itself")]
    want += [(40 + i, f"the very same long headline of all pages\ntext number {i}") for i in range(3)]
    assert got == [(i, t, len(t)) for i, t in want]
    assert extract(df.where("false")).collect() == []


def brute(pages: dict[int, tuple[str, str]]) -> dict[int, str]:
    """Every substring of RUN tokens of every page against every page of its host."""
    streams = {i: [t for _, t in blocks(page)] for i, (_, page) in pages.items()}
    hosts = defaultdict(set)
    for i, (url, _) in pages.items():
        hosts[url.split("/")[2]].add((url, tuple(streams[i])))
    out = {}
    for i, (url, page) in pages.items():
        found = blocks(page)
        if any(k == "main" for k, _ in found):
            out[i] = "\n".join(t for k, t in found if k == "main")
            continue
        host = hosts[url.split("/")[2]]
        tokens = " ".join(streams[i]).split(" ")
        gone = set()
        for a in range(len(tokens) - RUN + 1):
            run = " " + " ".join(tokens[a : a + RUN]) + " "
            if sum(run in f" {' '.join(s)} " for _, s in host) >= max(PAGES, ceil(len(host) * SHARE)):
                gone |= set(range(a, a + RUN))
        at, lines = 0, []
        for _, t in found:
            n = len(t.split(" "))
            lines.append((t, all(j in gone for j in range(at, at + n))))
            at += n
        out[i] = "\n".join([t for t, c in lines if not c] or [t for t, _ in lines])
    return out


@pytest.mark.parametrize("few", [500_000, 0])
def test_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", few)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    stock = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 15))) for _ in range(8)]
    pages = {}
    for i in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 7))]
        body = "".join(f"<div>{p}</div>" for p in parts)
        pages[i] = (f"http://host{i % 3}.example/{i}", f"<article>{body}</article>" if rng.random() < 0.2 else body)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in pages.items()], "page_id long, url string, html string")
    want = brute(pages)
    assert {r.page_id: r.text for r in extract(df).collect()} == want
    assert any(len(t.split("\n")) < len(blocks(pages[i][1])) for i, t in want.items())


@pytest.mark.parametrize("size", [2, 7, 13])
def test_several_arrays_of_a_host_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", size)
    test_matches_brute_force(spark, monkeypatch, 500_000)


def test_suffixes_in_order():
    rng = random.Random(1)
    for n, letters in ((1, 1), (50, 1), (200, 2), (300, 40)):
        ids = [rng.randrange(letters) for _ in range(n)]
        assert html_extract.suffix_array(html_extract.np.array(ids)).tolist() == sorted(range(n), key=lambda i: ids[i:])


@pytest.mark.parametrize("size", [256, 4])
def test_arrays_judge_marked_pages_too(spark, monkeypatch, size):
    """An article keeps what it shares with its host's other pages, and its row tells how much that is."""
    monkeypatch.setattr(html_extract, "BLOCK_PAGES", size)
    refrain, advert = "and so the old tale goes on and on", "buy this thing at our shop right now"
    page = lambda i, inner: (i, f"http://h.example/{i}", f"<div class='ad'>{advert}</div><article><p>text number {i}</p><p>{inner}</p></article><footer>foot {i}</footer>")
    rows = [page(i, refrain) for i in range(10)] + [page(10, advert), page(11, "a line that no other page of it shows"), (12, "http://h.example/12", None)]
    rows += [(20 + i, "http://few.example/%d" % i, f"<article>{refrain}</article>") for i in range(2)]
    got = {r.page_id: (r.text, r.n_repeated) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: (f"text number {i}\n{refrain}", len(refrain)) for i in range(10)}
    want |= {10: (f"text number 10\n{advert}", len(advert)), 11: ("text number 11\na line that no other page of it shows", 0), 12: ("", 0)}
    assert got == want | {20: (refrain, 0), 21: (refrain, 0)}


def test_pages_without_text_count_for_their_host(spark):
    rows = [(i, f"http://h.example/{i}", "<div>one and the same line of six words</div><p>own %d</p>" % i if i < 3 else "") for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got[0] == "one and the same line of six words\nown 0" and got[15] == ""
    assert {r.text for r in extract(df.where("page_id < 15")).collect()} == {"own 0", "own 1", "own 2", ""}
