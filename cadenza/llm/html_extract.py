"""Main text of web pages: page structure and host suffix arrays, which judge the blocks of every page.

Page structure sorts blocks: elements that a page marks as its article or main part are main, without
the menus, headers, footers, sidebars, notices, adverts, forms and comments inside them. Classes tell
such things only by whole words, and never of an article itself. The other blocks of a page that marks
no such part are open, but for a first heading.

The token streams of all pages of a host, with their menus and footers, are laid end to end and their
suffixes sorted. Neighbours whose common prefix has RUN tokens form runs; one that at least PAGES
distinct pages and the share SHARE of the host's pages show is repeated, and overlapping ones make up
repeated substrings of any length. An open block that they cover whole goes; blocks with a token of
their own stay as they are. A main block stays in any case, since the whole article is asked for, with
what it shares with other pages: articles do hold lines that their host shows as adverts as well. How
much of a page's text is repeated so is told beside it.

A host of over BLOCK_PAGES pages has several arrays, each over an even share of them. What the share
SHARE of all pages shows, that share of at least one array's pages shows, so the arrays give the
candidates, and one pass over that host's pages counts them exactly: one host may hold any share of
the pages.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Tokens of a substring that marks boilerplate, and distinct pages of a host that must show it: so many, and this share.
RUN = 6
PAGES = 3
SHARE = 0.2
#: Pages of one suffix array.
BLOCK_PAGES = 256
#: Large hosts, and candidates of theirs, up to which they are broadcast (under 64 MB); beyond, pages are shuffled to them.
BROADCAST_HOSTS = 500_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)", re.S)
_NAME = re.compile(r"[a-z]+|\d+")

#: Elements whose content is no text, elements that hold no part of an article, and void elements. Fixed values.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe"}
OUTSIDE = {
    "nav", "footer", "aside", "form", "noscript", "template", "svg", "canvas", "object", "audio", "video", "map",
    "menu", "dialog", "button", "select", "datalist", "fieldset", "head", "math", "applet", "frameset",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "rb",
}
#: Words in class, id or role that mark a container as no part of the article. Fixed values.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "masthead", "header", "alert", "respond",
}
#: Words that may stand beside a mark in one class without changing what it says, marks of headers, and what makes a header the page's. Fixed values.
BESIDE = {
    "area", "article", "articles", "bar", "bars", "block", "blocks", "blog", "body", "bottom", "box", "button", "buttons", "container", "content", "fixed", "float", "form", "global", "group", "icons", "inner",
    "item", "items", "left", "links", "list", "main", "media", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "stories", "text",
    "thread", "top", "unit", "user", "wrap", "wrapper",
}
HEADERS = {"header", "masthead"}
SITE = {"bar", "container", "global", "inner", "main", "site", "top", "wrap", "wrapper"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


def _marked(token: str) -> bool:
    """Whether one word of a class, id or role says that its element is no part of an article: a mark, alone or with words that say where or what of it.

    "comments", "site-footer" and "cookie-banner" do; "comments-open", "has-sidebar", "ad-free" and
    "entry-header" say something of the article or the page. A header must be the page's.
    """
    parts = _NAME.findall(token.lower())
    marks = [w for w in parts if w in MARKS]
    if not marks or not all(w in MARKS or w in BESIDE or w.isdigit() for w in parts):
        return False
    return not set(marks) <= HEADERS or all(w in HEADERS or w in SITE for w in parts)


def _kind(tag: str, attrs: str, marks: bool) -> str:
    """'main', 'out' or '' for a start tag; marks says whether classes, ids and roles may tell what is no part."""
    tokens, main, hidden = [], tag in MAIN, False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        key, value = (name or bare).lower(), a or b or c
        if key in ("class", "role"):
            tokens += value.split()
            main |= key == "role" and value.lower() in MAIN
        elif key == "id":
            tokens.append(value.strip())
        hidden |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", ""))
    if hidden or tag in OUTSIDE or marks and tag not in ("html", "body") and tag not in INLINE and any(map(_marked, tokens)):
        return "out"
    return "main" if main else "head" if tag == "header" else ""


class _Open:
    """The open elements of a page, with counts that answer each question about them in constant time."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.mains = 0  # open articles and main parts, of whatever kind
        self.at: dict[str, list[int]] = {}  # places of each tag
        self.block: list[int] = []  # places of elements that aren't inline
        self.kinds = {"out": 0, "head": 0, "main": 0, "": 0}

    def push(self, tag: str, kind: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.block.append(len(self.stack))
        self.stack.append((tag, kind))
        self.kinds[kind] += 1
        self.mains += tag in MAIN or kind == "main"

    def pop(self) -> None:
        tag, kind = self.stack.pop()
        self.at[tag].pop()
        if tag not in INLINE:
            self.block.pop()
        self.kinds[kind] -= 1
        self.mains -= tag in MAIN or kind == "main"

    def close(self, tag: str) -> None:
        """Close the innermost element of a tag and what is inside it; a stray end of an inline element closes no block."""
        places = self.at.get(tag)
        if not places or tag in INLINE and self.block and self.block[-1] > places[-1]:
            return
        first = places[-1]
        while len(self.stack) > first:
            self.pop()

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def state(self) -> str:
        if self.kinds["out"]:
            return "out"
        inner = self.stack[self.block[-1]][0] if self.block else ""
        if self.kinds["head"] and not (self.kinds["main"] and inner in HEADINGS):
            return "out"
        return "main" if self.kinds["main"] else "title" if inner == "h1" else "open"


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the non-empty blocks in page order; kind is main, open, title (an open first heading) or out. Time is linear in the page.

    A page whose article or main part would be all gone by the marks of its own elements or of those around
    it is read again with marks inside of it alone, and then with none.
    """
    page = page or ""
    out, main = _blocks(page, True, True)
    for around, inside in ((False, True), (False, False)):
        if not main or any(k == "main" for k, _ in out):
            break
        out, main = _blocks(page, around, inside)
    return out


def _blocks(page: str, around: bool, inside: bool) -> tuple[list[tuple[str, str]], bool]:
    """The blocks, and whether the page marks an article or main part that holds text; marks count around such a part, inside it, or both."""
    out: list[tuple[str, str]] = []
    held = _Open()
    text: list[str] = []
    state = "open"
    main = False  # whether an article or main part has text, wherever it stands

    def flush() -> None:
        nonlocal main
        line = " ".join("".join(text).split())
        if line:
            out.append((state, line))
            main = main or bool(held.mains)
        text.clear()

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if m[1]:
            held.close(tag)
        elif tag in RAW:
            end = _end_of(tag).search(page, at)
            at = end.start() if end else len(page)
        elif tag not in VOID:
            kind = _kind(tag, m[3], inside if held.mains else around and tag not in MAIN)
            if kind == "main":  # an unclosed menu or header before the article ends where the article begins
                while held.top() in ("nav", "header", "footer", "li", "ul", "ol", "a", "p"):
                    held.pop()
            elif tag == "p" and held.top() == "p":
                held.pop()
            if tag not in INLINE or kind:
                if tag in INLINE:
                    flush()
                held.push(tag, kind)
            elif tag != "a":
                held.push(tag, kind)
        fresh = held.state()
        if fresh != state:
            flush()
            state = fresh
    flush()
    return out, main


def covered_blocks(parts: list[str], starts) -> list[bool]:
    """Whether each block of a stream lies wholly under RUN-token substrings that begin at `starts` (from 1)."""
    sizes = [len(p.split(" ")) for p in parts]
    change = np.zeros(sum(sizes) + 1, "int64")
    for a in starts if starts is not None else ():
        change[a - 1] += 1
        change[min(a - 1 + RUN, len(change) - 1)] -= 1
    under = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
    ends = np.cumsum(sizes)
    return [bool(under[e] - under[e - n] == n) for e, n in zip(ends.tolist(), sizes, strict=True)]


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes of a sequence of numbers in their order, by doubling prefixes of those that aren't told apart yet."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    rank = np.empty(n, "int64")  # the first place of a suffix's group
    rank[sa] = _firsts(np.concatenate([[True], ids[sa][1:] != ids[sa][:-1]]))[:n]
    done = 1
    while True:
        placed = rank[sa]
        at = np.flatnonzero(np.bincount(placed, minlength=n)[placed] > 1)
        if not len(at):
            return sa
        s = sa[at]
        group, beyond = rank[s], np.where(s + done < n, rank[np.minimum(s + done, n - 1)], -1)
        order = np.lexsort((beyond, group))
        s, group, beyond = s[order], group[order], beyond[order]
        sa[at] = s
        rank[s] = at[_firsts(np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])]))]
        done *= 2


def _firsts(starts: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where something starts."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def _pack(kinds: list[str], stream: list[str]) -> bytes:
    """Blocks, which hold no line break, after their kinds."""
    return zlib.compress("\n".join([" ".join(kinds), *stream]).encode("utf-8", "surrogatepass"))


def _unpack(packed: bytes) -> tuple[list[str], str]:
    kinds, *stream = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
    return _tokens(kinds.split(), stream)


def _tokens(kinds: list[str], stream: list[str]) -> tuple[list[str], str]:
    """The tokens of a stream, and for each a letter for the kind of its block: m main, o open, t title, x out."""
    tokens, letters = [], []
    for kind, block in zip(kinds, stream, strict=True):
        found = block.split(" ")
        tokens += found
        letters.append(("x" if kind == "out" else kind[0]) * len(found))
    return tokens, "".join(letters)


def _counts(letters: str, at: int) -> bool:
    """Whether a prefix that starts there tells of a page's text: on pages with a main part those in it do."""
    return letters[at] == "m" or "m" not in letters


def repeated(pages: list[list[str]]) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs of the suffix array over a host's pages whose suffixes share RUN tokens and come from several pages: the places (page, token) of each, and its distinct pages."""
    names: dict[str, int] = {}
    sizes = np.array([len(tokens) for tokens in pages], "int64")
    ends = np.cumsum(sizes + 1)
    # a page's end is a number of its own, so no prefix goes on into the next page
    ids = np.array([x for i, tokens in enumerate(pages) for x in (*(names.setdefault(t, len(names)) for t in tokens), -1 - i)], "int64")
    page = np.repeat(np.arange(len(pages)), sizes + 1)
    sa = suffix_array(ids)
    same = np.ones(len(sa) - 1, bool)
    for j in range(RUN):
        one, two = sa[:-1] + j, sa[1:] + j
        inside = np.maximum(one, two) < len(ids)
        same &= inside
        same[inside] &= ids[one[inside]] == ids[two[inside]]
    run = np.cumsum(np.concatenate([[True], ~same])) - 1
    often = np.bincount(run)[run] > 1
    shown = np.unique(run[often] * len(pages) + page[sa[often]]) // len(pages)
    counts = np.bincount(shown, minlength=int(run[-1]) + 1)
    firsts = np.searchsorted(run, np.arange(len(counts) + 1))
    on, at = page[sa], sa - (ends - sizes - 1)[page[sa]]
    spans = [(slice(firsts[r], firsts[r + 1]), int(counts[r])) for r in np.flatnonzero(counts > 1).tolist()]
    return [(list(zip(on[s].tolist(), at[s].tolist(), strict=True)), n) for s, n in spans]


def _judge(table):
    """Of one array: where a small host's repeated prefixes start on its pages, or a large host's candidates."""
    import pyarrow as pa

    host, large = table.column("host")[0], table.column("large")[0].as_py()
    seen = dict(zip(table.column("k").to_pylist(), table.column("packed").to_pylist(), strict=True))  # equal rows are one page
    keys = list(seen)
    pages = [_unpack(p) for p in seen.values()]
    least = max(1, ceil(len(pages) * SHARE - 1e-9)) if large else max(PAGES, ceil(len(pages) * SHARE))  # 35 * 0.2 is above 7
    starts: dict[int, list[int]] = {}
    found = []
    for places, n in repeated([tokens for tokens, _ in pages]) if 1 < least <= len(pages) else ():
        if n >= least and large:
            i, at = places[0]
            found.append(" ".join(pages[i][0][at : at + RUN]))
        elif n >= least:
            for i, at in places:
                if _counts(pages[i][1], at):
                    starts.setdefault(i, []).append(at + 1)
    if large and least == 1:  # an array of so few pages makes everything a candidate
        found = sorted({" ".join(t[at : at + RUN]) for t, _ in pages for at in range(len(t) - RUN + 1)})
    rows = [(keys[i], at, None) for i, at in starts.items()] + [(None, None, p) for p in found]
    return pa.table({
        "host": pa.array([host.as_py()] * len(rows), "string"), "k": pa.array([r[0] for r in rows], "int64"),
        "starts": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "prefix": pa.array([r[2] for r in rows], "string"),
    })


def _repeats(read: DataFrame) -> DataFrame:
    """k and starts (from 1) of the pages where repeated prefixes that count for their blocks begin."""

    def pack(batches):
        seen = set()
        for pdf in batches:
            new = [k not in seen and not seen.add(k) for k in pdf["k"]]
            pdf = pdf[new]
            yield pd.DataFrame({"host": pdf["host"], "k": pdf["k"], "packed": [_pack(list(k), list(s)) for k, s in zip(pdf["kinds"], pdf["stream"], strict=True)]})

    sizes = read.select("host", "k").distinct().groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_PAGES)
    sizes = cut(sizes.select(F.col("host").alias("large_host"), "n"), "page-hosts")
    few = sizes.count() <= BROADCAST_HOSTS
    held = lambda df, ok: F.broadcast(df) if ok else df
    packed = read.select("host", "k", "kinds", "stream").mapInPandas(pack, "host string, k long, packed binary")
    packed = packed.join(held(sizes, few), F.col("host") == F.col("large_host"), "left")
    share = F.coalesce(F.pmod("k", F.ceil(F.col("n") / BLOCK_PAGES)), F.lit(0))
    packed = packed.select("host", share.alias("share"), F.col("n").isNotNull().alias("large"), "k", "packed")
    judged = cut(packed.groupBy("host", "share").applyInArrow(_judge, "host string, k long, starts array<long>, prefix string"), "page-arrays")
    small = judged.where("k is not null").select("k", "starts")
    asked = judged.where("k is null").select("host", "prefix").distinct()
    n_asked = asked.count()
    if not n_asked:
        return small

    # the candidates of large hosts, counted over all of their pages
    def find(batches):
        import pyarrow as pa

        known: dict[str, set[str]] = {}
        for table in batches:
            rows = []
            for i, host in enumerate(table.column("host").to_pylist()):
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = set(table.column("prefixes")[i].as_py())
                wanted = known[host]
                tokens, letters = _tokens(table.column("kinds")[i].as_py(), table.column("stream")[i].as_py())
                on: dict[str, list[int]] = {}
                for a in range(len(tokens) - RUN + 1):
                    prefix = " ".join(tokens[a : a + RUN])
                    if prefix in wanted:
                        on.setdefault(prefix, []).append(a)
                k = table.column("k")[i].as_py()
                rows += [(host, prefix, k, [a + 1 for a in places if _counts(letters, a)]) for prefix, places in on.items()]
            names, types = ["host", "prefix", "k", "starts"], [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate(types)], names=names)

    lists = asked.groupBy("host").agg(F.collect_list("prefix").alias("prefixes"))
    large = read.select("host", "k", "kinds", "stream").join(held(lists, n_asked <= BROADCAST_HOSTS), "host")
    hits = cut(large.mapInArrow(find, "host string, prefix string, k long, starts array<long>"), "page-hits").dropDuplicates(["host", "prefix", "k"])
    counts = hits.groupBy("host", "prefix").agg(F.count("*").alias("pages")).join(sizes, F.col("host") == F.col("large_host"))
    shared = counts.where(F.col("pages") >= F.greatest(F.lit(PAGES), F.ceil(F.col("n") * SHARE))).select("host", "prefix")
    kept = hits.where("size(starts) > 0").join(shared, ["host", "prefix"])
    return small.unionByName(kept.groupBy("k").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (code points of the text's blocks that its host repeats) of every row.

    White space inside a block (Unicode blanks and the separators U+001C to U+001F included) becomes
    one space, blocks are joined by line breaks, character references are decoded, br counts as white
    space; title and textarea hold no text. Null and empty pages, and those without text, give an empty
    text. An open page all of whose blocks are covered, a copy, keeps them. Rows may repeat; equal rows
    count as one page of their host. Empty tables give an empty result; further columns don't matter.
    """
    small_batches(pages.sparkSession, 512)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = dict(rows.dtypes)["page_id"]

    def run(batches):
        for pdf in batches:
            found = [blocks(page) for page in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "stream": [[t for _, t in f] for f in found], "kinds": [[k for k, _ in f] for f in found]})

    read = rows.mapInPandas(run, f"page_id {id_type}, url string, stream array<string>, kinds array<string>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    read = cut(read.select("*", host.alias("host"), F.xxhash64("url", "stream").alias("k")), "pages")
    starts = cut(_repeats(read).withColumnRenamed("k", "hk"), "page-starts")

    own = lambda t, i: (F.element_at("kinds", i + 1) == "main") | ~F.array_contains("kinds", "main") & F.element_at("kinds", i + 1).isin("open", "title")
    whole = read.join(starts, F.col("k") == F.col("hk"), "left_anti")
    whole = whole.select("page_id", "url", F.array_join(F.filter("stream", own), "\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"))
    both = read.join(starts, F.col("k") == F.col("hk")).select("page_id", "url", "stream", "kinds", "starts")

    def keep(batches):
        for pdf in batches:
            texts, sizes = [], []
            for parts, kinds, found in zip(pdf["stream"], pdf["kinds"], pdf["starts"], strict=True):
                parts, kinds = list(parts), list(kinds)
                own = ("main",) if "main" in kinds else ("open", "title")
                rest = [(p, k, c) for p, k, c in zip(parts, kinds, covered_blocks(parts, found), strict=True) if k in own]
                rest = [r for r in rest if r[1] != "open" or not r[2]] or rest
                texts.append("\n".join([p for p, _, _ in rest]))
                sizes.append(sum(len(p) for p, _, c in rest if c))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_repeated": sizes})

    parts = whole.unionByName(both.mapInPandas(keep, f"page_id {id_type}, url string, text string, n_repeated long"))
    return parts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; nulls, repeats and empty tables as extract() says."""
    return extract(table(spark, sf_dir, "pages"))
