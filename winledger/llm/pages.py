"""Main text of web pages by markup and by what the pages of a host share.

A page is read once, into blocks of text with the containers they stand in. An article is the text, where there is
one that is no mere card beside a longer main part; else main is; else all blocks are, but for what menus, headers,
footers, asides, forms, adverts, notices and comments hold. Of the blocks outside articles what the distinct pages
of the host repeat goes, found from suffixes: the token streams of these blocks are cut into suffixes of ``RUN``
tokens, equal suffixes are brought together in a shuffle by host, and those that start on enough distinct pages
mark their tokens as covered. The unique runs stay. Inside an article that is the text the suffixes that start at
blocks are taken, and a block goes whole where most of the host's articles repeat the suffix over all of it; what they
repeat inside a block is a quotation and stays.

A class or id names furniture by whole tokens, and not where the container is most of the page and no list of links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.llm.shared import pieces, stored, table, utf8

RUN = 6  # tokens a repeated string has at least
# A run is boilerplate on a host if it stands on so many of its n distinct pages: PAGES at least, and the lesser of
# SHARE * n and ROOT * sqrt(n).
PAGES, SHARE, ROOT = 3, 0.25, 4.0
# A block of RUN tokens or more is boilerplate inside articles if over that share of the host's distinct articles have it.
ARTICLES, ARTICLE_SHARE = 4, 0.5
_PIECE = 4 << 20

# Raw elements go with their content, to the end of the page if they are not closed.
_RAW = "script|style|template|noscript|iframe|object|svg|math|canvas|textarea|select|button|audio|video"
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    "promotions banner banners cookie cookies consent notice notices notification notifications gdpr disclaimer newsletter "
    "subscribe subscription paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "toolbar header footer share sharing social related recommended widget widgets popup modal overlay login signup search "
    "pagination pager copyright".split())
_TALK = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
_FRAME = frozenset(  # says what a container is like, not what it holds
    "area bar block bottom box btn button col container form global group icon icons inner item items left link links list "
    "main outer page panel right row section site thread top wrap wrapper".split())
_TEXT = frozenset("article content entry post prose story".split())
_TEXT_PARTS = _TEXT | {"body", "main", "text"}
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is|js)[-_]\S+", re.IGNORECASE)  # says what stands elsewhere
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog",
          "alertdialog", "toolbar"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
           "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
           "tt", "u", "var", "wbr", "img", "label", "input"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"p", "li", "dt", "dd", "tr", "td", "th", *_HEADING}  # a next one of them closes an open paragraph or its like
NONE, HEADER, HINTED, NAMED = 0, 1, 2, 3  # why a container is furniture: no reason, header, a class or id, its element


def _named(tokens: list[str]) -> int:
    """What the tokens of a class or id say. A token counts whole: every part of it has to be a name or a frame."""
    parts = [set(re.split("[-_]+", t.strip("-_"))) for t in tokens]
    if any(p <= _TALK | _FRAME and p & _TALK for p in parts):
        return NAMED
    if any(p <= _TEXT_PARTS and p & _TEXT for p in parts):
        return NONE
    found = [p & _HINTS for p in parts if p <= _HINTS | _FRAME and p & _HINTS]
    if not found:
        return NONE
    return HEADER if all(p == {"header"} for p in found) else HINTED


def _furniture(tag: str, rest: str) -> int:
    if tag in _FURNITURE:
        return NAMED
    if tag == "header":
        return HEADER
    if "=" not in rest:
        return NAMED if "hidden" in rest.split() else NONE
    tokens = []
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            tokens += _STATE.sub(" ", value).lower().split()
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return NAMED
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return NAMED
    if re.search(r"(?:^|\s)hidden(?:\s|$)", rest):
        return NAMED
    why = _named(tokens) if tag not in ("body", "html", "main") else NONE
    return NONE if tag == "article" and why != NAMED else why


class Reader:
    """One page's blocks: (text, container, furniture), the container 2 in an article, 1 in main, else 0."""

    def __init__(self):
        self.blocks: list[tuple[str, int, bool, tuple[int, ...]]] = []  # text, container, furniture, hinted containers
        self.text: list[str] = []
        self.stack: list[tuple[str, int, int]] = []  # tag, why it is furniture, its number if that is a hint
        self.hinted: list[list[int]] = []  # tokens and tokens in links of containers that a class or id hints at
        self.linked, self.in_link = 0, False

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.in_link:
            self.linked += len(text.split())

    def close_block(self) -> None:
        words = " ".join(html.unescape("".join(self.text)).split()) if self.text else ""
        linked, self.text, self.linked = self.linked, [], 0
        if not words:
            return
        tags = {t for t, why, _ in self.stack if not why}
        held = 2 if "article" in tags else 1 if "main" in tags else 0
        reasons = {why for _, why, _ in self.stack if why not in (NONE, HINTED)}
        hints = tuple(n for _, why, n in self.stack if why == HINTED)
        for n in hints:
            self.hinted[n][0] += words.count(" ") + 1
            self.hinted[n][1] += linked
        # The headings of an article's own header are its text.
        title = held == 2 and reasons == {HEADER} and tags & _HEADING
        self.blocks.append((words, held, bool(reasons) and not title, hints))

    def decided(self) -> list[tuple[str, int, bool]]:
        """The blocks; a hint does not count for a container that holds over half of the page's text and few links."""
        total = sum(text.count(" ") + 1 for text, _, furniture, _ in self.blocks if not furniture)
        real = [2 * n <= total or 4 * links >= n for n, links in self.hinted]
        return [(text, held, furniture or any(real[n] for n in hints)) for text, held, furniture, hints in self.blocks]

    def open(self, tag: str, why: int) -> None:
        if tag == "body":
            self.stack = []
        while self.stack and tag in _ITEMS and self.stack[-1][0] in _ITEMS and (
                self.stack[-1][0] == tag or self.stack[-1][0] == "p" or self.stack[-1][0] in _HEADING):
            self.stack.pop()
        while self.stack and tag not in _INLINE and self.stack[-1][0] == "p":
            self.stack.pop()
        if tag in ("article", "main") and not why:  # a container of the article is no furniture by its name alone
            self.stack = [(t, NONE if w == HINTED else w, n) for t, w, n in self.stack]
        self.stack.append((tag, why, len(self.hinted)))
        if why == HINTED:
            self.hinted.append([0, 0])

    def close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                del self.stack[depth:]
                return
            if self.stack[depth][0] in ("article", "main") and tag not in ("article", "main", "body", "html"):
                return

    def read(self, page: str) -> list[tuple[str, int, bool]]:
        at = 0
        for mark in _MARK.finditer(page):
            if mark.start() > at:
                self.add(page[at:mark.start()])
            at = mark.end()
            if mark["cdata"]:
                self.add(mark["cdata"])
            tag = (mark["tag"] or "").lower()
            if not tag:
                continue
            if tag == "a":
                self.in_link = not mark["end"]
            rest = mark["rest"]
            why = NONE if mark["end"] or tag in _VOID else _furniture(tag, rest)
            if tag in _INLINE and not why and all(t != tag for t, _, _ in self.stack):
                if tag == "br":
                    self.close_block()
                continue
            self.close_block()
            if mark["end"]:
                self.close(tag)
            elif tag not in _VOID and not rest.endswith("/"):
                self.open(tag, why)
        self.add(page[at:])
        self.close_block()
        return self.decided()


def blocks_of(page: str) -> list[tuple[str, int, bool]]:
    return Reader().read(page)


def chosen(blocks: list[tuple[str, int, bool]]) -> int:
    """The least container whose blocks are the page's text: 2 for articles alone, 1 with main, 0 for all.

    Articles are the text unless main holds twice as much beside them, as where they are cards."""
    size = [0, 0, 0]
    for text, held, furniture in blocks:
        if not furniture:
            size[held] += text.count(" ") + 1
    return 2 if size[2] and 2 * size[2] >= size[1] else 1 if size[1] else 2 if size[2] else 0


def article_text(blocks: list[tuple[str, int, bool]]) -> str:
    """By markup alone: the text of the articles, else of main, else of all blocks, without furniture."""
    least = chosen(blocks)
    return " ".join(text for text, held, furniture in blocks if held >= least and not furniture)


def packed(blocks: list[tuple[str, int, bool]]) -> str:
    """A page's blocks, one a line: the container, or for furniture a letter after it, and the text."""
    return "\n".join(f"{held}{'f' if furniture else ' '}{text}" for text, held, furniture in blocks)


def unpacked(lines: str) -> list[tuple[str, int, bool]]:
    return [(line[2:], int(line[0]), line[1] == "f") for line in lines.split("\n")] if lines else []


def unique_text(blocks: list[tuple[str, int, bool]], places: list[int], run: int = RUN) -> str:
    """The chosen blocks without furniture; outside articles without the tokens of repeated runs, of which ``places``
    are the starts among the tokens outside articles, in page order. Places below zero are repeated blocks (``-1 - n``) of
    the article; they go unless they are over half of it, as in an article that the host has in several versions."""
    gone = {at + i for at in places if at >= 0 for i in range(run)}
    least, kept, at = chosen(blocks), [], 0
    article = _article(blocks)
    common = {-1 - at for at in places if at < 0}
    if 2 * sum(article[n].count(" ") + 1 for n in common) > sum(text.count(" ") + 1 for text in article):
        common = set()
    if least == 2:
        return " ".join(text for n, text in enumerate(article) if n not in common)
    for text, held, furniture in blocks:
        if held == 2:
            kept += [] if furniture else [text]
            continue
        words = text.split()
        if held >= least and not furniture:
            kept += [w for i, w in enumerate(words, at) if i not in gone]
        at += len(words)
    return " ".join(kept)


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*:", "", (url or "").strip().lower()).lstrip("/").split("/")[0].split("?")[0].split("#")[0]


def _outside(blocks: list[tuple[str, int, bool]]) -> list[str]:
    """Tokens of the blocks outside articles, in page order."""
    return [w for text, held, _ in blocks if held != 2 for w in text.split()]


def _article(blocks: list[tuple[str, int, bool]]) -> list[str]:
    """The blocks of the articles of a page whose text they are, in page order."""
    return [text for text, held, furniture in blocks if held == 2 and not furniture] if chosen(blocks) == 2 else []


def _signed(string: bytes) -> int:
    return xxhash.xxh3_64_intdigest(string) - (1 << 63)


def _suffixes(parsed: DataFrame, run: int) -> DataFrame:
    """``page``, ``host``, ``copy``, ``at``, ``open``, ``name``, ``inside``: every suffix of the pages' outside tokens by the
    hash of its first ``run`` tokens; pages with the same tokens have the same ``copy``. ``open`` runs hold a token that
    may be text. A page's row without ``at`` says that it is there. ``inside`` rows are the suffixes that start at blocks of
    ``run`` tokens or more of an article, by the hash of the block, at ``-1 - n``; articles with the same text are a ``copy``,
    and ``host`` is a number of its own.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                page, of, copy, at, free, name, inside = [], [], [], [], [], [], []
                for key, url, data in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    blocks, host = unpacked(large.decompress(data).decode()), _host(url)
                    tokens, least = _outside(blocks), chosen(blocks)
                    n = max(0, len(tokens) - run + 1)
                    page += [key] * (n + 1)
                    of += [_signed(host.encode())] * (n + 1)
                    copy += [_signed("\0".join((host, *(w for t, _, _ in blocks for w in t.split()))).encode())] * (n + 1)
                    at += [None, *range(n)]
                    seen = np.cumsum([0, *(held >= least and not f for t, held, f in blocks if held != 2 for _ in t.split())])
                    free += [False, *(seen[run:] > seen[:-run]).tolist()] if n else [False]
                    name += [None, *(_signed("\0".join(tokens[i:i + run]).encode()) for i in range(n))]
                    inside += [False] * (n + 1)
                    article = _article(blocks)
                    if article:
                        long = [i for i, t in enumerate(article) if t.count(" ") + 1 >= run]
                        page += [key] * (len(long) + 1)
                        of += [_signed(f"{host}\0article".encode())] * (len(long) + 1)
                        copy += [_signed("\0".join((host, *article)).encode())] * (len(long) + 1)
                        at += [None, *(-1 - i for i in long)]
                        free += [False, *[True] * len(long)]
                        name += [None, *(_signed(article[i].encode()) for i in long)]
                        inside += [True] * (len(long) + 1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (page, of, copy)), pa.array(at, pa.int32()),
                     pa.array(free, pa.bool_()), pa.array(name, pa.int64()), pa.array(inside, pa.bool_())],
                    names=["page", "host", "copy", "at", "open", "name", "inside"])

    return parsed.select("_page", "_url", "_zip").mapInArrow(
        cut, "page long, host long, copy long, at int, open boolean, name long, inside boolean")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            run: int = RUN) -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of every page, the empty text if it has none.

    Null html is empty; pages without a url share the host without a name. Pages of a host with the same tokens
    are one page when the pages that repeat a string are counted, and come out each for itself, as rows do that
    differ in html only; repeated rows come out as often as they are there. An empty table gives no row.
    """
    read = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), utf8(html_col).alias("_html"),
                        F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("_page"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                zipped = [small.compress(packed(blocks_of(h)).encode()) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(zipped, pa.binary()),
                                                  part.column(3)], names=["_id", "_url", "_zip", "_page"])

    def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in pieces(batch, 2, _PIECE):
                texts = [unique_text(unpacked(large.decompress(z).decode()), places or [], run) for z, places in
                         zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["_id", "_url", "text"])

    parsed = stored(read.mapInArrow(parse, f"_id {kinds[id_col]}, _url {kinds[url_col]}, _zip binary, _page long"))
    suffixes = stored(_suffixes(parsed, run))
    # Written, so that their sizes are known when others are joined: what is small makes no shuffle.
    hosts = stored(suffixes.where("at IS NULL").groupBy(F.col("host").alias("_host")).agg(
        F.count_distinct("copy").alias("_all"), F.first("inside").alias("_inside")))
    outside = (F.col("_n") >= PAGES) & (F.col("_n") >= F.least(F.col("_all") * SHARE, F.sqrt("_all") * ROOT))
    inside = (F.col("_n") >= ARTICLES) & (F.col("_n") > F.col("_all") * ARTICLE_SHARE)
    repeated = (suffixes.where("at IS NOT NULL").groupBy(F.col("name").alias("_name"), F.col("host").alias("_of"))
                .agg(F.count_distinct("copy").alias("_n")).where(F.col("_n") >= min(PAGES, ARTICLES))
                .join(hosts, F.col("_of") == F.col("_host")).where(F.when(F.col("_inside"), inside).otherwise(outside))
                .select("_name", "_of"))
    places = stored(suffixes.where("open").join(repeated, (F.col("name") == F.col("_name")) & (F.col("host") == F.col("_of")))
                    .groupBy(F.col("page").alias("_p")).agg(F.collect_set("at").alias("_places")))
    done = (parsed.join(places, F.col("_page") == F.col("_p"), "left").select("_id", "_url", "_zip", "_places")
            .mapInArrow(by_runs, schema))
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
