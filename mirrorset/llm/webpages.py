"""Main text of web pages: declared parts of the markup, and runs of tokens that a host repeats.

A page becomes blocks of text in order. Markup says what many blocks are: part of an article (or
another main element), or of a menu, header, footer, sidebar, notice, advert, form or comments.
What it leaves open, blocks outside of any declared part and articles of pages that hold several, is
settled by the host: all tokens outside the one article, words and element names in page order, are
the page's stream. Streams of a host are concatenated with a break after each page, and their
suffixes are sorted to a depth of ``RUN`` tokens by doubling: the name of 2n tokens comes from the
names of two neighbouring runs of n (so names agree in all tasks), and Spark's aggregation brings
equal names of a host together, reduced inside each task first, however many pages the host has. A
name that different pages share marks ``RUN`` tokens as repeated; overlapping marks make the longer
runs. Open blocks lose their repeated runs and keep the unique ones; of several articles those that
are repeated throughout go, unless all are.

Inside the one article of a page, repeated text stays: copies of an article, quoted passages and
licence lines repeat on a host as well, and they are main text. Menus do not: a block of links alone,
no heading, goes when runs that different pages of the host hold around their articles cover it
throughout. Runs of the articles themselves are no such evidence, so links that copies of an article share stay.

Results that are defined here: null or empty html has no text; a null url has no host and so no
repeats; pages with equal streams count once, so a copied page does not make itself boilerplate;
repeated rows and ids give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged, tidy

#: Tokens of the shortest run that counts as repeated; a power of two.
RUN = 8

# Element names of the HTML standard by what they do to text.
RAW = set("script style noscript template iframe svg math object textarea select title canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("base link meta noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = set("li dt dd tr td th option".split())
CHROME = set("nav footer aside form dialog button menu fieldset head".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice banner "
    "alert newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended "
    "share sharing social comment comments commentlist disqus respond footer masthead popup modal overlay login search toolbar pagination pager skip".split()
)
#: A class such as ``has-sidebar`` speaks of something else.
ABOUT_OTHERS = {"has", "with", "no", "without", "is", "not"}
MAIN_WORDS = {"articlebody", "entry-content", "post-content", "article-content", "article-body", "post-body"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")

OPEN, MAIN, ARTICLE, DROPPED = range(4)
#: A token that no text holds.
BREAK = "\x00"


@dataclass
class Block:
    """Text of one block: what it is, the number of its article, whether it is all links, and where its words lie in the stream or in the links."""

    kind: int
    article: int
    words: list[str]
    linked: bool = False
    start: int = -1


@dataclass
class Page:
    """Blocks in page order, how many articles have text, the tokens around (or of several) articles, and those of the links in the one article."""

    blocks: list[Block]
    articles: int
    stream: list[str]
    links: list[str] = field(default_factory=list)

    @property
    def settled(self) -> bool:
        """Whether markup alone says what all blocks are."""
        return self.articles == 1 or all(b.kind == DROPPED for b in self.blocks)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _chrome_named(named: list[str], strict: bool, inside: int) -> bool:
    """Whether a class or id names chrome; of an article only whole names count."""
    for token in named:
        if strict:
            if token in CHROME_WORDS or token == "teaser":
                return True
            continue
        parts = _PARTS.split(token)
        if parts[0] not in ABOUT_OTHERS and not CHROME_WORDS.isdisjoint(parts) or "header" in parts and inside not in (MAIN, ARTICLE):
            return True
    return False


def _declared(name: str, said: str, inside: int) -> int:
    """What an element says about its text; ``OPEN`` where it says nothing."""
    if name in CHROME or name == "header" and inside not in (MAIN, ARTICLE):
        return DROPPED
    found = MAIN if name == "main" else ARTICLE if name == "article" else OPEN
    if said and name not in ("html", "body"):
        attributes = _attributes(said)
        role = attributes.get("role", "").lower()
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or role in CHROME_ROLES:
            return DROPPED
        if _chrome_named(named, found != OPEN, inside):
            return DROPPED
        if role == "article" or attributes.get("itemprop", "").lower() == "articlebody" or not MAIN_WORDS.isdisjoint(named):
            return ARTICLE
        if role == "main":
            return MAIN
    return found


def read_page(source: str) -> Page:
    """Blocks and stream of a page."""
    stack: list[tuple[str, int, int]] = []  # elements that hold blocks: name, kind, article
    parts: list[str | Block] = []  # element names and blocks in page order
    kind, article, articles = OPEN, -1, 0
    text: list[str] = []
    in_link, plain = False, False  # whether text here is a link's, and whether the block has other text

    def end_block() -> None:
        nonlocal plain
        words = "".join(text)
        text.clear()
        words = (entities.unescape(words) if "&" in words else words).split()
        if words:
            linked = not plain and kind == ARTICLE and all(name not in HEADINGS for name, *_ in stack)
            parts.append(Block(kind, article, words, linked))
        plain = False

    at = 0
    for m in _MARKUP.finditer(source):
        if m.start() < at:  # inside of an element whose text does not count
            continue
        text.append(source[at : m.start()])
        plain = plain or not in_link and not (text[-1].isspace() or text[-1] == "")
        at = m.end()
        closing, name = m[1], m[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br" or name == "img":
                text.append(" ")
            elif name == "a":
                in_link = not closing
            continue
        end_block()
        said = m[3] if m[3] is not None else m[4]
        if name in RAW:
            if not closing and not said.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            continue
        if not closing:
            parts.append(f"<{name}>")
        if name == "p" or name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not said.endswith("/"):
            if stack and (stack[-1][0] == "head" and name not in IN_HEAD or stack[-1][0] == name and name in SIBLINGS):
                stack.pop()
            here = stack[-1][1:] if stack else (OPEN, -1)
            told = _declared(name, said, here[0])
            if DROPPED in (told, here[0]):
                here = (DROPPED, -1)
            elif told > here[0]:
                here = (told, articles)
                articles += told == ARTICLE
            stack.append((name, *here))
        kind, article = stack[-1][1:] if stack else (OPEN, -1)
    text.append(source[at:])
    plain = plain or not in_link and not (text[-1].isspace() or text[-1] == "")
    end_block()
    return _numbered(parts)


def _numbered(parts: list[str | Block]) -> Page:
    """Main elements count where no article has text. The article of a page with one is not in its stream."""
    blocks = [b for b in parts if isinstance(b, Block)]
    found = any(b.kind == ARTICLE for b in blocks)
    for b in blocks:
        if b.kind == MAIN:
            b.kind, b.article = (OPEN, -1) if found else (ARTICLE, 0)
    articles = len({b.article for b in blocks if b.kind == ARTICLE})
    stream: list[str] = []
    for part in parts:
        if isinstance(part, str):
            stream.append(part)
        elif part.kind != ARTICLE or articles > 1:
            part.start = len(stream)
            stream += part.words
    return Page(blocks, articles, stream, _links(parts) if articles == 1 else [])


def _links(parts: list[str | Block]) -> list[str]:
    """The article's blocks of links with the element names before and between them; other text breaks them."""
    links: list[str] = []
    if not any(isinstance(b, Block) and b.kind == ARTICLE and b.linked for b in parts):
        return links
    for part in parts:
        if isinstance(part, str):
            links.append(part)
        elif part.kind == ARTICLE and part.linked:
            part.start = len(links)
            links += part.words
        elif links and links[-1] != BREAK:
            links.append(BREAK)
    return links


def run_names(stream: list[str], host: str | None) -> np.ndarray:
    """For each token the name of the ``RUN`` tokens from there on, by doubling; shorter ends have none.

    A name is 64 bits over tokens and host, so names of different hosts differ; without a host there are none.
    """
    if host is None:
        return np.zeros(0, np.int64)
    own = xxhash.xxh64_intdigest(host)
    names = np.array([xxhash.xxh64_intdigest(t, own) for t in stream], np.uint64)
    width = 1
    with np.errstate(over="ignore"):
        while width < RUN:
            if len(names) <= width:
                return names[:0].view(np.int64)
            left, right = names[:-width], names[width:]
            names = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + (left >> np.uint64(29)))
            names = (names ^ (names >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            names ^= names >> np.uint64(32)
            width *= 2
    return names.view(np.int64)


def main_text(page: Page, names_at: np.ndarray, links_at: np.ndarray | None = None) -> str:
    """The text that is left; ``names_at`` are places in the stream where a repeated run begins, ``links_at`` those in the links."""
    if page.settled:
        menus = repeated_tokens(len(page.links), np.zeros(0, np.int64) if links_at is None else links_at)

        def menu(b: Block) -> bool:
            return b.linked and bool(menus[b.start : b.start + len(b.words)].all())

        return "\n".join(" ".join(b.words) for b in page.blocks if b.kind == ARTICLE and not (page.links and menu(b)))
    covered = repeated_tokens(len(page.stream), names_at)

    def repeated(b: Block) -> np.ndarray:
        return covered[b.start : b.start + len(b.words)]

    if page.articles:
        unique = {b.article for b in page.blocks if b.kind == ARTICLE and not repeated(b).all()}
        return "\n".join(" ".join(b.words) for b in page.blocks if b.kind == ARTICLE and (b.article in unique or not unique))
    left = (" ".join(w for w, x in zip(b.words, repeated(b)) if not x) for b in page.blocks if b.kind == OPEN)
    return "\n".join(x for x in left if x)


def repeated_tokens(n: int, names_at: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + RUN + 1, np.int32)
    np.add.at(edges, names_at, 1)
    np.add.at(edges, names_at + RUN, -1)
    return edges.cumsum()[:n] > 0


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or None) if url else None
    except ValueError:
        return None


#: Names that each task gets as a whole, 8 bytes each; more of them are joined.
HELD_NAMES = 1_000_000
#: Pages with equal keys have equal url and html, hence equal results.
KEYS = ["k1", "k2"]


def _signed(data: str) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each page's stream, and the names of the runs in it and in its links."""
    for batch in batches:
        digests, names, links = [], [], []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page, host = read_page(source or ""), host_of(url)
            names.append(run_names(page.stream, host))
            links.append(run_names(page.links, host))
            digests.append(_signed("\x00".join(page.stream)))
        runs = [pa.array(x, pa.list_(pa.int64())) for x in (names, links)]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(digests, pa.int64()), *runs], [*KEYS, "stream", "names", "links"])


def _told(batch: pa.RecordBatch, pages: list[Page], places: Iterator[np.ndarray]) -> pa.RecordBatch:
    """Texts and repeats of pages, given where repeated runs begin in each: in its stream, and on from there in its links."""
    texts, repeated = [], []
    for page, at in zip(pages, places):
        ends = max(len(page.stream) - RUN + 1, 0)
        at, links_at = at[at < ends], at[at >= ends] - ends
        texts.append(main_text(page, at, links_at))
        repeated.append(int(repeated_tokens(len(page.stream), at).sum()))
    columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(repeated, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_repeated"])


def _pages(batch: pa.RecordBatch) -> list[Page]:
    return [read_page(x or "") for x in batch.column("html").to_pylist()]


def _by_names(held):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        for batch in batches:
            pages = _pages(batch)
            hosts = map(host_of, batch.column("url").to_pylist())
            own = [np.concatenate([run_names(p.stream, h), run_names(p.links, h)]) if p.links else run_names(p.stream, h) for p, h in zip(pages, hosts)]
            found = (np.flatnonzero(names[np.searchsorted(names, x).clip(max=len(names) - 1)] == x) if len(names) else x[:0] for x in own)
            yield _told(batch, pages, found)

    return rows


def _by_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _told(batch, _pages(batch), (np.array(x or [], np.int64) for x in batch.column("places").to_pylist()))


def repeated_names(streams: DataFrame) -> DataFrame:
    """Names of runs that different pages of a host share."""
    each = streams.select("stream", F.explode("names").alias("name"))
    ends = each.groupBy("name").agg(F.min("stream").alias("low"), F.max("stream").alias("high"))
    return ends.where("low <> high").select("name")


def extract(pages: DataFrame, held_names: int = HELD_NAMES) -> DataFrame:
    """(page_id, url, text, n_repeated) of each page; the last counts the tokens around its article that the host repeats.

    Hosts repeat far fewer runs than they have pages. Up to ``held_names`` of them go to every task,
    and pages are read again where they lie; more are joined to the pages. Both give the same rows.
    """
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("k1"), F.xxhash64("html", "url", F.lit(1)).alias("k2"))
    streams = staged(keyed.select(*KEYS, "url", "html").mapInArrow(tidy(_streams), "k1 bigint, k2 bigint, stream bigint, names array<bigint>, links array<bigint>"), "page-streams")
    repeated = staged(repeated_names(streams), "page-names")
    out = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in ("page_id", "url")) + ", text string, n_repeated bigint"
    some = repeated.limit(held_names + 1).toArrow().column("name").to_numpy()
    if len(some) <= held_names:
        held = spark.sparkContext.broadcast(np.sort(some))
        return keyed.select("page_id", "url", "html").mapInArrow(tidy(_by_names(held)), out)
    each = streams.select(*KEYS, F.posexplode(F.concat("names", "links")).alias("place", "name"))
    places = each.join(repeated, "name").groupBy(*KEYS).agg(F.collect_set("place").alias("places"))
    return keyed.join(places, KEYS, "left").mapInArrow(tidy(_by_places), out)
