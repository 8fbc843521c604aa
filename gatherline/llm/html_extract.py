"""Operator 9: main text of web pages, by paths on which the pages of a host agree.

1. Each page names the path (tags and classes, numbers generalised, as a hash) of the container that holds its main text: the
   deepest outside of which there is none of it.
2. Spark adds the votes up per host and path; the hosts' winning paths are a small table (pre-aggregated, so a host
   with a third of all pages is no burden).
3. Pages are read again and give all text below their host's winning path, without what is no article text. A page on
   which that path does not occur falls back to its host's next one, or to its own best container; so does one that
   has main text outside of that path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized_join, written

#: Winning paths that a host keeps, by votes.
PATHS_PER_HOST = 3
#: A block's text is the host's own where so many different pages of it have it at one path, and this share of them; and a page
#: keeps what is the host's own where that is more than this share of its text.
REPEATS, REPEAT_SHARE, MOST_DROPPED = 3, 0.5, 0.3

_WORDY = re.compile(r"[^\W_]")
_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {
    name: re.compile(rf"</{name}\s*>", re.I)
    for name in "script style noscript template svg iframe textarea select object canvas audio video title datalist annotation annotation-xml".split()
}
_ATTRIBUTE = re.compile(r"([a-z_:][-a-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("html body article main section div td table tbody tr center fieldset".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption header footer nav aside form address details summary thead tfoot th caption hr hgroup menu dialog".split())
#: Elements that never hold article text.
_OUT = frozenset("nav aside footer form button menu dialog label input".split())
_LISTS = frozenset("ul ol dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of a class or id that mark what is no article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social"
    " related recommend recommended recommendations comment comments reply replies respond disqus widget login search pagination pager toolbar hidden skip".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


@dataclass
class Block:
    """A run of text between block boundaries."""

    holder: int  # its innermost container
    out: bool  # inside what is no article text
    parts: list[str] = field(default_factory=list)
    wanted: bool = False  # words outside of links, or a heading
    text: str = ""


@dataclass
class Page:
    """Containers in page order, 0 the page itself, and text blocks. A path is the hash of its labels one after another."""

    parents: list[int]
    paths: list[int]
    blocks: list[Block]


def _tag_end(source: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` closes; -1 if a quoted value or the tag itself never does."""
    near = source.find(">", at)
    inside = source[at:near]
    if near >= 0 and '"' not in inside and "'" not in inside:
        return near
    while True:
        stop = _PLAIN.match(source, at).end()
        if stop == len(source):
            return -1
        if source[stop] == ">":
            return stop
        if source[at:stop].rstrip()[-1:] == "=":  # a quote opens a value after an equals sign only
            stop = source.find(source[stop], stop + 1)
            if stop < 0:
                return -1
        at = stop + 1


def pieces(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): "text", "open" with its attributes, "close" and "cdata", in one scan forward.

    Comments, declarations and the content of raw elements are left out. After a tag that never closes as written, tags
    end at the next ``>``, quoted or not, so that no stretch is looked at again and again.
    """
    at, text_from, lenient = 0, 0, False
    last = source.rfind(">")
    while True:
        at = source.find("<", at)
        if at < 0 or at > last:
            break
        end, piece = -1, None
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(source)
        elif source.startswith("<![CDATA[", at) and (stop := source.find("]]>", at)) >= 0:
            end, piece = stop + 3, ("cdata", "", source[at + 9 : stop])
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
        elif m := _NAME.match(source, at):
            stop = -1 if lenient else _tag_end(source, m.end())
            if stop < 0:
                lenient, stop = True, source.find(">", m.end())
            name, end = m[2].lower(), stop + 1
            piece = ("close" if m[1] else "open", name, source[m.end() : stop])
            if name in _RAW and not m[1]:
                piece = None
                if source[stop - 1] != "/":
                    close = _RAW[name].search(source, end)
                    end = close.end() if close else len(source)
        if end < 0:  # a lone "<"
            at += 1
            continue
        if at > text_from:
            yield "text", "", source[text_from:at]
        if piece:
            yield piece
        at = text_from = end
    if text_from < len(source):
        yield "text", "", source[text_from:]


def _words(value: str) -> list[str]:
    return re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())


def _label(tag: str, attributes: dict[str, str]) -> str:
    names = sorted(re.sub(r"\d+", "N", c.lower()) for c in attributes.get("class", "").split())
    return ".".join([tag, *names])


def _unwanted(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _OUT or (tag == "header" and not in_article):
        return True
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    marks = set(_words(attributes.get("class", "") + " " + attributes.get("id", "")))
    return bool(marks & _MARKS) or bool(in_article is False and marks & {"header"})


class _Open:
    """The open elements, and where on the stack those of each name and kind are."""

    def __init__(self):
        # name, whether nothing is wanted from here on, whether a container, and the block around an unwanted inline element
        self.stack: list[tuple[str, bool, bool, tuple[Block | None, int] | None]] = []
        self.at: dict[str, list[int]] = {}
        self.bounds: list[int] = []  # containers and lists
        self.containers: list[int] = []

    def push(self, name: str, out: bool, around: tuple[Block, int] | None = None) -> None:
        here = len(self.stack)
        self.stack.append((name, out, name in _CONTAINER, around))
        self.at.setdefault(name, []).append(here)
        if name in _CONTAINER:
            self.containers.append(here)
        if name in _CONTAINER or name in _LISTS:
            self.bounds.append(here)

    def pop(self) -> tuple[str, bool, bool, tuple[Block, int] | None]:
        top = self.stack.pop()
        here = len(self.stack)
        self.at[top[0]].pop()
        for held in (self.containers, self.bounds):
            if held and held[-1] == here:
                held.pop()
        return top

    def last(self, names: Iterable[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def count(self, *names: str) -> int:
        return sum(len(self.at.get(n, ())) for n in names)


@lru_cache(1 << 15)
def _described(tag: str, content: str) -> tuple[str, bool, bool]:
    """(label, whether no article text is inside, the same within an article) of a start tag: pages share most of them."""
    attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(content)} if content.strip() else {}
    return _label(tag, attributes), _unwanted(tag, attributes, False), _unwanted(tag, attributes, True)


def parse(source: str) -> Page:
    """The page's containers and text blocks. Unclosed and stray tags are put up with; the time is linear in the size."""
    page = Page([-1], [0], [])
    opened, holders = _Open(), [0]
    block: Block | None = None
    bounds = 0  # boundaries of blocks so far

    def pop_to(depth: int) -> tuple[Block, int] | None:
        """Close elements; the block around the outermost unwanted inline one of them."""
        around = None
        while len(opened.stack) > depth:
            top = opened.pop()
            around = top[3] or around
            if top[2]:
                holders.pop()
        return around

    links, articles, mains = (opened.at.setdefault(x, []) for x in ("a", "article", "main"))
    for kind, tag, content in pieces(source):
        linked = bool(links)
        if kind == "text":
            if block is None:
                if not content.strip():
                    continue
                block = Block(holders[-1], bool(opened.stack) and opened.stack[-1][1])
                page.blocks.append(block)
            block.parts.append(content)
            if not block.wanted and (not linked or opened.count(*_HEADINGS)):
                block.wanted = _WORDY.search(html.unescape(content) if "&" in content else content) is not None
        elif kind == "cdata":
            if block is not None:
                block.parts.append(content.replace("&", "&amp;"))
                block.wanted |= not linked
        elif tag in ("br", "wbr"):
            if block is not None and tag == "br":
                block.parts.append(" ")
        elif kind == "close":
            here = opened.last((tag,))
            if tag in _BLOCK:
                block, bounds = None, bounds + 1
            elif opened.containers and here < opened.containers[-1]:
                continue
            around = pop_to(here) if here >= 0 else None
            if around and around[1] == bounds:
                block = around[0]  # the text goes on where the unwanted element stood in it
        else:
            if tag in _BLOCK:
                block, bounds = None, bounds + 1
                # an open paragraph ends where a block begins, with whatever was left open in it
                same = opened.last(("p", *_SAME.get(tag, ())))
                if same >= 0 and same >= (opened.bounds[-1] if opened.bounds else -1):
                    pop_to(same)
            if tag in _VOID or content.rstrip().endswith("/") and tag not in _BLOCK and tag != "a":
                continue
            label, *unwanted = (_described if len(content) < 300 else _described.__wrapped__)(tag, content)
            before = bool(opened.stack) and opened.stack[-1][1]
            out = before or unwanted[bool(articles or mains)]
            if tag in _CONTAINER:
                page.parents.append(holders[-1])
                page.paths.append(xxhash.xxh3_64_intdigest(label.encode("utf-8", "replace"), page.paths[holders[-1]]))
                holders.append(len(page.paths) - 1)
            around = (block, bounds) if out != before and tag not in _BLOCK else None
            if out != before:
                block = None
            opened.push(tag, out, around)
    for b in page.blocks:
        text = "".join(b.parts)
        b.text = " ".join((html.unescape(text) if "&" in text else text).split())
    return page


def _core(page: Page) -> tuple[int, int]:
    """(the deepest container that holds all main text, characters of it).

    Main text is what is no unwanted block and no list of links: a block whose words are all in links, but for headings.
    """
    held = [0] * len(page.paths)
    for b in page.blocks:
        if b.wanted and not b.out:
            held[b.holder] += len(b.text)
    for i in range(len(held) - 1, 0, -1):  # containers stand after those that hold them
        held[page.parents[i]] += held[i]
    return max(i for i, n in enumerate(held) if n == held[0]) if held[0] else 0, held[0]


def votes(page: Page) -> list[tuple[int, float]]:
    """(path, weight) for the container that holds the page's main text: the deepest with all of it."""
    core, total = _core(page)
    return [(_signed(page.paths[core]), min(1.0, total / 500))] if total else []


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def repeats(page: Page) -> tuple[int, list[int]]:
    """(hash of all text, hash of each block's text and path): what tells whether a host repeats a block over its pages."""
    good = [b for b in page.blocks if b.text and not b.out]
    keys = {_signed(xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "replace"), page.paths[b.holder])) for b in good}
    return _signed(xxhash.xxh3_64_intdigest("\n".join(b.text for b in good).encode("utf-8", "replace"))), sorted(keys)


def extract(page: Page, paths: list[int], repeated: frozenset[int] = frozenset()) -> str:
    """Text below the first of ``paths`` that occurs with all main text, else below the page's own best container.

    Blocks that the host repeats (``repeated``) go, unless they are too much of the page: then its pages are copies of each other.
    """
    core, total = _core(page)
    good = [b for b in page.blocks if b.text and not b.out]
    for path in [*paths, *([_signed(page.paths[core])] if total else [])]:
        below = [False] * len(page.paths)
        for i, p in enumerate(page.paths):
            below[i] = _signed(p) == path or i > 0 and below[page.parents[i]]
        found = [b for b in good if below[b.holder]]
        if found and sum(len(b.text) for b in found if b.wanted) == total:
            if repeated:
                own = [b for b in found if _signed(xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "replace"), page.paths[b.holder])) not in repeated]
                if sum(len(b.text) for b in found) - sum(len(b.text) for b in own) <= MOST_DROPPED * sum(len(b.text) for b in found):
                    found = own
            return "\n".join(b.text for b in found)
    return ""


def main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paths_per_host: int = PATHS_PER_HOST) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Text blocks in page order, joined by a line feed; within one, white space is a single space. Null and empty pages
    give the empty text; a null or unreadable URL is a host of its own (the empty one); ties between paths go to the
    smaller path; rows that repeat a page count as pages of their own. An empty table gives no rows. A block whose text
    stands at one path of half of a host's pages (different ones, three at least) is the host's and goes from all of
    them, whatever it is called, but where most of a page would go.
    """
    host = F.coalesce(F.lower(F.expr(f"try_parse_url(`{url_col}`, 'HOST')")), F.lit(""))
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"host": [], "path": [], "weight": [], "body": [], "blocks": []}
            for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(s)
                path, weight = next(iter(votes(page)), (None, None))
                for name, value in zip(out, (h, path, weight, *repeats(page)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"host": pa.array(out["host"], pa.string()), "path": pa.array(out["path"], pa.int64()), "weight": pa.array(out["weight"], pa.float64()), "body": pa.array(out["body"], pa.int64()), "blocks": pa.array(out["blocks"], pa.list_(pa.int64()))})

    ballot = written(spark, keyed.select("host", "html").mapInArrow(vote, "host string, path long, weight double, body long, blocks array<long>"), "ballot")
    # pages that are alike count once, and each block once for each of them
    bodies = ballot.groupBy("host", "body").agg(F.first("blocks").alias("blocks"))
    held = bodies.groupBy("host").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= REPEATS)
    common = bodies.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)
    common = common.join(held, "host").where(F.col("n") >= REPEAT_SHARE * F.col("bodies")).groupBy("host").agg(F.collect_list("block").alias("repeated"))
    ballot = ballot.where("path is not null")
    # partial sums first, so that no host's pages meet; a host has few paths
    totals = ballot.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("weight"))
    ranked = totals.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("weight"), "path"))).where(F.col("nth") <= paths_per_host)
    winners = ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))
    # a host repeats at most 1 / REPEAT_SHARE times the blocks that a page of it has on average
    winners = written(spark, winners.join(common, "host", "full"), "host_paths")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            texts = [extract(parse(s), p or [], frozenset(r or ())) for s, p, r in zip(col["html"].to_pylist(), col["paths"].to_pylist(), col["repeated"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": col["page_id"], "url": col["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    id_type = keyed.schema["page_id"].dataType.simpleString()
    return sized_join(keyed, winners, ["host"], "left").select("page_id", "url", "html", "paths", "repeated").mapInArrow(apply, f"page_id {id_type}, url string, text string, n_chars long")
