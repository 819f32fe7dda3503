"""Main text of web pages by removing each site's template.

A page is read once into blocks of text. Every block element's subtree is hashed
from its tag, its texts and its children. Spark counts, per host, on how many
different pages a hash occurs; subtrees that recur over many pages of a host are
its template and are deleted, inside articles as outside.

What tells a template from copies of an article is the rest of the page. Each of
KEYS hash functions names the page's text outside the subtree by the least hash
of its three-word runs. Around a template these names differ from page to page;
around the paragraphs of an article of which there are copies, exact or with a
few changes, they mostly agree. A subtree is a template if the names, on average
over the functions, are at least LEAST_PAGES and LEAST_SHARE of the different
pages with the subtree (not of the host's pages, so sections and languages of
a large site have templates of their own). Up to ROUNDS times this is repeated
without what has been found, so that a long template doesn't hide others.

Elements whose tag or role says that they are no text (navigation, header,
footer, sidebar, form, script, style ...) go without counting, as do containers
all of whose class or id is made of such names (`cookie-banner`, but not
`social-history`). Names are a guess, so they never take an article or main
element with them, nor headings or paragraphs, and if nothing else is left they
are disregarded. If the page has articles (or else a main element), only their
text counts; otherwise the body's.

Nulls: a null page is empty and has an empty text; a null url, or one without a
host, shares one host with its like. Broken markup is read as far as it makes
sense: open elements end with their parent or the page, a cut tag is markup.
Repeated rows are pages of their own in the result, one page for the counts. On a host
of which all pages are copies nothing is a template. Time is linear in a page's
length, however deep it nests. Columns that the pages have besides may have any
name. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small

#: A template's subtree is on so many different pages at least, and so many of
#: those that have it, to this share, are different articles.
LEAST_PAGES, LEAST_SHARE = 3, 0.25
#: Hash functions that name the rest of a page.
KEYS = 8
#: Rounds of counting, fewer if one finds nothing.
ROUNDS = 3
#: Up to so many rows a side is broadcast, beyond it is joined by shuffle.
BROADCAST_ROWS = 100_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select article main section div body td th".split())

# Elements, roles and names that aren't the article.
NOT_TEXT = frozenset("head header nav footer aside form button select menu dialog object audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended widget widgets "
    "comment comments discussion disqus reply replies responses pagination pager toolbar copyright skip".split()
)
#: Words that say nothing beside a name.
BESIDE = frozenset("area bar bottom box block buttons container content form inner items left link links list main outer page right section site slot text title top wrap wrapper".split())
#: What a name can't take.
TEXT_TAGS = frozenset("html body main p h1 h2 h3 h4 h5 h6 blockquote pre td th tr table tbody".split())
#: What is never a template as a whole.
WHOLE = frozenset(("", "html", "body", "article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|svg|math|iframe|textarea|xmp|noembed|noframes)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?:[!?]|/(?![a-z]))[^>]*(?:>|\Z)"
    r"|<[a-z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[a-z]+")

# Why a block is left out.
KEPT, NAMED, TAGGED = 0, 1, 2


def _says(value: str) -> bool:
    """Whether one of the names of a class or id is no text's."""
    for name in value.split():
        parts = set(NAME.findall(name))
        if parts and parts <= NAMES | BESIDE and not parts.isdisjoint(NAMES):
            return True
    return False


def _left_out(tag: str, attrs: str) -> int:
    if tag in NOT_TEXT:
        return TAGGED
    for kind, *value in ATTR.findall(attrs) if attrs else ():
        kind, said = kind.lower(), "".join(value).lower()
        if kind == "role" and said.strip() in ROLES:
            return TAGGED
        if kind in ("class", "id") and tag not in TEXT_TAGS and _says(said):
            return NAMED
    return KEPT


class _Open:
    __slots__ = ("tag", "out", "parts", "first", "inside")

    def __init__(self, tag: str, out: int, first: int, inside: str):
        self.tag, self.out, self.first, self.inside = tag, out, first, inside
        self.parts: list[int] = []


class Page:
    """blocks: the texts that count, in order. subtrees: (hash, first, last) of
    the elements that hold blocks, the last one excluded."""

    __slots__ = ("blocks", "subtrees")

    def __init__(self, blocks: list[str], subtrees: list[tuple[int, int, int]]):
        self.blocks, self.subtrees = blocks, subtrees

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """Without the subtrees of `template`."""
        if template.isdisjoint(s[0] for s in self.subtrees):
            return " ".join(self.blocks)
        stays = np.ones(len(self.blocks), bool)
        for mark, first, last in self.subtrees:
            if mark in template:
                stays[first:last] = False
        return " ".join(b for b, s in zip(self.blocks, stays, strict=True) if s)

    def content(self) -> int:
        """A hash of all blocks."""
        return _hash("\n".join(self.blocks))

    def rests(self, marks: set[int], gone: set[int]) -> dict[int, np.ndarray]:
        """For each of the subtrees, KEYS names of the blocks outside it and
        outside the subtrees that are gone."""
        least = np.stack([_least(b) for b in self.blocks])
        none = np.full((1, KEYS), 0xFFFFFFFF, np.uint32)
        for mark, first, last in self.subtrees:
            if mark in gone:
                least[first:last] = none
        before = np.minimum.accumulate(np.r_[none, least])
        behind = np.minimum.accumulate(np.r_[least, none][::-1])[::-1]
        return {mark: np.minimum(before[first], behind[last]) for mark, first, last in self.subtrees if mark in marks}


_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, KEYS, dtype=np.uint64) | np.uint64(1)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _least(block: str) -> np.ndarray:
    """The least hash of a block's three-word runs under each function."""
    words = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in block.split(" ")], np.uint64)
    runs = words.copy()
    runs[:-1] += words[1:] * np.uint64(0x9E3779B97F4A7C15)
    runs[:-2] += words[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    runs = runs[: max(1, len(runs) - 2)]
    runs ^= runs >> np.uint64(31)
    return ((runs[:, None] * _FACTORS) >> np.uint64(32)).min(axis=0).astype(np.uint32)


def read(page: str | None) -> Page:
    page = page or ""
    stack = [_Open("", KEPT, 0, "")]
    blocks: list[str] = []
    kinds: list[tuple[int, str]] = []  # why a block is left out; article or main
    subtrees: list[tuple[int, int, int, str]] = []
    run: list[str] = []

    def flush() -> None:
        """Ends a block of the innermost element."""
        if run:
            block = " ".join("".join(run).split())
            run.clear()
            if block:
                blocks.append(block)
                kinds.append((stack[-1].out, stack[-1].inside))
                stack[-1].parts.append(_hash(block))

    def close() -> None:
        node = stack[-1]
        if node.tag in INLINE:
            if node.out != stack[-2].out:
                flush()
            stack.pop()
            return
        flush()
        stack.pop()
        if node.parts:
            mark = xxhash.xxh64_intdigest(node.tag.encode("utf-8", "surrogatepass") + b"\0" + np.array(node.parts, np.int64).tobytes()) - (1 << 63)
            stack[-1].parts.append(mark)
            if node.tag not in WHOLE:
                subtrees.append((mark, node.first, len(blocks), node.inside))

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at and stack[-1].out != TAGGED:
            said = page[at : token.start()]
            run.append(entities.unescape(said) if "&" in said else said)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or stack[k].tag in HOLDS and tag in INLINE), 0)
            if depth and stack[depth].tag == tag:
                while len(stack) > depth:
                    close()
            continue
        if tag in VOID:
            if tag not in ("wbr", "img", "input", "link", "meta"):
                run.append(" ")
            continue
        if tag in CLOSES_P or tag in SAME_ENDS:
            ends = ("p",) if tag in CLOSES_P else SAME_ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    if tag != "tr":
                        break
                elif stack[k].tag not in INLINE and stack[k].tag not in ("p", "td", "th"):
                    break
        over = stack[-1]
        if tag in INLINE:
            out = _left_out(tag, token["attrs"] or "") if over.out == KEPT else over.out
            if out != over.out:
                flush()  # what was said before stays
            node = _Open(tag, out, over.first, over.inside)
            node.parts = over.parts if out == over.out else []
            stack.append(node)
            continue
        flush()
        out = max(over.out, _left_out(tag, token["attrs"] or ""))
        inside = over.inside
        if tag in ("article", "main"):
            if not inside or tag == "article" and inside == "main":
                inside = tag
                if over.out == NAMED and _left_out(tag, token["attrs"] or "") == KEPT:
                    out = KEPT  # a name can't take an article
        stack.append(_Open(tag, out, len(blocks), inside))
    if at < len(page) and stack[-1].out != TAGGED:
        run.append(entities.unescape(page[at:]) if "&" in page[at:] else page[at:])
    while len(stack) > 1:
        close()
    flush()
    for out in (KEPT, NAMED):  # what names have left out only if nothing else is there
        for places in (("article",), ("main",), ("", "article", "main")):
            picked = [o == out and inside in places for o, inside in kinds]
            if any(picked):
                return _only(blocks, picked, subtrees)
    return Page([], [])


def _only(blocks: list[str], picked: list[bool], subtrees: list[tuple[int, int, int, str]]) -> Page:
    at = np.r_[0, np.cumsum(picked)]
    inner = {}
    for mark, first, last, _ in subtrees:
        if at[last] > at[first]:
            inner.setdefault((mark, int(at[first])), (mark, int(at[first]), int(at[last])))
    return Page([b for b, p in zip(blocks, picked, strict=True) if p], list(inner.values()))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")))


PARSED = "blocks binary, marks array<long>, spans binary, content long"


def _packed(page: Page) -> tuple[bytes, np.ndarray, bytes, int]:
    """Compressed, for it is written once. Blocks hold no line feeds."""
    raw = "\n".join(page.blocks).encode("utf-8", "surrogatepass")
    spans = np.array([s[1:] for s in page.subtrees], np.int32).reshape(-1, 2)
    return zlib.compress(raw, 1), np.array([s[0] for s in page.subtrees], np.int64), spans.tobytes(), page.content()


def _unpacked(blocks: bytes, marks: np.ndarray, spans: bytes) -> Page:
    raw = zlib.decompress(blocks).decode("utf-8", "surrogatepass")
    of = np.frombuffer(spans, np.int32).reshape(-1, 2).tolist()
    return Page(raw.split("\n") if raw else [], [(int(m), a, b) for m, (a, b) in zip(marks, of, strict=True)])


def parsed(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """page (all columns but the html), host, row (a number of its own), and the
    page's blocks and subtrees. Written, so that pages are read once and row
    numbers stay."""

    @F.pandas_udf(PARSED)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_packed(read(p)) for p in batch], columns=["blocks", "marks", "spans", "content"])

    kept = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html])
    rows = pages.select(kept.alias("page"), host_of(F.col(f"`{url}`")).alias("host"), F.monotonically_increasing_id().alias("row"), of(F.col(f"`{html}`")).alias("of"))
    return cut(rows.select("page", "host", "row", "of.*"))


def marked(read_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, found: the marks of each page that `wanted` (host, mark) has."""
    each = read_pages.select("row", "host", F.explode("marks").alias("mark"))
    of = small(wanted, BROADCAST_ROWS).select(F.col("host").alias("of_host"), F.col("mark").alias("of_mark"))
    hits = each.join(of, (F.col("host") == F.col("of_host")) & (F.col("mark") == F.col("of_mark")), "left_semi")
    return cut(hits.groupBy("row").agg(F.collect_set("mark").alias("found")))


def templates(read_pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """host, mark: the subtrees that recur over the host's pages. Each round
    leaves out of the rest what the ones before have found, so that a long
    template doesn't hide others."""

    @F.pandas_udf("array<struct<mark: long, keys: array<long>>>")
    def rests(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for blocks, marks, spans, found, gone in zip(*batch, strict=True):
                gone = set() if gone is None else set(map(int, gone))
                names = _unpacked(blocks, marks, spans).rests(set(map(int, found)) - gone, gone)
                out.append([{"mark": m, "keys": k.astype(np.int64).tolist()} for m, k in names.items()])
            yield pd.Series(out, dtype=object)

    # Copies of a page count once.
    each = read_pages.select("host", F.explode("marks").alias("mark"), "content").distinct()
    many = cut(each.groupBy("host", "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages))
    found = small(marked(read_pages, many), BROADCAST_ROWS).withColumnRenamed("row", "of_row")
    asked = read_pages.join(found, F.col("row") == F.col("of_row")).drop("page", "of_row")
    known = None
    for _ in range(rounds):
        gone = F.lit(None).cast("array<long>")
        if known is not None:
            out = small(marked(read_pages, known), BROADCAST_ROWS).withColumnRenamed("row", "out_row").withColumnRenamed("found", "gone")
            asked_now, gone = asked.join(out, F.col("row") == F.col("out_row"), "left"), F.col("gone")
        else:
            asked_now = asked
        named = asked_now.select("host", "content", F.explode(rests("blocks", "marks", "spans", "found", gone)).alias("of"))
        named = named.select("host", "content", "of.mark", "of.keys").groupBy("host", "mark", "content").agg(F.first("keys").alias("keys"))
        keys = named.select("host", "mark", F.posexplode("keys").alias("turn", "key")).distinct()
        each_turn = keys.groupBy("host", "mark", "turn").agg(F.count("*").alias("rests"))
        rest = each_turn.groupBy(F.col("host").alias("of_host"), F.col("mark").alias("of_mark")).agg(F.avg("rests").alias("rests"))
        judged = many.join(rest, (F.col("host") == F.col("of_host")) & (F.col("mark") == F.col("of_mark")))
        new = cut(judged.where((F.col("rests") >= least_pages) & (F.col("rests") >= F.lit(least_share) * F.col("pages"))).select("host", "mark"))
        known = new if known is None else known.unionByName(new)
        if new.isEmpty():
            break
    return known


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """`pages` without the html, with the main text of each; a column of that
    name is replaced."""

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for blocks, marks, spans, found in zip(*batch, strict=True):
                out.append(_unpacked(blocks, marks, spans).text(frozenset() if found is None else frozenset(map(int, found))))
            yield pd.Series(out, dtype=object)

    rows = parsed(pages, url=url, html=html)
    found = small(marked(rows, templates(rows)), BROADCAST_ROWS).withColumnRenamed("row", "of_row")
    joined = rows.join(found, F.col("row") == F.col("of_row"), "left")
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c not in (into, html)]
    return joined.select(*kept, text("blocks", "marks", "spans", "found").alias(into))


def op7(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
