"""Main text of web pages by a template deduced from pages of the same host.

Tokens are the block elements of a page, told apart by their path, and its
runs of text. Tokens of a host with the same occurrence vector (how often each
page has them) form an equivalence class. Spark sums a hash of (page, count)
over the pages of a host, so equal sums stand for equal vectors and no vector
is gathered anywhere. Classes that enough pages have are valid; the elements
of valid classes, nested by their paths, are the template, and text in the
class of the page itself is part of it. A page is laid on its host's template:
what stands between template tokens is a slot, and the slots inside the
article are its text. Text that every page of the host has once is template,
inside an article element too, unless the article has no other text."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, prepare, texts_of

#: Pages that a valid class spans: two, and this share of the host's. Text is
#: taken for template only on hosts of so many pages.
SHARE, TEXT_PAGES = 0.5, 5
#: Template tokens that are broadcast (8 bytes each); beyond, pages and
#: templates are joined by host.
BROADCAST_TOKENS = 1_000_000
#: Part of the text that the article holds on pages that mark none.
DENSE = 0.7

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""html head body address article aside blockquote center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul button caption""".split())
_DROPPED = frozenset("head nav footer aside form menu dialog button".split())
_MAIN = frozenset(("article", "main"))
#: Words of a class or id that name a part beside the article.
_BESIDE = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    sidebar sidebars widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb
    breadcrumbs pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond replies
    discussion disqus""".split())
#: Class names of articles that are not the page's own.
_OTHER = frozenset("comment comments related promo sponsored ad teaser".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    main: bool
    parent: Element | None
    good: int = 0  # text below it that is not in links


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    names = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    label = f"{names.get('id', '')} {names.get('class', '')}".strip()
    above = parent.main if parent else False
    main = tag in _MAIN or names.get("role") == "main" or names.get("itemprop") == "articleBody"
    dropped = bool(parent and parent.dropped) or tag in _DROPPED or (tag == "header" and not above)
    if not dropped and tag == "article":
        dropped = bool(_OTHER & set(label.lower().split()))
    elif not dropped and tag not in ("html", "body", "main"):
        words = {w.lower() for w in _WORD.findall(label)}
        dropped = (bool(words & _BESIDE) or ("header" in words and not above) or names.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")
                   or names.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) is not None
                   or bool(_HIDDEN.search(names.get("style", ""))))
    signature = tag + ("." + re.sub(r"\d+", "0", label) if label else "")
    return Element(tag, f"{_number(parent.path) if parent else 0:x}>{signature}", dropped, above or main, parent)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Block elements in page order and the runs of text between their marks.
    Inline marks leave no trace; a line break ends a run."""
    top = Element("", "", False, False, None)
    now, elements, blocks = top, [], []
    still_open: Counter = Counter()
    run: Block | None = None
    links = at = 0
    size = len(page)

    def add(text: str) -> None:
        nonlocal run
        if text:
            if run is None:
                run = Block(now)
                blocks.append(run)
            run.parts.append(text)
            if links:
                run.linked += len(text.strip())

    while at < size:
        mark = _TAG.search(page, at)
        if mark is None:
            add(page[at:])
            break
        if mark.start() > at:
            add(page[at:mark.start()])
        at = mark.end()
        if mark[2] is None:
            continue
        tag, closing = mark[2].lower(), bool(mark[1])
        if tag in _RAW:
            if not closing and not mark[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br" or tag == "hr":
            run = None
        elif tag in _BLOCK and not closing:
            run = None
            links = 0
            while now.tag == "p" or now.tag in _CLOSES.get(tag, ()):
                still_open[now.tag] -= 1
                now = now.parent
            now = _opened(tag, mark[3], now if now is not top else None)
            if now.parent is None:
                now.parent = top
            elements.append(now)
            still_open[tag] += 1
        elif tag in _BLOCK:
            run = None
            if still_open[tag]:
                while now.tag != tag:
                    still_open[now.tag] -= 1
                    now = now.parent
                still_open[tag] -= 1
                now = now.parent
    return elements, blocks


@lru_cache(maxsize=100_000)
def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def page_tokens(page: str) -> Counter:
    """How often each token occurs on a page."""
    elements, blocks = parse(page)
    tokens = Counter(e.path for e in elements)
    tokens.update(f"{b.element.path}={t}" for b in blocks if (t := b.text()))
    return tokens


def template_tokens(pages: DataFrame) -> DataFrame:
    """``pages(host, page, html)`` -> ``host, tokens, fixed``: the elements of
    valid classes, and the texts that every page of the host has once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                for token, n in [*page_tokens(text).items(), ("", 1)]:
                    own = sums.setdefault((host, token), [0, 0])
                    own[0] += 1
                    own[1] += _number(f"{page} {n}")
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in sums], pa.string()), pa.array([_number(t) for _, t in sums], pa.int64()), pa.array(["=" in t for _, t in sums], pa.bool_()),
                pa.array([not t for _, t in sums], pa.bool_()), pa.array([x[0] for x in sums.values()], pa.int64()),
                pa.array([(x[1] + (1 << 63)) % (1 << 64) - (1 << 63) for x in sums.values()], pa.int64())],
                ["host", "token", "is_text", "is_page", "pages", "vector"])

    seen = durable(pages.mapInArrow(count, "host string, token long, is_text boolean, is_page boolean, pages long, vector long")
                   .groupBy("host", "token", "is_text", "is_page").agg(F.sum("pages").alias("pages"), _wrapping_sum("vector").alias("vector"))
                   .where("pages > 1"))
    hosts = seen.where("is_page").select("host", F.col("pages").alias("all"), F.col("vector").alias("once"))
    often = seen.where("not is_page").join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all"))
    classes = often.groupBy("host", "vector").agg(F.count("*").alias("members")).where("members > 1")
    valid = often.join(classes, ["host", "vector"], "left").where((F.col("members").isNotNull() & ~F.col("is_text")) | (F.col("is_text") & (F.col("vector") == F.col("once")) & (F.col("all") >= TEXT_PAGES)))
    return durable(valid.groupBy("host").agg(F.collect_set(F.when(~F.col("is_text"), F.col("token"))).alias("tokens"), F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("fixed")))


def _wrapping_sum(column: str) -> Column:
    """Sum modulo 2^64 of a long column, as two sums that cannot overflow."""
    low = F.sum(F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.sum(F.shiftrightunsigned(F.col(column), 32))
    return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def main_text(page: str, tokens: set | None, fixed: set) -> str:
    """The article of a page, given its host's template (None: the page's own
    elements are the template)."""
    elements, blocks = parse(page)
    numbers: dict[str, int] = {}

    def in_template(e: Element) -> bool:
        if tokens is None:
            return True
        if e.path not in numbers:
            numbers[e.path] = _number(e.path)
        return numbers[e.path] in tokens

    def slot(e: Element) -> Element:
        """The innermost template element around a place: its slot."""
        while e.parent is not None and not in_template(e):
            e = e.parent
        return e

    texts = [(b, slot(b.element), text) for b in blocks if not b.element.dropped and (text := b.text())]
    own = [(b, s, text) for b, s, text in texts if not (fixed and _number(f"{b.element.path}={text}") in fixed)]

    def marked(found: list[tuple]) -> list[str]:
        # the slots of the article; an article that only a few pages of the host mark counts as well
        return [text for b, s, text in found if not s.dropped and (s.main or b.element.main)]
    if any(e.main and not e.dropped for e in elements):
        return "\n".join(marked(own) or marked(texts))
    texts = own
    total = 0
    for b, _, text in texts:
        good = max(0, len(text) - 2 * b.linked)
        total += good
        up = b.element
        while up is not None:
            up.good += good
            up = up.parent
    best = None
    for e in elements:  # the innermost slot that holds most of the text
        if e.good >= max(1, DENSE * total) and e.tag != "p" and in_template(e):
            best = e

    def within(e: Element | None) -> bool:
        while e is not None and e is not best:
            e = e.parent
        return best is None or e is best
    return "\n".join(t for b, _, t in texts if within(b.element) and 2 * b.linked <= len(t))


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, url, text, n_chars``.

    ``text`` holds the article's blocks in page order, one a line, character
    references decoded and white space inside a block as one space: without
    menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles, markup and reader comments. A page without any gives the empty
    text, as does null html. Pages whose url names no host, and the only page
    of a host, are taken by their own elements. One row per input row, repeated
    ones too; other columns are not read."""
    prepare(pages.sparkSession)
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    templates = template_tokens(pages.where("host <> ''").select("host", F.concat_ws(" ", "page_id", "url").alias("page"), "html"))
    size = templates.agg(F.sum(F.size("tokens") + F.size("fixed"))).first()[0] or 0
    joined = pages.join(F.broadcast(templates) if size <= BROADCAST_TOKENS else templates, "host", "left").select("page_id", "url", "html", "tokens", "fixed")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            texts = []
            for page, tokens, fixed in zip(texts_of(batch.column(2)), batch.column(3), batch.column(4), strict=True):
                if tokens.is_valid:
                    key = (tokens.values.to_numpy().tobytes(), fixed.values.to_numpy().tobytes())
                    if key not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[key] = tuple(set(np.frombuffer(k, np.int64).tolist()) for k in key)
                    texts.append(main_text(page, *known[key]))
                else:
                    texts.append(main_text(page, None, set()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(take, "page_id long, url string, text string, n_chars long")
