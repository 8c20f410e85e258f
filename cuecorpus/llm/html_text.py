"""Main text of web pages by the distribution of line blocks.

Markup is stripped in one pass over a page: each block element's text becomes a line, with the characters that stand in links,
whether it lies in the page's article, and whether its elements or their names mark it as a menu, notice, advert or the like.
Lengths of lines are then summed over sliding windows of lines. Text begins where the sum surges and ends where it dives; what
lies between is kept, short lines included. Marked lines and links weigh nothing; lines of an article weigh enough to surge by
themselves, however short.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cuecorpus.llm.workspace import column

#: Lines of a window, and the sum at which text surges.
WINDOW, SURGE = 3, 80
#: Characters of an answer that are gathered before they go to Spark.
BATCH_CHARS = 16_000_000

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html "
    "li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th".split())
#: Elements that never hold text of the article.
CHROME = frozenset("aside audio button canvas dialog footer form head menu nav noscript object search select svg template video".split())
REGIONS = frozenset(("article", "main"))
#: What an open element is closed by, if nothing but inline elements stands between.
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
#: Parts of names (class, id) of elements outside the main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright cta disqus discussion donate footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain "
    "overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: Words that are written together with others.
JOINED = re.compile(
    r"(?!commentar)(?:comment|cookie|footer|sidebar|advert|banner|newsletter|navigation|breadcrumb|sponsor|pagination|disqus|masthead)\w+"
    r"|\w+(?:comments?|sidebar|footer|navbar|nav|menu|banner|advert|cookies?)|ads?(?:area|banner|block|box|container|label|panel|sense|slot|space|unit|wrap|wrapper|zone)"
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Names that say that an element has or lacks such a part besides the main text.
HAVING = frozenset("has no with without".split())
# End of fixed values.

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
AFTER = re.compile(r"\W*(?:\d+\s+)?(?:reader |user |leser)?(?:comments?|kommentare?|commentaires?|comentarios?|responses|replies)\b\W*(?:\(?\d+\)?)?\W*", re.I)
CLAIM = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)


class Line(NamedTuple):
    text: str
    #: Characters outside of links.
    free: int
    heading: bool
    item: bool
    chrome: bool
    #: The article or main element that it lies in (0: none), and its nearest other container.
    region: int
    holder: int


class _Open:
    """An open element."""

    __slots__ = ("name", "chrome", "link", "region", "holder", "heading", "item")

    def __init__(self, name: str, above: _Open | None):
        self.name = name
        self.chrome = above is not None and above.chrome
        self.link = name == "a" or (above is not None and above.link)
        self.region = above.region if above else 0
        self.holder = above.holder if above else 0
        self.heading = name in HEADINGS or (above is not None and above.heading)
        self.item = name == "li" or (above is not None and above.item)


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name or attributes say that it isn't main text."""
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attributes or attributes.isspace():
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name not in ("html", "body"):
            for whole in value.split():
                words = {w.lower() for w in WORDS.findall(whole)}
                if words & HAVING:
                    continue
                if words & NAMES or any(JOINED.fullmatch(w) for w in words) or (not inside and "header" in words and not words & {"article", "entry", "post", "story", "content"}):
                    return True
    return False


def lines_of(page: str, forms: bool = True) -> list[Line]:
    """The lines of a page, markup stripped: one pass, linear in the page's length. Without ``forms`` those aren't chrome."""
    found: list[Line] = []
    parts: list[str] = []
    free, n = 0, len(page)
    top: _Open = _Open("", None)
    stack, names, lower, made = [top], {}, None, 0

    def flush() -> None:
        nonlocal parts, free
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Line(text, free, top.heading, top.item, top.chrome, top.region, top.holder))
            parts, free = [], 0

    def pop(depth: int) -> None:
        nonlocal top
        while len(stack) > depth:
            names[stack.pop().name] -= 1
        top = stack[-1]

    def say(text: str) -> None:
        nonlocal free
        if text:
            parts.append(text)
            if not top.link:
                free += len(text.strip())

    pos = 0
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        say(page[pos:lt])
        after = page[lt + 1 : lt + 3]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            pos = n if end < 0 else end + 3
            continue
        if after[:1] in ("!", "?"):
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        closing = after[:1] == "/"
        if not after[closing : closing + 1].isascii() or not after[closing : closing + 1].isalpha():
            say("<")
            pos = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:  # a tag that the end of the page cuts
            break
        pos, name = m.end(), m[1].lower()
        if closing:
            block = name in BLOCKS
            if block:
                flush()
            elif name in SPACES:
                say(" ")
            if names.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                # An inline end tag doesn't close blocks around it.
                if block or not any(x.name in BLOCKS for x in stack[depth + 1 :]):
                    was = top.chrome
                    if was and not stack[depth - 1].chrome:
                        flush()
                    pop(depth)
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", pos) if len(lower) == n else (lambda x: x.start() if x else -1)(re.compile(f"</{name}", re.I).search(page, pos))
            if end >= 0:
                pos = end
            elif name in ("script", "style"):
                break
            continue
        if name in BLOCKS:
            flush()
            shut = CLOSERS.get(name, set()) | {"p"}
            if any(names.get(x) for x in shut):
                depth = len(stack) - 1
                while depth and stack[depth].name not in BLOCKS:
                    depth -= 1
                if stack[depth].name in shut:
                    pop(depth)
                    if name in CLOSERS and stack[-1].name in CLOSERS[name]:
                        pop(len(stack) - 1)
        elif name in SPACES:
            say(" ")
        if name in VOID or m[2].rstrip().endswith("/") and name not in BLOCKS:
            continue
        x = _Open(name, top)
        if name in REGIONS and not top.region:
            # An article doesn't lie in a menu: that element was left open.
            made += 1
            x.region, x.chrome = made, False
        if not x.chrome and name not in HEADINGS and (forms or name != "form") and _marked(name, m[2], bool(x.region)):
            flush()
            x.chrome = True
        if name in ("div", "section", "td", "body", "article", "main"):
            made += 1
            x.holder = made
        stack.append(x)
        names[name] = names.get(name, 0) + 1
        top = x
    flush()
    return found


def _segments(weights: np.ndarray) -> list[tuple[int, int]]:
    """From each surge to its dive: windows of WINDOW lines whose sum reaches SURGE, up to one that holds nothing."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    out, at = [], 0
    high, empty = np.flatnonzero(sums >= SURGE), np.flatnonzero(sums == 0)
    while True:
        k = np.searchsorted(high, at)
        if k == len(high):
            return out
        start = int(high[k])
        e = np.searchsorted(empty, start)
        end = int(empty[e]) if e < len(empty) else len(weights)
        out.append((start, end))
        at = end + 1


def _chosen(lines: list[Line]) -> list[Line]:
    usable = [x for x in lines if not x.chrome]
    if any(x.region for x in usable):
        weights = np.array([len(x.text) + SURGE if x.region else 0 for x in usable], np.int64)
        return [x for a, b in _segments(weights) for x in usable[a:b] if x.region]
    # A heading over readers' comments ends the text; links weigh nothing.
    for k, x in enumerate(usable):
        if x.heading and AFTER.fullmatch(x.text):
            usable = usable[:k]
            break
    linked = [x.free * 3 < len(x.text) for x in usable]
    weights = np.array([0 if b or (x.item and len(x.text) < SURGE) else x.free for x, b in zip(usable, linked, strict=True)], np.int64)
    segments = _segments(weights)
    if not segments:  # too little text to surge
        return [x for x, b in zip(usable, linked, strict=True) if not b and not x.item and not CLAIM.match(x.text)]
    main = max(segments, key=lambda s: int(weights[s[0] : s[1]].sum()))
    holder = max(range(*main), key=lambda i: weights[i])
    out = []
    for a, b in segments:
        if (a, b) != main and not any(usable[i].holder == usable[holder].holder for i in range(a, b)):
            continue
        own = [i for i in range(a, b) if not linked[i]]
        while own and not usable[own[0]].heading and usable[own[0]].free < SURGE // 4 and usable[own[0]].holder != usable[holder].holder:
            own = own[1:]
        while own and CLAIM.match(usable[own[-1]].text):
            own.pop()
        out += [usable[i] for i in own]
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: its lines in order, joined by empty lines; empty if there is none."""
    if not page:
        return ""
    found = _chosen(lines_of(page))
    if not found and "<form" in page.lower():  # one form around all of a page
        found = _chosen(lines_of(page, forms=False))
    return "\n\n".join(x.text for x in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, texts, size = 0, [], 0
        for k in range(batch.num_rows):
            texts.append(main_text(batch.column(0)[k].as_py()))
            size += len(texts[-1])
            if size >= BATCH_CHARS or k == batch.num_rows - 1:
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), own.column(1)], names=["text", "row"])
                at, texts, size = k + 1, [], 0


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text``: the main text of the whole page.

    A line's character references are decoded and its white space is one space each; lines stand in page order with an empty
    line between. Of a page with article or main elements, what lies in them is kept; of others, what lies between surges and
    dives. A null or empty page, and one without main text, gives an empty text. Pages of any length are read whole, in one
    pass; rows stay apart, so repeated rows give repeated answers, and an empty table gives none. A column ``text`` of the
    caller's is replaced.
    """
    others = [c for c in pages.columns if c not in (html_col, "text")]
    row = F.struct(*[column(c) for c in others]) if others else F.struct(F.lit(0).alias("_"))
    asked = pages.select(column(html_col).cast("string").alias("html"), row.alias("row"))
    out = asked.mapInArrow(_extract, StructType([StructField("text", StringType()), asked.schema["row"]]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "text")
