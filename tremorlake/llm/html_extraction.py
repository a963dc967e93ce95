"""HTML extraction: blocks of a page are labelled content or boilerplate by a minimum cut.

A page is cut into blocks of text. A classifier gives each the log-odds of being content, from the elements around it
and from its own words and links; they are the capacities to the two terminals. Blocks that follow each other, and
blocks of one element (through a node of their own), are tied by smoothness edges. The cut of least capacity separates
content from boilerplate. Pages are independent, so Spark deals them to tasks and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.tokens import slices

# Elements by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg math select button object canvas video audio map datalist".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr ul".split())
#: What a new element ends where the end tag is left out; any other block between keeps it open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "thead": {"tr", "thead", "tbody", "tfoot"}, "body": {"head"}}
ENDS |= {"tbody": ENDS["thead"], "tfoot": ENDS["thead"]}
STOPS = BLOCK - {"address", "div"}

# Names of parts of a page, by element, role, or word of a class or id.
BAD_TAGS = frozenset("nav footer aside dialog menu search".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist status".split())
GOOD_ROLES = frozenset("main article".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle adsense adslot adunit promo promos promotion promoted sponsor sponsors sponsored affiliate "
    "nav navbar navigation topnav sidenav subnav sitenav menu menubar submenu breadcrumb breadcrumbs pagination pager paging toolbar topbar bottombar skip "
    "sidebar sidebars side sidenote rail aside widget widgets related recommended recommendations trending popular teaser teasers "
    "footer footers sitefooter pagefooter bottom colophon copyright legal imprint masthead siteheader pageheader banner banners "
    "cookie cookies cookiebar consent gdpr ccpa privacy notice notices notification notifications alert alerts popup popups modal overlay toast paywall disclaimer "
    "comment comments commentlist commenter disqus respond reply replies discussion guestbook "
    "newsletter subscribe subscription signup login signin register search searchform form share sharing shares social followus".split()
)
#: Bad at the top of a page, but the head of an article belongs to it.
HEAD_WORDS = frozenset("header headers head top".split())
GOOD_WORDS = frozenset("article articles articlebody post posts postbody entry story storybody content contents main maincontent body text prose".split())
#: "has-sidebar" speaks of another element.
ABOUT_OTHERS = frozenset("has with no not without is hide show".split())
BOILERPLATE_TEXT = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookies?\b|subscribe|sign (?:in|up)|log in|privacy policy|terms of (?:use|service)|advertisement|sponsored", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</[^a-zA-Z>][^>]*>|</>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

#: Log-odds of the classifier: what surrounds a block outweighs what it says.
AROUND, OUTSIDE, NEAR_ARTICLE, PRIOR = 6.0, -2.0, 1.0, 1.0
#: Capacities of smoothness edges: successive blocks, blocks with their element, elements with the one around.
NEXT, INSIDE, BETWEEN = 0.8, 0.5, 0.25

#: Kinds of surroundings.
NONE, GOOD, MAIN, FORM, BAD = range(5)


def _kind(tag: str, attributes: str, around: int) -> int:
    """Kind of an element, given that of the element around it. Bad surroundings stay bad; a form's stay so until an
    article begins."""
    if around == BAD or tag in BAD_TAGS:
        return BAD
    own = GOOD if tag == "article" else MAIN if tag == "main" else FORM if tag in ("form", "fieldset") else NONE
    head = tag == "header"
    good = own in (GOOD, MAIN)
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), unescape(values[0] or values[1] or values[2])
            if name == "hidden" or name == "style" and UNSHOWN.search(value):
                return BAD
            if name == "role":
                if value.strip().lower() in BAD_ROLES:
                    return BAD
                good = good or value.strip().lower() in GOOD_ROLES
            elif name == "itemprop":
                good = good or value.strip() == "articleBody"
            elif name in ("class", "id"):
                for word in value.split():
                    before = ""
                    for part in NAME_PART.findall(word):
                        part = part.lower()
                        if before not in ABOUT_OTHERS:
                            # A page's main part may tell what stands beside it.
                            if part in BAD_WORDS and own != MAIN:
                                return BAD
                            head = head or part in HEAD_WORDS
                            good = good or around != FORM and part in GOOD_WORDS
                        before = part
    if head and not good and around not in (GOOD, MAIN):
        return BAD
    if own == FORM and around not in (GOOD, MAIN):
        return FORM
    if own == FORM:
        return BAD
    if good:
        return MAIN if own == MAIN else GOOD
    return around


class Block:
    """A block of text: its pieces, characters in links, element and kind of surroundings."""

    __slots__ = ("element", "kind", "linked", "pieces", "tag", "text")

    def __init__(self, tag: str, element: int, kind: int):
        self.tag, self.element, self.kind = tag, element, kind
        self.pieces: list[str] = []
        self.linked = 0
        self.text = ""


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The blocks with text of a page in order, and for each element the one around it (0: the page)."""
    parents, blocks = [0], []
    # Open elements: tag, number, kind, unseen.
    open_ = [("", 0, NONE, False)]
    counts: Counter[str] = Counter()
    now: Block | None = None
    # Open elements where a link began; 0 outside links.
    link = 0
    at, end = 0, len(page)
    lower = None

    def shut(k: int) -> None:
        nonlocal link
        for x in open_[k:]:
            counts[x[0]] -= 1
        del open_[k:]
        if link > k:
            link = 0

    def said(text: str) -> None:
        nonlocal now
        tag, element, kind, unseen = open_[-1]
        if unseen or not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(tag, element, kind)
            blocks.append(now)
        text = unescape(text) if "&" in text else text
        now.pieces.append(text)
        if link:
            now.linked += len(text.strip())

    while at < end:
        start = page.find("<", at)
        if start < 0:
            said(page[at:])
            break
        if start > at:
            said(page[at:start])
        found = TOKEN.match(page, start) or LOOSE.match(page, start)
        if found is None:
            said("<")
            at = start + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                link = 0
            if tag in BLOCK or tag in UNSEEN:
                if tag in BLOCK:
                    now = None
                if counts[tag]:
                    shut(next(k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == tag))
            elif tag in ("td", "th"):
                said(" ")
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            # Lower-casing changes the length of a few texts; those are searched by a pattern.
            if len(lower) == end:
                close = lower.find(f"</{tag}", at)
            else:
                close = next((m.start() for m in re.compile(f"</{tag}", re.I).finditer(page, at)), -1)
            at = end if close < 0 else close
            continue
        if tag == "br":
            said(" ")
        elif tag in ("td", "th"):
            said(" ")
        elif tag == "hr":
            now = None
        elif tag == "a":
            link = len(open_)
        elif tag in UNSEEN:
            if not found[3].endswith("/"):
                open_.append((tag, open_[-1][1], open_[-1][2], True))
                counts[tag] += 1
        elif tag in BLOCK and tag not in VOID:
            now = None
            if open_[-1][0] == "p":
                shut(len(open_) - 1)
            if ended := ENDS.get(tag):
                lowest = 0
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] in ended:
                        lowest = k
                    elif open_[k][0] in STOPS:
                        break
                if lowest:
                    shut(lowest)
            number = len(parents)
            around = open_[-1]
            parents.append(around[1])
            open_.append((tag, number, _kind(tag, found[3], around[2]), around[3]))
            counts[tag] += 1
    for block in blocks:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in blocks if b.text], parents


def scores(blocks: list[Block]) -> list[float]:
    """Log-odds of each block being content."""
    has_article = any(b.kind == GOOD for b in blocks)
    has_good = has_article or any(b.kind == MAIN for b in blocks)
    out = []
    for b in blocks:
        n = b.text.count(" ") + 1
        links = min(1.0, b.linked / len(b.text))
        score = PRIOR + max(-1.0, min(1.5, 0.1 * (n - 10))) - 4.0 * links
        if b.text[-1] in ".!?…\"'”»)。":
            score += 0.5
        if b.tag in ("p", "blockquote", "pre"):
            score += 0.7
        elif b.tag == "li":
            score -= 0.5
        elif b.tag in ("h1", "h2", "h3"):
            score += 0.4
        if b.kind in (NONE, MAIN) and n < 30 and BOILERPLATE_TEXT.search(b.text):
            score -= 2.0
        if b.kind in (BAD, FORM):
            score -= 2 * AROUND
        elif b.kind == GOOD or b.kind == MAIN and not has_article:
            score += AROUND
        elif b.kind == MAIN:
            score += NEAR_ARTICLE
        elif has_good:
            score += OUTSIDE
        out.append(score)
    return out


def edges_of(blocks: list[Block], parents: list[int]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of nodes and smoothness edges: blocks first, then one node for each element that holds blocks itself."""
    holding = {b.element for b in blocks}
    number = {e: len(blocks) + k for k, e in enumerate(sorted(holding))}
    edges = [(k, k + 1, NEXT) for k in range(len(blocks) - 1)]
    edges += [(k, number[b.element], INSIDE) for k, b in enumerate(blocks)]
    for e in number:
        # An element is made after the one around it, so each walk ends; elements without blocks are passed over.
        up = parents[e]
        while up and up not in number:
            up = parents[up]
        if e and up in number:
            edges.append((number[e], number[up], BETWEEN))
    return len(blocks) + len(number), edges


def cut(capacity: list[float], n: int, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each of ``n`` nodes is on the source's side of a minimum cut.

    ``capacity``: of the first nodes, to the source if positive, to the sink if negative. A node whose terminal
    outweighs all its edges keeps that side in every minimum cut, so it becomes part of the terminal; max-flow by
    levels of shortest augmenting paths settles the others.
    """
    tied = [0.0] * n
    for a, b, c in edges:
        tied[a] += c
        tied[b] += c
    side: list[bool | None] = [None] * n
    for k, c in enumerate(capacity):
        if abs(c) > tied[k]:
            side[k] = c > 0
    if None not in side[: len(capacity)]:
        return [bool(s) for s in side]
    source, sink = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def joined(a: int, b: int, c: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        left.append(c)
        near[b].append(len(to))
        to.append(a)
        left.append(back)

    fixed = [0.0] * n
    for k, c in enumerate(capacity):
        if side[k] is None:
            fixed[k] = c
    from_source, to_sink = [max(0.0, c) for c in fixed], [max(0.0, -c) for c in fixed]
    for a, b, c in edges:
        if side[a] is None and side[b] is None:
            joined(a, b, c, c)
        elif side[a] is not None and side[b] is not None:
            continue
        else:
            known, free = (a, b) if side[a] is not None else (b, a)
            if side[known]:
                from_source[free] += c
            else:
                to_sink[free] += c
    for k in range(n):
        if side[k] is None:
            # What passes straight through the node is flow already.
            through = min(from_source[k], to_sink[k])
            if from_source[k] > through:
                joined(source, k, from_source[k] - through, 0.0)
            if to_sink[k] > through:
                joined(k, sink, to_sink[k] - through, 0.0)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [bool(s) if s is not None else level[k] >= 0 for k, s in enumerate(side)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                most = min(left[e] for e in path)
                keep = len(path)
                for k, e in enumerate(path):
                    left[e] -= most
                    left[e ^ 1] += most
                    if left[e] <= tiny:
                        keep = min(keep, k)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while tried[a] < len(near[a]):
                e = near[a][tried[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                tried[a] += 1


def main_text(page: str | None) -> str:
    blocks, parents = blocks_of(page or "")
    if not blocks:
        return ""
    n, edges = edges_of(blocks, parents)
    content = cut(scores(blocks), n, edges)
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=False) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages`` (page_id, url, html; others are ignored).

    Blocks of the main text, in page order, are joined by one \\n; white space within a block is one space, character
    references are decoded. Null and empty pages, and pages without main text, give an empty text. Null ids and urls
    and repeated rows stay as they are; pages of any length are read whole; an empty table gives an empty result.
    """
    ids = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(_extracted, f"page_id {ids}, url string, text string, n_chars long")
