"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags.  The graph's nodes are the
blocks and the elements that contain them.  Two classifiers give terminal
capacities (cost of one label less that of the other, as log odds): for a
block its length, end, link share and tag, whatever stands around it; for an
element its name and class words.  Elements that by their name can't be part
of an article are seeds with a capacity beyond all others, as usual in
segmentation by cuts; all other names are only evidence.  Smoothness edges
join each block and element to the element around it, and each block to the
next one, the stronger the closer they stand in the tree.  The minimum cut
separates content from boilerplate: short paragraphs go with their article,
long ones of a sidebar with the sidebar, a list of links is cut off.

Exact reductions come first: nodes whose evidence outweighs their edges,
nodes without evidence and at most two edges, and parts of the graph without
any evidence to the contrary.  Max-flow (blocking flows on shortest paths)
labels the rest.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_moved int"
#: Elements by their role in HTML, and words of class, id and role attributes.
RAW = "script style noscript template svg math canvas iframe object audio video textarea select button title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEAD = frozenset("html head meta link base".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus reply replies sharing social newsletter related recommended recommendations widget widgets tagcloud pagination pager complementary contentinfo".split()
)
WEAK_NAMES = frozenset(
    "header alert rail respond share follow subscribe subscription signup login register more trending popular tags copyright legal disclaimer skip search form".split()
)
CONTENT_NAMES = frozenset("article content main post entry story body text prose".split())
#: Words after which a name says what a page has or hasn't, not what the element is.
MODIFIERS = frozenset("no has with without hide is".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag: quotes count after "=" only, and what was read is never tried again.
_ATTRS = re.compile(r"""((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
#: Tags that end only in quotes left open; beyond that many, quotes of the page no longer count.
OPEN_QUOTES = 20
#: How many inline elements up an inline end tag finds its start.
INLINE = 32
#: Log odds that an element's name gives, and the block classifier's weights.
SEED, WEAK, NAMED, ARTICLE = -1e6, -3.0, 3.0, 6.0
BIAS, LENGTH, PER_CHARS, ENDED, OPEN_END, LINKS, RIGHTS = -0.6, 2.2, 100, 0.5, -0.1, -3.0, -3.0
TAG_WEIGHTS = {"p": 0.5, "h1": 0.4, "h2": 0.4, "h3": 0.4, "h4": 0.4, "h5": 0.4, "h6": 0.4, "li": 0.7, "td": 0.7, "th": 0.7}
#: Elements that are parts of running text: lists, tables, quotations.
FLOW_TAGS = frozenset("blockquote dd dl dt figure li ol pre table tbody td tfoot th thead tr ul".split())
#: Smoothness: with the element around (less for the page's own, more for each unlinked block of running text), and with the next block.
AROUND, PAGE, FLOW, NEXT = 4.0, 0.25, 1.4, 1.0


@dataclass
class Element:
    """A block-level element: the one around it, its depth, and what its name says."""

    above: int
    depth: int
    hint: float
    page: bool
    flow: bool


@dataclass
class Block:
    inside: int
    tag: str
    hint: float
    apart: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@lru_cache(4096)
def _hint(tag: str, attrs: str, article: bool) -> float:
    """What an element's name says about the text in it; article: whether it stands in one."""
    if tag in ("html", "body"):
        return 0.0
    if attrs and _HIDDEN.search(attrs):
        return SEED
    if tag in BOILER_TAGS:
        return SEED
    bad = weak = good = False
    for m in _NAMES.finditer(attrs) if "=" in attrs else ():
        for name in m[1].strip("\"'").split():
            words = [p.lower() for p in _PART.findall(name)]
            if words and words[0] in MODIFIERS:
                continue
            own = not CONTENT_NAMES.isdisjoint(words)
            bad = bad or not BOILER_NAMES.isdisjoint(words)
            weak = weak or not WEAK_NAMES.isdisjoint(words)
            good = good or (own and BOILER_NAMES.isdisjoint(words) and WEAK_NAMES.isdisjoint(words))
    if tag == "header":
        return WEAK / 2 if article else SEED
    if bad:
        return WEAK if good else SEED
    if tag in CONTENT_TAGS:
        return ARTICLE
    return (NAMED if good else 0.0) + (WEAK if weak else 0.0)


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, white space collapsed and references decoded, empty ones left out; and its elements."""
    elements = [Element(-1, 0, 0.0, True, False)]
    # Open tags: (tag, element or -1 for an inline one, whether in an article, links open below).
    stack: list[tuple[str, int, bool, int]] = []
    counts: dict[str, int] = {}
    out: list[Block] = []
    now: Block | None = None
    inside = 0
    links = at = end = failed = 0
    low = 0
    in_head = False
    last = html.rfind(">")

    def say(text: str) -> None:
        nonlocal now, in_head, low
        # Text of its own ends the head, as in browsers; that of a title or script is no text here.
        in_head = in_head and (not text or text.isspace())
        if in_head or not text:
            return
        if now is None:
            if text.isspace():
                return
            e = elements[inside]
            tag = next((t for t, n, _, _ in reversed(stack) if n >= 0), "")
            now = Block(inside, tag, 0.0)
            if out:
                now.apart = elements[out[-1].inside].depth + e.depth - 2 * low
            low = e.depth
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def close(depth: int) -> None:
        nonlocal inside, links, low
        while len(stack) > depth:
            tag, n, _, links = stack.pop()
            counts[tag] -= 1
            if n >= 0:
                inside = elements[n].above
                low = min(low, elements[inside].depth)

    while True:
        start = html.find("<", end)
        if start < 0 or start > last:
            break
        m = _NAME.match(html, start + 1)
        if not m:
            end = start + 1
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                stop = len(html) if stop < 0 else stop + 3
            elif html[end : end + 1] in ("!", "?"):
                stop = html.find(">", start) + 1
            else:
                continue
            say(html[at:start])
            at = end = stop
            continue
        rest = _ATTRS.match(html, m.end()) if failed < OPEN_QUOTES else None
        if rest is None:
            failed += 1
            attrs, end = html[m.end() : (stop := html.find(">", m.end()))], stop + 1
        else:
            attrs, end = rest[1], rest.end()
        say(html[at:start])
        at = end
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW_END:
            if not closing and not attrs.endswith("/"):
                stop = _RAW_END[tag].search(html, end)
                at = end = stop.end() if stop else len(html)
            continue
        # A tag that can't stand in the head ends it too; elements of RAW are taken whole above.
        if in_head and (tag not in HEAD if not closing else tag in ("body", "html", "br")):
            in_head = False
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag == "head":
            in_head = not closing
            continue
        block = tag in BLOCK
        if block:
            now = None
        if closing:
            if not counts.get(tag):
                continue
            if block:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            else:  # an inline end tag doesn't close blocks around it
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - INLINE), -1):
                    if stack[k][1] >= 0:
                        break
                    if stack[k][0] == tag:
                        close(k)
                        break
        elif tag not in VOID and not attrs.endswith("/"):
            if block:
                same = ("p",) if tag not in ("li", "dt", "dd", "tr", "td", "th") else ("p", tag)
                while stack and (stack[-1][0] in same or stack[-1][1] < 0):
                    close(len(stack) - 1)
            article = bool(stack) and stack[-1][2]
            hint = SEED if elements[inside].hint <= SEED else _hint(tag, attrs[:1000], article)
            # An inline element counts only where its name rules it out.
            if block or hint <= SEED < elements[inside].hint:
                elements.append(Element(inside, elements[inside].depth + 1, hint, tag in ("html", "body"), tag in FLOW_TAGS))
                if not block:
                    now = None
                inside = len(elements) - 1
                stack.append((tag, inside, article or tag in CONTENT_TAGS, links))
            else:
                stack.append((tag, -1, article, links))
            counts[tag] = counts.get(tag, 0) + 1
            links += tag == "a"
    say(html[at:])
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
    return [b for b in out if b.text], elements


def evidence(b: Block) -> float:
    """Log odds of content by the block's own text, links and tag."""
    n = len(b.text)
    z = BIAS + min(n / PER_CHARS, LENGTH) + TAG_WEIGHTS.get(b.tag, 0.0)
    z += ENDED if b.text[-1] in ".!?:;\"'”»)" else OPEN_END
    z += LINKS * min(1.0, b.linked / max(n, 1)) if b.linked * 2 > n else 0.0
    return z + RIGHTS if "©" in b.text[:20] else z


def graph(page: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(gains, edges) of the page's nodes: its blocks first, then the elements around them."""
    gain = [evidence(b) for b in page]
    links: list[tuple[int, int, float]] = []
    node: dict[int, int] = {}
    # Unlinked blocks of the elements of running text; an element's number is greater than that of the one around it.
    loose: dict[int, int] = {}
    for b in page:
        if elements[b.inside].flow:
            loose[b.inside] = loose.get(b.inside, 0) + (b.linked * 2 <= len(b.text))
    for e in range(len(elements) - 1, 0, -1):
        if e in loose and elements[above := elements[e].above].flow:
            loose[above] = loose.get(above, 0) + loose[e]
    for i, b in enumerate(page):
        child, more, e = i, 0.0, b.inside
        while e >= 0:
            known = e in node
            if not known:
                node[e] = len(gain)
                gain.append(elements[e].hint)
            links.append((child, node[e], PAGE if elements[e].page else AROUND + more))
            if known:
                break
            child, more, e = node[e], FLOW * loose.get(e, 0), elements[e].above
        if i:
            links.append((i - 1, i, NEXT / (1 + b.apart / 2)))
    return gain, links


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut; gain: capacity from the source, or to the sink if negative."""
    n = len(gain)
    net, near = list(gain), [dict() for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    # Float sums may come out short of what taking edges away again and again leaves, hence the margin.
    total = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    joined: list[tuple[int, int]] = []
    gone = [False] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if gone[i]:
            continue
        if not near[i] or abs(net[i]) >= total[i] + 1e-9:  # no cut would label it otherwise; its edges become terminal ones
            side[i], gone[i] = net[i] > 0, True
            for j, c in near[i].items():
                net[j] += c if side[i] else -c
                total[j] -= c
                del near[j][i]
                queue.append(j)
            near[i] = {}
        elif len(near[i]) == 1:  # weaker than its only edge: it goes where that leads
            (j,) = near[i]
            joined.append((i, j))
            gone[i] = True
            net[j] += net[i]
            total[j] -= near[j].pop(i)
            queue.append(j)
        elif len(near[i]) == 2 and net[i] == 0:  # a link of a chain
            (j, c), (k, d) = near[i].items()
            joined.append((i, j if c >= d else k))
            gone[i] = True
            for x, y in ((j, k), (k, j)):
                total[x] += min(c, d) - near[x].pop(i)
                near[x][y] = near[x].get(y, 0.0) + min(c, d)
            queue += (j, k)
    seen = list(gone)
    for first in range(n):
        if not seen[first]:
            part, todo = [], [first]
            seen[first] = True
            while todo:
                i = todo.pop()
                part.append(i)
                for j in near[i]:
                    if not seen[j]:
                        seen[j] = True
                        todo.append(j)
            if all(net[i] >= 0 for i in part) or all(net[i] <= 0 for i in part):
                one = any(net[i] > 0 for i in part)
                for i in part:
                    side[i] = one
            else:
                for i, s in _max_flow(part, net, near).items():
                    side[i] = s
    for i, j in reversed(joined):
        side[i] = side[j]
    return [bool(x) for x in side]


def _max_flow(part: list[int], net: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Source's side of the nodes of ``part``, by blocking flows on shortest paths."""
    number = {x: k for k, x in enumerate(part)}
    s, t = len(part), len(part) + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(t + 1)]

    def add(a: int, b: int, ab: float, ba: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for x, k in number.items():
        if net[x] > 0:
            add(s, k, net[x], 0.0)
        elif net[x] < 0:
            add(k, t, -net[x], 0.0)
        for y, c in near[x].items():
            if number[y] > k:
                add(k, number[y], c, c)
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for a in arcs[i]:
                if room[a] > 1e-12 and level[to[a]] < 0:
                    level[to[a]] = level[i] + 1
                    queue.append(to[a])
        if level[t] < 0:
            return {x: level[k] >= 0 for x, k in number.items()}
        turn = [0] * (t + 1)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                flow = min(room[a] for a in path)
                for a in path:
                    room[a] -= flow
                    room[a ^ 1] += flow
                cut = next(k for k, a in enumerate(path) if room[a] <= 1e-12)
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            own = arcs[i]
            while turn[i] < len(own) and not (room[own[turn[i]]] > 1e-12 and level[to[own[turn[i]]]] == level[i] + 1):
                turn[i] += 1
            if turn[i] < len(own):
                path.append(own[turn[i]])
                i = to[path[-1]]
            elif path:
                a = path.pop()
                i = to[a ^ 1]
                turn[i] += 1
            else:
                break


def labelled(html: str | None) -> list[tuple[Block, bool]]:
    """The page's blocks in order, with whether each is content."""
    page, elements = blocks(html or "")
    return list(zip(page, minimum_cut(*graph(page, elements)), strict=False))


def main_text(html: str | None) -> str:
    """The blocks labelled content, in page order, one on a line."""
    return "\n".join(b.text for b, keep in labelled(html) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, moved = [], [], []
        for html in batch.column(2).to_pylist():
            page = labelled(html)
            texts.append("\n".join(b.text for b, keep in page if keep))
            counts.append(len(page))
            moved.append(sum(keep != (evidence(b) > 0) for b, keep in page))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32()), pa.array(moved, pa.int32())], [x.split()[0] for x in SCHEMA.split(", ")])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points), n_blocks, n_moved.

    n_moved: blocks that the cut labels otherwise than their own classifier.
    Null or empty html, and pages without a content block, have the text ''.
    Broken markup never fails: unclosed elements end with the page, an
    unclosed comment or script takes the rest of it.  Time grows with the
    length of a page, not with its nesting or its open quotes.  Rows are
    independent of each other, null ids and repeated rows among them, and an
    empty table gives no rows.  Columns other than page_id, url and html are
    not read, whatever their names.
    """
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, SCHEMA)
