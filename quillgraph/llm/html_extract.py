"""Main text of web pages through wrappers: union-free regular expressions over a host's token streams.

1. A page becomes a balanced stream of tokens: block elements (their sign is the tag with its first class or id) and texts.
   Inline elements are part of the text around them. Runs of equal flow elements (p p p, dt dd dt dd) are one repeated
   group. Pages of one stream are one structure: per text its least and largest hash say whether it is always the same.
2. A host's structures are aligned one after another into its wrapper. Where two streams differ in a text, it becomes a
   slot; where they differ in a tag, first a further round of the group just passed is looked for (a repeated group), else
   the nearest element at which both go on, and what is skipped is optional. Structures are dealt to SALTS groups by their
   hash, folded in the order of their text, and the groups' wrappers in the order of their numbers: neither partitions nor
   the order of rows matter, and no task sees all structures of a host. Of a level of more than WIDE elements the first and
   the last are kept in order and what lies between is one slot; in a wrapper of more than NODES elements that holds for levels
   of more than FEW at the depth where there are more, and what lies below these isn't told apart: its size is bounded.
3. The wrapper is marked: it tells which elements hold the article. These are its outermost article and main elements, with
   the h1 that vary outside them; on hosts without such elements, what lies between the first and the last slot of the
   deepest container that holds all slots. Texts that are the same on all pages don't count as slots. A name (class or id)
   takes an element out only where the wrapper agrees: a clear one (advert, comments) if the element belongs to the template
   (it is on several pages) or nothing can tell (what it lies in is on one page), a doubtful one if its text is the same on all pages,
   and none of them if no slot would be left.
4. Each page is aligned with its host's marked wrapper; its text is what fills the marked slots, block by block.

Defined results: a null or empty html gives an empty text, a null url the host ''; truncated pages end all open elements, a
tag without its end is dropped with what follows; elements below DEEP levels are not told apart, their texts stay; white
space in a block becomes one space, empty blocks go; repeated rows give repeated rows; other columns are not read. nav,
footer, aside, dialog, menu and form elements never give text (a form does if it holds the article), header elements only
their headings.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, slices
from quillgraph.llm.url_filter import host_of

GROUP, DEEP, WIDE, FEW, NODES = 4, 64, 512, 32, 4096
#: Groups that a host's structures are dealt to, by rounds of folding.
SALTS = (4096, 64, 1)
#: Structures that a task holds before it passes them on; characters of wrappers that are broadcast; parts of a host's pages beyond.
HELD, MOST_CHARS, PARTS = 20_000, 1 << 26, 16

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside dialog menu head".split())
#: An opening tag of the first kind ends an open p.
ENDS_P = BLOCKS - {"html", "body", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: An opening tag ends open elements of these kinds.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody")}
#: What the search for an article's place goes into, and what is told apart by its place on a page.
CONTAINERS = frozenset("html body div section center form fieldset".split())
PLACED = CONTAINERS | {"article", "main", "header"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Whole classes or ids of adverts, reader comments and notices; of other parts of a site that aren't an article; and of what may be part of one.
CLEAR = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle ad-slot ad-banner ad-container sponsored cookie-notice cookie-banner cookie-consent "
    "cookie-bar comments commentlist comment-list comments-area comments-section disqus_thread share-buttons social-share newsletter-signup".split()
)
USUAL = frozenset(
    "cookie cookies consent gdpr sidebar sidebar-left sidebar-right left-sidebar right-sidebar social-links related-posts related-articles newsletter signup login "
    "breadcrumb breadcrumbs nav navbar navigation main-menu menu footer masthead popup modal pagination".split()
)
MAYBE = frozenset(
    "alert banner comment discussion disqus notice notices overlay pager paywall promo promotion recommended related replies reply respond share sharing side "
    "skip skip-link social sponsor subscribe subscription toolbar widget".split()
)
UNNAMED = HEADINGS | {"html", "body", "main", "article"}
ROLES = frozenset("complementary navigation banner menu".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_END = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"[\s\xa0]+")
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def tag_end(html: str, at: int) -> int:
    """Index of the > that ends the tag whose name ends at `at`, -1 without one. A quote counts after = only; one that is
    never closed is none."""
    pos = at
    while (m := _END.search(html, pos)) is not None:
        if m[0] == ">":
            return m.start()
        pos = m.end()
        before = m.start() - 1
        while before > at and html[before].isspace() and m.start() - before < 64:
            before -= 1
        if html[before] == "=" and (close := html.find(m[0], pos)) >= 0:
            pos = close + 1
    return -1


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw text, ""), ("open", tag, attributes), ("close", tag, ""): one pass, each character looked at a fixed number of times."""
    at, end = 0, len(html)
    while at < end:
        low = html.find("<", at)
        if low != at:
            yield "text", html[at : low if low >= 0 else end], ""
            if low < 0:
                return
        if html.startswith("<!--", low):
            close = html.find("-->", low + 4)
            at = close + 3 if close >= 0 else end
            continue
        closing = html.startswith("/", low + 1)
        name = _NAME.match(html, low + 1 + closing)
        if name is None:
            if closing or html.startswith(("!", "?"), low + 1):
                close = html.find(">", low)
                at = close + 1 if close >= 0 else end
            else:
                yield "text", "<", ""
                at = low + 1
            continue
        close = tag_end(html, name.end())
        if close < 0:
            return
        at, tag = close + 1, name[0].lower()
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, html[name.end() : close]
        if tag in RAW and html[close - 1] != "/":
            found = _CLOSING[tag].search(html, at)
            at = found.start() if found else end


def sign_of(tag: str, attributes: str) -> tuple[str, bool]:
    """The sign of an element: tag.word, then !!! for a name of CLEAR, !! of USUAL, ! of MAYBE; and whether its role is that of no article."""
    first, second, rank, never = "", "", 0, False
    if attributes:
        for m in _NAMED.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "role":
                never = never or tag not in UNNAMED and any(x in ROLES for x in value.split())
                continue
            if word := _WORD.search(value):
                if kind == "class":
                    first = first or "." + word[0]
                else:
                    second = second or "." + word[0]
            if tag in UNNAMED:
                continue
            for name in [value.strip()] if kind == "id" else value.split():
                own = 3 if name in CLEAR else 2 if name in USUAL else 1 if name in MAYBE else 0
                # A section's id is its title's anchor.
                rank = max(rank, min(own, 1) if kind == "id" and tag == "section" else own)
    return tag + (first or second or "." * (rank > 0)) + "!" * rank, never


class Node:
    """An element (or "#", a text) of a page or wrapper: how many pages have it, whether it is optional, repeated or its
    children without order, the least and largest hash of its text."""

    __slots__ = ("sign", "pages", "flags", "lo", "hi", "kids", "mark")

    def __init__(self, sign: str, pages: int = 1, flags: int = 0, lo: int = 0, hi: int = 0) -> None:
        self.sign, self.pages, self.flags, self.lo, self.hi = sign, pages, flags, lo, hi
        self.kids: list[Node] = []
        self.mark = ""

    @property
    def tag(self) -> str:
        return self.sign.partition(".")[0]

    @property
    def rank(self) -> int:
        return self.sign.count("!")


#: HOLDS: a region lies below (set by decide).
OPTIONAL, REPEATED, FREE, HOLDS = 1, 2, 4, 8


def page_tree(html: str) -> tuple[Node, list[str]]:
    """The page's elements, texts as "#" with their number in the list of blocks as lo. Elements that never give text are left out."""
    root, blocks = Node(""), []
    stack: list[tuple[str, Node]] = [("", root)]
    opened: Counter[str] = Counter()
    skip, parts = 0, []

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                stack[-1][1].kids.append(Node("#", lo=len(blocks)))
                blocks.append(text)

    def pop() -> None:
        nonlocal skip
        flush()
        tag, node = stack.pop()
        opened[tag] -= 1
        if skip and len(stack) <= skip:
            skip = 0

    for kind, value, attributes in tokens(html):
        if kind == "text":
            if not skip:
                parts.append(unescape(value))
            continue
        if kind == "close":
            if value in BLOCKS and opened[value]:
                while stack[-1][0] != value:
                    pop()
                pop()
            continue
        if value == "br":
            parts.append(" ")
        elif value == "hr":
            flush()
        if value not in BLOCKS:
            continue
        if value in ("html", "body") and opened[value]:
            continue
        flush()
        ended = SAME.get(value, ())
        while stack[-1][0] == "head" or stack[-1][0] == "p" and (value in ENDS_P or ended) or stack[-1][0] in ended:
            pop()
        sign, never = sign_of(value, attributes)
        own = stack[-1][1]
        if not skip:
            if value in NEVER or never:
                skip = len(stack)
            elif len(stack) <= DEEP:
                own = Node(sign)
                stack[-1][1].kids.append(own)
        stack.append((value, own))
        opened[value] += 1
    while len(stack) > 1:
        pop()
    flush()
    return root, blocks


def structure(html: str) -> tuple[str, list[int], list[int]]:
    """A page's stream with its repeated groups, written out, and the least and largest hash of each of its texts."""
    root, blocks = page_tree(html)
    order = [root]
    for node in order:
        order.extend(node.kids)
    for node in order:
        if node.sign == "#":
            node.lo = node.hi = zlib.crc32(blocks[node.lo].encode("utf-8", "surrogatepass"))
    for node in reversed(order):  # children before their parents
        fold_rounds(node)
    bound(root)
    return written(root)


def written(root: Node) -> tuple[str, list[int], list[int]]:
    out, lows, highs, work = [], [], [], list(reversed(root.kids))
    while work:
        node = work.pop()
        if node is None:
            out.append("/")
            continue
        if node.sign == "#":
            out.append("#+" if node.flags & REPEATED else "#")
            lows.append(node.lo)
            highs.append(node.hi)
            continue
        out.append(node.sign + "+" * bool(node.flags & REPEATED) + "*" * bool(node.flags & FREE))
        work.append(None)
        work.extend(reversed(node.kids))
    return " ".join(out), lows, highs


def read(stream: str, pages: int, lows: list[int], highs: list[int]) -> Node:
    """The wrapper of the pages of one structure."""
    root = Node("", pages)
    stack, at = [root], 0
    for token in stream.split(" ") if stream else ():
        if token == "/":
            stack.pop()
            continue
        flags = REPEATED * ("+" in token) | FREE * ("*" in token[1:])
        node = Node(token.rstrip("*+") or "*", pages, flags)
        stack[-1].kids.append(node)
        if node.sign == "#":
            node.lo, node.hi = lows[at], highs[at]
            at += 1
        else:
            stack.append(node)
    return root


def fold_rounds(top: Node) -> None:
    """Runs of equal groups of flow elements or texts become one repeated group."""
    kids = top.kids
    if len(kids) < 2:
        return
    for size in range(1, GROUP + 1):
        out: list[Node] = []
        for kid in kids:
            out.append(kid)
            while len(out) >= 2 * size and all(x.sign == y.sign and x.tag not in PLACED for x, y in zip(out[-size:], out[-2 * size : -size], strict=True)):
                for k in range(size):
                    merge(out[k - 2 * size], out[k - size], True)
                    out[k - 2 * size].flags |= REPEATED
                del out[-size:]
        kids = out
    top.kids = kids


def merge(a: Node, b: Node, same: bool = False) -> None:
    """Makes a the wrapper of all pages of both; same: b is another round of a on the same pages."""
    work = [(a, b, same)]
    while work:
        a, b, same = work.pop()
        if a.sign == "#":
            if same and a.lo == a.hi and b.lo == b.hi:
                a.lo = a.hi = zlib.crc32(b.lo.to_bytes(4, "big"), a.lo)
            else:
                a.lo, a.hi = min(a.lo, b.lo), max(a.hi, b.hi)
        else:
            aligned(a, b, same, work)
        a.pages = max(a.pages, b.pages) if same else a.pages + b.pages
        a.flags |= b.flags


def aligned(a: Node, b: Node, same: bool, work: list[tuple[Node, Node, bool]]) -> None:
    """Aligns the children of b with those of a, in place; pairs whose contents are still to be aligned go to work."""
    left, right = a.kids, b.kids
    if (a.flags | b.flags) & FREE:
        a.flags |= FREE
        n, m = edges_shared(left, right)
        work.extend((left[k], right[k], same) for k in range(n))
        work.extend((left[-k], right[-k], same) for k in range(1, m + 1))
        a.kids = [*left[:n], anything(a.pages + b.pages), *left[len(left) - m :]]
        return
    pairs = matched(left, right)
    out: list[Node] = []
    for i, j, again in pairs:
        if again:  # another round of what stands `again` places before
            x = left[i] if i >= 0 else right[j]
            out[-again].flags |= REPEATED
            work.append((out[-again], x, True))
            # The round moves on with its group: the next element of it is compared with the group's next one.
            out.append(out.pop(-again))
            continue
        if i >= 0 and j >= 0:
            out.append(left[i])
            work.append((left[i], right[j], same))
        else:
            x = left[i] if i >= 0 else right[j]
            x.flags |= OPTIONAL
            if out and out[-1].sign == x.sign and out[-1].flags & OPTIONAL:  # options of one sign side by side are one repeated option
                out[-1].flags |= REPEATED
                work.append((out[-1], x, same))
            else:
                out.append(x)
    a.kids = out


def matched(left: list[Node], right: list[Node]) -> list[tuple[int, int, int]]:
    """(i, j, 0): left[i] and right[j] are partners; (i, -1, 0), (-1, j, 0): one has none; (i, -1, k), (-1, j, k): it is a
    further round of what stands k places before. One pass; partners further on are found through lists of places by sign."""
    if len(left) == len(right) and all(x.sign == y.sign for x, y in zip(left, right, strict=True)):
        return [(i, i, 0) for i in range(len(left))]
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))
    for side, kids in zip(places, (left, right), strict=True):
        for k, x in enumerate(kids):
            side[x.sign].append(k)
    out: list[tuple[int, int, int]] = []
    passed: list[str] = []  # signs of the partners just passed
    i = j = 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i].sign == right[j].sign:
            out.append((i, j, 0))
            passed.append(left[i].sign)
            i, j = i + 1, j + 1
            continue
        ahead_l = next_place(places[0], right[j].sign, i) if j < len(right) else -1
        ahead_r = next_place(places[1], left[i].sign, j) if i < len(left) else -1
        size, of_left, count = further(passed, left, right, i, j, ahead_l < 0 and ahead_r < 0)
        if size:
            for k in range(count):
                out.append((i + k, -1, size) if of_left else (-1, j + k, size))
            i, j = (i + count, j) if of_left else (i, j + count)
            continue
        if ahead_l >= 0 and (ahead_r < 0 or ahead_l - i <= ahead_r - j):
            out += [(k, -1, 0) for k in range(i, ahead_l)]
            i = ahead_l
        elif ahead_r >= 0:
            out += [(-1, k, 0) for k in range(j, ahead_r)]
            j = ahead_r
        else:
            if i < len(left):
                out.append((i, -1, 0))
                i += 1
            if j < len(right):
                out.append((-1, j, 0))
                j += 1
        passed.clear()
    return out


def further(passed: list[str], left: list[Node], right: list[Node], i: int, j: int, only: bool) -> tuple[int, bool, int]:
    """Size of the group just passed that goes on in further rounds on one side, whether on the left, and how many elements
    these are; size 0 if there is none, or if the sides don't meet behind it (but for `only`: nothing else can be done)."""
    for size in range(1, min(GROUP, len(passed)) + 1):
        group = passed[-size:]
        for of_left, kids, at in ((True, left, i), (False, right, j)):
            end = at
            while end + size <= len(kids) and all(kids[end + k].sign == group[k] for k in range(size)):
                end += size
            if end > at:
                x, y = (end, j) if of_left else (i, end)
                if only or [n.sign for n in left[x : x + 1]] == [n.sign for n in right[y : y + 1]]:
                    return size, of_left, end - at
    return 0, False, 0


def next_place(places: dict[str, list[int]], sign: str, at: int) -> int:
    known = places.get(sign, ())
    k = bisect_left(known, at)
    return known[k] if k < len(known) else -1


def anything(pages: int) -> Node:
    """Stands for elements that aren't told apart; its text is a slot, but on one page, where no text is one."""
    node = Node("*", pages, OPTIONAL | REPEATED)
    node.kids = [Node("#", pages, REPEATED, 0, 0xFFFFFFFF if pages > 1 else 0)]
    return node


def parted(kids: list[Node]) -> tuple[list[Node], list[Node], bool]:
    """What stands before and behind the middle of a wide level that isn't told apart; both are all children, if there is none."""
    at = next((k for k, x in enumerate(kids) if x.sign == "*"), -1)
    return (kids, kids, False) if at < 0 else (kids[:at], kids[at + 1 :], True)


def edges_shared(left: list[Node], right: list[Node]) -> tuple[int, int]:
    """How many children at the beginning and at the end of two levels have the same signs."""
    (head_l, tail_l, wide_l), (head_r, tail_r, wide_r) = parted(left), parted(right)
    n = 0
    while n < min(len(head_l), len(head_r)) and head_l[n].sign == head_r[n].sign:
        n += 1
    most, m = min(len(tail_l) - n * (not wide_l), len(tail_r) - n * (not wide_r)), 0
    while m < most and tail_l[-1 - m].sign == tail_r[-1 - m].sign:
        m += 1
    return n, m


def narrow(node: Node, most: int) -> None:
    """Leaves the first and last children of a level, in order; those between aren't told apart, their text is a slot."""
    head, tail, _ = parted(node.kids)
    if len(node.kids) > most:
        node.kids = [*head[: most // 2], anything(node.pages), *tail[max(len(tail) - most // 2, 0) :]]
        node.flags |= FREE


def bound(root: Node) -> Node:
    """Narrows levels of more than WIDE children; beyond NODES elements all of a depth to FEW, and what lies below isn't told
    apart."""
    level, total = [root], 1
    while level:
        for node in level:
            narrow(node, WIDE)
        if total + sum(len(node.kids) for node in level) > NODES:
            for node in level:
                narrow(node, FEW)
        below = [kid for node in level for kid in node.kids]
        total += len(below)
        if total > NODES:
            for node in below:
                if node.sign not in "#*" and node.kids:
                    node.kids = anything(node.pages).kids
            return root
        level = below
    return root


# Marks of a wrapper: r the root of a region, i inside one, t a title outside, x no part of an article, c a text that is the
# same on all pages, o any other.


def walk(top: Node, into=lambda node: True) -> Iterator[tuple[Node, tuple[Node, ...]]]:
    """All nodes below top with their ancestors, in the order of the page; not below those that `into` refuses."""
    work: list[tuple[Node, tuple[Node, ...]]] = [(kid, (top,)) for kid in reversed(top.kids)]
    while work:
        node, above = work.pop()
        yield node, above
        if into(node):
            work.extend((kid, (*above, node)) for kid in reversed(node.kids))


def decide(wrapper: Node) -> Node:
    """Marks the wrapper's nodes."""
    pages = wrapper.pages
    slots: set[int] = set()  # ids of the elements with a slot below, and of the slots
    texts: set[int] = set()
    holds: set[int] = set()  # ids of the elements above an article or main
    for node, above in walk(wrapper):
        if node.sign == "#":
            same = node.lo == node.hi and (node.pages > 1 or pages == 1)
            node.mark = "c" if same and pages > 1 else "o"
            texts.update(id(x) for x in (*above, node))
            if not same:
                slots.update(id(x) for x in (*above, node))
        elif node.tag in ("article", "main"):
            holds.update(id(x) for x in above)
    several = bool(slots)
    tell = slots if several else texts

    def never(node: Node) -> bool:
        """Whether kind or name say that it is no part of an article, and the wrapper agrees."""
        if node.tag == "form":
            return True
        if node.rank == 1:
            return several and node.pages == pages and id(node) not in slots and id(node) not in holds
        return node.rank > 1 and (node.pages > 1 or id(node) in alone and (node.rank == 3 or id(node) not in inside))

    inside: set[int] = set()  # ids of what lies in an article or main
    alone: set[int] = set()  # ids of what nothing can tell of: its parent is on one page
    for node, above in walk(wrapper):
        if above[-1].pages == 1:
            alone.add(id(node))
        if id(above[-1]) in inside or above[-1].tag in ("article", "main"):
            inside.add(id(node))

    def regions(barred) -> list[tuple[Node, tuple[Node, ...]]]:
        """Outermost articles; else the run of children, from the first slot to the last, of the deepest container with all slots."""
        found = [(node, above) for node, above in walk(wrapper, lambda x: x.tag not in ("article", "main") and not barred(x)) if node.tag in ("article", "main") and not barred(node)]
        if found:
            return found
        told = {id(x) for node, above in walk(wrapper, lambda x: not barred(x)) if node.sign == "#" and id(node) in tell for x in (*above, node)}
        top, above = wrapper, (wrapper,)
        while True:
            own = [k for k, kid in enumerate(top.kids) if id(kid) in told and not barred(kid)]
            if not own:
                return []
            if not several:
                return [(kid, above) for kid in top.kids if not barred(kid)]
            if len(own) == 1 and top.kids[own[0]].tag in CONTAINERS:
                top = top.kids[own[0]]
                above = (*above, top)
                continue
            return [(kid, above) for kid in top.kids[own[0] : own[-1] + 1] if not barred(kid)]

    def open_form(node: Node) -> bool:
        return node.tag == "form" and id(node) not in holds

    found, kept = regions(never), set()
    if not found:
        # Names and forms bar all that varies, so they mean nothing on the way to it.
        found = regions(lambda node: open_form(node)) or regions(lambda node: False)
        kept = {id(x) for node, above in found for x in (*above, node)}
        below = [n for node, _ in found for n in (node, *(x for x, _ in walk(node, lambda x: id(x) in kept or not never(x)))) if n.sign == "#" and id(n) in tell]
        if not below:
            kept = {id(x) for x, _ in walk(wrapper)}

    roots = {id(node) for node, _ in found}
    around = {id(x) for _, above in found for x in above}
    by_article = any(node.tag in ("article", "main") for node, _ in found)
    work = [(kid, "o", False) for kid in reversed(wrapper.kids)]
    while work:
        node, mark, topped = work.pop()
        node.flags |= HOLDS * (id(node) in around)
        if mark != "x" and node.sign != "#" and id(node) not in kept and id(node) not in around and never(node):
            mark = "x"
        elif id(node) in roots and mark != "x":
            mark = "i"
            node.mark = "r"
        elif mark == "o" and by_article and node.tag == "h1" and any(x.lo != x.hi for x, _ in walk(node) if x.sign == "#"):
            mark = "t"
        if node.tag == "header" and id(node) not in around and id(node) not in inside:
            # The site's header, unless it has the title.
            topped, mark = True, mark if several else "x"
        if topped and node.sign == "#" and node.mark == "c":
            mark = "x"
        if node.mark != "r":
            node.mark = "c" if node.sign == "#" and mark == "o" and node.mark == "c" else mark
        work.extend((kid, mark, topped) for kid in reversed(node.kids))
    wrapper.mark = "A" if by_article else "S"
    return wrapper


def dump(root: Node) -> str:
    """Nodes as nested lists; at most DEEP levels."""

    def plain(node: Node) -> list:
        return [node.sign, node.pages, node.flags, node.lo, node.hi, node.mark, [plain(x) for x in node.kids]]

    return json.dumps(plain(root), separators=(",", ":"))


def load(text: str) -> Node:
    def made(x: list) -> Node:
        node = Node(*x[:5])
        node.mark, node.kids = x[5], [made(y) for y in x[6]]
        return node

    return made(json.loads(text))


def text_of(html: str, wrapper: Node | None) -> str:
    """The blocks of a page that fill its host's marked slots. On a page without any of the wrapper's regions (or without a
    wrapper), what its own article and main elements hold, else all that isn't the same on all pages."""
    root, blocks = page_tree(html)
    said: list[tuple[str, str, bool]] = []  # block, mark, whether in an own article
    seen = own_seen = False
    sloted = wrapper is not None and wrapper.mark == "S"
    # node, its wrapper node, mark, in an own article, and whether in a header (2: in a heading of it)
    work: list[tuple[Node, Node | None, str, bool, int]] = [(root, wrapper, "o", False, 0)]
    while work:
        node, known, mark, own, header = work.pop()
        if node.sign == "#":
            if header != 1:
                said.append((blocks[node.lo], mark, own))
            continue
        below: list[tuple[Node, Node | None, str, bool, int]] = []
        for kid, partner in zip(node.kids, partners(known, node), strict=True):
            if partner is not None:
                now = "i" if partner.mark == "r" else partner.mark
                seen = seen or partner.mark == "r"
            else:  # what the wrapper doesn't know is no part of the template
                now = "i" if sloted and known is not None and mark == "o" else mark
            if mark == "x":
                now = "x"
            inner = own or kid.tag in ("article", "main")
            own_seen = own_seen or inner
            if header == 1 and kid.tag in HEADINGS:
                head = 2
            elif not header and kid.tag == "header" and not (partner is not None and partner.flags & HOLDS):
                head = 1
            else:
                head = header
            below.append((kid, partner, now, inner, head))
        work.extend(reversed(below))
    if seen:
        return "\n\n".join(block for block, mark, _ in said if mark in "it")
    if own_seen:
        return "\n\n".join(block for block, mark, own in said if mark != "x" and (own or mark == "t"))
    return "\n\n".join(block for block, mark, _ in said if mark not in "xc")


def partners(wrapper: Node | None, page: Node) -> list[Node | None]:
    """For each child of the page's node the child of the wrapper's that it fits: the next one, else the first of a repeated
    group just passed, else the nearest further on, else the last of its sign."""
    if wrapper is None:
        return [None] * len(page.kids)
    if wrapper.flags & FREE:
        n, m = edges_shared(wrapper.kids, page.kids)
        middle = wrapper.kids[len(parted(wrapper.kids)[0])]
        return [*wrapper.kids[:n], *[middle] * (len(page.kids) - n - m), *wrapper.kids[len(wrapper.kids) - m :]]
    left, out = wrapper.kids, []
    places: dict[str, list[int]] = defaultdict(list)
    for k, x in enumerate(left):
        places[x.sign].append(k)
    at, passed = 0, []
    for x in page.kids:
        k = next_place(places, x.sign, at)
        if k != at:
            for known in reversed(passed[-GROUP:]):
                if left[known].sign == x.sign and left[known].flags & REPEATED:
                    k = known
                    break
        if k >= 0:
            at = k + 1
            passed.append(k)
        elif x.sign in places:
            k = places[x.sign][-1]
        out.append(left[k] if k >= 0 else None)
    return out


STRUCTURES = "host string, stream string, pages bigint, lows array<bigint>, highs array<bigint>"


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The structures in a task; they are added up further on, so it doesn't matter when they are passed on."""
    known: dict[tuple[str, str], list] = {}

    def out() -> pa.RecordBatch:
        columns = [[k[0] for k in known], [k[1] for k in known], *([v[i] for v in known.values()] for i in range(3))]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["host", "stream", "pages", "lows", "highs"])

    for batch in slices(batches):
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stream, lows, highs = structure(html or "")
            add_structure(known, (host, stream), 1, lows, highs)
        if len(known) > HELD:
            yield out()
            known.clear()
    yield out()


def add_structure(known: dict, key, pages: int, lows: list[int], highs: list[int]) -> None:
    if (have := known.get(key)) is None:
        known[key] = [pages, lows, highs]
    else:
        have[0] += pages
        have[1] = [min(x, y) for x, y in zip(have[1], lows, strict=True)]
        have[2] = [max(x, y) for x, y in zip(have[2], highs, strict=True)]


def _first_fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for batch in batches:
        for stream, pages, lows, highs in zip(*(batch.column(x).to_pylist() for x in ("stream", "pages", "lows", "highs")), strict=True):
            add_structure(known, stream, pages, lows, highs)
    # Equal pages are one: repeated rows confirm nothing.
    yield _folded(key, (read(stream, pages if lows != highs else 1, lows, highs) for stream, (pages, lows, highs) in sorted(known.items())))


def _next_fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((n, w) for batch in batches for n, w in zip(batch.column("part").to_pylist(), batch.column("wrapper").to_pylist(), strict=True))
    yield _folded(key, (load(w) for _, w in rows))


def _folded(key: tuple, wrappers: Iterator[Node]) -> pa.RecordBatch:
    whole = None
    for wrapper in wrappers:
        if whole is None:
            whole = wrapper
        else:
            merge(whole, wrapper)
            bound(whole)
    return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([dump(whole)], pa.string())], names=["host", "part", "wrapper"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, part (0), wrapper (JSON), one row per host."""
    needed = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    found = needed.mapInArrow(_structures, STRUCTURES).withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(SALTS[0])).cast("int"))
    kind = "host string, part int, wrapper string"
    folded = found.groupBy("host", "part").applyInArrow(_first_fold, kind)
    for salts in SALTS[1:]:
        folded = folded.withColumn("into", F.pmod("part", F.lit(salts)).cast("int")).groupBy("host", "into").applyInArrow(_next_fold, kind)
    return folded


def marked(wrappers: DataFrame) -> DataFrame:
    """host, wrapper with its marks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [dump(decide(load(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["host", "wrapper"])

    return wrappers.select("host", "wrapper").mapInArrow(rows, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers = materialize(marked(infer_wrappers(pages)), "wrappers")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in slices(batches):
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = load(wrapper)
                texts.append(text_of(html or "", known[wrapper] if wrapper is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    needed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("_host"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    if size <= MOST_CHARS:
        placed = needed.join(F.broadcast(wrappers), needed["_host"] == wrappers["host"], "left")
    else:  # a host's pages are dealt to PARTS tasks, and its wrapper goes to each of them
        own = needed.withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)))
        each = wrappers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).cast("long"))
        placed = own.join(each.hint("merge"), (own["_host"] == each["host"]) & (own["_part"] == each["part"]), "left")
    return placed.select("page_id", "url", "html", "wrapper").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
