"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Each page becomes a small tree of its block elements, in
which like siblings are one repeated node. One page a host stands for the wrapper;
every other page of that host is aligned with it by simple tree matching, and per wrapper node
the pages that match it and those with the very same text are counted. Nodes that stay the same
are template; the others are slots. Inside of a repeated node the same is done block by block:
one that nearly all pages with another article have, too, is template wherever it stands. The content region is found by going down from the root into
the child that holds most of the varying text, with the elements' names as prior: navigation,
headers, footers, asides, notices, adverts, forms and comments are no content, an article or
main element that varies is. Variation overrides names in classes, ids and roles: one that holds
most of the varying text, or without which none is left, doesn't count. A page's text is what
its nodes under that region hold.

Only counts and one page a host are moved, never groups of pages; a host with a third of all
pages is counted in parts.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from collections.abc import Set as AbstractSet

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string, materialize, row_slices, table

#: Elements that hold text but don't end a block. All others are blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select option button xmp".split())
#: Elements that never hold main text.
OUT = frozenset("head script style title noscript iframe template svg math object select option button textarea xmp nav header footer aside form menu dialog fieldset input canvas audio video map".split())
#: Names (in class, id or role) that mark such a region.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu menus nav navbar navigation newsletter notice notices "
    "notification pager pagination popup popups promo promos promotion promotions related recommended reply replies respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets complementary contentinfo search alert modal overlay gdpr".split()
)
#: Words that make the names after them in a class a layout or a topic ("has-sidebar", "category-search").
QUALIFIERS = frozenset("has have no not non with without is layout template type format category categories cat tag term topic".split())
#: Words after a name that make it a state ("comments-closed").
STATES = frozenset("open opened closed on off enabled disabled none".split())
#: Names of regions that may hold more varying text than the page's own; they give way only if nothing else is left.
LISTS = frozenset("comment comments disqus related recommended reply replies respond".split())
CONTENT = frozenset(("article", "main"))
#: Names that say nothing on a single paragraph, heading or quotation: they may be about what it says.
WEAK = frozenset("header masthead related recommended reply replies respond search share sharing signup skip social tags toolbar topbar widget widgets menu menus complementary contentinfo alert modal overlay".split())
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Start tags that end an open element of the kinds named (the optional end tags).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
#: Elements that come in rows: those with one label among the children of an element are one repeated node.
ITEMS = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre hr figure option".split())
#: An end tag or an implied end never reaches out of these.
WALL = frozenset("table ul ol dl article section main aside nav body".split())
_MARK = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
#: Calls within each other that a page's nesting may take; shapes and alignments, and bytes of wrapper pages, that a task remembers;
#: bytes of wrapper pages and counts that are broadcast (beyond, pages are joined with them by host, in salted parts).
DEPTH, MOST_SHAPES, HELD_BYTES, BROADCAST_BYTES, SALTS = 1 << 20, 1 << 18, 32 << 20, 16 << 20, 64


class Node:
    """A block element: label, whether its kind marks it as no content and whether its names do (2 for those in LISTS), parent,
    children, and its text as runs in page order."""

    __slots__ = ("label", "tag", "out", "named", "parent", "children", "texts")

    def __init__(self, tag: str, label: str, out: bool, named: int, parent: Node | None):
        self.tag, self.label, self.out, self.named, self.parent = tag, label, out, named, parent
        self.children: list[Node] = []
        self.texts: list[int] = []  # numbers of the page's blocks


def _named(token: str, single: bool = False) -> int:
    """What one class, id or role says: 0 nothing, 1 no content, 2 a list beside the content."""
    words = _NAME.findall(token)
    for k, word in enumerate(words):
        if word in OUT_NAMES and not (single and word in WEAK) and not STATES.intersection(words[k + 1 : k + 2]):
            return 2 if word in LISTS else 1
        if word in QUALIFIERS:
            break
    return 0


def _attributes(raw: str, tag: str, parent: Node) -> tuple[str, bool, int]:
    tokens = []
    if "=" in raw:
        for m in _ATTRIBUTE.finditer(raw):
            if m[1].lower() in ("class", "id", "role"):
                tokens += (m[2] or m[3] or m[4] or "").lower().split()
    first = next((m[0] for w in tokens if (m := _NAME.search(w))), None)
    if tag in CONTENT:  # only one that is a comment itself
        named = 2 * any(w in LISTS for w in tokens)
    else:
        named = 0 if tag in ("html", "body") else max((_named(w, tag in SINGLE) for w in tokens), default=0)
    out = tag in OUT
    if tag == "header":  # an article's own header holds its title
        node = parent
        while out and node is not None:
            out = node.tag not in CONTENT or node.out
            node = node.parent
    return (f"{tag}.{first}" if first else tag), out, named


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's tree and its blocks in page order: (element, text). Never fails: any text is some page."""
    root = at = Node("", "", False, 0, None)
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []
    opened: dict[str, int] = {}  # by tag, elements that are open
    pos, size = 0, len(page)

    def end_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                at.texts.append(len(blocks))
                blocks.append((at, text))

    def close(node: Node) -> None:
        """Close all elements from the open one up to this."""
        nonlocal at
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent

    while pos < size:
        m = _MARK.search(page, pos)
        if m is None:
            held.append(page[pos:])
            break
        if m.start() > pos:
            held.append(page[pos : m.start()])
        pos = max(m.end(), pos + 1)
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            continue
        if tag in RAW:  # text up to the end tag is no markup, and is left out of its block
            if not m[1]:
                ended = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
                pos = page.find(">", ended.start()) + 1 if ended else size
                pos = pos or size
            continue
        if m[1]:  # an end tag: close up to its element, unless a wall lies between
            end_block()
            node = at if opened.get(tag) else root
            while node.parent is not None and node.tag != tag:
                if node.tag in WALL and tag not in WALL and tag not in ("html", "div"):
                    node = root
                    break
                node = node.parent
            if node.parent is not None:
                close(node)
            continue
        end_block()
        ends = CLOSES.get(tag, ())
        if opened.get("p") and tag in ENDS_P or any(opened.get(t) for t in ends):
            last, node = None, at
            while node.parent is not None and node.tag not in WALL:
                if node.tag in ends or node.tag == "p" and tag in ENDS_P:
                    last = node
                node = node.parent
            if last is not None:
                close(last)
        if tag in VOID:
            continue
        label, out, named = _attributes(m[3], tag, at)
        child = Node(tag, label, out, named, at)
        at.children.append(child)
        opened[tag] = opened.get(tag, 0) + 1
        at = child
    end_block()
    return root, blocks


class Slot:
    """A wrapper-tree node: like siblings merged. `shape` is the number of its tree of labels, the same for equal trees."""

    __slots__ = ("label", "out", "named", "children", "nodes", "tag", "shape")

    def __init__(self, label: str, tag: str, out: bool, named: int):
        self.label, self.tag, self.out, self.named = label, tag, out, named
        self.children: list[Slot] = []
        self.nodes: list[Node] = []
        self.shape = -1


class Shapes:
    """Trees of labels by number, and sizes of their largest alignments. Trees are equal where their numbers are."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.weight: list[int] = []  # nodes in the tree
        self.known: dict[tuple[int, int], int] = {}

    def number(self, label: str, children: tuple[int, ...]) -> int:
        key = label, children
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.labels)
            weight = 1
            for c in children:
                weight += self.weight[c]
            self.labels.append(label)
            self.children.append(children)
            self.weight.append(weight)
        return got

    def size(self, a: int, b: int) -> int:
        """Node pairs in the largest order-keeping, level-keeping alignment of two trees (simple tree matching)."""
        if a == b:
            return self.weight[a]
        if self.labels[a] != self.labels[b]:
            return 0
        got = self.known.get((a, b))
        if got is None:
            got = 1
            start, end, rows = self.table(self.children[a], self.children[b])
            for c in self.children[a][:start]:
                got += self.weight[c]
            for c in self.children[a][len(self.children[a]) - end :]:
                got += self.weight[c]
            got += rows[2]
            self.known[a, b] = got
        return got

    def table(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int, tuple[list[np.ndarray], list[np.ndarray], int]]:
        """Equal children at the start and at the end, which an optimal alignment can pair; and for those between, by rows, whether
        the best alignment up to (i, j) pairs the two, whether it is as good without a's child, and how good the best is."""
        start, most = 0, min(len(a), len(b))
        while start < most and a[start] == b[start]:
            start += 1
        end = 0
        while end < most - start and a[-1 - end] == b[-1 - end]:
            end += 1
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        best = np.zeros(len(b) + 1, np.int64)
        pairs, ups = [], []
        if a and b:
            kinds, which = np.unique(np.array(b), return_inverse=True)
            rows: dict[int, np.ndarray] = {}
            for c in a:
                if c not in rows:
                    found = []
                    for d in kinds.tolist():
                        found.append(self.size(c, d))
                    rows[c] = np.array(found, np.int64)[which]
                w = rows[c]
                through = best[:-1] + w
                now = best.copy()
                np.maximum(now[1:], through, out=now[1:])
                np.maximum.accumulate(now, out=now)
                pairs.append(np.packbits((w > 0) & (now[1:] == through)))
                ups.append(np.packbits(now[1:] == best[1:]))
                best = now
        return start, end, (pairs, ups, int(best[-1]))


def _bit(bits: np.ndarray, k: int) -> bool:
    return bool(bits[k >> 3] >> (7 - (k & 7)) & 1)


def _absorb(a: Slot, b: Slot) -> None:
    """Put b, of the same shape, into a."""
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        x.nodes += y.nodes
        pairs += list(zip(x.children, y.children))


def fold(nodes: list[Node], shapes: Shapes | None = None) -> Slot:
    """Like siblings become one repeated node: elements that come in rows wherever they stand, others next to one of the same
    label and shape; and what repeated nodes hold, by label."""
    shapes = Shapes() if shapes is None else shapes
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)  # calls of Python functions take no stack of the machine's
    slot = Slot(nodes[0].label, nodes[0].tag, nodes[0].out, nodes[0].named)
    slot.nodes = nodes
    like: dict[str, list[Node]] = {}
    order: list[Node | list[Node]] = []
    for n in nodes:
        for child in n.children:
            if len(nodes) > 1 or child.tag in ITEMS:
                if child.label not in like:
                    like[child.label] = []
                    order.append(like[child.label])
                like[child.label].append(child)
            else:
                order.append(child)
    for part in order:
        folded = fold(part if isinstance(part, list) else [part], shapes)
        if slot.children and folded.tag not in ITEMS and slot.children[-1].label == folded.label and slot.children[-1].shape == folded.shape:
            _absorb(slot.children[-1], folded)
        else:
            slot.children.append(folded)
    slot.shape = shapes.number(slot.label, tuple([c.shape for c in slot.children]))
    return slot


def match(a: Slot, b: Slot, shapes: Shapes) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the largest number of node pairs in an order-keeping, level-keeping alignment, and those pairs.

    Both are folded with these shapes. Exact at every size."""
    if a.label != b.label:
        return 0, []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        start, end, (pairs, ups, _) = shapes.table(tuple([c.shape for c in x.children]), tuple([c.shape for c in y.children]))
        todo += list(zip(x.children[:start], y.children[:start]))
        if end:
            todo += list(zip(x.children[-end:], y.children[-end:]))
        i, j = len(x.children) - start - end, len(y.children) - start - end
        while i and j:
            if _bit(pairs[i - 1], j - 1):
                i, j = i - 1, j - 1
                todo.append((x.children[start + i], y.children[start + j]))
            elif _bit(ups[i - 1], j - 1):
                i -= 1
            else:
                j -= 1
    return shapes.size(a.shape, b.shape), out


def number(slot: Slot) -> list[Slot]:
    """All nodes in page order; a node's number is its place here."""
    out, todo = [], [slot]
    while todo:
        out.append(todo.pop())
        todo += out[-1].children[::-1]
    return out


def own_text(slot: Slot, blocks: list[tuple[Node, str]]) -> str:
    return "\n".join([blocks[t][1] for n in slot.nodes for t in n.texts])


def weigh(wrapper: list[Slot], varying: dict[int, float], least: int = 1, freed: AbstractSet[int] = frozenset()) -> dict[int, float]:
    """Varying characters in each node and below it, without what is marked: by its kind, or by its names (from `least` on) and not freed.

    What stands under a mark isn't listed."""
    at = {id(s): k for k, s in enumerate(wrapper)}
    mass: dict[int, float] = {}

    seen, todo = [], [wrapper[0]]
    while todo:
        seen.append(todo.pop())
        k = at[id(seen[-1])]
        marked = seen[-1].out or seen[-1].named >= least and k not in freed
        mass[k] = 0.0 if marked else varying.get(k, 0.0)
        if not marked:
            todo += seen[-1].children
    for slot in seen[::-1]:  # children before their parents
        for c in slot.children:
            mass[at[id(slot)]] += mass.get(at[id(c)], 0.0)
    return mass


def free(wrapper: list[Slot], varying: dict[int, float], known: bool, share: float = 0.6, some: float = 0.2, nothing: float = 0.05) -> set[int]:
    """The nodes whose names don't count: those that hold a main element or `share` of what varies (lists set apart), and, if names
    leave as good as `nothing`, all that hold `some` of it. An article or main outside with `some` of it lets none beside it be freed.

    known: whether it's known what varies; if not, only nodes with an article, main or first heading in them are freed.
    """
    if not any(s.named for s in wrapper):
        return set()
    at = {id(s): k for k, s in enumerate(wrapper)}

    def below(k: int) -> list[Slot]:
        return number(wrapper[k])

    first, apart, whole = weigh(wrapper, varying), weigh(wrapper, varying, 2), weigh(wrapper, varying, 3)
    home = region(wrapper, varying)
    inside = {at[id(s)] for s in below(home)} if wrapper[home].tag in CONTENT and first[home] >= some * apart[0] > 0 else None
    freed: set[int] = set()

    def may(k: int, slot: Slot) -> bool:
        return bool(slot.named) and (inside is None or k in inside) and (known or any((s.tag in CONTENT or s.tag == "h1") and whole.get(at[id(s)], 0) > 0 for s in below(k)))

    for k, slot in enumerate(wrapper):
        if apart.get(k, 0) > 0 and apart[0] >= nothing * whole[0] and may(k, slot) and (apart[k] >= share * apart[0] or any(s.tag == "main" and apart.get(at[id(s)], 0) > 0 for s in below(k))):
            freed.add(k)
    if weigh(wrapper, varying, 1, freed)[0] < nothing * whole[0]:
        freed |= {k for k, slot in enumerate(wrapper) if whole.get(k, 0) >= some * whole[0] > 0 and may(k, slot)}
    return freed


def region(wrapper: list[Slot], varying: dict[int, float], share: float = 0.6, freed: AbstractSet[int] = frozenset()) -> int:
    """The number of the wrapper node that is the content region.

    varying: characters of varying text by node. An article or main element with varying text wins at once
    (the one with most of it, the inner one on a tie); else go down while one child holds `share` of what varies.
    """
    at = {id(s): k for k, s in enumerate(wrapper)}
    mass = weigh(wrapper, varying, 1, freed)
    named = [k for k, s in enumerate(wrapper) if s.tag in CONTENT and mass.get(k, 0) > 0]
    if named:
        return max(named, key=lambda k: (mass[k], k))
    slot = wrapper[0]
    while slot.children:
        child = max(slot.children, key=lambda c: mass.get(at[id(c)], 0.0))
        here = mass.get(at[id(slot)], 0.0)
        if not here or mass.get(at[id(child)], 0.0) < share * here or child.tag in ("p", "li", "td", "blockquote", "pre"):
            break
        slot = child
    return at[id(slot)]


#: Elements that hold prose: a node of these isn't template as a whole, its blocks are judged one by one.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt li figcaption".split())


def unmarked(slot: Slot, least: int) -> list[Slot]:
    """The article and main elements that aren't under a mark (by names from `least` on)."""
    found, todo = [], [slot]
    while todo:
        s = todo.pop()
        if not s.out and s.named < least:
            found += [s] if s.tag in CONTENT else []
            todo += s.children[::-1]
    return found


class Wrapper:
    """A host's wrapper page as nodes, and what the counts of its pages say about them."""

    def __init__(self, page: str, counts: dict[int, tuple[int, int, int, int]] | None = None, least_pages: int = 3, same_share: float = 0.9):
        self.shapes = Shapes()
        root, self.blocks = parse(page)
        self.root = fold([root], self.shapes)
        self.nodes = number(self.root)
        self.place = {id(s): k for k, s in enumerate(self.nodes)}
        self.texts = [own_text(s, self.blocks) for s in self.nodes]
        self.block_texts = list(dict.fromkeys(t for _, t in self.blocks))
        self.known_texts = frozenset(self.block_texts)
        self.size = 64 * len(self.nodes) + 2 * len(page)
        if counts is not None:
            self.learn(counts, least_pages, same_share)

    def learn(self, counts: dict[int, tuple[int, int, int, int]], least_pages: int, same_share: float) -> None:
        """counts: by node and by -1 - k for the k-th text of the wrapper page: pages that vote (count_page says which), those of them
        whose text there is the wrapper page's (that have the text), characters, and all pages. The wrapper page is one of least_pages."""
        nodes = {k: x for k, x in counts.items() if k >= 0}
        told = {k for k, (votes, same, _, _) in counts.items() if votes and votes + 1 >= least_pages and same >= same_share * votes}
        self.template = {k for k in told if k >= 0}
        if not any(c for k, (_, _, c, _) in nodes.items() if k not in self.template):  # nothing tells template from content
            self.template = set()
        self.constant = frozenset(self.block_texts[-1 - k] for k in told if k < 0)
        varying = {k: c / max(1, n) for k, (_, _, c, n) in nodes.items() if k not in self.template}
        if not any(varying.values()):  # nothing varies: every text may be content
            varying = {k: c / max(1, n) for k, (_, _, c, n) in nodes.items()}
        known = any(votes and same < votes for votes, same, _, _ in nodes.values())
        self.freed = free(self.nodes, varying, known) if varying else set()
        self.home = region(self.nodes, varying, freed=self.freed) if varying else 0

    def aligned(self, root: Node) -> tuple[Slot, list[tuple[int, Slot]]]:
        """A page's folded tree, and the wrapper nodes (by number) with the nodes of the page they are aligned with."""
        if len(self.shapes.labels) + len(self.shapes.known) > MOST_SHAPES:  # shapes of pages before: forget them
            self.shapes = Shapes()
            number_again(self.root, self.shapes)
        tree = fold([root], self.shapes)
        return tree, [(self.place[id(a)], b) for a, b in match(self.root, tree, self.shapes)[1]]

    def another_article(self, blocks: list[tuple[Node, str]], share: float = 0.6) -> bool:
        """Whether at most `share` of a page's prose is the wrapper page's too: what such pages have in common isn't their article."""
        whole = same = 0
        for node, text in blocks:
            if node.tag in PROSE and not node.out and not node.named:
                whole += len(text)
                same += len(text) if text in self.known_texts else 0
        return 0 < whole and same <= share * whole


def number_again(root: Slot, shapes: Shapes) -> None:
    for slot in number(root)[::-1]:
        slot.shape = shapes.number(slot.label, tuple([c.shape for c in slot.children]))


def main_of(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page of the wrapper's host; without one, of a page by itself."""
    root, blocks = parse(page)
    if not blocks:
        return ""
    if wrapper is None:
        tree, pairs = fold([root]), []
        start, freed, drop, constant = None, set(), set(), frozenset()
    else:
        tree, pairs = wrapper.aligned(root)
        into = dict(pairs)
        start, constant = into.get(wrapper.home), wrapper.constant
        freed = {id(b) for k, b in pairs if k in wrapper.freed}
        drop = {id(b) for k, b in pairs if k in wrapper.template and k != wrapper.home and b.tag not in CONTENT and b.tag not in PROSE and not wrapper.nodes[k].children}
    if start is None:  # no wrapper, or another layout: the page's own article or main element, or its body
        start, most = tree, -1
        for slot in unmarked(tree, 1) or unmarked(tree, 2):
            size = len(own_text(slot, blocks))
            if size > most:
                start, most = slot, size
    keep: set[int] = set()
    todo = [start]
    while todo:
        slot = todo.pop()
        if slot is not start and (slot.out or slot.named and id(slot) not in freed or id(slot) in drop):
            continue
        keep.update([t for n in slot.nodes for t in n.texts if blocks[t][1] not in constant])
        todo += slot.children
    return "\n".join([blocks[t][1] for t in sorted(keep)])


def extract(page: str, wrapper_page: str | None, counts: dict[int, tuple[int, int, int, int]], least_pages: int = 3, same_share: float = 0.9) -> str:
    """The main text of a page, given its host's wrapper page and the counts of all its pages (see Wrapper.learn)."""
    return main_of(page, None if wrapper_page is None else Wrapper(wrapper_page, counts, least_pages, same_share))


def count_page(page: str, wrapper: Wrapper, found: dict[int, list[int]]) -> None:
    """Add a page of its host to the wrapper's counts. Pages with another article than the wrapper page's vote on nodes and texts;
    on nodes also pages without prose, so that a layout of plain divisions is learnt; copies of the wrapper page have no vote."""
    root, blocks = parse(page)
    other = wrapper.another_article(blocks)
    vote = other or not any(node.tag in PROSE and not node.out and not node.named and text for node, text in blocks)
    for k, slot in wrapper.aligned(root)[1]:
        text = own_text(slot, blocks)
        got = found[k]
        got[0] += vote
        got[1] += vote and text == wrapper.texts[k]
        got[2] += len(text)
        got[3] += 1
    if other:
        here = {t for _, t in blocks}
        for k, text in enumerate(wrapper.block_texts):
            got = found[-1 - k]
            got[0] += 1
            got[1] += text in here
            got[3] += 1


def host_of(url):
    """The host of a URL column, lower case without the port; the empty one where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class Wrappers:
    """Wrappers of hosts, parsed once and remembered while they are small together."""

    def __init__(self) -> None:
        self.held: dict[tuple, Wrapper] = {}
        self.size = 0

    def __call__(self, host: str, page: str, learnt: str | None = None) -> Wrapper:
        key = host, learnt is None
        if key not in self.held:
            if self.size > HELD_BYTES:
                self.held, self.size = {}, 0
            self.held[key] = Wrapper(page, None if learnt is None else {k: tuple(x) for k, *x in json.loads(learnt)})
            self.size += self.held[key].size
        return self.held[key]


def _with_host(pages: DataFrame, by_host: DataFrame) -> tuple[DataFrame, dict[str, tuple] | None]:
    """pages, and by_host (one row a host, written) as a dict where that is small; else pages with its columns, without gathering a host's pages."""
    size = by_host.select(F.coalesce(F.sum(sum((F.octet_length(c).cast("bigint") for c, t in by_host.dtypes if t in ("string", "binary")), F.lit(0))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return pages, {r[0]: tuple(r)[1:] for r in by_host.collect()}
    salted = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt"), None


def main_text(pages: DataFrame, *, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns and `text`, the page's main text (empty if there is none).

    A null page is empty. Pages without a host are one host. Every row comes back once, repeated ones alike; other columns of pages
    play no part, and keep mustn't hold _host or _html. An empty table gives an empty result. A host has one wrapper page: pages of another
    layout than its are read by their own article or main element. From three pages on, what nearly all pages with another article have
    is template; with two, a passage that two articles share would look the same; such a host, or one of copies, has only the names to go by.
    """
    spark = pages.sparkSession
    rows = pages.select(*keep, host_of(F.col(url)).alias("_host"), F.coalesce(F.col(page), F.lit("")).alias("_html"))
    # the wrapper page: a page of middle size would be best, but any will do as long as it is the same each time
    wrappers = materialize(rows.groupBy("_host").agg(F.min_by("_html", F.struct(F.md5("_html"))).alias("_wrapper")), "wrappers")

    def parts(batches: Iterator[pa.RecordBatch], told: dict[str, tuple] | None) -> Iterator[tuple[pa.RecordBatch, int, int, list[str], list[str], list[tuple]]]:
        """(batch, from, to, pages, hosts, what is known of each row's host) in slices of rows."""
        for batch in batches:
            whole = as_string(batch.column("_html"))
            for lo, hi in row_slices(whole, 4 << 20):
                part = batch.slice(lo, hi - lo)
                hosts = part.column("_host").to_pylist()
                if told is not None:
                    own = [told[h] for h in hosts]
                else:
                    own = list(zip(*(part.column(c).to_pylist() for c in ("_wrapper", "_counts") if c in part.schema.names)))
                yield batch, lo, hi, whole.slice(lo, hi - lo).to_pylist(), hosts, own

    met, few = _with_host(rows.select("_host", "_html"), wrappers)
    told = spark.sparkContext.broadcast(few)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0]))
        known = Wrappers()
        for *_, texts, hosts, own in parts(batches, told.value):
            for text, host, (wrapper_page, *_) in zip(texts, hosts, own):
                count_page(text, known(host, wrapper_page or ""), found[host])
        keys = [(h, k) for h, x in found.items() for k in x]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), *(pa.array([found[h][k][c] for h, k in keys], pa.int64()) for c in range(4))], ["_host", "node", "votes", "same", "chars", "pages"])

    counted = met.mapInArrow(count, "_host string, node int, votes bigint, same bigint, chars bigint, pages bigint")
    counts = counted.groupBy("_host", "node").agg(*(F.sum(c).alias(c) for c in ("votes", "same", "chars", "pages")))
    by_host = counts.groupBy("_host").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("node").cast("bigint"), "votes", "same", "chars", "pages")))).alias("_counts"))  # one entry a node or text of the wrapper page
    learned = materialize(wrappers.join(by_host, "_host", "left"), "wrappers")
    met, few_learned = _with_host(rows, learned)
    told_learned = spark.sparkContext.broadcast(few_learned)
    names = [*keep, "_host", "_html", *(() if few_learned is not None else ("_wrapper", "_counts"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Wrappers()
        for batch, lo, hi, texts, hosts, own in parts(batches, told_learned.value):
            out = [main_of(text, known(host, wrapper_page or "", learnt or "[]")) for text, host, (wrapper_page, learnt) in zip(texts, hosts, own)]
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), pa.array(out, pa.string())], [*batch.schema.names[: len(keep)], "text"])

    joined = met.select(*names)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema.fields[: len(keep)])
    return joined.mapInArrow(run, fields + "text string")


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text and its number of code points (see main_text)."""
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
