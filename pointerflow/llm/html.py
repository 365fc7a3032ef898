"""Main text of web pages by wrapper induction (op6)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

#: A tag up to its end, white space and quotes as HTML takes them: a quote opens
#: a value only after "=".
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|=(?!\s*+["'])|["'])*+)>""")
#: The same without regard to quotes, for pages in which one is never closed.
BARE = re.compile(r"<(/?)([A-Za-z][^\s/><]*)([^<>]*)>?")
OPENING = re.compile(r"<(?:/?[A-Za-z]|[!?])")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Element names by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot option optgroup title summary figcaption".split())
#: What an opening tag ends when it is open in the same scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPES = frozenset("html body table ul ol dl div article section main aside nav form select".split())
#: Elements that are never part of an article.
CHROME_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu search audio video title".split())
UNSEEN = frozenset("head script style noscript template title".split())
#: Names of things beside an article, and words that go with them: a class or id
#: made of these alone, at least one of the former, names a part of the page's
#: frame ("cookie-bar", "comment_list", but not "post-header").
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer comment comments reply replies disqus share sharing social related recommended recommendations trending widget widgets toolbar pagination pager contentinfo complementary search".split()
)
PLACE_WORDS = frozenset("area bar block box container content form global group header inner item items left link links list main outer page panel posts primary right row secondary section site slot thread top bottom unit wrap wrapper".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that come in any number: like neighbours in a row are one slot.
REPEATED = frozenset("p li tr td th dt dd option h2 h3 h4 h5 h6 blockquote pre figure".split())

#: Levels of a tree; a block opened deeper takes the place of the deepest one.
DEPTH = 100
#: Children of a node beyond which all like neighbours are one slot.
CROWD = 64
#: How trees are matched, not what is found: sizes of matches held at a time, and
#: children up to which a row of them is a list.
KNOWN, NARROW = 1_000_000, 64
#: Slots of a wrapper beyond which those on few of its pages are left out.
SLOTS = 4096


class Node:
    __slots__ = ("items", "label", "linked", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.linked = tag, label, 0  # characters within links
        self.items: list = []  # strings and Nodes in page order


def _is_frame(name: str) -> bool:
    """Whether a class, id or role names a part of the page's frame."""
    words = [w.lower() for w in WORDS.findall(name)]
    return any(w in FRAME_WORDS for w in words) and all(w in FRAME_WORDS or w in PLACE_WORDS for w in words)


def framed(label: str) -> bool:
    """Whether an element of this label never belongs to an article."""
    tag, *names = label.split(".")
    return tag in CHROME_TAGS or (tag not in ("html", "body", "main") and any(map(_is_frame, names)))


def parse(html: str) -> Node:
    """The block elements of a page as a tree; inline markup joins its text.

    Missing end tags are supplied as HTML does for paragraphs, list items,
    table cells and the like; stray ones are skipped.  A tag that never ends, or
    whose quoted value never does, ends at the next ``>``, ``<`` or the page's
    end.  Reading is linear in the page's length.
    """
    root = Node("#page", "#page")
    stack = [root]
    skipped, depth_skipped = "", 0  # the inline element of the frame being left out
    links = 0
    at, end, quoted = 0, len(html), True
    while at < end:
        m = OPENING.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not skipped:
            text = unescape(text) if "&" in text else text
            stack[-1].items.append(text)
            if links:
                stack[-1].linked += len(text.strip())
        if not m:
            break
        at = m.start()
        if html[at + 1] in "!?":
            close = "-->" if html.startswith("<!--", at) else ">"
            found = html.find(close, at + 2)
            at = found + len(close) if found >= 0 else end
            continue
        tag_at = TAG.match(html, at) if quoted else None
        if not tag_at:
            quoted = False
            tag_at = BARE.match(html, at)
        at = tag_at.end()
        closing, tag, attributes = tag_at[1], tag_at[2].lower(), tag_at[3]
        if closing:
            if tag == "a":
                links = 0
            if tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        skipped, links = "", 0
                        break
            elif tag == skipped:
                depth_skipped -= 1
                skipped = skipped if depth_skipped else ""
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].items.append("\n")
            continue
        names = ["".join(a) for a in NAMES.findall(attributes)] if attributes else []
        label = ".".join([tag, *[n.replace(".", "-") for name in names for n in name.split()][:3]])
        if tag not in BLOCK:
            if tag == skipped:
                depth_skipped += 1
            elif not skipped and not attributes.endswith("/") and framed(label):
                skipped, depth_skipped = tag, 1
            links = 1 if tag == "a" else links
            continue
        skipped, depth_skipped = "", 0
        ends = {"p"} if tag in CLOSES_P else ENDS.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ends:
                del stack[depth:]
            elif stack[depth].tag in SCOPES and stack[depth].tag != tag:
                break
        if len(stack) >= DEPTH:
            stack.pop()
        node = Node(tag, label)
        stack[-1].items.append(node)
        stack.append(node)
    return root


# A wrapper node is [label, pages, digest, children, chars, linked]: pages that
# have the slot, a digest of its own text (0: it varies), children in page order,
# characters of its own text on all pages and those of them within links.


def wrapper_of(node: Node) -> list:
    """A page's tree as a wrapper of one page."""
    text = "".join(x if isinstance(x, str) else " " for x in node.items).split()
    own = " ".join(text)
    return [node.label, 1, xxhash.xxh64_intdigest(own) >> 2 | 1, _slot_trees([x for x in node.items if isinstance(x, Node)]), len(own), node.linked]


def _numbered(nodes: list[Node]) -> list[int]:
    """The number of each child's slot: like neighbours in a row may share one."""
    out: list[int] = []
    for k, x in enumerate(nodes):
        shared = k and nodes[k - 1].label == x.label and (x.tag in REPEATED or len(nodes) > CROWD)
        out.append(out[-1] + (not shared) if out else 0)
    return out


def _slot_trees(nodes: list[Node]) -> list[list]:
    """The slots of a node's children, each a wrapper of one page."""
    out: list[list] = []
    for x, number in zip(nodes, _numbered(nodes)):
        child = wrapper_of(x)
        if number < len(out):
            first = out[-1]
            _merge_into(first, child, 0)
            first[2] = _joint(first[2], child[2])
            first[4] += child[4]
            first[5] += child[5]
        else:
            out.append(child)
    return out


def _joint(a: int, b: int) -> int:
    return xxhash.xxh64_intdigest(f"{a},{b}") >> 2 | 1


class Shapes:
    """Trees known by their shape, the labels all the way down.

    What two shapes have in common is worked out once, however many trees have
    them.  Nodes are known by identity, so a tree must not change before it is
    matched.
    """

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.children: list[tuple] = []
        self.nodes: list[int] = []
        self.known: dict[int, tuple[int, list]] = {}
        self.common: dict[tuple[int, int], int] = {}

    def of(self, w: list) -> int:
        """The number of a tree's shape."""
        n, _ = self.known.get(id(w), (-1, w))
        if n < 0:
            children = tuple(map(self.of, w[3]))
            n = self.number.setdefault((w[0], children), len(self.label))
            if n == len(self.label):
                self.label.append(w[0])
                self.children.append(children)
                self.nodes.append(1 + sum(self.nodes[c] for c in children))
            self.known[id(w)] = n, w
        return n

    def size(self, s: int, t: int) -> int:
        """Nodes that the best match of two trees has in common."""
        if s == t:
            return self.nodes[s]
        if self.label[s] != self.label[t]:
            return 0
        a, b = self.children[s], self.children[t]
        if not a or not b:
            return 1
        found = self.common.get((s, t))
        if found is None:
            found = 1 + self._best(a, b)
            if len(self.common) >= KNOWN:
                self.common.clear()
            self.common[s, t] = found
        return found

    def _best(self, a: tuple, b: tuple) -> int:
        i, x, y = 0, len(a), len(b)
        while i < x and i < y and a[i] == b[i]:  # like ends belong together
            i += 1
        while i < x and i < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        alike = sum(self.nodes[c] for c in (*a[:i], *a[x:]))
        if i == x or i == y:
            return alike
        row, add = self.rows(a[i:x])
        for c in b[i:y]:
            row = add(row, c)
        return alike + int(row[-1])

    def rows(self, a: tuple | list) -> tuple:
        """The table of best matches with the first i trees of ``a``, a row for
        each tree of the other list: its first row, and what makes the next one."""
        places: dict[str, list[int]] = {}
        for i, s in enumerate(a):
            places.setdefault(self.label[s], []).append(i)
        if len(a) <= NARROW:

            def short(before: list, t: int) -> list:
                sizes = [0] * len(a)
                for i in places.get(self.label[t], ()):
                    sizes[i] = self.size(a[i], t)
                row = [0]
                for i, n in enumerate(sizes):
                    row.append(max(before[i + 1], row[i], before[i] + n))
                return row

            return [0] * (len(a) + 1), short
        shapes = {label: (np.array(where), *np.unique([a[i] for i in where], return_inverse=True)) for label, where in places.items()}

        def long(before: np.ndarray, t: int) -> np.ndarray:
            sizes = np.zeros(len(a), np.int32)
            if self.label[t] in shapes:
                where, different, which = shapes[self.label[t]]
                sizes[where] = np.array([self.size(s, t) for s in different.tolist()], np.int32)[which]
            row = before.copy()
            np.maximum(row[1:], before[:-1] + sizes, out=row[1:])
            return np.maximum.accumulate(row)

        return np.zeros(len(a) + 1, np.int32), long


def _label_rows(a: list[str]) -> tuple:
    """The same where only labels count, a row being the bits of a number: 0
    where it grows (Hyyro's form of the longest common subsequence)."""
    places: dict[str, list[int]] = {}
    for i, label in enumerate(a):
        places.setdefault(label, []).append(i)
    masks: dict[str, int] = {}

    def mask(label: str) -> int:
        if label not in masks:
            if len(masks) * len(a) >= 64 * KNOWN:
                masks.clear()
            bits = bytearray((len(a) >> 3) + 1)
            for i in places.get(label, ()):
                bits[i >> 3] |= 1 << (i & 7)
            masks[label] = int.from_bytes(bits, "little")
        return masks[label]

    full = (1 << len(a)) - 1

    def add(before: int, label: str) -> int:
        hit = before & mask(label)
        return ((before + hit) | (before - hit)) & full

    return full, add


def _blocks(b: list, first: object, add: Callable) -> Iterator[tuple[int, list]]:
    """Rows of the table in blocks, the last block first: a block's number of
    rows before it and its rows, with the one before.  About twice the square
    root of all rows is held at a time."""
    many = max(64, isqrt(len(b)) + 1)
    last = (len(b) - 1) // many * many
    kept, row = [first], first
    for k in range(last):
        row = add(row, b[k])
        if (k + 1) % many == 0:
            kept.append(row)
    for low in range(last, -1, -many):
        rows = [kept.pop()]
        for t in b[low : low + many]:
            rows.append(add(rows[-1], t))
        yield low, rows


def tree_match(a: list, b: list, shapes: Shapes | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of subtrees: which pairs of children
    the best order-preserving match takes, of any number of children."""
    s, t = [x[0] for x in a], [y[0] for y in b]
    if s == t and len(set(s)) == len(s):
        return [(i, i) for i in range(len(s))]
    alone = not any(x[3] for x in a) or not any(y[3] for y in b)  # labels are all there is
    if not alone:
        shapes = shapes or Shapes()
        s, t = list(map(shapes.of, a)), list(map(shapes.of, b))
    same = 0
    while same < len(s) and same < len(t) and s[same] == t[same]:  # like beginnings belong together
        same += 1
    s, t = s[same:], t[same:]
    pairs: list[tuple[int, int]] = []
    if s and t:
        i = len(s)
        for low, rows in _blocks(t, *(_label_rows(s) if alone else shapes.rows(s))):
            if alone:
                rows = [r.to_bytes((len(s) >> 3) + 1, "little") for r in rows]
            j = len(rows) - 1
            while i and j:
                row, before = rows[j], rows[j - 1]
                at, bit = i - 1 >> 3, i - 1 & 7
                if (row[at] >> bit & 1) if alone else row[i] == row[i - 1]:
                    i -= 1
                elif not (before[at] >> bit & 1) if alone else row[i] == before[i]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((same + i, same + low + j))
            if not i:
                break
    return [(i, i) for i in range(same)] + pairs[::-1]


def _match_size(x: list, y: list) -> int:
    """Nodes that the best match of two trees has in common."""
    shapes = Shapes()
    return shapes.size(shapes.of(x), shapes.of(y))


def _merge_into(a: list, b: list, pages: int, shapes: Shapes | None = None) -> None:
    """Align ``b`` with ``a``; unmatched children are put in where they stand."""
    shapes = shapes or Shapes()
    pairs = tree_match(a[3], b[3], shapes)
    partner = {j: i for i, j in pairs}
    for i, j in pairs:
        merge(a[3][i], b[3][j], pages, shapes)
    if len(pairs) < len(b[3]):
        merged, used = [], 0
        for j, child in enumerate(b[3]):
            if j in partner:
                merged += a[3][used : partner[j] + 1]
                used = partner[j] + 1
            else:
                merged.append(child)
        a[3] = merged + a[3][used:]


def merge(a: list, b: list, pages: int = 1, shapes: Shapes | None = None) -> list:
    """Wrapper of the pages of both; a slot's text stays constant if equal."""
    a[1] += b[1] * pages
    a[4] += b[4]
    a[5] += b[5]
    if pages:
        a[2] = a[2] if a[2] == b[2] else 0
    _merge_into(a, b, pages, shapes)
    return a


def _count(w: list) -> int:
    return 1 + sum(map(_count, w[3]))


def pruned(w: list, share: float = 1 / 64) -> list:
    """``w`` without slots on less than ``share`` of its pages, if it has very
    many.  Extraction keeps all slots, as what a cut leaves depends on how many
    pages were merged before it; this is for wrappers that are kept for show."""

    def cut(x: list) -> None:
        x[3] = [c for c in x[3] if c[1] >= share * w[1]]
        for c in x[3]:
            cut(c)

    if _count(w) > SLOTS:
        cut(w)
    return w


def host_of(url: Column) -> Column:
    """Host of a URL, its letters A-Z lower-cased; no scheme: empty."""
    rest = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def induce_wrappers(pages: DataFrame, html_col: str = "html", flush: int = 500) -> DataFrame:
    """host, wrapper (JSON) learnt from all pages of the host.

    ``pages`` has ``host`` and the html.  A task merges its pages into one
    wrapper a host before anything is shuffled; those are merged in groups of
    tasks and then by host, so a host with a third of all pages costs one row a
    task.  All slots stay: a wrapper grows with the different slots of its host.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        salt = TaskContext.get().partitionId() % 64

        def out() -> pa.RecordBatch:
            hosts = list(found)
            rows = pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "salt": pa.array([salt] * len(hosts), pa.int32()), "wrapper": pa.array([json.dumps(found[h]) for h in hosts], pa.string())})
            found.clear()
            return rows

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = wrapper_of(parse(html or ""))
                found[host] = merge(found[host], tree) if host in found else tree
            if len(found) >= flush:
                yield out()
        if found:
            yield out()

    def join(g: pd.DataFrame) -> pd.DataFrame:
        wrappers = sorted(g["wrapper"])
        whole = json.loads(wrappers[0])
        for w in wrappers[1:]:
            merge(whole, json.loads(w))
        return pd.DataFrame({"host": [g["host"].iloc[0]], "salt": [int(g["salt"].iloc[0])], "wrapper": [json.dumps(whole)]})

    parts = map_batches(pages.select("host", html_col), partial, "host string, salt int, wrapper string")
    parts = parts.groupBy("host", "salt").applyInPandas(join, "host string, salt int, wrapper string")
    return parts.groupBy("host").applyInPandas(join, "host string, salt int, wrapper string").select("host", "wrapper")


#: What becomes of a slot: left out, on the way to the content, content.
DROP, WAY, CONTENT = 0, 1, 2
#: Odds that an element marked as the article or main part on all pages holds
#: the content; less, if it is marked on some.
MARKED = 16


def _tag(w: list) -> str:
    return w[0].split(".")[0]


def content_slots(wrapper: list, share: float = 0.5, linked: float = 0.5, most: float = 0.7) -> list:
    """[label, what, weight, children, chars, linked, usual, trees] of each slot of
    a host, usual ones being those of ``share`` of its pages; trees are the
    wrapper's children, by which a page's are told.

    Template is a slot equal on two pages or more, those being ``share`` of the
    host's; a list or division whose text is mostly within links is a menu.  Of
    what is left the content is the slot that ``_chosen`` finds.

    A host whose pages, or article whose texts, are all alike have no varying
    slot to tell content by, so nothing of them is template.
    """
    total = wrapper[1]

    def varies(w: list) -> bool:
        return not w[2] or any(map(varies, w[3]))

    def marks(w: list, alike: bool, within: bool) -> list:
        tag = _tag(w)
        article = tag in ARTICLE
        alike, within = alike or (article and not varies(w)), within or article
        usual = w[1] >= share * total
        constant = w[2] and not alike and not article and usual and w[1] > 1 and not any(map(varies, w[3]))
        if constant or framed(w[0]):
            return [w[0], DROP, 0, [], 0, 0, usual, []]
        children = [marks(c, alike, within) for c in w[3]]
        weight, chars, links = (own + sum(c[i] for c in children) for i, own in ((2, w[4]), (4, w[4]), (5, w[5])))
        if links > linked * chars and not article and tag not in REPEATED and tag not in HEADINGS:
            return [w[0], DROP, 0, [], 0, 0, usual, []]
        if tag == "header" and not within:  # the page's: at most a heading of it counts
            return [w[0], WAY, 0, children, 0, 0, usual, w[3]]
        odds = 1 + (MARKED - 1) * min(1, w[1] / total) if article else 1
        return [w[0], WAY, weight * odds, children, chars, links, usual, w[3]]

    def whole(w: list) -> None:
        if w[1] != DROP and w[2]:
            w[1] = CONTENT
            for c in w[3]:
                whole(c)

    out = marks(wrapper, not varies(wrapper), False)
    for w in _chosen(out, most):
        whole(w)
    return out


def _chosen(w: list, most: float) -> list[list]:
    """The deepest slot that holds ``most`` of the weight of each slot above it,
    articles weighing up to MARKED times their text; or the articles side by side
    that hold it together.

    An article is left for one within it only, and a slot with paragraphs of its
    own (a hundredth of its text) is not left, as they belong to what follows.
    """

    def articles(x: list) -> list[list]:
        return [x] if _tag(x) in ARTICLE else [a for c in x[3] for a in articles(c)]

    while True:
        inner = [a for c in w[3] for a in articles(c)]
        if _tag(w) in ARTICLE and sum(a[4] for a in inner) < most * w[4]:
            return [w]
        if not inner and sum(c[4] for c in w[3] if _tag(c) in ("p", "blockquote", "pre")) * 100 > w[4]:
            return [w]
        best = max(w[3], key=lambda c: c[2], default=None)
        if best is not None and w[2] and best[2] >= most * sum(c[2] for c in w[3]):
            w = best
            continue
        beside = [c for c in w[3] if _tag(c) in ARTICLE]
        return beside if beside and sum(c[2] for c in beside) >= most * sum(c[2] for c in w[3]) else [w]


def main_text(root: Node, slots: list | None) -> str:
    """Text of a page's content slots; without slots, all that a reader sees.

    A page that has none of the host's content slots, or more text in slots that
    few of the host's pages have, is told by itself.
    """
    if slots:
        found, told = _content(root, slots)
        return found if told or not root.items else _content(root, content_slots(wrapper_of(root)))[0]
    out: list[str] = []

    def walk(node: Node) -> None:
        out.append(" ")
        for x in node.items:
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in UNSEEN:
                walk(x)
        out.append(" ")

    walk(root)
    return " ".join("".join(out).split())


def _content(root: Node, slots: list) -> tuple[str, bool]:
    """Text in content slots, and whether they tell the page.

    If it has no first heading, one that stands before it is put in front.
    """
    out: list[str] = []
    title: list[str] = []
    other: list[str] = []  # in slots that are not usual
    met = headed = False
    shapes = Shapes()

    def walk(node: Node, slot: list | None, trees: list | None, inside: bool, to: list[str] | None) -> None:
        nonlocal met, headed
        here = inside if slot is None else slot[1] == CONTENT
        if here:
            met, to = True, out
            headed = headed or node.tag == "h1"
        elif node.tag == "h1" and not met and not title:
            to = title
        elif to is None and not (slot and slot[6]):
            to = other
        match = _slots_of([x for x in node.items if isinstance(x, Node)], slot, trees, shapes)
        place = 0
        if to is not None:
            to.append(" ")
        for x in node.items:
            if isinstance(x, str):
                if to is not None:
                    to.append(x)
                continue
            its, its_trees = match[place]
            place += 1
            if its[1] != DROP if its else not framed(x.label):
                walk(x, its, its_trees, here, to)
        if to is not None:
            to.append(" ")

    walk(root, slots, None, False, None)
    told = met and len("".join("".join(out).split())) >= len("".join("".join(other).split()))
    return " ".join("".join(out if headed else [*title, *out]).split()), told


def _slots_of(children: list[Node], slot: list | None, trees: list | None, shapes: Shapes) -> list[tuple]:
    """The slot of each child, by the same matching that made the wrapper, and
    the child's own slots where that needed them.  ``trees`` are the children's
    slots, if known."""
    if not slot or not slot[3] or not children:
        return [(None, None)] * len(children)
    number = _numbered(children)
    labels = [x.label for k, x in enumerate(children) if not k or number[k] != number[k - 1]]
    if labels == [w[0] for w in slot[7]] and len(set(labels)) == len(labels):
        return [(slot[3][k], None) for k in number]
    trees = trees or _slot_trees(children)
    partner = {j: slot[3][i] for i, j in tree_match(slot[7], trees, shapes)}
    many = Counter(number)  # a slot of several is no child's own
    return [(partner.get(k), trees[k][3] if many[k] == 1 else None) for k in number]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    The wrapper of its host tells a page's content.  Null or empty html gives
    the empty text; null urls, and urls without ``://``, share the empty host;
    repeated rows are extracted each; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col).cast("string")).alias("host"))
    wrappers = saved(induce_wrappers(rows), "wrappers")
    names = ["page_id", "url", "text", "n_chars"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper and wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[wrapper] = content_slots(json.loads(wrapper))
                texts.append(main_text(parse(html), known.get(wrapper)) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=names)

    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = dict(rows.dtypes)["page_id"]
    return map_batches(joined, extract, f"page_id {kind}, url string, text string, n_chars long")
