"""A forgiving HTML tree, its skeleton of blocks, and wrappers aligned by simple tree matching.

Nothing here recurses, so a page may nest as deep as it likes.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of the values, up to the nearest of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
SCOPE = frozenset("ul ol dl table select article section div nav aside main body html".split())
ENDS_P = BLOCK - {"br", "body", "html", "option"}
#: Elements within a line; they are part of their block's text, not of the skeleton.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: As browsers read tags: a quote opens a value only behind an equals sign, anywhere else it is a character like others.
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?>\s*(?:\"[^\"]*\"|'[^']*')?))*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)


class Node:
    """An element; text stands among the children as str."""

    __slots__ = ("attributes", "children", "named", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.named = tag, attributes, [], None

    def attribute(self, *names: str) -> str:
        if not self.attributes:
            return ""
        if self.named is None:
            self.named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attributes)}
        found = self.named
        return " ".join(found[n] or n for n in names if n in found)


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and misnested tags are mended as browsers do in the common cases; raw elements hold text only."""
    root = Node("#root")
    stack, opened = [root], Counter()
    at, n = 0, len(page)
    lower = None

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is not None:
            stack[-1].children.append(m[2])
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        closes = ENDS.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        if any(opened[c] for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    close(i)
                    if tag not in ("tbody", "tfoot", "tr"):
                        break
                elif stack[i].tag in SCOPE and not (tag in ("tr", "td", "th", "tbody", "tfoot") and stack[i].tag in ("div", "section")):
                    break
        node = Node(tag, m[5])
        stack[-1].children.append(node)
        if tag in RAW and not m[5].endswith("/"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == n else -1
            end = n if end < 0 else end
            node.children.append(page[at:end])
            after = page.find(">", end)
            at = n if after < 0 else after + 1
        elif tag not in VOID and not m[5].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


class Slot:
    """A skeleton node: a block, or a run of neighbouring sibling blocks of one shape, or every other of a run like dt dd dt dd.

    text: a digest of all that stands in it; own and links: code points of its text outside blocks within, and of these in links.
    """

    __slots__ = ("children", "label", "links", "nodes", "own", "shape", "size", "text")

    def __init__(self, label: str, nodes: list[Node], flag=None):
        """The skeleton of a page; flag(node) marks the label of an element that says it is no article text."""
        self._bare(label, nodes)
        _build(self, flag or (lambda node: False))

    def _bare(self, label: str, nodes: list[Node]) -> Slot:
        self.label, self.nodes, self.children = label, nodes, []
        self.own = self.links = 0
        self.text = self.shape = b""
        self.size = 1
        return self

    def walk(self) -> list[Slot]:
        """The slot and all within, each before what it holds."""
        out, stack = [], [self]
        while stack:
            slot = stack.pop()
            out.append(slot)
            stack.extend(reversed(slot.children))
        return out


    def add(self, other: Slot) -> None:
        """Take in a slot of the same shape."""
        for x, y in zip(self.walk(), other.walk(), strict=True):
            x.nodes += y.nodes
            x.own += y.own
            x.links += y.links
            x.text = hashlib.blake2b(x.text + y.text, digest_size=8).digest()


def _build(top: Slot, flag) -> None:
    """Fill the slots within, from the leaves up."""
    order, stack = [], [top]
    while stack:
        slot = stack.pop()
        order.append(slot)
        digest = hashlib.blake2b(digest_size=8)
        todo = [(c, False) for node in reversed(slot.nodes) for c in reversed(node.children)]
        while todo:
            child, linked = todo.pop()
            if isinstance(child, str):
                digest.update(child.encode("utf-8", "surrogatepass"))
                n = len(child) - child.count(" ")
                slot.own += n
                slot.links += n * linked
            elif child.tag in INLINE:
                todo.extend((c, linked or child.tag == "a") for c in reversed(child.children))
            else:
                slot.children.append(Slot.__new__(Slot)._bare(label_of(child) + ("!" if flag(child) else ""), [child]))
        slot.text = digest.digest()
        stack.extend(slot.children)
    for slot in reversed(order):
        digest = hashlib.blake2b(slot.text, digest_size=8)
        for c in slot.children:
            digest.update(c.text)
        slot.text = digest.digest()
        slot.children = _folded(slot.children)
        shape = hashlib.blake2b(slot.label.encode("utf-8", "surrogatepass"), digest_size=8)
        for c in slot.children:
            shape.update(c.shape)
            slot.size += c.size
        slot.shape = shape.digest()


def _folded(found: list[Slot]) -> list[Slot]:
    """Sibling slots, where a run of shapes with a period of at most four becomes one slot for each shape of the period."""
    out: list[Slot] = []
    at, n = 0, len(found)
    while at < n:
        for period in (1, 2, 3, 4):
            end = at + period
            while end < n and found[end].shape == found[end - period].shape:
                end += 1
            if end - at >= period * (2 if period == 1 else 3):
                break
        else:
            period, end = 1, at + 1
        for k in range(at + period, end):
            found[at + (k - at) % period].add(found[k])
        out += found[at : at + period]
        at = end
    return out


def label_of(node: Node) -> str:
    """Tag with class and id, digits dropped, so that numbered siblings are alike."""
    return f"{node.tag}.{re.sub(r'[0-9]+', '', node.attribute('class', 'id'))}" if node.attributes else node.tag


class Template:
    """A wrapper node: a label and what stands within."""

    __slots__ = ("children", "label", "shape", "size")

    def __init__(self, label: str):
        self.label = label
        self.children: list[Template] = []
        self.shape, self.size = b"", 1

    walk = Slot.walk

    def pack(self) -> list:
        """The tree as a flat list in the order of walk(), each node with the place of its parent."""
        return packed(self)

    @classmethod
    def unpack(cls, rows: list) -> Template:
        nodes: list[Template] = []
        for parent, label, *_ in rows:
            nodes.append(cls(label))
            if parent >= 0:
                nodes[parent].children.append(nodes[-1])
        nodes[0].measure()
        return nodes[0]

    def measure(self) -> int:
        """Bring size and shape up to date; the number of nodes."""
        for t in reversed(self.walk()):
            shape = hashlib.blake2b(t.label.encode("utf-8", "surrogatepass"), digest_size=8)
            t.size = 1
            for c in t.children:
                shape.update(c.shape)
                t.size += c.size
            t.shape = shape.digest()
        return self.size


def packed(top, *of) -> list:
    """A Slot or Template tree as a flat list in the order of walk(): the place of the parent, the label, and what the functions give."""
    nodes = top.walk()
    place = {id(t): k for k, t in enumerate(nodes)}
    parent = {id(c): place[id(t)] for t in nodes for c in t.children}
    return [[parent.get(id(t), -1), t.label, *[f(t) for f in of]] for t in nodes]


def match(a, b, memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of one label, whose size and shape are known: the size of the largest top-down
    order-preserving matching, and which children it pairs. memo holds the answers for pairs of nodes."""
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (id(x), id(y)) in memo:
            stack.pop()
            continue
        low, high = _alike(x, y)
        at: dict[str, list[int]] = {}
        for j in range(low, len(y.children) - high):
            at.setdefault(y.children[j].label, []).append(j)
        rows = [(i, at[x.children[i].label]) for i in range(low, len(x.children) - high) if x.children[i].label in at]
        todo = [
            (c, d) for i, js in rows if (c := x.children[i]).children for j in js if (d := y.children[j]).children and c.shape != d.shape and (id(c), id(d)) not in memo
        ]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()

        def weight(i: int, j: int, x=x, y=y) -> int:
            c, d = x.children[i], y.children[j]
            return c.size if c.shape == d.shape else memo[id(c), id(d)][0] if c.children and d.children else 1

        total, pairs = _heaviest(rows, weight)
        m, n = len(x.children), len(y.children)
        same = [(k, k) for k in range(low)], [(m - high + k, n - high + k) for k in range(high)]
        total += sum(x.children[i].size for part in same for i, _ in part)
        memo[id(x), id(y)] = 1 + total, [*same[0], *pairs, *same[1]]
    return memo[id(a), id(b)]


def _alike(x, y) -> tuple[int, int]:
    """How many children at either end have one shape in turn; some largest matching pairs these."""
    m, n = len(x.children), len(y.children)
    low = 0
    while low < min(m, n) and x.children[low].shape == y.children[low].shape:
        low += 1
    high = 0
    while high < min(m, n) - low and x.children[m - 1 - high].shape == y.children[n - 1 - high].shape:
        high += 1
    return low, high


def _heaviest(rows: list[tuple[int, list[int]]], weight) -> tuple[int, list[tuple[int, int]]]:
    """The chain of pairs (i, j), rising in both, with the largest weight; rows: for rising i the j it may go with, rising too.

    ends, sums and tips hold the chains worth keeping: for every last j the heaviest, both rising. A chain is a link to the one it
    extends, so what is not worth keeping is let go.
    """
    ends: list[int] = []
    sums: list[int] = []
    tips: list[tuple] = []
    for i, js in rows:
        for j in reversed(js):  # by falling j, so that none extends another of the same i
            k = bisect_left(ends, j)
            w = weight(i, j)
            total, before = (sums[k - 1] + w, tips[k - 1]) if k else (w, None)
            if k < len(ends) and ends[k] == j and sums[k] >= total:
                continue
            z = k
            while z < len(ends) and sums[z] <= total:
                z += 1
            ends[k:z], sums[k:z], tips[k:z] = [j], [total], [(i, j, before)]
    chain, tip = [], tips[-1] if tips else None
    while tip:
        chain.append(tip[:2])
        tip = tip[2]
    return sums[-1] if sums else 0, chain[::-1]


def align(template: Template, other, grow: bool) -> list[tuple[Template, object]]:
    """Pairs of template nodes and the nodes of other (a Slot or Template tree) that match them; with grow, what has no
    match is inserted where it stands."""
    for x in (template, other):
        if isinstance(x, Template):
            x.measure()
    memo, out, stack = {}, [], [(template, other)]
    while stack:
        t, o = stack.pop()
        out.append((t, o))
        pairs = {j: i for i, j in match(t, o, memo)[1]}
        children, shift, last = list(t.children), 0, 0
        for j, child in enumerate(o.children):
            if j in pairs:
                stack.append((children[pairs[j]], child))
                last = pairs[j] + shift + 1
            elif grow:
                new = Template(child.label)
                fresh = [(new, child)]
                while fresh:
                    made, source = fresh.pop()
                    out.append((made, source))
                    made.children = [Template(c.label) for c in source.children]
                    fresh.extend(zip(made.children, source.children, strict=True))
                t.children.insert(last, new)
                shift, last = shift + 1, last + 1
    return out
