"""HTML extraction by wrapper induction.

1. Every page is parsed once into the skeleton of its blocks: labels, digests of their texts, lengths.
2. The wrapper of a host is the alignment, by simple tree matching, of the skeletons of its most frequent shapes, most frequent first. It is the same
   for any order or partitioning of the pages, and does not grow with them.
3. All pages are aligned to their host's wrapper, and Spark sums for each wrapper node on how many pages it is, the smallest and the largest
   digest of its text there, and how much text and linked text it held. A node with one digest on most pages is template, the others vary.
4. The content's place is where varying text is: the article or main element if the wrapper has one with any, else down from the root as long as only
   one block holds paragraphs or headings. A page's text is what stands at that place, less template and less elements that say by tag, role, class or
   id that they are no article (menus, headers, footers, sidebars, notices, adverts, forms, comments). Only where a host has too few different
   pages to tell, or a page lacks the place, does the page's own article or main element, or else its body, take its part.

A node that is template is on more than half of a host's pages, so that none of SHAPES shapes has it is next to impossible; it would stay in the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .dom import BLOCK, Node, Slot, Template, align, packed, parse

#: Page shapes of a host that its wrapper is made of.
SHAPES = 64
#: Pages, and different pages, that a node must be on before it can be template.
LEAST_PAGES = 3
BROADCAST_BYTES = 32 << 20
HOSTS_HELD = 2000
#: Alignments (by host and shape) and sums that a task holds before it lets them go.
PLANS_HELD, SUMS_HELD = 5000, 100_000
DROPPED_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea input label iframe object embed svg canvas math audio video dialog menu link meta title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids, split at anything but letters, that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disqus "
    "dropdown footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted "
    "promotion related recommended respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets adsbygoogle".split()
)
#: Words that may stand beside these in one class name ("comment-list"); any other ("share-price") makes it say something else.
NEUTRAL_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons center col column container content entries entry form global google group holder icon icons inner input item items "
    "js left link links list main mobile module outer page panel post posts primary reader readers right row secondary section site slot sticky story stories the thread top unit user users wrap wrapper".split()
)
#: Elements that hold lines of text; the content's place is never one of them, and constant ones between varying ones stay.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th caption figcaption summary ul ol dl table tbody tr br hr address figure".split())


def is_boilerplate(node: Node, inside: bool) -> bool:
    """True if the element itself says that it is no article text; inside: it stands in an article or main element."""
    if node.tag in DROPPED_TAGS:
        return True
    if node.tag == "header" and not inside:
        return True
    if not node.attributes:
        return False
    if DROPPED_ROLES.intersection(node.attribute("role").lower().split()):
        return True
    if node.attribute("hidden") or node.attribute("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", node.attribute("style")):
        return True
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and any({"comment", "comments", "related", "promo", "ad"}.intersection(t) for t in _tokens(node))
    tokens = _tokens(node)
    return any(DROPPED_WORDS.intersection(t) and all(w in DROPPED_WORDS or w in NEUTRAL_WORDS or len(w) == 1 for w in t) and not (inside and node.tag == "header" and t == ["header"]) for t in tokens)


def _tokens(node: Node) -> list[list[str]]:
    """The words of each class name and id."""
    return [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in node.attribute("class", "id").split()]


def _blocks_of(top: Node, left_out: set[int], inside: bool) -> list[str]:
    """The text of an element, block by block."""
    blocks: list[list[str]] = [[]]
    todo: list = [(top, inside)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            blocks[-1].append(node)
        elif node is not top and (id(node) in left_out or is_boilerplate(node, inside)):
            if node.tag in BLOCK:
                blocks.append([])
        else:
            inside = inside or node.tag in ("article", "main")
            if node.tag in BLOCK and node is not top:
                blocks.append([])
                todo.append((None, False))
            todo.extend((c, inside) for c in reversed(node.children))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return [x for x in lines if x]


def _containers(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag, main also by its role."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and node.tag == tag or (tag == "main" and node.attribute("role") == "main"):
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str) and not is_boilerplate(c, False))
    return out


def by_elements(root: Node, left_out: set[int]) -> str:
    """The text of the longest article element, else of main, else of the whole page but what is left out."""
    for tag in ("article", "main"):
        found = [_blocks_of(x, set(), True) for x in _containers(root, tag)]
        if found and (len(found) == 1 or any(found)):
            return "\n".join(max(found, key=lambda blocks: sum(map(len, blocks))))
    return "\n".join(_blocks_of(root, left_out, False))


class Wrapper:
    """What a host's wrapper says: which of its nodes are template, and where the content is (None where there are too few pages to tell)."""

    def __init__(self, top: Template, sums: dict[int, tuple[int, bytes, bytes, int, int]], different: int):
        """sums: of each node, by its place: pages, smallest and largest digest, code points of its own text, those in links."""
        self.top, self.plans, nodes = top, {}, top.walk()
        place = {id(t): k for k, t in enumerate(nodes)}
        seen = lambda t: sums.get(place[id(t)], (0, b"", b"", 0, 0))
        pages = seen(top)[0]
        self.known = pages >= LEAST_PAGES and different >= LEAST_PAGES
        self.template: dict[int, bytes] = {}
        self.place, self.chosen = None, set()
        if not self.known:
            return
        self.template = {id(t): seen(t)[1] for t in nodes if t is not top and seen(t)[1] == seen(t)[2] and seen(t)[0] >= LEAST_PAGES and seen(t)[0] > pages // 2}
        mass, textual, article = {}, {}, {}
        for t in reversed(nodes):
            if id(t) in self.template or t.label.endswith("!"):
                mass[id(t)] = textual[id(t)] = article[id(t)] = 0
                continue
            _, _, _, own, links = seen(t)
            mass[id(t)] = max(0, own - links) + sum(mass[id(c)] for c in t.children)
            textual[id(t)] = bool(mass[id(t)]) and (tag_of(t) in TEXT_TAGS or any(textual[id(c)] for c in t.children))
            article[id(t)] = bool(mass[id(t)]) and (2 if tag_of(t) == "article" else max([int(tag_of(t) == "main"), *[article[id(c)] for c in t.children]]))
        self.place = self._descend(top, seen, mass, textual, article) if mass[id(top)] else None

    def _descend(self, place: Template, seen, mass, textual, article) -> Template:
        while tag_of(place) != "article":
            kids = [c for c in place.children if mass[id(c)]]
            best = max((article[id(c)] for c in kids), default=0)
            if best and not (best == 1 and tag_of(place) == "main"):
                kids = [c for c in kids if article[id(c)] == best]
            elif any(textual[id(c)] for c in kids):
                kids = [c for c in kids if textual[id(c)]]
            _, _, _, own, links = seen(place)
            bare = max(0, own - links) and not best
            if bare or len(kids) != 1 or tag_of(kids[0]) in TEXT_TAGS or (tag_of(place) == "main" and tag_of(kids[0]) != "article" and best < 2):
                self.chosen = set() if bare else {id(c) for c in kids}
                break
            place = kids[0]
        return place

    def plan(self, page: Slot, slots: list[Slot]) -> tuple[list[int], list[tuple[int, bytes]], list[int]]:
        """Numbers of the page's slots at the content's place, of those that may be template, with what that holds, and of the chosen blocks."""
        if page.shape not in self.plans:
            if len(self.plans) >= PLANS_HELD:
                self.plans.clear()
            index = {id(s): k for k, s in enumerate(slots)}
            pairs = align(self.top, page, False)
            self.plans[page.shape] = [index[id(s)] for t, s in pairs if t is self.place], [(index[id(s)], self.template[id(t)]) for t, s in pairs if id(t) in self.template], [index[id(s)] for t, s in pairs if id(t) in self.chosen]
        return self.plans[page.shape]


def tag_of(x: Template | Slot) -> str:
    return x.label.partition(".")[0].rstrip("!")


def extract(root: Node, wrapper: Wrapper | None) -> str:
    """The text of a page."""
    if wrapper is None or not wrapper.known:
        return by_elements(root, set())
    page = Slot("#root", [root], says_no)
    slots = page.walk()
    places, constants, chosen = wrapper.plan(page, slots)
    constant = {k for k, text in constants if slots[k].text == text}
    frames = ("html", "body", "article", "main")
    if not places or places[0] in constant:
        return by_elements(root, {id(n) for k in constant for n in slots[k].nodes if tag_of(slots[k]) not in frames})
    place = slots[places[0]]
    own = place.walk()
    number = {id(s): k for k, s in enumerate(slots)}
    if tag_of(place) in ("article", "main"):
        # Template may stand within an article, but a heading or a paragraph that all its articles have is theirs.
        texts: set[int] = set()
        for s in own:  # each before what it holds
            if tag_of(s) in TEXT_TAGS or id(s) in texts:
                texts.update((id(s), *map(id, s.children)))
        left_out = {id(n) for s in own if number[id(s)] in constant and id(s) not in texts for n in s.nodes}
        found = [_blocks_of(x, left_out, True) for x in place.nodes]
        lines = max(found, key=lambda blocks: sum(map(len, blocks)))
    else:
        here = [k for k, s in enumerate(place.children) if number[id(s)] not in constant and (number[id(s)] in chosen or not chosen) and not s.label.endswith("!")]
        first, last = (here[0], here[-1]) if here else (0, -1)
        # Between blocks of the content bare text stays, and so do headings and paragraphs that are on all pages; around it neither.
        inner = {id(s) for k, s in enumerate(place.children) if first <= k <= last and (number[id(s)] not in constant or tag_of(s) in TEXT_TAGS)}
        outer = [s for s in place.children if chosen and here and id(s) not in inner]
        gone = [s for s in own if number[id(s)] in constant and id(s) not in inner]
        left_out = {id(n) for s in (*outer, *gone) for n in s.nodes}
        lines = [line for x in place.nodes for line in _blocks_of(x, left_out, False)]
    if not _says_more_than_headings(place, {number[id(s)] for s in own} - constant, number):
        return by_elements(root, set())  # the pages differ in their headings alone
    return "\n".join(lines)


def _says_more_than_headings(place: Slot, varying: set[int], number: dict[int, int]) -> bool:
    """True if some text that varies stands outside headings, or none varies at all."""
    said = [tag_of(s) for s in place.walk() if number[id(s)] in varying and s.own and not s.label.endswith("!")]
    return not said or any(not re.fullmatch("h[1-6]", t) for t in said)


def says_no(node: Node) -> bool:
    return is_boilerplate(node, False)


# --- induction --------------------------------------------------------------------------------------------------------


def skeleton_of(html: str | None) -> tuple[Slot, list]:
    page = Slot("#root", [parse(html or "")], says_no)
    return page, packed(page, lambda s: s.text.hex(), lambda s: s.own, lambda s: s.links)


def reference(skeletons: list[list]) -> Template:
    """Skeletons aligned one after the other into one tree."""
    top = Template("#root")
    for rows in skeletons:
        align(top, Template.unpack(rows), True)
    top.measure()
    return top


def _pairs_of(top: Template, rows: list) -> list[tuple[int, int]]:
    """Places of wrapper nodes with those of a skeleton's nodes that match them."""
    page = Template.unpack(rows)
    at = {id(t): k for tree in (top, page) for k, t in enumerate(tree.walk())}
    return [(at[id(t)], at[id(s)]) for t, s in align(top, page, False)]


def wrapper_of(pages: list[str]) -> Wrapper:
    """The wrapper of a few pages, as wrappers() makes it of a table."""
    made = [skeleton_of(p) for p in pages]
    by_shape: dict[bytes, list] = {}
    for page, rows in made:
        by_shape.setdefault(page.shape, []).append(rows)
    top = reference([r[0] for _, r in sorted(by_shape.items(), key=lambda x: (-len(x[1]), x[0].hex()))[:SHAPES]])
    sums: dict[int, tuple] = {}
    for _, rows in made:
        for t, s in _pairs_of(top, rows):
            _, _, text, own, links = rows[s]
            n, low, high, o, k = sums.get(t, (0, text, text, 0, 0))
            sums[t] = (n + 1, min(low, text), max(high, text), o + own, k + links)
    return Wrapper(top, {t: (n, bytes.fromhex(low), bytes.fromhex(high), o, k) for t, (n, low, high, o, k) in sums.items()}, len({rows[0][2] for _, rows in made}))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, shape, text, skeleton)."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 500):
            made = [skeleton_of(x.as_py()) for x in batch.column(1).slice(at, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array([p.shape.hex() for p, _ in made], pa.string()), pa.array([rows[0][2] for _, rows in made], pa.string()), pa.array([json.dumps(rows, separators=(",", ":")) for _, rows in made], pa.string())], ["host", "shape", "text", "skeleton"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, skeletons in order) to (host, wrapper)."""
    for batch in batches:
        for host, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            top = reference([json.loads(s["skeleton"]) for s in found.as_py()])
            yield pa.RecordBatch.from_pylist([{"host": host, "wrapper": json.dumps(top.pack(), separators=(",", ":"))}], pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


_SUMS = pa.schema([("host", pa.string()), ("node", pa.int32()), ("n", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("own", pa.int64()), ("links", pa.int64())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, skeleton, wrapper) to the sums of each wrapper node over the task's pages."""
    tops: dict[str, Template] = {}
    plans: dict[tuple, list] = {}
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        rows = [{"host": h, "node": t, "n": n, "low": low, "high": high, "own": own, "links": links} for (h, t), (n, low, high, own, links) in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, _SUMS)

    for batch in batches:
        for host, shape, skeleton, packed_top in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            rows = json.loads(skeleton.as_py())
            if (host, shape) not in plans:
                if len(plans) >= PLANS_HELD or len(tops) >= HOSTS_HELD:
                    plans.clear()
                    tops.clear()
                if host not in tops:
                    tops[host] = Template.unpack(json.loads(packed_top.as_py()))
                plans[host, shape] = _pairs_of(tops[host], rows)
            for t, s in plans[host, shape]:
                _, _, text, own, links = rows[s]
                x = held.get((host, t))
                if x is None:
                    held[host, t] = [1, text, text, own, links]
                else:
                    x[0] += 1
                    x[1], x[2] = min(x[1], text), max(x[2], text)
                    x[3] += own
                    x[4] += links
            if len(held) >= SUMS_HELD:
                yield out()
    yield out()


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, sums, different): the wrapper of every host as JSON, what its nodes held, and the number of its different pages.

    Null and empty pages are pages; repeated ones count as often as they are there, but not as different. An empty table gives no rows.
    """
    source = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").alias("html"))
    made = written(source.mapInArrow(_skeletons, "host string, shape string, text string, skeleton string"), "skeletons")
    shapes = made.groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("skeleton").alias("skeleton"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))
    frequent = shapes.withColumn("place", place).where(F.col("place") <= SHAPES).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "skeleton"))).alias("found"))
    tops = written(frequent.mapInArrow(_references, "host string, wrapper string"), "references")
    counted = made.select("host", "shape", "skeleton").join(_small(tops), "host").mapInArrow(_sums, "host string, node int, n long, low string, high string, own long, links long")
    sums = counted.groupBy("host", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("own").alias("own"), F.sum("links").alias("links"))
    packed_sums = sums.groupBy("host").agg(F.collect_list(F.struct("node", "n", "low", "high", "own", "links")).alias("sums"))
    different = made.select("host", "text").distinct().groupBy("host").agg(F.count("*").alias("different"))
    return tops.join(packed_sums, "host").join(different, "host")


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if its wrappers are within BROADCAST_BYTES, which is looked up."""
    size = df.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def host_of(url_col: str):
    """Lower-case host of a URL; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _extract(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Wrapper | None] = {}
        for batch in batches:
            texts = []
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for page, host, known, sums, different in zip(column["__html"], column["__host"].to_pylist(), column["__wrapper"], column["__sums"], column["__different"].to_pylist(), strict=True):
                if host not in cache:
                    if len(cache) >= HOSTS_HELD:
                        cache.clear()
                    held = {x["node"]: (x["n"], bytes.fromhex(x["low"]), bytes.fromhex(x["high"]), x["own"], x["links"]) for x in sums.as_py() or ()}
                    cache[host] = Wrapper(Template.unpack(json.loads(known.as_py())), held, different) if known.is_valid else None
                texts.append(extract(parse(page.as_py() or ""), cache[host]))
            yield pa.RecordBatch.from_arrays([*[column[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns `keep`) with text and n_chars (code points).

    A null or empty page has the text ''. Pages whose URL is null or has no host share the host ''. Copies of a page never
    make each other template: a host needs LEAST_PAGES different pages for that. Repeated rows each get a row. Input
    columns named text or n_chars are replaced. An empty table gives no rows.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    known = written(wrappers(pages, url_col, html_col), "wrappers")
    known = _small(known).withColumnsRenamed({c: f"__{c}" for c in ("host", "wrapper", "sums", "different")})
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"), host_of(url_col).alias("__host"))
    joined = source.join(known, "__host", "left").select(*[F.col(f"`{c}`") for c in keep], "__html", "__host", "__wrapper", "__sums", "__different")
    kept = T.StructType([f for f in source.schema.fields if not f.name.startswith("__")])
    schema = T.StructType([*kept.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_extract(keep), schema)
