"""Main text of web pages by inferred wrappers (operator 13).

A wrapper is a union-free regular expression over a host's token streams: tags, template
strings and text slots, with optional and repeated groups. Each page's stream is aligned with
the wrapper as it stands, and mismatches change it: another string at one place becomes a text
slot, a tag that one side lacks an optional group, a tag that comes again a repeated group, and
siblings that follow one another both ways one repeated group of optionals. What an alignment
leaves behind at a place (how often it occurs, in how many of its parents, the least and the
greatest hash of its text, what follows it) only grows by sums, minima, maxima and sets, so
the alignments of parts merge in any order to one wrapper: tasks align the pages they hold,
Spark adds up by host and place, and a host with a third of all pages is no large group.

The wrapper then says where a host's main text lies: in the slots of the element that is named
as an article, else of the smallest container that holds most of the running text, without
places whose text is a template string or mostly links. Pages that lack that element are
decided by their own stream in the same way.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, read_table

DEPTH = 64  # deeper elements belong to their ancestor of this depth
RARE = 1000  # a place on less than 1 / RARE of a host's pages is left to those pages: at most RARE x places of a page in a wrapper
PLACES = 50_000  # places a task holds before it hands them on
BROADCAST = 32 << 20  # bytes of wrappers up to which they are broadcast
EVIDENCE = 3  # pages on which a string must be the same to be a template string

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title textarea noscript iframe noframes noembed xmp template svg math object select button canvas audio video datalist".split())
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CONTAINERS = frozenset("html body div section main article table tbody tr td center form".split())
LISTS = frozenset("ul ol dl div section table p nav".split())
ENDS = {  # an opening tag ends these open elements, up to one of the others
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = frozenset({"table", "td", "th", "button", "html"})

# Words of class, id and role names. A name is a hint if all its words are, apart from words of layout.
UNWANTED = frozenset(
    "comment comments disqus respond reply replies discussion nav navbar navigation menu menus breadcrumb breadcrumbs ad ads advert adverts advertisement advertising adsense"
    " sponsor sponsored promo promoted promotion cookie cookies consent gdpr privacy newsletter subscribe subscription share sharing social related recommended recommendations"
    " pagination pager popup modal overlay login signup footer copyright notice notices alert toolbar complementary contentinfo search".split()
)
SIDE = frozenset("header masthead banner sidebar aside widget widgets topbar form".split())
WANTED = frozenset("article content entry post story".split())
LAYOUT = frozenset(
    "box list section wrapper wrap area block container inner outer item items bar link links top bottom left right main site page global primary secondary the slot unit button"
    " buttons post article entry content story body text blog news thread form group panel row col column message".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = re.compile(r"(?:class|id|role|itemprop|hidden|style)", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

NONE, SOFT, HARD = 0, 1, 2
ROOT = 0


@dataclass(slots=True)
class Element:
    """An element of one page."""

    key: int
    parent: int
    tag: str
    symbol: str
    depth: int
    level: int  # 3: an article, 2: main, 1: named like content
    skip: int  # why it is no main text: NONE, SOFT (an article inside is one all the same) or HARD
    inside: bool  # in an article or main
    hashed: int = 0
    chars: int = 0
    links: int = 0
    anchors: int = 0
    good: int = 0


@dataclass(slots=True)
class Place:
    """What alignments have left of an element at one place of a wrapper."""

    key: int
    parent: int
    symbol: str
    depth: int
    level: int
    pages: int = 0
    instances: int = 0
    parents: int = 0  # parents that have it
    most: int = 0  # in one parent
    least_hash: int = 0
    greatest_hash: int = 0
    chars: int = 0
    links: int = 0
    anchors: int = 0
    good: int = 0
    children: list[int] = field(default_factory=list)

    @property
    def tag(self) -> str:
        return re.split(r"[.:]", self.symbol, maxsplit=1)[0]

    @property
    def same(self) -> bool:
        return self.least_hash == self.greatest_hash


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1  # fits a signed long


def hints(names: list[str]) -> tuple[int, int]:
    """Level and skip of class, id and role names."""
    level = skip = NONE
    for name in names:
        words = {w.lower() for w in WORDS.findall(name)}
        if not words:
            continue
        if words & UNWANTED and words <= UNWANTED | SIDE | LAYOUT:
            skip = HARD
        elif words & SIDE and words <= SIDE | LAYOUT:
            skip = max(skip, SOFT)
        elif words & WANTED and words <= WANTED | LAYOUT:
            level = 1
    return level, skip


def describe(tag: str, attributes: str) -> tuple[str, int, int]:
    """Symbol, level and skip of an opening tag; digits are left out of names, so that ids do not multiply symbols."""
    level, skip, names, role = NONE, NONE, [], ""
    if attributes and NAMING.search(attributes):
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
            found.setdefault(m[1].lower(), value or "")
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        role = found.get("role", "").lower()
        level, skip = hints([*names, role])
        if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            skip = HARD
        if "articleBody" in found.get("itemprop", ""):
            level = 3
    if tag in ("nav", "footer", "aside", "dialog", "menu", "head"):
        skip = HARD
    elif tag in ("header", "form"):
        skip = max(skip, SOFT)
    elif tag == "article" and skip == NONE:
        level = 3
    elif (tag == "main" or role == "main") and skip == NONE:
        level = max(level, 2)
    if tag in ("html", "body"):
        level = skip = NONE
    kept = sorted({w for w in (re.sub(r"\d+", "", n).lower() for n in names) if w})
    return ".".join([tag, *kept])[:200], level, skip


class Page:
    """The elements of a page and its blocks of text, each with the element it stands in."""

    def __init__(self, text: str):
        self.elements = [Element(ROOT, -1, "", "", 0, NONE, NONE, False)]
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[tuple[int, int]] = []  # characters in links and links, by block
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.pieces: list[str] = []
        self.in_link, self.link_chars, self.link_count = False, 0, 0
        self.read(text)
        self.place()
        self.measure()

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                self.blocks.append((self.stack[-1][1], text))
                self.linked.append((min(self.link_chars, len(text)), self.link_count))
        self.link_chars = self.link_count = 0

    def add(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append(text)
        if self.in_link:
            self.link_chars += len(" ".join(text.split()))

    def pop_to(self, depth: int) -> None:
        self.end_block()
        del self.stack[depth:]

    def find(self, tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int:
        """Depth of the outermost open element of `tags` above the innermost of `stops`; -1 if none."""
        at = -1
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                at = i
            elif tag in stops:
                break
        return at

    def open(self, tag: str, symbol: str, level: int, skip: int) -> None:
        self.end_block()
        at = self.find(*ENDS[tag]) if tag in ENDS else -1
        if at < 0 and tag not in INLINE and self.stack[-1][0] in ("p", "head"):
            at = len(self.stack) - 1
        if at > 0:
            self.pop_to(at)
        parent = self.stack[-1][1]
        above = self.elements[parent]
        if above.depth >= DEPTH:
            self.stack.append((tag, parent))
            return
        if tag == "header" and above.inside:
            skip = NONE if skip == SOFT else skip
        if above.skip and not (above.skip == SOFT and level >= 2 and skip == NONE):
            skip = max(skip, above.skip)
        self.elements.append(Element(ROOT, parent, tag, symbol, above.depth + 1, level, skip, above.inside or (level >= 2 and not skip)))
        self.stack.append((tag, len(self.elements) - 1))

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE or tag not in ("html", "body", "table") and self.stack[i][0] in SCOPES:
                return

    def read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            m = TOKEN.search(text, at)
            if m is None:
                self.add(text[at:])
                break
            if m.start() > at:
                self.add(text[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    self.in_link = False
                if tag in INLINE:
                    if len(self.stack) > 1 and self.stack[-1][0] in INLINE:
                        self.close(tag)
                elif tag == "br":
                    self.pieces.append(" ")
                else:
                    self.close(tag)
                continue
            if tag == "br":
                self.pieces.append(" ")
                continue
            if tag in HIDDEN:
                at = self.skip_hidden(text, at, tag, m[3])
                continue
            if tag in VOID:
                if tag == "hr":
                    self.end_block()
                continue
            symbol, level, skip = describe(tag, m[3])
            if tag in INLINE:
                if tag == "a":
                    self.in_link, self.link_count = True, self.link_count + 1
                if not skip:
                    continue
            self.open(tag, symbol, level, skip)
        self.end_block()

    @staticmethod
    def skip_hidden(text: str, at: int, tag: str, attributes: str) -> int:
        """Where an element that shows no text ends; other elements of its kind may lie in it unless it is raw text."""
        if attributes.endswith("/") and tag not in RAW:
            return at
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>?", re.I).finditer(text, at):
            if m[1]:
                depth -= 1
            elif tag not in RAW and not m[0].endswith("/>"):
                depth += 1
            if depth == 0:
                return m.end()
        return len(text) if tag in RAW else at

    def place(self) -> None:
        """Keys of the elements: the symbols down to each. A container without a name is told by the kinds of its children."""
        kinds: list[set[str]] = [set() for _ in self.elements]
        for (i, text), (link, _) in zip(self.blocks, self.linked):
            kinds[i].add("links" if 2 * link > len(text) else "text")
        for e in self.elements[1:]:
            kinds[e.parent].add("title" if e.tag in ("h1", "h2") else "boxes" if e.tag in CONTAINERS else "blocks")
        for e, kind in zip(self.elements[1:], kinds[1:]):
            if e.tag in CONTAINERS and e.symbol == e.tag and e.tag not in ("html", "body", "main", "article"):
                strongest = next((k for k in ("blocks", "text", "links", "boxes") if k in kind), "")
                e.symbol += "".join(f":{k}" for k in ("title" if "title" in kind else "", strongest) if k)
            e.key = hash64(f"{self.elements[e.parent].key}/{e.symbol}")

    def measure(self) -> None:
        elements = self.elements
        for (i, text), (link, count) in zip(self.blocks, self.linked):
            h = hash64(text)
            e = elements[i]
            e.chars += len(text)
            e.links += link
            e.anchors += count
            while i >= 0:
                e = elements[i]
                e.hashed = (e.hashed * 1000003 + h) & 0x7FFFFFFFFFFFFFFF
                i = e.parent
        own = [(e.chars, e.links) for e in elements]
        for e in reversed(elements[1:]):
            up = elements[e.parent]
            up.chars, up.links, up.anchors = up.chars + e.chars, up.links + e.links, up.anchors + e.anchors
        if any(e.tag == "form" and 2 * e.chars > elements[0].chars for e in elements):
            self.unskip_forms()
        for e, (chars, links) in zip(elements, own):
            e.good = 0 if e.skip else 10 * chars - 9 * links  # running text weighs ten times as much as links
        for e in reversed(elements[1:]):
            elements[e.parent].good += e.good

    def unskip_forms(self) -> None:
        """A form around most of a page is no form to leave out."""
        total = self.elements[0].chars
        for e in self.elements[1:]:
            if e.skip == SOFT:
                wide = e.tag == "form" and 2 * e.chars > total
                inherited = self.elements[e.parent].skip == NONE and e.tag not in ("form", "header") and not hints(e.symbol.split(".")[1:])[1]
                if wide or inherited:
                    e.skip = NONE


def align(wrapper: dict, page: Page) -> None:
    """Align a page with a wrapper, {(key, next key): Place}; mismatches widen the places."""
    counts: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    on_page: set[tuple[int, int]] = set()
    for e in page.elements:
        p = wrapper.get((e.key, 0))
        if p is None:
            up = page.elements[e.parent].key if e.parent >= 0 else -1
            p = wrapper[e.key, 0] = Place(e.key, up, e.symbol, e.depth, e.level, least_hash=e.hashed, greatest_hash=e.hashed)
        p.pages += (e.key, 0) not in on_page
        on_page.add((e.key, 0))
        p.instances += 1
        p.least_hash, p.greatest_hash = min(p.least_hash, e.hashed), max(p.greatest_hash, e.hashed)
        p.chars, p.links, p.anchors, p.good = p.chars + e.chars, p.links + e.links, p.anchors + e.anchors, p.good + e.good
        n = counts[e.parent, e.key] = counts.get((e.parent, e.key), 0) + 1
        p.parents += n == 1
        p.most = max(p.most, n)
        before = last.get(e.parent)
        if before is not None and before != e.key:
            edge = wrapper.get((before, e.key))
            if edge is None:
                edge = wrapper[before, e.key] = Place(before, p.parent, "", e.depth, 0)
            edge.pages += (before, e.key) not in on_page
            on_page.add((before, e.key))
        last[e.parent] = e.key


def choose(places: dict[int, Place]) -> tuple[set[int], set[int]]:
    """Keys of the elements that hold the main text, and of those in them that do not belong to it."""
    root = places.get(ROOT)
    if root is None or root.good <= 0:
        return set(), set()
    for p in places.values():
        p.children = []
    for p in sorted(places.values(), key=lambda p: p.key):
        if p.key != ROOT and p.parent in places:
            places[p.parent].children.append(p.key)
    varied = not root.same
    template = lambda p: varied and p.same and p.pages >= EVIDENCE and 2 * p.good < root.good
    linky = lambda p: p.anchors >= 2 * p.instances and 10 * p.links >= 7 * p.chars and 3 * p.chars < root.chars
    main = None
    for level, share in ((3, 0.3), (2, 0.3), (1, 0.5)):
        named = [p for p in places.values() if p.level == level and p.good > 0 and not template(p)]
        best = max(named, key=lambda p: (p.good, p.depth, p.key), default=None)
        if best is not None and best.good >= share * root.good:
            near = [p for p in named if 10 * p.good >= 9 * best.good] if level == 1 else [best]
            main = max(near, key=lambda p: (p.depth, p.good, p.key))
            break
    named = main is not None
    if main is None:
        main = root
        while True:
            inside = [places[k] for k in main.children]
            out = [p for p in inside if template(p) or linky(p)]
            total = main.good - sum(p.good for p in out)
            inside = [p for p in inside if p.good > 0 and p not in out]
            best = max(inside, key=lambda p: (p.good, p.key), default=None)
            if best is None or best.tag not in CONTAINERS or 10 * best.good < 7 * total:
                break
            main = best
    drops, todo, heading = set(), list(main.children), False
    while todo:
        p = places[todo.pop()]
        heading |= p.tag == "h1"
        keep = p.tag == "h1" or 2 * p.good >= main.good
        if not keep and (p.tag in LISTS and linky(p) or template(p) and (not named or p.tag in ("div", "section"))):
            drops.add(p.key)
        else:
            todo.extend(p.children)
    mains = {main.key}
    if not heading:  # the title may stand above the container
        mains |= {p.key for p in places.values() if p.tag == "h1" and p.good > 0 and not template(p)}
    return mains, drops


def expression(places: dict[int, Place], follows: dict[int, set[int]]) -> str:
    """The wrapper as a union-free expression: x? optional, x+ repeated, (x? y?)+ a repeated group, #text a slot, '…' a template string."""

    def groups(keys: list[int]) -> list[list[int]]:
        """Siblings in order; those that follow one another both ways are one group (strongly connected)."""
        inside = set(keys)
        reach = {}
        for k in keys:
            seen, todo = set(), [k]
            while todo:
                for x in follows.get(todo.pop(), ()):
                    if x in inside and x not in seen:
                        seen.add(x)
                        todo.append(x)
            reach[k] = seen
        out: dict[tuple, list[int]] = {}
        for k in keys:
            out.setdefault(tuple(sorted({k, *(x for x in reach[k] if k in reach[x])})), []).append(k)
        # a group that more groups come after stands earlier
        return sorted(out.values(), key=lambda g: (-len(reach[g[0]] - set(g)), sorted(places[k].symbol for k in g), g))

    def one(key: int, grouped: bool) -> str:
        p = places[key]
        body = " ".join(map(part_of, groups(p.children)))
        if not p.children:
            body = "" if not p.chars else "'…'" if p.same and p.pages > 1 else "#text"
        text = f"{p.symbol}({body})" if body else p.symbol
        optional = grouped or (p.parent in places and p.parents < places[p.parent].instances)
        return text + ({(0, 0): "", (0, 1): "+", (1, 0): "?", (1, 1): "*"}[optional, p.most > 1])

    def part_of(group: list[int]) -> str:
        return one(group[0], False) if len(group) == 1 else "(" + " ".join(one(k, True) for k in sorted(group, key=lambda k: places[k].symbol)) + ")+"

    return " ".join(part_of(g) for g in groups(places[ROOT].children)) if ROOT in places else ""


FIELDS = ["parent", "symbol", "depth", "level", "pages", "instances", "parents", "most", "least_hash", "greatest_hash", "chars", "links", "anchors", "good"]
PLACE_SCHEMA = (
    "host string, key long, next long, parent long, symbol string, depth int, level int, pages long, instances long, parents long, most long,"
    " least_hash long, greatest_hash long, chars long, links long, anchors long, good long"
)
WRAPPER_SCHEMA = "host string, n_pages long, expression string, mains array<long>, drops array<long>"


def with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), HOST, 1), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, n_pages, expression, and the keys of main elements and of what is left out of them.

    Pages whose url is null or names no host share the host ''. All pages take part; repeated
    pages count each time. A wrapper holds places on at least 1 / RARE of the host's pages.
    """

    def aligned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, dict] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            flat = [(h, k, nxt, *(getattr(p, f) for f in FIELDS)) for h, w in wrappers.items() for (k, nxt), p in w.items()]
            names = ["host", "key", "next", *FIELDS]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 10]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flat), types)], names)

        for b in bounded(it, 0, 1 << 20):
            for text, host in zip(b.column(0), b.column(1).to_pylist()):
                w = wrappers.setdefault(host, {})
                held -= len(w)
                align(w, Page(text.as_py() or ""))
                held += len(w)
                if held > PLACES:
                    yield rows()
                    wrappers.clear()
                    held = 0
        if wrappers:
            yield rows()

    def assemble(key: tuple, table: pa.Table) -> pa.Table:
        places, follows = {}, {}
        for r in table.to_pylist():
            if r["next"]:
                follows.setdefault(r["key"], set()).add(r["next"])
            else:
                places[r["key"]] = Place(r["key"], *(r[f] for f in FIELDS))
        mains, drops = choose(places)
        one = {"host": key[0].as_py(), "n_pages": places[ROOT].pages, "expression": expression(places, follows), "mains": sorted(mains), "drops": sorted(drops)}
        types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array([v], t) for v, t in zip(one.values(), types)], names=list(one))

    sums = ["pages", "instances", "parents", "chars", "links", "anchors", "good"]
    places = materialize(
        with_host(pages).select("html", "host").mapInArrow(aligned, PLACE_SCHEMA).groupBy("host", "key", "next").agg(
            *(F.min(c).alias(c) for c in ("parent", "symbol", "depth", "level", "least_hash")),
            *(F.max(c).alias(c) for c in ("most", "greatest_hash")),
            *(F.sum(c).alias(c) for c in sums),
        ),
        "places",
    )
    totals = places.where("key = 0 AND next = 0").select("host", F.col("pages").alias("n_pages"))
    common = places.join(totals, "host").where(F.col("pages") * RARE >= F.col("n_pages")).drop("n_pages")
    wrappers = materialize(common.groupBy("host").applyInArrow(assemble, WRAPPER_SCHEMA), "wrappers")
    discard(places)
    return wrappers


def main_text(page: Page, mains: set[int], drops: set[int]) -> str:
    elements = page.elements
    if not any(e.key in mains for e in elements):
        own: dict = {}
        align(own, page)
        mains, drops = choose({k: p for (k, nxt), p in own.items() if not nxt})
    wanted = [False] * len(elements)
    for i, e in enumerate(elements):
        wanted[i] = not e.skip and e.key not in drops and (e.key in mains or (e.parent >= 0 and wanted[e.parent]))
    return " ".join(text for i, text in page.blocks if wanted[i])


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (its main text; empty if none), n_chars.

    `wrappers` is a result of `infer_wrappers`; pages of other hosts are decided on their own. A
    null html counts as empty and gives an empty text; very long pages are read whole; broken
    markup is read as far as it goes; null page_ids and repeated rows stay, one for one; equal
    pages of one host give equal texts; further columns, whatever their names, are ignored; an
    empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for b in bounded(it, 2, 1 << 20):
            texts = []
            for i, host in enumerate(b.column(3).to_pylist()):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = set(b.column(4)[i].as_py() or ()), set(b.column(5)[i].as_py() or ())
                texts.append(main_text(Page(b.column(2)[i].as_py() or ""), *known[host]))
            chars = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    found = wrappers.select("host", "mains", "drops")
    size = wrappers.agg(F.sum(8 * (F.size("mains") + F.size("drops")) + F.length("host"))).first()[0] or 0
    if size <= BROADCAST:
        found = F.broadcast(found)  # beyond it hosts are shuffled, and adaptive execution splits large ones
    joined = with_host(pages).join(found, "host", "left").select("page_id", "url", "html", "host", "mains", "drops")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, infer_wrappers(pages))
