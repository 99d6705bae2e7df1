"""Main text of web pages by wrappers that are inferred per host.

A wrapper is a union-free regular expression over tags, kept as a tree: all pages of a host are
aligned, by task one after the other, and the trees of the tasks are merged pair by pair; where
child sequences differ, an element becomes optional, where it comes again in a row, repeated; texts
become slots that count what they hold. The region of the wrapper that holds most of the variable
text, away from elements that frame articles, is where the pages of the host have their article; other
places that hold as much on the pages that have them are read too. Some tags always frame; names of
class, id or role are only a first guess at it, which what the element holds must bear out, see
``settle``.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreunc.llm.common import slices, written
from foreunc.llm.urls import host_and_path

#: Children of a slot from which labels are widened, and labels of one tag from which its names are left open.
MOST_CHILDREN = 256
MOST_LABELS = 64
#: Slots a task holds before it passes its wrappers on.
HELD_SLOTS = 200_000
#: Wrappers of one host that a task merges at a time.
MERGED = 8
#: Open elements that are kept apart.
DEPTH = 150
#: A region is narrowed to a child with at least this share of its text.
DOMINANT = 0.6
#: Wrappers (a host name and a short path, under 1 kB) up to which they are broadcast; above it they
#: are joined by a shuffle of both sides.
BROADCAST_ROWS = 50_000

#: Fixed values of HTML: elements without content, with raw content, that stand in a line, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
#: Elements that frame an article and aren't part of it.
FRAME_TAGS = frozenset("nav header footer aside form button select dialog head menu".split()) | RAW
#: Words of class, id and role that hint at a frame: of elements full of links, of reader comments, of others.
LINK_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs related recommended share sharing social signup login search".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist replies respond disqus".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo header masthead footer sidebar aside "
    "widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe contentinfo "
    "complementary form".split()
)
#: Words that make a name with one of the above tell of a state or kind of page instead, as in ``no-sidebar``.
STATE_WORDS = frozenset(
    "no not non without with has have is free open opened closed enabled disabled on off active hidden visible page "
    "pages post single layout results type template ready fixed sticky".split()
)
#: Elements whose names tell nothing: the page, the article, and blocks of text.
UNNAMED = frozenset(
    "html body main article p h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot dd dt blockquote pre figure figcaption".split()
)
#: An element named as a frame isn't one if it holds this many times the text outside such elements,
RESCUE = 3
#: one named for comments, this many times, and at least so many letters;
RESCUE_COMMENTS = 50
LONG = 200
#: one named for its links, if fewer than this share of its text are links and it is longer than that.
LINKED = 0.3
SHORT = 100
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: What stands for any names.
OPEN = "*"


@dataclass
class Element:
    tag: str
    names: str
    children: list = field(default_factory=list)
    #: Whether this is a menu, header, footer, sidebar, notice, advert, form, comment or code.
    frames: bool = False

    @property
    def label(self) -> str:
        names = f"{self.tag} {self.names}" if self.names else self.tag
        return f"!{names}" if self.frames else names

    @property
    def widened(self) -> str:
        """Label with names left open; elements that frame articles stay apart from the others."""
        return f"!{self.tag} {OPEN}" if self.frames else f"{self.tag} {OPEN}"


def hints(element: Element) -> frozenset | None:
    """The set of words that an element's names hint by, the strictest of them; None without a hint."""
    if element.tag in UNNAMED:
        return None
    found: set[str] = set()
    for name in element.names.lower().split():
        words = set(WORD.findall(name))
        if words.isdisjoint(STATE_WORDS):
            found |= words
    return next((kind for kind in (COMMENT_WORDS, OTHER_WORDS, LINK_WORDS) if not kind.isdisjoint(found)), None)


def settle(root: Element) -> None:
    """Tell which elements frame the article: some tags do, and those that names hint at, if it is borne out.

    Text is measured outside of such tags. One named for links must be short or hold links. Any of them
    is no frame if it holds RESCUE times what stands outside all elements with such names (reader comments
    RESCUE_COMMENTS times) and LONG letters; what is inside of it is then judged alike.
    """
    sizes: dict[int, tuple[int, int]] = {}
    order = [(root, False)]
    for element, linked in order:
        element.frames = element.tag in FRAME_TAGS
        if not element.frames:
            linked = linked or element.tag == "a"
            order += [(c, linked) for c in element.children if isinstance(c, Element)]
    guessed: dict[int, frozenset] = {}
    for element, linked in reversed(order):
        if element.frames:
            continue
        linked = linked or element.tag == "a"
        # Text of the element outside of guessed elements in it, and in links of all of it; and all its text.
        text = links = whole = 0
        for child in element.children:
            if isinstance(child, str):
                length = len(child) - child.count(" ") if child.strip() else 0
                text, links, whole = text + length, links + length * linked, whole + length
            elif not child.frames:
                inner, inner_links, inner_whole = sizes[id(child)]
                text += 0 if id(child) in guessed else inner
                links, whole = links + inner_links, whole + inner_whole
        sizes[id(element)] = (text, links, whole)
        kind = hints(element)
        if kind is LINK_WORDS and whole > SHORT and links < LINKED * whole:
            kind = None
        if kind is not None:
            guessed[id(element)] = kind
    outside = sizes[id(root)][0]
    inside = [root]
    while inside:
        # The guessed elements that stand in no other one, with what they hold themselves.
        first, look = [], [c for e in inside for c in e.children if isinstance(c, Element) and not c.frames]
        while look:
            element = look.pop()
            if id(element) in guessed:
                first.append(element)
            else:
                look += [c for c in element.children if isinstance(c, Element) and not c.frames]
        inside = []
        for element in first:
            times = RESCUE_COMMENTS if guessed[id(element)] is COMMENT_WORDS else RESCUE
            if sizes[id(element)][0] > max(times * outside, LONG):
                inside.append(element)
            else:
                element.frames = True
        outside += sum(sizes[id(e)][0] for e in inside)


def parse(page: str) -> Element:
    """Elements and texts of a page, however badly nested; comments and raw content are left out.

    Elements more than DEPTH deep stand side by side.
    """
    root = Element("", "")
    stack, at = [root], 0
    flat: Counter = Counter()
    while (found := TAG.search(page, at)) is not None:
        if found.start() > at:
            stack[-1].children.append(unescape(page[at : found.start()]))
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1] and flat[tag]:
            flat[tag] -= 1
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        names = " ".join(sorted(w for m in NAMED.finditer(found[3]) for w in (m[2] or m[3] or m[4] or "").split()))
        element = Element(tag, names)
        _close_implied(stack, tag)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(element)
        elif tag not in VOID:
            flat[tag] += 1
    if at < len(page):
        stack[-1].children.append(unescape(page[at:]))
    settle(root)
    return root


def _close_implied(stack: list[Element], tag: str) -> None:
    """End what the start of ``tag`` ends: an open paragraph, list item, cell or the like."""
    if tag in CLOSES:
        ends, within = CLOSES[tag]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in within:
                break
            if stack[depth].tag in ends.split():
                del stack[depth:]
                break
    if tag not in INLINE and tag != "br":
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag not in INLINE:
                break


@dataclass
class Slot:
    """An element of a wrapper, with what the pages seen so far hold at its place."""

    element: Element
    pages: int = 0
    optional: bool = False
    repeated: bool = False
    again: int = 0
    text: int = 0
    linked: int = 0
    first: str | None = None
    variable: bool = False
    open: set = field(default_factory=set)
    children: list = field(default_factory=list)

    def content(self) -> int:
        """Length of the text that varies between pages (any text of a single page), without frames and links."""
        if self.element.frames:
            return 0
        own = self.text - self.linked if self.variable or self.pages < 2 else 0
        return max(own, 0) + sum(c.content() for c in self.children)

    def label(self, element: Element) -> str:
        """What a child is known by: its label, or its tag where names are left open."""
        return element.widened if element.tag in self.open else element.label

    def slots(self) -> int:
        return 1 + sum(c.slots() for c in self.children)


def collapsed(slot: Slot, children: list) -> list[list[Element]]:
    """Runs of elements that ``slot`` knows by one label; texts are left out."""
    runs: list[list[Element]] = []
    last = None
    for child in children:
        if isinstance(child, Element):
            label = slot.label(child)
            if runs and last == label:
                runs[-1].append(child)
            else:
                runs.append([child])
            last = label
    return runs


def align(slot: Slot, elements: list[Element], linked: bool = False) -> None:
    """Take a run of elements of one page into their place of the wrapper.

    What is inside of an element that frames articles isn't needed.
    """
    slot.repeated |= len(elements) > 1
    slot.again += len(elements) > 1
    slot.pages += 1
    if slot.element.frames:
        return
    texts = [" ".join(" ".join(c for c in e.children if isinstance(c, str)).split()) for e in elements]
    text = blake2b("\n".join(texts).encode(errors="surrogatepass"), digest_size=8).hexdigest()
    linked = linked or slot.element.tag == "a"
    length = sum(map(len, texts))
    slot.text += length
    slot.linked += length * linked
    slot.variable |= slot.first is not None and slot.first != text
    slot.first = text if slot.first is None else slot.first
    for position, element in enumerate(elements):
        runs = collapsed(slot, element.children)
        before, now = [slot.label(c.element) for c in slot.children], [slot.label(r[0]) for r in runs]
        merged: list[Slot] = []
        for kind, i, j, m, n in steps(before, now):
            if kind == "equal":
                for child, run in zip(slot.children[i:j], runs[m:n], strict=True):
                    align(child, run, linked)
                    merged.append(child)
                continue
            for child in slot.children[i:j]:
                child.optional = True
                merged.append(child)
            for run in runs[m:n]:
                child = Slot(known_by(slot, run[0]), optional=slot.pages > 1 or position > 0)
                align(child, run, linked)
                merged.append(child)
        slot.children = merged
        widen(slot)


def steps(before: list[str], now: list[str]) -> list[tuple]:
    """How one sequence of labels becomes the other."""
    if before == now:
        return [("equal", 0, len(before), 0, len(now))]
    return SequenceMatcher(None, before, now, autojunk=False).get_opcodes()


def known_by(slot: Slot, element: Element) -> Element:
    """An element as the child of a slot: without content, its names left open if they are there."""
    return Element(element.tag, OPEN if element.tag in slot.open else element.names, frames=element.frames)


def widen(slot: Slot) -> None:
    """Where children are many, leave the names of tags open that have many, and join equal children.

    So a wrapper stays small however many pages have names of their own, and nothing is left out of it.
    """
    if len(slot.children) <= MOST_CHILDREN:
        return
    labels = defaultdict(set)
    for child in slot.children:
        labels[child.element.tag].add(child.element.label)
    slot.open |= {tag for tag, names in labels.items() if len(names) > MOST_LABELS}
    regroup(slot)


def regroup(slot: Slot) -> None:
    """Join all children that the slot knows by one label."""
    by_label: dict[str, Slot] = {}
    for child in slot.children:
        label = slot.label(child.element)
        child.element = known_by(slot, child.element)
        if label in by_label:
            merge(by_label[label], child)
        else:
            by_label[label] = child
    slot.children = list(by_label.values())


def merge(slot: Slot, other: Slot) -> None:
    """Take what another wrapper has at the place of ``slot`` into it."""
    slot.variable |= other.variable or None not in (slot.first, other.first) and slot.first != other.first
    slot.first = other.first if slot.first is None else slot.first
    slot.optional |= other.optional
    slot.repeated |= other.repeated
    for name in ("pages", "again", "text", "linked"):
        setattr(slot, name, getattr(slot, name) + getattr(other, name))
    if slot.open != other.open:
        slot.open = other.open = slot.open | other.open
        regroup(slot)
        regroup(other)
    before, now = ([slot.label(c.element) for c in s.children] for s in (slot, other))
    merged: list[Slot] = []
    for kind, i, j, m, n in steps(before, now):
        if kind == "equal":
            for child, more in zip(slot.children[i:j], other.children[m:n], strict=True):
                merge(child, more)
                merged.append(child)
            continue
        for child in [*slot.children[i:j], *other.children[m:n]]:
            child.optional = True
            merged.append(child)
    slot.children = merged
    widen(slot)


def packed(slot: Slot) -> list:
    """A wrapper as lists, for JSON."""
    return [
        slot.element.tag, slot.element.names, slot.element.frames, slot.pages, slot.optional, slot.repeated, slot.again,
        slot.text, slot.linked, slot.first, slot.variable, sorted(slot.open), [packed(c) for c in slot.children],
    ]


def unpacked(values: list) -> Slot:
    tag, names, frames, *rest, opened, children = values
    return Slot(Element(tag, names, frames=frames), *rest, set(opened), [unpacked(c) for c in children])


def infer(pages: list[str]) -> Slot:
    """The wrapper of some pages."""
    wrapper = Slot(Element("", ""))
    for page in pages:
        align(wrapper, [parse(page)])
    return wrapper


def regions(wrapper: Slot) -> list[list[str]]:
    """Labels from the root down to the elements that hold articles, that of the most text first.

    Narrowed while one child, which isn't repeated on most pages and isn't itself a block of text,
    holds most. What stands beside it is another region if on the pages that have it, it holds too much
    for the first to hold most there.
    """
    path, others, slot = [], [], wrapper
    while True:
        whole = slot.content()
        best = max(slot.children, key=Slot.content, default=None)
        if best is None or whole == 0 or best.content() < DOMINANT * whole or 2 * best.again > best.pages:
            break
        if best.element.tag in INLINE or not any(c.element.tag not in INLINE | VOID for c in best.children):
            break
        for child in slot.children:
            if child is not best and child.content() * slot.pages >= (1 - DOMINANT) * whole * child.pages:
                others.append([*path, child.element.label])
        path.append(best.element.label)
        slot = best
    return [path, *(p for p in others if p != path[: len(p)])]


def region(wrapper: Slot) -> list[str]:
    """Labels from the root down to the element that holds the article, see ``regions``."""
    return regions(wrapper)[0]


def blocks(element: Element) -> list[str]:
    """Texts of the blocks of an element in turn, white space collapsed, frames left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack = [(iter(element.children), False)]
    while stack:
        children, block = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if block:
                flush()
        elif isinstance(child, str):
            line.append(child)
        elif not child.frames:
            if child.tag not in INLINE:
                flush()
            stack.append((iter(child.children), child.tag not in INLINE))
        elif child.tag not in INLINE:
            flush()
    flush()
    return out


def places(element: Element, paths: list[list[str]]) -> list[Element]:
    """All elements that a path leads to, in turn; none within another."""
    if not all(paths):
        return [element]
    found = []
    for child in element.children:
        if isinstance(child, Element) and not child.frames:
            labels = (child.label, child.widened)
            inner = [p[1:] for p in paths if p[0] in labels]
            if inner:
                found += places(child, inner)
    return found


def main_text(page: str, path: list[str] | None, *others: list[str]) -> str:
    """Article of a page: what stands at the paths, else at the regions of the page by itself."""
    root = parse(page)
    found = [] if path is None else places(root, [path, *others])
    if not found:
        wrapper = Slot(Element("", ""))
        align(wrapper, [root])
        found = places(root, regions(wrapper)) or [root]
    return "\n".join(b for f in found for b in blocks(f))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, paths): the regions of the wrapper of each host of ``pages`` (url, html), as JSON.

    All pages are aligned: each task does so with its own, then the wrappers of a host are merged,
    MERGED at a time. Copies of a page count once. Pages without a host have nothing in common and get
    no wrapper; nor do hosts whose pages have no text that varies, which are read like single pages.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        task, held = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            trees = [json.dumps(packed(w)) for w in known.values()]
            rows = [pa.array(list(known), pa.string()), pa.array([task] * len(known), pa.int64()), pa.array(trees, pa.string())]
            return pa.RecordBatch.from_arrays(rows, names=["host", "number", "tree"])

        for part in slices(batches, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                align(known.setdefault(host, Slot(Element("", ""))), [parse(page)])
            held = sum(w.slots() for w in known.values())
            if held > HELD_SLOTS:
                yield out()
                known.clear()
        yield out()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        first, *rest = (unpacked(json.loads(t)) for t in group["tree"])
        for other in rest:
            merge(first, other)
        return group[["host", "number"]].iloc[:1].assign(tree=json.dumps(packed(first)))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpacked(json.loads(t)) for t in batch.column("tree").to_pylist()]
            paths = [json.dumps(regions(w)) if w.content() else None for w in found]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "paths"])

    host, _ = host_and_path("url")
    kind = "host string, number bigint, tree string"
    trees = written(
        pages.select(host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
        .filter("host <> ''")
        .distinct()
        .mapInArrow(learn, kind),
        "trees",
    )
    while (trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        trees = written(
            trees.withColumn("number", F.floor(F.col("number") / MERGED))
            .groupBy("host", "number")
            .applyInPandas(join, kind),
            "trees",
        )
    return trees.mapInArrow(narrow, "host string, paths string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Blocks of the article are joined by \\n, white space inside a block is one blank, character
    references are decoded; ``text`` is empty for null, empty or markup-only html. A page without
    the regions of its host's wrapper, or without a host, is read by its own; repeated rows and null ids stay, other columns are ignored.
    """
    known = written(wrappers(pages), "wrappers")
    small = known.count() <= BROADCAST_ROWS
    host, _ = host_and_path("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [
                main_text(page or "", *json.loads(paths or "[null]"))
                for page, paths in zip(part.column("html").to_pylist(), part.column("region").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    known = known.withColumnRenamed("paths", "region")
    kind = pages.schema["page_id"].dataType.simpleString()
    return (
        pages.select("page_id", "url", "html", host.alias("host"))
        .join(F.broadcast(known) if small else known, "host", "left")
        .select("page_id", "url", "html", "region")
        .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
    )
