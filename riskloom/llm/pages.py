"""HTML extraction by wrapper induction.

Every page becomes a tree of its block elements in which a run of equal
siblings is one repeated node. Pages of a host are aligned with reference
pages of that host by simple tree matching: a single node with the same text
in the references is template, a node whose text varies, and every repeated
node, is content. Elements whose name, role or class says what they are
(menus, footers, adverts, comments, forms, ...) are furniture wherever they
stand, since their text may vary as well.

Up to ``REFERENCES`` pages per host, spread over the host by a hash, are its
frames. Every page of the host is aligned with the frame that it fits best and
says which text it has at each single node of that frame; the texts at a node
are counted over all pages, near copies once. A text that ``CONSTANT`` of them
agree on is template; any other text there is content. Only a node that fewer
than ``ENOUGH`` different pages hold, as on hosts of a few pages, is decided
by the frames themselves: two must agree with the page and none differ, where
a frame that shares most of the blocks that are the page's own (not on most
frames) is a copy and no evidence.
The frames are broadcast when their measured size allows; else pages are dealt
by host, but those of hot hosts, which are bounded in number, stay in place.

Cases: null or empty html gives an empty text; a page without a host (null or
relative url) is extracted by its elements alone; unclosed and stray tags are
repaired; repeated rows are extracted one by one; a null id is returned as
null; only id, url and html are read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textkit as T
from riskloom.llm.graph import spread_join
from riskloom.session import cut_lineage

REFERENCES = 6         # alignment frames of a host; the evidence is all its pages
ENOUGH = 8             # different pages at a node from which their counts decide
CONSTANT = 0.9         # share of them that a template text has at least
AGREE = 2              # references that must agree on a template node
COPY_SHARE = 0.5       # a page's own blocks shared beyond this: a copy, no evidence
COMMON_SHARE = 2 / 3   # references with a block beyond this: the host's, not a page's own
BROADCAST_CHARS = 32 << 20
SLOT_BYTES = 48        # of one decided node in a broadcast row
LINK_SHARE = 0.5       # without an article, a block of mostly links is a menu

# Fixed vocabulary of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
    p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("caption html body td th tr tbody thead tfoot legend summary li dt dd".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table td th article section div main aside body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Elements, roles and class or id words that are never article text.
DROP_TAGS = frozenset("""nav footer aside form script style textarea title noscript iframe template head
    button select input svg canvas object audio video dialog menu xmp map datalist""".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROP_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
    banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent
    notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing
    social related recommended comment comments respond disqus discussion pagination pager toolbar widget
    copyright form search""".split())
# Words that may stand beside those in a compound name: "site-footer" is a
# footer, "form-of-government" is no form.
PLAIN_WORDS = frozenset("""site page main top bottom left right box block bar list item items link links button
    buttons wrap wrapper container inner outer area section panel slot unit post posts article articles story
    stories content header title text body row col column group holder region global primary secondary small
    large big inline mobile desktop sticky fixed floating js id the our my a more also read you may like policy
    message user reader entry entries module count counter bottom icon icons media tag tags""".split())
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
CONTENT_WORDS = frozenset("content article post entry story maincontent".split())

# a quote opens a value only after "="; elsewhere, and inside a bare value, it is a character
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Node:
    tag: str
    label: str
    furniture: bool = False
    region: int = 0            # 3 article, 2 main, 1 content container
    children: list = field(default_factory=list)  # Node, or Text


@dataclass
class Text:
    """One block of running text."""

    value: str
    linked: int                # characters inside links


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


def _says_furniture(names: str, whole_only: bool = False) -> bool:
    """Whether a class or id names furniture: a whole name of the list, or a
    compound of such words and plain ones."""
    for name in names.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        named = [w in DROP_WORDS or w.isdigit() for w in parts]
        if not any(w in DROP_WORDS for w in parts):
            continue
        if all(named) or (not whole_only and all(n or w in PLAIN_WORDS for n, w in zip(named, parts, strict=True))):
            return True
    return False


def _node(tag: str, raw: str) -> Node:
    if not raw or raw == "/":
        return Node(tag, tag, tag in DROP_TAGS, {"article": 3, "main": 2}.get(tag, 0))
    at = _attributes(raw)
    named = at.get("class", "") + " " + at.get("id", "")
    words, role = _words(named), at.get("role", "").lower()
    furniture = tag in DROP_TAGS or role in DROP_ROLES or "hidden" in at \
        or at.get("aria-hidden", "").lower() == "true" \
        or "display:none" in at.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body", "main"):
        furniture = False
    elif tag == "article":
        furniture = bool(words & COMMENT_WORDS)
    else:
        furniture = furniture or _says_furniture(named, tag == "p" or tag in HEADINGS)
    region = {"article": 3, "main": 2}.get(tag, 0)
    if role == "main" or at.get("itemprop") == "articleBody":
        region = 2
    elif not region and words & CONTENT_WORDS:
        region = 1
    return Node(tag, tag + "." + ".".join(sorted(words)), furniture, region)


def parse(html: str) -> Node:
    """The tree of block elements; inline elements only mark links."""
    root = Node("#", "#")
    stack, text, state = [root], [], {"links": 0, "linked": 0}

    def flush() -> None:
        value = " ".join("".join(text).split())
        text.clear()
        if value:
            stack[-1].children.append(Text(value, min(state["linked"], len(value))))
        state["linked"] = 0

    def say(raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        text.append(piece)
        if state["links"]:
            state["linked"] += len(" ".join(piece.split()))

    def pop_to(tags: tuple[str, ...], stops: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                state["links"] = max(0, state["links"] - 1)
            elif tag in BLOCK or tag in DROP_TAGS:
                pop_to((tag,))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            state["links"] += 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK or tag in DROP_TAGS:
            if tag in CLOSES_P:
                pop_to(("p",), SCOPE)
            if tag in ENDS:
                pop_to(ENDS[tag], SCOPE - frozenset(ENDS[tag]))
            flush()
            if tag in VOID:
                continue
            node = _node(tag, m[3])
            stack[-1].children.append(node)
            if not m[3].endswith("/"):
                stack.append(node)
        elif tag not in VOID and "class" in m[3] and _says_furniture(_attributes(m[3]).get("class", "")):
            # an inline advert or the like: a node of its own until it closes
            flush()
            node = _node(tag, m[3])
            stack[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else at
    flush()
    return root


# ----------------------------------------------------------- tree matching

@dataclass
class Shape:
    """Compact tree in preorder: depth, label, whether repeated, and the hash
    of the node's own text (none for repeated nodes)."""

    depth: list
    label: list
    many: list
    own: list
    blocks: list               # hashes of all text blocks of the page

    def key(self) -> str:
        return "|".join(f"{d}{x}{'+' * m}" for d, x, m in zip(self.depth, self.label, self.many, strict=True))

    def dump(self) -> str:
        return json.dumps([self.depth, self.label, self.many, self.own, self.blocks])


def _hash(value: str) -> int:
    return xxhash.xxh32_intdigest(value.encode())


def shape_of(root: Node) -> tuple[Shape, dict[int, int]]:
    """The compact tree, and the compact index of each single text block
    (by identity). Blocks under a repeated node have none."""
    shape, index = Shape([], [], [], [], []), {}

    def labels_of(node: Node) -> list[str]:
        return ["#text" if isinstance(k, Text) else k.label for k in node.children]

    # (node, its depth, inside a repeated node, next child, labels): no recursion, pages may be deep
    stack = [(root, 0, False, 0, labels_of(root))]
    while stack:
        node, depth, inside, i, labels = stack.pop()
        while i < len(labels):
            kid, label = node.children[i], labels[i]
            is_text = label == "#text" and isinstance(kid, Text)
            if is_text:
                shape.blocks.append(_hash(kid.value))
            again = i > 0 and labels[i - 1] == label
            many = again or (i + 1 < len(labels) and labels[i + 1] == label)
            i += 1
            hidden = again or inside
            if not hidden:
                shape.depth.append(depth)
                shape.label.append(label)
                shape.many.append(int(many))
                shape.own.append(_hash(kid.value) if is_text and not many else None)
                if is_text and not many:
                    index[id(kid)] = len(shape.depth) - 1
            if not is_text:
                stack.append((node, depth, inside, i, labels))
                stack.append((kid, depth + 1, True if hidden else many, 0, labels_of(kid)))
                break
    return shape, index


def _kids(depth: list) -> list[list[int]]:
    """Children of each node; the last entry has the roots."""
    out: list[list[int]] = [[] for _ in range(len(depth) + 1)]
    path: list[int] = []
    for i, d in enumerate(depth):
        del path[d:]
        out[path[-1] if path else len(depth)].append(i)
        path.append(i)
    return out


def tree_match(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """Simple tree matching: the largest order- and ancestor-preserving
    matching of equal labels, as pairs of preorder indices."""
    ka, kb = _kids(a.depth), _kids(b.depth)
    score: dict[tuple[int, int], int] = {}

    def table(xs: list[int], ys: list[int]) -> list[list[int]]:
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y))
        return m

    def match(x: int, y: int) -> int:
        return score.get((x, y), 0)

    # pairs of equal labels under pairs of equal labels, level by level, then
    # scored from the deepest level up
    levels = [[(x, y) for x in ka[-1] for y in kb[-1] if a.label[x] == b.label[y]]]
    while levels[-1]:
        levels.append([(x, y) for p, q in levels[-1] for x in ka[p] for y in kb[q] if a.label[x] == b.label[y]])
    for level in reversed(levels):
        for x, y in level:
            score[x, y] = 1 + table(ka[x], kb[y])[-1][-1]

    pairs: list[tuple[int, int]] = []
    todo = [(ka[-1], kb[-1])]
    while todo:
        xs, ys = todo.pop()
        m = table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            gain = match(xs[i - 1], ys[j - 1])
            if gain and m[i][j] == m[i - 1][j - 1] + gain:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
                todo.append((ka[xs[i]], kb[ys[j]]))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


class Wrapper:
    """The frames of a host, the alignments met so far, and what the counts
    over all its pages say: the template text of a (frame, node), None where
    the texts vary."""

    def __init__(self, dumps: list[str], slots: list[dict] | None = None):
        self.slots = {(x["frame"], x["node"]): x["own"] for x in slots or []}
        self.shapes = [Shape(*json.loads(d)) for d in sorted(set(dumps))]
        self.blocks = [set(s.blocks) for s in self.shapes]
        counts = Counter(x for blocks in self.blocks for x in blocks)
        most = max(AGREE, math.ceil(COMMON_SHARE * len(self.shapes)))
        self.common = {x for x, n in counts.items() if n >= most}
        self.aligned: dict[str, list[list[tuple[int, int]]]] = {}

    def alignments(self, shape: Shape) -> list[list[tuple[int, int]]]:
        """The pairs (node of the page, node of the frame), by frame."""
        key = shape.key()
        if key not in self.aligned:
            if len(self.aligned) >= 256:
                self.aligned.clear()
            self.aligned[key] = [tree_match(shape, s) for s in self.shapes]
        return self.aligned[key]

    def frame(self, shape: Shape) -> int:
        """The frame that the page fits best, the first of equals."""
        fit = [len(pairs) / (len(shape.depth) + len(ref.depth) or 1)
               for pairs, ref in zip(self.alignments(shape), self.shapes, strict=True)]
        return fit.index(max(fit))

    def evidence(self, shape: Shape) -> tuple[int, int, list[tuple[int, int]]] | None:
        """What the page says about its host: its frame, the least of its own
        blocks (the same on near copies, mostly), and (node, text) at the
        nodes of the frame; None for a page without blocks of its own."""
        mine = set(shape.blocks) - self.common
        if not mine or not self.shapes:
            return None
        best = self.frame(shape)
        return best, min(mine), [(y, shape.own[x]) for x, y in self.alignments(shape)[best] if shape.own[x] is not None]

    def template(self, shape: Shape) -> set[int]:
        """Compact indices of the page's nodes that are template."""
        if len(self.shapes) < AGREE or not any(x is not None for x in shape.own):
            return set()
        # what most references hold says nothing about copies
        mine = set(shape.blocks) - self.common
        if not mine:
            return set()
        found = self._by_frames(shape, mine)
        best = self.frame(shape) if self.slots else 0
        for x, y in self.alignments(shape)[best]:
            if (best, y) in self.slots and shape.own[x] is not None:
                found.discard(x)
                if shape.own[x] == self.slots[best, y]:
                    found.add(x)
        return found

    def _by_frames(self, shape: Shape, mine: set[int]) -> set[int]:
        same: dict[int, int] = {}
        other: set[int] = set()
        for ref, blocks, pairs in zip(self.shapes, self.blocks, self.alignments(shape), strict=True):
            if len(mine & blocks) > COPY_SHARE * len(mine):
                continue
            for x, y in pairs:
                if shape.own[x] is not None:
                    if shape.own[x] == ref.own[y]:
                        same[x] = same.get(x, 0) + 1
                    else:
                        other.add(x)
        return {x for x, n in same.items() if n >= AGREE and x not in other}


# -------------------------------------------------------------- extraction

def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    root = parse(html)
    template: set[int] = set()
    index: dict[int, int] = {}
    if wrapper is not None:
        shape, index = shape_of(root)
        template = wrapper.template(shape)
    best = 0
    todo = [root]
    while todo:  # the best kind of region that is there, outside furniture
        node = todo.pop()
        best = max(best, node.region)
        todo += [k for k in node.children if isinstance(k, Node) and not k.furniture]
    out: list[str] = []

    # children in page order from a stack, so the last child goes on it first
    todo = [(root, root, best == 0, False)]
    while todo:
        node, parent, inside, header = todo.pop()
        if isinstance(node, Node):
            inside = inside or node.region == best
            header = header or node.tag == "header"
            todo += [(kid, node, inside, header) for kid in reversed(node.children)
                     if isinstance(kid, Text) or not kid.furniture]
        elif inside and not (header and parent.tag not in HEADINGS) and index.get(id(node)) not in template:
            if best > 1 or node.linked <= LINK_SHARE * len(node.value):
                out.append(node.value)
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url, '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def wrappers(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """(host, refs): the shapes of up to ``REFERENCES`` pages of each host,
    each the least by a hash in its salt. A task sends on at most one page of
    a host and salt, whatever it has read."""
    h = F.xxhash64(F.col(page), F.col(url))
    chosen = (pages.select(host_of(F.col(url)).alias("host"), F.pmod(h, F.lit(REFERENCES)).alias("_salt"),
                           F.struct(h.alias("h"), F.col(page).alias("p"), F.col(html).alias("html")).alias("_page"))
              .filter((F.col("host") != "") & F.col("_page.p").isNotNull())
              .groupBy("host", "_salt").agg(F.min("_page").alias("_page"))
              .select("host", F.col("_page.html").alias("_html")))

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        found = [shape_of(parse(t))[0].dump() for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), T.string_column(found)], ["host", "shape"])

    shapes = T.map_texts(chosen, run, "host string, shape string", "_html")
    return shapes.groupBy("host").agg(F.array_sort(F.collect_set("shape")).alias("refs"))


def with_wrappers(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Every page with the references of its host. The table is broadcast
    when its measured size allows; beyond that pages are dealt by host, and
    those of hot hosts stay in place."""
    width = F.length(F.concat_ws("", "refs"))
    if "slots" in table.columns:
        width = width + SLOT_BYTES * F.coalesce(F.size("slots"), F.lit(0))
    size = table.agg(F.sum(width).alias("n")).collect()[0]["n"] or 0
    if size <= BROADCAST_CHARS:
        return rows.join(F.broadcast(table), "host", "left")
    return spread_join(rows, table, "host", "left")


class _Hosts:
    """The wrappers of the hosts that a task met last."""

    def __init__(self):
        self.known: dict[str, Wrapper] = {}

    def __call__(self, host: str, refs: pa.Scalar, slots: pa.Scalar | None = None) -> Wrapper:
        if host not in self.known:
            if len(self.known) >= 200:
                self.known.clear()
            self.known[host] = Wrapper(refs.as_py() or [], slots.as_py() if slots is not None else None)
        return self.known[host]


def slots(pages: DataFrame, table: DataFrame, url: str, html: str) -> DataFrame:
    """(host, slots): per host the (frame, node, own) of every frame node that
    at least ``ENOUGH`` different pages hold, with the text hash that
    ``CONSTANT`` of them agree on, null where there is none. All pages are
    counted; pages with the same least own block count once per text."""
    inner = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("_html")).filter("host <> ''")
    rows = with_wrappers(inner, table).filter(F.col("refs").isNotNull()).select("host", "refs", "_html")

    def run(batches):
        wrapper = _Hosts()
        for batch in batches:
            for part, texts in T.slices(batch, "_html"):
                hosts, refs = part.column(0).to_pylist(), part.column(1)
                found: set[tuple[str, int, int, int, int]] = set()
                for i, value in enumerate(texts.to_pylist()):
                    said = wrapper(hosts[i], refs[i]).evidence(shape_of(parse(value))[0]) if value else None
                    if said is not None:
                        found.update((hosts[i], said[0], y, own, said[1]) for y, own in said[2])
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int32()] * 2, *[pa.int64()] * 2), strict=True)],
                    ["host", "frame", "node", "own", "sign"])

    seen = rows.mapInArrow(run, "host string, frame int, node int, own long, sign long")
    texts = seen.distinct().groupBy("host", "frame", "node", "own").agg(F.count(F.lit(1)).alias("n"))
    nodes = (texts.groupBy("host", "frame", "node")
             .agg(F.sum("n").alias("_all"), F.max(F.struct("n", "own")).alias("_top")).filter(F.col("_all") >= ENOUGH))
    constant = F.when(F.col("_top.n") >= CONSTANT * F.col("_all"), F.col("_top.own")).alias("own")
    return nodes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("frame", "node", constant))).alias("slots"))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text, n_chars): one row per input row."""
    inner = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"),
                         host_of(F.col(url)).alias("host"))
    frames = cut_lineage(wrappers(pages, page, url, html))
    table = cut_lineage(frames.join(slots(pages, frames, url, html), "host", "left"))
    rows = with_wrappers(inner, table).select("page_id", "url", "_html", "host", "refs", "slots")
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (page, url))

    def run_all(batches):
        wrapper = _Hosts()
        for batch in batches:
            for part, texts in T.slices(batch, "_html"):
                hosts, refs, decided = part.column(3).to_pylist(), part.column(4), part.column(5)
                found = [main_text(value, wrapper(hosts[i], refs[i], decided[i]))
                         for i, value in enumerate(texts.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), T.string_column(found),
                     pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = rows.mapInArrow(run_all, f"page_id {id_type}, url {url_type}, text string, n_chars long")
    return out.select(F.col("page_id").alias(page), F.col("url").alias(url), "text", "n_chars")
