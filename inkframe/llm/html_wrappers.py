"""Main text of web pages with wrappers: templates with slots, optional and repeated parts, inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Elements and words of class, id or role that mark what isn't the article, and how elements break text.
ASIDE = frozenset((
    "head title nav header footer aside form script style noscript template iframe object svg canvas button select option "
    "textarea input label menu dialog fieldset datalist audio video map"
).split())
#: Whole names of class, id or role.
ASIDE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising ad-slot ad-box ad-unit ad-container ad-banner adbox adslot sponsor sponsored "
    "banner cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices alert alerts alertdialog nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs masthead footer site-header site-footer site-navigation main-navigation sidebar "
    "widget-area aside login signup subscribe subscription newsletter share sharing share-bar share-box share-buttons share-links social "
    "social-links related related-posts related-articles related-links related-content search search-form login-form popup modal "
    "toolbar pagination pager contentinfo complementary"
).split())
COMMENTS = frozenset((
    "comment comments comment-body comment-list comment-content comment-respond comments-area comments-section comment-section "
    "comments-list user-comment user-comments reader-comments commentlist reply replies respond disqus disqus_thread"
).split())
HIDDEN = "hidden!"
#: Elements whose class, id or role says nothing of what they hold, and elements whose id is commonly made from a title.
ROOTS = frozenset({"html", "body"})
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What articles are made of, in any order and number: neighbours of these are one repeated group.
FLOW = frozenset("# p h2 h3 h4 h5 h6 ul ol dl dt dd li blockquote pre table figure address hr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr"
).split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Different pages that must agree on a text before it counts as the template's, and their least share of the pages that have
#: a text at its path.
AGREE, SHARE = 8, 0.9
#: Share of a host's pages below which a node of its wrapper is forgotten, pages between two such looks, nesting beyond which elements
#: count as part of what holds them, least likeness of two elements that are the same node, and cells of an alignment of two
#: lists of children beyond which they are aligned by name alone.
SUPPORT, LOOK, DEEPEST, ALIKE, CELLS = 0.005, 512, 120, 0.3, 250_000
#: Share of the mass of an element that one child must hold for the article to be within it, and share of that which
#: article and main elements must hold to be the article.
HOLDS, MAINS = 0.6, 0.5
#: Wrapper bytes of all hosts up to which they are broadcast; beyond, hosts are salted.
BROADCAST, SALTS = 8 << 20, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-z](?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>|</?[a-z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.IGNORECASE)
_MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")


_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_STYLE = re.compile(r"""(?<![\w-])style\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\shidden(?=[\s=/>])", re.IGNORECASE)


def names(tag: str, name: str) -> list[str]:
    """Whole names of class, id and role in lower case, without digits, so that numbered ids are alike; HIDDEN if it isn't shown."""
    found = {
        w for kind, *v in _MARK.findall(tag) if kind.lower() != "id" or name not in TITLED
        for w in _DIGITS.sub("", "".join(v).lower()).split()
    }
    if _ATTRIBUTE.search(_QUOTED.sub("=", tag)) or any(_NONE.search("".join(v)) for v in _STYLE.findall(tag)):
        found.add(HIDDEN)
    return sorted(found)


@lru_cache(1 << 16)
def under(path: int, key: str) -> int:
    """The path of an element within another, as a number that every process gives alike."""
    return int.from_bytes(hashlib.md5(f"{path} {key}".encode(), usedforsecurity=False).digest()[:8], "big", signed=True)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text) of tags and texts in order: keys are `<name words>`, `</name>` or `#`. What holds no text is left out."""
    out = []
    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            if out and out[-1][0] == "#":
                out[-1] = ("#", out[-1][1] + t)
            else:
                out.append(("#", t))
        elif m[1] is None and (name := _NAME.match(t)):
            n = name[1].lower()
            if t[1] == "/":
                out.append((f"</{n}>", ""))
            else:
                words = names(t, n) if "=" in t or "hidden" in t.lower() else []
                out.append((f"<{' '.join([n, *words])}>", ""))
    return [x for x in out if x[0] != "#" or not x[1].isspace()]


def digest(text: str) -> str:
    return hashlib.md5(" ".join(text.split()).encode(), usedforsecurity=False).hexdigest()[:16]


class Run:
    """Text between two blocks: pieces (text, whether it is a link's, path)."""

    __slots__ = ("pieces",)
    key = name = "#"
    aside = 0

    def __init__(self):
        self.pieces: list[tuple[str, bool, int]] = []

    def sizes(self) -> tuple[int, int]:
        n = link = 0
        for text, is_link, _ in self.pieces:
            k = len(text) - text.count(" ")
            n += k
            link += k if is_link else 0
        return n, link


class Element:
    """An element that breaks text. `aside`: 1 if a name or a form marks it as no part of an article, 2 if its element or comments do."""

    __slots__ = ("key", "name", "aside", "kids", "path", "_items", "_mass")

    def __init__(self, key: str, aside: int, path: int):
        self.key, self.name, self.aside, self.path = key, key[1:-1].split(" ", 1)[0], aside, path
        self.kids: list = []
        self._items = self._mass = None

    def items(self) -> list[tuple[str, list]]:
        """Children as the wrapper sees them: neighbours of FLOW are one group `+`, others that follow each other and are alike fold."""
        if self._items is None:
            out: list[tuple[str, list]] = []
            for kid in self.kids:
                if kid.name in FLOW and not kid.aside:
                    if out and out[-1][0] == "+":
                        out[-1][1].append(kid)
                    else:
                        out.append(("+", [kid]))
                elif out and out[-1][0] == kid.key and likeness(kid.key, out[-1][1][0].shape(), kid.shape()) >= ALIKE:
                    out[-1][1].append(kid)
                else:
                    out.append((kid.key, [kid]))
            self._items = out
        return self._items

    def shape(self) -> frozenset[str]:
        """Keys of its children, those of a group by themselves."""
        return frozenset(k for key, members in self.items() for k in ([m.key for m in members] if key == "+" else [key]))

    def mass(self) -> int:
        """Characters outside links and marked parts."""
        if self._mass is None:
            self._mass = sum(k.mass() if isinstance(k, Element) else k.sizes()[0] - k.sizes()[1] for k in self.kids if not k.aside)
        return self._mass

    def below(self, wanted: frozenset[str], marked: bool = False) -> Iterator[Element]:
        """Outermost elements of these names, in unmarked parts unless `marked` (then not in parts marked for good)."""
        for k in self.kids:
            if isinstance(k, Element) and (not k.aside or marked and k.aside == 1):
                if k.name in wanted and not k.aside:
                    yield k
                else:
                    yield from k.below(wanted, marked)


def dom(found: list[tuple[str, str]]) -> Element:
    """The tree of blocks of a token stream. Inline elements and what lies deeper than DEEPEST belong to the block around them."""
    root = Element("<>", 0, 0)
    # Open elements: name, block, whether in a link, whether left out, path.
    stack: list[tuple[str, Element, bool, bool, int]] = [("", root, False, False, 0)]
    opened: Counter = Counter()

    def cut(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def piece(text: str, path: int = 0) -> None:
        _, block, link, out, at = stack[-1]
        if not out:
            if not block.kids or not isinstance(block.kids[-1], Run):
                block.kids.append(Run())
            block.kids[-1].pieces.append((text, link, path or at))

    for key, text in found:
        if key == "#":
            piece(text)
            continue
        if key[1] == "/":
            name = key[2:-1]
            if name not in INLINE:
                piece(" ")
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            continue
        name, *words = key[1:-1].split(" ")
        if name in VOID:
            if name not in INLINE:
                piece(" ")
            continue
        if name not in INLINE:  # an open paragraph ends where a block begins, a list item where the next one begins
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] == name == "li":
                    cut(k)
                elif stack[k][0] in INLINE:
                    continue
                break
        _, block, link, out, path = stack[-1]
        marks = () if name in ROOTS else words
        fixed = (name in ASIDE and name not in ("form", "fieldset")) or not COMMENTS.isdisjoint(marks) or HIDDEN in marks
        aside = 2 if fixed else int(name in ASIDE or not ASIDE_WORDS.isdisjoint(marks))
        path = under(path, key)
        if name in INLINE or len(stack) > DEEPEST:
            if name not in INLINE:
                piece(" ")
            stack.append((name, block, link or name == "a", out or aside > 0, path))
        else:
            new = Element(key, aside, path)
            if not out:
                block.kids.append(new)
            stack.append((name, new, link, out, path))
        opened[name] += 1
    return tidied(root)


def tidied(e: Element) -> Element:
    """Without runs of blanks alone."""
    e.kids = [tidied(k) if isinstance(k, Element) else k for k in e.kids if isinstance(k, Element) or any(not t.isspace() for t, *_ in k.pieces)]
    return e


# A wrapper is a union-free expression as a tree of nodes [key, optional, repeated, pages, characters, link characters, children]. A
# key is a tag's with its names, "#" for a text slot, or "+" for a group of flow elements that repeats in any order. Pages are
# weights, as copies of a page count as one.
KEY, OPTIONAL, REPEATED, PAGES, CHARS, LINKS, KIDS = range(7)


def likeness(key: str, one: frozenset[str], other: frozenset[str]) -> float:
    """Of elements of one key: how many kinds of children they share. A name of their own makes them alike."""
    if " " in key or one == other:
        return 1.0
    return len(one & other) / len(one | other)


def node_shape(node: list) -> frozenset[str]:
    return frozenset(k for kid in node[KIDS] for k in ([x[KEY] for x in kid[KIDS]] if kid[KEY] == "+" else [kid[KEY]]))


def align(one: list[tuple[str, frozenset]], other: list[tuple[str, frozenset]]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of the same node in two lists of (key, shape), in order, so that the likeness of all pairs is largest;
    one is None where only the other list has a node."""
    n, m = len(one), len(other)
    if n == m and all(a[0] == b[0] and (a[0] in ("+", "#") or likeness(a[0], a[1], b[1]) >= ALIKE) for a, b in zip(one, other)):
        return list(zip(range(n), range(n)))
    names = [[k for k, _ in side] for side in (one, other)]
    if n * m > CELLS:
        return by_key(*names)
    if all(len(set(k)) == len(k) for k in names):  # every key once: where pages differ in order or have one or the other, keys decide
        return [x for i, j in by_key(*names) for x in ([(i, j)] if None in (i, j) or names[0][i] in ("+", "#") or likeness(names[0][i], one[i][1], other[j][1]) >= ALIKE else [(i, None), (None, j)])]
    like = [[0.0] * m for _ in range(n)]
    for i, (key, shape) in enumerate(one):
        for j, (k, s) in enumerate(other):
            if k == key:
                x = 0.8 if key in ("+", "#") else likeness(key, shape, s)
                like[i][j] = x if x >= ALIKE else 0.0
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], like[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + own[j] if own[j] else 0.0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def by_key(one: list[str], other: list[str]) -> list[tuple[int | None, int | None]]:
    """The same for groups, whose order says nothing: by key alone, each key once."""
    at, out, seen = {}, [], set()
    for j, k in enumerate(other):
        at.setdefault(k, j)
    for i, k in enumerate(one):
        j = at.get(k)
        out.append((i, j if j is not None and j not in seen else None))
        seen.add(j)
    return [*out, *((None, j) for j in range(len(other)) if j not in seen)]


def merged(a: list, b: list, pages: float | None = None) -> list:
    """The wrapper of what either matches; children that only one has are optional. `pages` if both are of one page."""
    kids, used = [], (a[KIDS], b[KIDS])
    if a[KEY] == "+":
        pairs = by_key([x[KEY] for x in used[0]], [x[KEY] for x in used[1]])
    else:
        pairs = align(*([(x[KEY], node_shape(x) if x[KEY] not in ("+", "#") else frozenset()) for x in u] for u in used))
    for i, j in pairs:
        if i is not None and j is not None:
            kids.append(merged(used[0][i], used[1][j], pages))
        else:
            x = used[0][i] if j is None else used[1][j]
            kids.append([x[KEY], True, *x[REPEATED:]])
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[PAGES] + b[PAGES] if pages is None else pages, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], kids]


def expression(e: Element | Run, weight: float) -> list:
    """The wrapper of one page: repeats side by side are aligned with each other and made one repeated group."""
    if isinstance(e, Run):
        n, link = e.sizes()
        return ["#", False, False, weight, n * weight, link * weight, []]
    if e.aside:
        return [e.key, False, False, weight, 0.0, 0.0, []]
    kids = []
    for key, members in e.items():
        if key == "+":
            found: dict[str, list] = {}
            for m in members:
                x = expression(m, weight)
                found[m.key] = x if m.key not in found else merged(found[m.key], x, weight)
                found[m.key][REPEATED] = found[m.key][REPEATED] or found[m.key] is not x
            kids.append(["+", False, len(members) > len(found), weight, sum(x[CHARS] for x in found.values()), sum(x[LINKS] for x in found.values()), list(found.values())])
        else:
            whole = expression(members[0], weight)
            for m in members[1:]:
                whole = merged(whole, expression(m, weight), weight)
            whole[REPEATED] = whole[REPEATED] or len(members) > 1
            kids.append(whole)
    return [e.key, False, False, weight, sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), kids]


def pruned(node: list, least: float) -> list:
    """Without nodes on fewer pages than `least`: as lossy counting does, what comes up often enough is never lost for good."""
    return [*node[:KIDS], [pruned(k, least) for k in node[KIDS] if k[PAGES] >= least]]


class Extractor:
    """Applies one host's wrapper and its template's texts, pairs (path, digest)."""

    def __init__(self, wrapper: list | None, fixed: set[tuple[int, str]] = frozenset()):
        self.wrapper, self.fixed = wrapper, fixed
        self.paths = {p for p, _ in fixed}
        self.shapes: dict[int, frozenset] = {}

    def _shape(self, node: list) -> frozenset[str]:
        if node[KEY] in ("+", "#"):
            return frozenset()
        if id(node) not in self.shapes:
            self.shapes[id(node)] = node_shape(node)
        return self.shapes[id(node)]

    def matched(self, e: Element, node: list | None) -> list[tuple[str, list, list | None]]:
        """An element's children with the wrapper's nodes for them."""
        items = e.items()
        if node is None or not node[KIDS]:
            return [(key, members, None) for key, members in items]
        own = [(key, members[0].shape() if key != "+" else frozenset()) for key, members in items]
        pairs = align(own, [(k[KEY], self._shape(k)) for k in node[KIDS]])
        return [(*items[i], None if j is None else node[KIDS][j]) for i, j in pairs if i is not None]

    def region(self, e: Element) -> list[Element]:
        """The parts of a page that hold its article.

        From the page downwards, into the child that holds most of the mass - what its node holds on a page of the host, on
        average, outside links - as long as that is HOLDS of it and no headline stays outside. Article and main
        elements are a sign more: where they hold most of that part they are the article, and a part within one is widened to it.
        """
        node, around = self.wrapper, None
        outer = next((m for m in e.below(MAIN, marked=True) if m.mass() > e.mass()), None)
        if outer is not None:  # the article is in a part that a name marks, and larger than all that isn't marked
            return [outer]
        while True:
            total, best = 0.0, (0.0, None, None)
            if e.name in MAIN and around is None:
                around = e
            for key, members, own in self.matched(e, node):
                if members[0].aside:
                    continue
                if own is not None:
                    mass = (own[CHARS] - own[LINKS]) / own[PAGES]
                else:
                    mass = float(sum(m.mass() if isinstance(m, Element) else m.sizes()[0] - m.sizes()[1] for m in members))
                total += mass
                if key != "+" and len(members) == 1 and members[0].name not in HEADINGS and mass > best[0]:
                    best = (mass, members[0], own)
            mass, kid, own = best
            if kid is None or mass < HOLDS * total or not kid.mass() and e.mass():
                break
            if any(True for _ in e.below(frozenset({"h1"}))) and kid.name != "h1" and not any(True for _ in kid.below(frozenset({"h1"}))):
                break
            e, node = kid, own
        if around is not None:
            return [around]
        mains = list(e.below(MAIN))
        return mains if mains and sum(m.mass() for m in mains) >= MAINS * e.mass() else [e]

    def text(self, page: str) -> str:
        root, out = dom(tokens(page)), []

        def told(e: Element, headings: bool) -> None:
            for k in e.kids:
                if isinstance(k, Run):
                    if headings and e.name not in HEADINGS:
                        continue
                    kept = [t for t, _, p in k.pieces if p not in self.paths or (p, digest(t)) not in self.fixed]
                    words = " ".join(entities.unescape("".join(kept)).split())
                    if words:
                        out.append(words)
                elif not k.aside:
                    told(k, headings)
                elif k.key == "<header>":  # of the article's own header, its headlines
                    told(k, True)

        for e in self.region(root):
            inner = Element("<>", 0, 0) if e.aside else e
            inner.kids = e.kids
            told(inner, False)
        return " ".join(out)


def host(url: str = "url"):
    """The host of an address in lower case, without port; the whole text of what is no address; null stays null."""
    found = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.when(found == "", F.col(url)).otherwise(found))


PARTS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("text", pa.string()), ("pages", pa.float64()), ("wrapper", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pages that a task has: the wrapper of each host (path null), the pages of a host with a text at a path (text null), and with
    each text there. Counts are written out early to bound the memory."""
    found: dict = {}
    wrappers: dict[str | None, list] = {}
    seen_pages = 0

    def counts():
        if found:
            h, p, t = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.int64()), pa.array(t, pa.string()), pa.array(found.values(), pa.float64()), pa.nulls(len(h), pa.string())], schema=PARTS)
            found.clear()

    def expressions():
        for name, w in wrappers.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, None, None, w[PAGES], json.dumps(w)), PARTS.types)], schema=PARTS)
        wrappers.clear()

    for b in slices(batches, 64):
        for name, page, share in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("share").to_pylist()):
            root = dom(tokens(page or ""))
            own = expression(root, share)
            wrappers[name] = merged(wrappers[name], own) if name in wrappers else own
            seen, open_ = set(), [root]
            while open_:
                for k in open_.pop().kids:
                    if isinstance(k, Element):
                        open_.append(k)
                    else:
                        for text, _, path in k.pieces:
                            if not text.isspace():
                                seen.add((name, path, None))
                                seen.add((name, path, digest(text)))
            for x in seen:
                found[x] = found.get(x, 0.0) + share
            seen_pages += 1
            if seen_pages % LOOK == 0:
                for name, w in wrappers.items():
                    wrappers[name] = pruned(w, SUPPORT * w[PAGES])
        if len(found) > 200_000:
            yield from counts()
        if len(wrappers) > 4096:
            yield from expressions()
    yield from counts()
    yield from expressions()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers come sorted by host: those of one are merged as they stream by."""
    schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])
    held: tuple | None = None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int32()), pa.array([json.dumps(held[2])], pa.string())], schema=schema)

    for b in batches:
        for name, salt, text in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "wrapper"))):
            own = json.loads(text)
            if held and held[:2] == (name, salt):
                whole = merged(held[2], own)
                held = (name, salt, pruned(whole, SUPPORT * whole[PAGES]))
            else:
                if held:
                    yield told()
                held = (name, salt, own)
    if held:
        yield told()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): the union-free expression of each host's pages and the texts of its template.

    Each task aligns the pages that it has of a host, one after the other, with what it has so far: what mismatches becomes a slot, an
    optional node or a repeated group. Tasks' wrappers are aligned in turn, first in SALTS parts of a host, so that a host with a
    third of all pages is no one task's. Nodes go only by their support over all pages. A text that AGREE different pages
    and SHARE of those with its path have is the template's, any other slot varies. Copies of a page count as one.
    """
    rows = pages.select(host().alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    copies = rows.groupBy("page").count().where("count > 1").select(F.col("page").alias("copied"), "count")
    copies = stored(copies, "copies")
    rows = rows.join(copies, F.col("page") == F.col("copied"), "left")
    rows = rows.select("host", "html", F.coalesce(F.lit(1.0) / F.col("count"), F.lit(1.0)).alias("share"))
    parts = stored(rows.mapInArrow(_parts, "host string, path long, text string, pages double, wrapper string"), "parts")
    counts = parts.where("wrapper is null").groupBy("host", "path", "text").agg(F.sum("pages").alias("pages"))
    counts = stored(counts.where(f"pages > {AGREE - 0.5}"), "counts")
    every = counts.where("text is null").select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("pages").alias("every"))
    same = counts.where("text is not null").join(every, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")))
    same = same.where(F.col("pages") > F.lit(SHARE) * F.col("every") - 1e-6)
    texts = same.groupBy(F.col("host").alias("of")).agg(F.to_json(F.collect_set(F.struct("path", "text"))).alias("texts"))
    trees = parts.where("wrapper is not null").select("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int").alias("salt"), "wrapper")
    for few in (trees.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper"), None):
        if few is None:
            few = trees.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper")
        trees = stored(few.mapInArrow(_aligned, "host string, salt int, wrapper string"), "trees")
    whole = trees.join(texts, F.col("host").eqNullSafe(F.col("of")), "left")
    told = F.concat(F.lit('{"tree":'), F.col("wrapper"), F.lit(',"texts":'), F.coalesce("texts", F.lit("[]")), F.lit("}"))
    return stored(whole.select("host", told.alias("wrapper")), "wrappers")


def opened(wrapper: str | None) -> Extractor:
    w = json.loads(wrapper) if wrapper else {"tree": None, "texts": []}
    return Extractor(w["tree"], {(x["path"], x["text"]) for x in w["texts"]})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page: the article's blocks, one space between them.

    The article is the part of the page that holds most of what its host's wrapper shows as varying text outside links; without
    what the template's texts are, and without the parts that elements or whole names of class, id or role mark as menu,
    header, footer, sidebar, notice, advert, form or comments, or as not shown. Of a header within the article its headlines stay.

    Null or empty html gives an empty text. Null addresses share one wrapper, and a host with a single page has its own page's.
    Repeated rows stay. Pages of any length and nesting are read whole. An empty table gives no rows.
    """
    wrappers = infer_wrappers(pages)
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    named = wrappers.select(F.col("host").alias("of"), "wrapper")
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(named), F.col("host").eqNullSafe(F.col("of")), "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)))
        named = named.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(named, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        known: dict = {}
        for b in slices(batches, 64):
            texts = []
            for page, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                if w not in known:
                    if len(known) > 256:
                        known.clear()
                    known[w] = opened(w)
                texts.append(known[w].text(page or ""))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
