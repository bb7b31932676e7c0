"""Main text of web pages by inferred wrappers.

A page becomes a tree of blocks. A host's wrapper is a union-free expression over such trees: same-host pages are aligned
one after another, level by level; siblings that repeat become a repeated group, parts that only some pages have become
optional, and texts that differ become text slots, while texts that stay the same are template text. Every slot counts the
characters outside links that it holds.

The wrapper says which part of the pages is the article: the innermost element that holds most of the text that differs
from page to page. Menus are links, notices stay the same and adverts are short, so none of them needs a telling name.
Elements that say what they are (article, main) and class names only settle what the differences leave open. A page's
article is found by aligning the page with its host's wrapper once more.
"""

from __future__ import annotations

import hashlib
import html
import json
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_or_not, staged, table, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul template object button".split()
)
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas menu dialog search noembed noframes xmp audio video map datalist".split())
#: A new element of the key's kind ends open ones of the listed kinds, up to the nearest of the last kinds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select", "datalist")),
}
#: Words of class, id and role that mark what isn't the article, and those that mark the article.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus reply replies respond discussion "
    "share sharing social related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination pager skip search complementary contentinfo topbar".split()
)
MAIN = frozenset("content article post entry story maincontent main text body".split())
#: Blocks of running text: neighbours of one kind repeat, and the article is never one of them but what holds them.
FLOW = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption address details summary hgroup legend fieldset".split())
HEADINGS = frozenset("h1 h2 h3".split())
_BIT = {t: 1 << k for k, t in enumerate(sorted(BLOCK | {"#"}))}
_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    regex.S,
)
_ATTR = regex.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_WORDS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {t: regex.compile(rf"</{t}\b[^>]*>|\Z", regex.I) for t in RAW}


class Node:
    """An element that holds blocks, or a text (tag "#", with its characters and how many of them are in links)."""

    __slots__ = ("tag", "key", "label", "kids", "text", "linked")

    def __init__(self, tag: str, key: str = "", label: str = "", text: str = "", linked: int = 0) -> None:
        self.tag, self.key, self.label, self.text, self.linked = tag, key, label, text, linked
        self.kids: list[Node] = []


def _described(tag: str, attrs: str) -> tuple[str, str]:
    """Class words without digits; "-" or "+" if tag, class, id or role mark the element as other than the article or as it."""
    if not attrs or "=" not in attrs:
        return "", "-" if tag in DROPPED else ""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]
    words = {w.lower() for _, v in found for w in _WORDS.findall(v)}
    key = " ".join(sorted({c for n, v in found if n == "class" for c in v.split() if c.isalpha()}))
    if tag in DROPPED or words & NOT_MAIN and tag not in ("body", "html", "article", "main") or "comment" in words or "comments" in words:
        return key, "-"
    return key, "+" if words & MAIN else ""


def parse(page: str) -> Node:
    """Tree of the page: elements that are blocks, or are marked as other than the article; texts between them."""
    root = Node("html")
    open_: list[tuple[str, Node]] = [("html", root)]
    opened = Counter(html=1)  # of each tag: an end tag that ends nothing looks for nothing
    buffer: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                open_[-1][1].kids.append(Node("#", text=text, linked=min(linked, len(text))))
        linked, in_link = 0, False

    def close(at: int) -> None:
        if any(t in BLOCK or n is not open_[at - 1][1] for t, n in open_[at:]):
            flush()
        for t, _ in open_[at:]:
            opened[t] -= 1
        del open_[at:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            buffer.append(text)
            if in_link:
                linked += len(text)
            continue
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"]:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                in_link = False
            if opened[tag]:
                for k in range(len(open_) - 1, 0, -1):
                    t = open_[k][0]
                    if t == tag:
                        close(k)
                        break
                    if t in ("table", "article", "main", "body") and tag not in ("table", "article", "main", "body", "html", "div", "section"):
                        break
            continue
        if tag in ("br", "wbr", "img"):
            buffer.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end()
            continue
        if tag in ("html", "body") and opened[tag]:
            if tag == "body" or len(open_) > 1:
                continue
        if tag == "html":
            continue
        if opened["head"] and (tag == "body" or tag in BLOCK and tag not in ("head", "noscript", "template") and open_[-1][0] == "head"):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "head":
                    close(k)
        if tag in BLOCK and opened["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] in ("table", "td", "th", "button", "object", "caption"):
                    break
        if tag in ENDS:
            kinds, walls = ENDS[tag]
            lowest = None
            if any(opened[x] for x in kinds):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] in walls:
                        break
                    if open_[k][0] in kinds:
                        lowest = k
            if lowest:
                close(lowest)
        key, label = _described(tag, m["attrs"])
        parent = open_[-1][1]
        if tag in BLOCK or label == "-":
            flush()
            node = Node(tag, key, label)
            parent.kids.append(node)
            open_.append((tag, node))
        else:
            in_link = in_link or tag == "a"
            open_.append((tag, parent))
        opened[tag] += 1
        if m["attrs"].endswith("/") and tag == "svg":
            close(len(open_) - 1)
    flush()
    return root


class Part:
    """A part of a wrapper: an element, a text slot (tag "#"), or a repeated group of either.

    rep, opt: repeated, optional. mask: the tags of its children. Of a slot: digest (None if the text differs between
    pages), mass (characters outside links, over all pages), seen (pages). nodes: of a page's own wrapper, what it stands for.
    """

    __slots__ = ("tag", "key", "label", "rep", "opt", "mask", "digest", "mass", "seen", "kids", "nodes")

    def __init__(self, tag: str, key: str, label: str, rep: int, opt: int, mask: int, digest: str | None, mass: int, seen: int, kids: list[Part], nodes: list[Node] | None = None) -> None:
        self.tag, self.key, self.label, self.rep, self.opt, self.mask = tag, key, label, rep, opt, mask
        self.digest, self.mass, self.seen, self.kids, self.nodes = digest, mass, seen, kids, nodes


def deep() -> None:
    """Trees are as deep as pages nest their elements; recursion here is in Python only, which takes no C stack."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)


def _digest(*texts_: str) -> str:
    return hashlib.blake2b("\0".join(texts_).encode(), digest_size=6).hexdigest()


def _mask(kids: list[Part]) -> int:
    mask = 0
    for k in kids:
        mask |= _BIT.get(k.tag, 0)
    return mask


def wrapper_of(node: Node) -> Part:
    """A page's own wrapper; elements marked as other than the article are left out."""
    if node.tag == "#":
        return Part("#", "", "", 0, 0, 0, _digest(node.text), len(node.text) - node.linked, 1, [], [node])
    kids = _collapsed([wrapper_of(c) for c in node.kids if c.label != "-"])
    return Part(node.tag, node.key, node.label, 0, 0, _mask(kids), None, 0, 1, kids, [node])


def _like(a: Part, b: Part) -> bool:
    """Whether neighbours are members of one group: blocks of text by their tag, others by class words and shape too."""
    return a.tag == b.tag and (a.tag in FLOW or a.key == b.key and a.mask == b.mask)


def _collapsed(kids: list[Part]) -> list[Part]:
    """Neighbouring siblings that are alike, and neighbouring equal runs of up to three, become repeated ones."""
    for period in (1, 2, 3):
        if len(kids) < 2 * period:
            break
        out: list[Part] = []
        for c in kids:
            out.append(c)
            if len(out) >= 2 * period and all(_like(out[-k - period], out[-k]) for k in range(1, period + 1)):
                if period > 1 and all(_like(out[-1], x) for x in out[-period:-1]):
                    continue
                for k in range(period):
                    one = out[-2 * period + k] = _joined(out[-2 * period + k], out[-period + k], True)
                    one.rep = 1
                del out[-period:]
        kids = out
    return kids


def _joined(a: Part, b: Part, one_page: bool) -> Part:
    """The smallest expression of this kind that both match. Texts of one page's group stand together; those of two
    pages at one place are compared."""
    if a.tag == "#":
        if one_page:
            digest = _digest(a.digest, b.digest) if a.digest and b.digest else None
        else:
            digest = a.digest if a.digest == b.digest else None
        kids, mask = [], 0
    else:
        digest, kids = None, _aligned(a.kids, b.kids, one_page)
        mask = _mask(kids)
    seen = max(a.seen, b.seen) if one_page else a.seen + b.seen
    nodes = [*a.nodes, *b.nodes] if one_page and a.nodes and b.nodes else None
    return Part(a.tag, a.key if a.key == b.key else "", a.label or b.label, a.rep | b.rep, a.opt | b.opt, mask, digest, a.mass + b.mass, seen, kids, nodes)


def merged(a: Part, b: Part) -> Part:
    """The wrapper of the pages of both."""
    deep()
    return _joined(a, b, False)


#: Of lists with more pairs than this, the elements that are alone of their kind are matched first, the rest between them.
CELLS = 4_096


def _worth(a: Part, b: Part) -> int:
    """How well two parts match, 0: not at all. Shape counts, class words settle ties."""
    if a.tag != b.tag:
        return 0
    union = (a.mask | b.mask).bit_count()
    return 8 + (8 * (a.mask & b.mask).bit_count() // union if union else 8) + (2 if a.key == b.key else 0 if not (a.key and b.key) else -2)


def pairs(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """Places of a and b that belong together, ascending in both."""
    n, m = len(a), len(b)
    head = 0
    same = lambda x, y: x.tag == y.tag and x.mask == y.mask and x.key == y.key
    while head < min(n, m) and same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(n, m) - head and same(a[n - 1 - tail], b[m - 1 - tail]):
        tail += 1
    out = [(k, k) for k in range(head)]
    out += [(head + i, head + j) for i, j in _between(a[head : n - tail], b[head : m - tail])]
    return out + [(n - k, m - k) for k in range(tail, 0, -1)]


def _between(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n * m <= CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                w = _worth(a[i], b[j])
                best[i][j] = max(best[i + 1][j + 1] + w if w else 0, best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n and j < m:
            w = _worth(a[i], b[j])
            if w and best[i][j] == best[i + 1][j + 1] + w:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
        return out
    kinds_a, kinds_b = ([(x.tag, x.mask, x.key) for x in side] for side in (a, b))
    once_a, once_b = (Counter(k) for k in (kinds_a, kinds_b))
    place = {k: j for j, k in enumerate(kinds_b) if once_b[k] == 1}
    met = [(i, place[k]) for i, k in enumerate(kinds_a) if once_a[k] == 1 and k in place]
    ends: list[int] = []  # longest ascending run of places in b
    last: list[int] = []
    before = [-1] * len(met)
    for k, (_, j) in enumerate(met):
        at = bisect_left(ends, j)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
        before[k] = last[at - 1] if at else -1
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(met[k])
        k = before[k]
    chain.reverse()
    if not chain:  # nothing stands out: halves with halves, by order
        half = (n + 1) // 2, (m + 1) // 2
        return _between(a[: half[0]], b[: half[1]]) + [(half[0] + i, half[1] + j) for i, j in _between(a[half[0] :], b[half[1] :])]
    out, i0, j0 = [], 0, 0
    for i, j in [*chain, (n, m)]:
        out += [(i0 + x, j0 + y) for x, y in _between(a[i0:i], b[j0:j])]
        if i < n:
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def _aligned(a: list[Part], b: list[Part], one_page: bool) -> list[Part]:
    out: list[Part] = []
    i = j = 0

    def only(x: Part) -> Part:
        return Part(x.tag, x.key, x.label, x.rep, 1, x.mask, x.digest, x.mass, x.seen, x.kids, x.nodes)

    for x, y in [*pairs(a, b), (len(a), len(b))]:
        out += [only(p) for p in a[i:x]]
        out += [only(p) for p in b[j:y]]
        if x < len(a):
            out.append(_joined(a[x], b[y], one_page))
        i, j = x + 1, y + 1
    return _collapsed(out)


def packed(w: Part) -> str:
    """A wrapper as flat JSON: its parts in order, each with its depth."""
    rows, stack = [], [(0, w)]
    while stack:
        depth, x = stack.pop()
        rows.append([depth, x.tag, x.key, x.label, x.rep, x.opt, x.digest, x.mass, x.seen])
        stack += [(depth + 1, k) for k in reversed(x.kids)]
    return json.dumps(rows, separators=(",", ":"))


def unpacked(text: str) -> Part:
    path: list[Part] = []
    for depth, tag, key, label, rep, opt, digest, mass, seen in json.loads(text):
        one = Part(tag, key, label, rep, opt, 0, digest, mass, seen, [])
        del path[depth:]
        if path:
            path[-1].kids.append(one)
            path[-1].mask |= _BIT.get(tag, 0)
        path.append(one)
    return path[0]


def _masses(w: Part, pages: int) -> dict[int, int]:
    """By id of each part: characters outside links of its slots whose text differs between pages (all, of a lone page)."""
    out: dict[int, int] = {}

    def walk(x: Part, every: bool) -> int:
        own = x.mass if every or x.digest is None or x.seen == 1 else 0
        out[id(x)] = own + sum([walk(k, every) for k in x.kids])
        return out[id(x)]

    if not walk(w, pages == 1):
        walk(w, True)
    return out


def _path_to(w: Part, wanted: Part) -> list[int]:
    """Places of the children that lead to a part."""
    stack: list[tuple[Part, list[int]]] = [(w, [])]
    while stack:
        x, path = stack.pop()
        if x is wanted:
            return path
        stack += [(k, [*path, i]) for i, k in enumerate(x.kids)]
    return []


def rules(w: Part, pages: int) -> dict:
    """Where the article is in a wrapper: per level the children's kinds, the place to go on with, and headings beside it.

    The innermost container that holds over half of the differing text; an article or main element around it, or in it
    with a fifth of that text, takes its place; so does, if the differences single out nothing, one with a telling class.
    """
    deep()
    mass = _masses(w, pages)
    total = mass[id(w)]
    x, chain = w, [w]
    while True:
        inner = max(x.kids, key=lambda k: mass[id(k)], default=None)
        if inner is None or inner.tag in FLOW or inner.rep or 2 * mass[id(inner)] <= total:
            break
        x = inner
        chain.append(x)
    open_ = x.tag in ("html", "body")  # the differences single out nothing
    told = [k for k in chain if k.tag == "article"][:1] or [k for k in chain if k.tag == "main"][:1]
    for ok in () if told else (lambda k: k.tag == "article", lambda k: k.tag == "main", lambda k: open_ and k.label == "+" and k.tag in ("div", "section", "td")):
        told = _outermost(x, ok)
        if told and (open_ or 5 * sum(mass[id(k)] for k in told) >= total):
            break
        told = []
    return {"paths": [_levels(w, k, [] if told else HEADINGS, pages) for k in told or [x]]}


def _outermost(w: Part, ok: Callable[[Part], bool]) -> list[Part]:
    out, stack = [], list(reversed(w.kids))
    while stack:
        k = stack.pop()
        if ok(k):
            out.append(k)
        else:
            stack += reversed(k.kids)
    return out


def _levels(w: Part, part: Part, headings: Iterable[str], pages: int) -> list:
    """Per level above the part: the children's kinds, the place to go on with, and differing headings before it."""
    out, at = [], w
    for i in _path_to(w, part):
        beside = [j for j, k in enumerate(at.kids[:i]) if k.tag in headings and at.tag not in ("html", "body") and (pages == 1 or any(s.digest is None for s in k.kids))]
        out.append([[[k.tag, k.key, k.mask] for k in at.kids], i, beside])
        at = at.kids[i]
    return out


def _nodes_at(own: Part, levels: list) -> list[Node]:
    """Of a page's own wrapper: the article's elements, and headings beside them; none if it isn't there."""
    at, beside = [own], []
    for kinds, i, headings in levels:
        parts = [Part(t, k, "", 0, 0, m, None, 0, 0, []) for t, k, m in kinds]
        onward = []
        for x in at:
            place = dict(pairs(parts, x.kids))
            beside += [n for j in headings if j in place for n in x.kids[place[j]].nodes]
            if i in place:
                onward.append(x.kids[place[i]])
        at = onward
    return [*beside, *(n for x in at for n in x.nodes)] if at else []


def extract(root: Node, rule: dict | None) -> str:
    """Text of the article by the host's rule; a page without the rule's article goes by its own wrapper."""
    deep()
    own = wrapper_of(root)
    out: list[str] = []
    for paths in (rule["paths"] if rule else [], None):
        if paths is None:
            paths = rules(own, 1)["paths"]
        wanted = {id(n) for levels in paths for n in _nodes_at(own, levels)}
        stack = [(root, False)]
        while stack:
            x, inside = stack.pop()
            inside = inside or id(x) in wanted
            if inside and x.tag == "#":
                out.append(x.text)
            stack += [(k, inside) for k in reversed(x.kids) if k.label != "-"]
        if out:
            break
    return "\n".join(out)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _folded(rows: Iterator[tuple[str, Part, int]], most: int = 2_000) -> Iterator[tuple[str, Part, int]]:
    """One wrapper per host seen; what many hosts have gathered goes on before it takes much memory."""
    held: dict[str, tuple[Part, int]] = {}
    for host, w, n in rows:
        old = held.get(host)
        held[host] = (merged(old[0], w), old[1] + n) if old else (w, n)
        if len(held) > most:
            yield from ((h, *x) for h, x in held.items())
            held.clear()
    yield from ((h, *x) for h, x in held.items())


def _folded_runs(rows: Iterator[tuple[str, Part, int]]) -> Iterator[tuple[str, Part, int]]:
    """One wrapper per host, of rows sorted by host; holds one at a time."""
    for host, run in groupby(rows, key=lambda r: r[0]):
        _, w, n = next(run)
        for _, x, k in run:
            w, n = merged(w, x), n + k
        yield host, w, n


def _batch(rows: list[tuple[str, Part, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([packed(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["host", "wrapper", "pages"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), pages: one row per host, from all its pages.

    Pages fold into wrappers where they are read, so a host with very many pages sends a few small rows; these fold
    in 64 salted groups per host, then once more, in an order of their own.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        rows = ((h, wrapper_of(parse(t)), 1) for b in slices(batches) for h, t in zip(b.column("host").to_pylist(), texts(b.column("html")), strict=True))
        for r in _folded(rows):
            yield _batch([r])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, unpacked(w), n) for b in slices(batches) for h, w, n in zip(*(b.column(c).to_pylist() for c in ("host", "wrapper", "pages")), strict=True))
        for r in _folded_runs(rows):
            yield _batch([r])

    kind = "host string, wrapper string, pages long"
    part = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(first, kind)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(64)).alias("salt")
    part = part.select("*", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").drop("salt").mapInArrow(again, kind)
    return part.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(again, kind)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every row's whole html, "" if it has none.

    Null html is empty; a null or odd url belongs to the host "". Repeated rows are pages of their own; a null page_id
    stays. Only page_id, url and html are read. All texts inside the article stay, however many pages have them. Rules
    are a row per host: broadcast up to a counted number of rows and characters, joined by host beyond it.
    """

    def to_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [json.dumps(rules(unpacked(w), n), separators=(",", ":")) for w, n in zip(b.column("wrapper").to_pylist(), b.column("pages").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(r, pa.string())], ["host", "rule"])

    known = staged(wrappers(pages).mapInArrow(to_rules, "host string, rule string"), "wrapper-rules")
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    count, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
    rows = rows.join(small_or_not(known, count, size), "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, dict] = {}
        for b in slices(batches):
            out = []
            for r, t in zip(b.column("rule").to_pylist(), texts(b.column("html")), strict=True):
                if r is not None and r not in made:
                    if len(made) > 5_000:
                        made.clear()
                    made[r] = json.loads(r)
                out.append(extract(parse(t), made.get(r)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every page."""
    return extracted(table(spark, sf_dir, "pages"))
