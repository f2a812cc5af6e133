"""Main text of web pages by union-free regular-expression inference.

Pages of one host are aligned one after another: where token streams differ in text a slot is made, where they differ in
tags the tokens become an optional or a repeated group. The result is the host's wrapper, a union-free expression over
tags whose parts also carry how much text they held. Tasks align the pages they read, and their partial wrappers are
aligned again by host, so every page teaches and no page is moved.

The wrapper decides each page's text. Its text that stays the same over pages that differ is the template's and left
out. From the root the page is followed into the part whose slots hold most of the host's prose, weighed by what HTML
says of an element; where that part's slots are spread over siblings, a heading stands beside it, or it is an article,
that is the article. In there, groups whose slots are links, and repeated groups of short marks with text beside the
main prose (comments), are left out. Class names are hints: they weigh, and decide only about lesser parts.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, written

#: Levels of nested elements that are told apart; deeper ones belong to the last of these. Open elements that are kept count of, one by one.
DEPTH, OPEN = 150, 512
#: Kinds of children of one element that a wrapper tells apart; beyond them elements count by tag alone.
MOST_KINDS = 200
#: Bytes of all wrappers up to which they are broadcast; beyond it pages and wrappers are joined by host.
BROADCAST_BYTES = 32_000_000
#: Wrappers of one host that a task aligns at once, and hosts that a task keeps before it hands its wrappers on.
GROUP, HOSTS = 64, 500
#: Share of the prose that a part must have to be followed, the letters of a long block, of a mark beside a comment, and of a fixed text that is kept as it is.
SHARE, LONG, SHORT, KEPT = 0.6, 80, 40, 200
#: Long blocks of a host that are watched, the smallest by hash, to tell pages that differ from copies.
WATCHED = 16
#: Parts into which the pages of a host with more than a thousandth of all pages are dealt in the join.
SALT = 64

#: A tag ends at its bracket, and is text where another one opens before that outside quotes: so no character is read for more than a few tags.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
DIGITS = re.compile(r"\d{3,}")

# Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Elements that a start tag of the key closes when they are open, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "iframe", "svg", "head", "title", "dialog", "menu", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes", "input"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks whose text is one: if some of it is the page's own, all of it is.
SAID = HEADINGS | {"p", "li", "blockquote", "dd", "dt", "td", "th", "pre", "figcaption"}
#: Blocks that hold parts rather than a text of their own: only these are judged as a group.
GROUPS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "header", "fieldset", "center", "details", "figure"}
#: Hints: words of class names and ids that often name lesser parts, and the article.
ASIDE_HINTS = {"ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "nav", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "cookie", "consent", "notice", "popup", "newsletter", "share", "social", "related", "pagination", "comments", "comment"}
MAIN_HINTS = {"content", "main", "article", "post", "entry", "story"}


class Node:
    __slots__ = ("tag", "key", "kids")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.kids = tag, key, []


def parse(page: str) -> Node:
    """Lenient tree of a page: elements and raw text; comments and declarations are left out, unclosed elements end with their parent. Elements below DEPTH give their content to the last one above it, except those that hold no article text."""
    root = Node("", "")
    stack, at, size, is_open, beyond = [root], 0, len(page), Counter(), Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            is_open[x.tag] -= 1
        del stack[k:]

    m = TOKEN.search(page)
    while m:
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag:
            tag = tag.lower()
            if m[1]:
                if beyond[tag]:
                    beyond[tag] -= 1
                elif is_open[tag]:
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    if k >= DEPTH and tag in BLOCK:
                        stack[-1].kids.append(Node("hr", "hr"))
                    close(k)
            else:
                if tag in CLOSES:
                    ends, scope = CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1) if any(is_open[e] for e in ends) else ():
                        if stack[k].tag in scope:
                            break
                        if stack[k].tag in ends:
                            close(k)
                            if tag not in ("tr",):
                                break
                elif tag in BLOCK and is_open["p"]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            close(k)
                            break
                        if stack[k].tag in BLOCK:
                            break
                node = Node(tag, _key(tag, m[3]) if m[3] else tag)
                if len(stack) < DEPTH:
                    stack[-1].kids.append(node)
                else:
                    if tag in BLOCK or tag == "br":
                        stack[-1].kids.append(Node("hr", "hr"))
                    if kind(node.key)[0] != "aside":
                        node.kids = stack[-1].kids
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b[^<>]*+>", re.IGNORECASE).search(page, at)
                    if len(stack) < DEPTH:
                        node.kids.append(page[at : end.start() if end else size])
                    at = end.end() if end else size
                elif tag not in VOID and not m[3].endswith("/"):
                    if len(stack) < OPEN or len(stack) == OPEN and kind(node.key)[0] == "aside":
                        stack.append(node)
                        is_open[tag] += 1
                    else:
                        beyond[tag] += 1
        m = TOKEN.search(page, at)
    if at < size:
        stack[-1].kids.append(page[at:])
    return root


def _key(tag: str, attributes: str) -> str:
    """tag|class|id|role with long numbers as #, and * after a hidden one."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if not found:
        return tag
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    return DIGITS.sub("#", f"{tag}|{found.get('class', '').lower()}|{found.get('id', '').lower()}|{found.get('role', '').lower()}") + "*" * hidden


_kinds: dict[str, tuple[str, str]] = {}


def kind(key: str) -> tuple[str, str]:
    """What HTML says of an element (aside, header, main or nothing), and what its names hint at (aside, main or nothing)."""
    if key not in _kinds:
        if len(_kinds) > 100_000:
            _kinds.clear()
        tag, _, rest = key.rstrip("*").partition("|")
        classes, _, rest = rest.partition("|")
        ident, _, role = rest.partition("|")
        names = {w for n in f"{classes} {ident}".split() for w in (n, *re.split(r"[-_#]", n))}
        says = "aside" if key.endswith("*") or tag in ASIDE_TAGS or role in ASIDE_ROLES else "main" if tag in ("article", "main") or role in ("main", "article") else "header" if tag == "header" else ""
        _kinds[key] = says, "" if tag in ("body", "html", "article", "main") else "aside" if names & ASIDE_HINTS else "main" if names & MAIN_HINTS else ""
    return _kinds[key]


# --- wrappers: [key, kids, optional, repeated, pages that have it, how often] for elements, ["#", text or None for a slot, optional, repeated, pages, letters, letters in links] for text


def _lift(node: Node, linked: bool = False) -> list:
    kids = []
    linked = linked or node.tag == "a"
    for k in node.kids:
        if isinstance(k, str):
            text = " ".join(k.split())
            if text:
                n = len(text)
                if n > KEPT:
                    text = "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                kids.append(["#", text, False, False, 1, 0 if linked else n, n if linked else 0])
        elif k.tag not in RAW and k.tag not in VOID:
            kids.append(_lift(k, linked))
    return [node.key, _fold(kids), False, False, 1, 1]


def _merge(a: list, b: list, pages: bool) -> list:
    """One item for two of a kind; with `pages`, of different pages."""
    count = a[4] + b[4] if pages else max(a[4], b[4])
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] or b[2], a[3] or b[3], count, a[5] + b[5], a[6] + b[6]]
    return [a[0], align(a[1], b[1], pages), a[2] or b[2], a[3] or b[3], count, a[5] + b[5]]


def _fold(items: list) -> list:
    """Neighbours of one kind, or alternating runs of two or three kinds, become a repeated group."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = _merge(out[-1], x, False)
            out[-1][3] = True
        else:
            out.append(x)
    for p in (2, 3):
        done: list = []
        for x in out:
            done.append(x)
            while len(done) >= 2 * p and [y[0] for y in done[-2 * p : -p]] == [y[0] for y in done[-p:]]:
                group = [_merge(a, b, False) for a, b in zip(done[-2 * p : -p], done[-p:], strict=True)]
                for y in group:
                    y[3] = True
                done[-2 * p :] = group
        out = done
    return _bounded(out)


def _bounded(items: list) -> list:
    """Items as they are, or by tag alone where there are too many."""
    if len(items) <= MOST_KINDS:
        return items
    found: dict[str, list] = {}
    for x in items:
        key = x[0].partition("|")[0] if kind(x[0])[0] != "aside" else x[0] if x[0].endswith("*") else x[0].partition("|")[0]
        x = [key, *x[1:]]
        found[key] = _merge(found[key], x, False) if key in found else x
        found[key][3] = True
    return list(found.values())


def align(a: list, b: list, pages: bool = True) -> list:
    """The expression that both sequences match: common items in order are merged, the others are optional."""
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [_merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    where: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        where.setdefault(y[0], []).append(j)
    tails: list[int] = []  # the longest ascending run of the nearest places of one kind
    nodes: list = []
    seen: Counter = Counter()
    for i, x in enumerate(a):
        places = where.get(x[0], [])
        if seen[x[0]] < len(places):
            j = places[seen[x[0]]]
            seen[x[0]] += 1
            k = bisect_left(tails, j)
            node = (i, j, nodes[k - 1] if k else None)
            if k < len(tails):
                tails[k], nodes[k] = j, node
            else:
                tails.append(j)
                nodes.append(node)
    pairs, node = [], nodes[-1] if nodes else None
    while node:
        pairs.append(node[:2])
        node = node[2]
    out, i, j = [], 0, 0
    for p, q in [*reversed(pairs), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            out.append([x[0], x[1], True, *x[3:]])
        if p < len(a):
            out.append(_merge(a[p], b[q], pages))
        i, j = p + 1, q + 1
    # a kind stands at one place: later ones join the first
    first: dict[str, int] = {}
    joined: list = []
    for x in out:
        if x[0] in first:
            k = first[x[0]]
            both = _merge(joined[k], x, True)
            both[3] = True
            joined[k] = both
        else:
            first[x[0]] = len(joined)
            joined.append(x)
    return _bounded(joined)


def _watched(page: str) -> dict[str, int]:
    """The WATCHED smallest hashes of the page's long texts; of a page without one, the page's own."""
    found = {hashlib.md5(" ".join(t.split()).encode("utf-8", "surrogatepass")).hexdigest()[:16] for t in re.findall(r">([^<>]{%d,})" % LONG, page) or [page]}
    return dict.fromkeys(sorted(found)[:WATCHED], 1)


def lift(page: str) -> list:
    """The wrapper of one page: [expression, watched texts and their pages]."""
    return [_lift(parse(page)), _watched(page)]


def merge(a: list, b: list) -> list:
    """The wrapper that the pages of both match."""
    watched = Counter(a[1])
    watched.update(b[1])
    return [_merge(a[0], b[0], True), {k: watched[k] for k in sorted(watched)[:WATCHED]}]


def infer(pages: list[str]) -> list | None:
    """The wrapper of some pages of a host; None without pages."""
    w = None
    for p in pages:
        w = lift(p) if w is None else merge(w, lift(p))
    return w


def expression(w: list) -> str:
    """The wrapper as text: # is a slot, ( )? an optional and ( )+ a repeated group."""
    w = w[0] if isinstance(w[0], list) else w
    if w[0] == "#":
        body = "#" if w[1] is None else w[1]
    else:
        tag = w[0].partition("|")[0]
        body = "".join(map(expression, w[1]))
        body = f"<{tag}>{body}</{tag}>" if tag else body
    return f"({body}){'*' if w[2] else '+'}" if w[3] else f"({body})?" if w[2] else body


# --- what the wrapper says of its parts


class Part:
    """One kind of element at one place of a wrapper."""

    __slots__ = ("key", "says", "hint", "group", "heading", "repeated", "fixed", "own", "prose", "links", "pages", "often", "weight", "kids", "marked")

    def __init__(self, key: str):
        self.key = key
        self.says, self.hint = kind(key)
        tag = key.partition("|")[0].rstrip("*")
        self.group, self.heading = tag in GROUPS, tag in HEADINGS
        self.repeated, self.fixed, self.kids = False, set(), {}
        self.own = self.prose = self.links = self.pages = self.often = self.weight = 0
        self.marked = False


def parts(wrapper: list) -> Part:
    """The wrapper's parts with their prose: letters of slots outside links. Text counts as the template's where it stays the same over two pages or more that differ in their long texts."""
    w, watched = wrapper
    copies = sorted(watched.values())[len(watched) // 2] if watched else 1
    differ = w[4] >= 2 * copies

    def build(items: list) -> Part:
        p = Part(items[0][0])
        below: dict[str, list] = {}
        for x in items:
            p.repeated |= x[3]
            p.pages = max(p.pages, x[4])
            p.often += x[5]
            for k in x[1]:
                if k[0] == "#":
                    p.links += k[6]
                    if k[1] is not None and differ and k[4] >= 2 and not k[3]:
                        p.fixed.add(k[1])
                    else:
                        p.own += k[5]
                else:
                    below.setdefault(k[0], []).append(k)
        p.kids = {key: build(x) for key, x in below.items()}
        use = [k for k in p.kids.values() if k.says != "aside"]
        p.prose = p.own + sum(k.prose for k in use)
        p.links += sum(k.links for k in use)
        p.weight = (p.own + sum(k.weight for k in use)) * (8 if p.says == "main" else 2 if p.hint == "main" else 0.2 if p.hint == "aside" else 1)
        p.marked = any(not k.group and not k.heading and k.key.partition("|")[0] not in ("p", "li", "dt", "dd", "td", "th") and 0 < k.prose + k.links <= SHORT * k.often for k in use)
        return p

    return build([w])


def _lesser(p: Part, whole: Part, article: bool) -> bool:
    """Whether a part of the article doesn't belong to its text."""
    if p.says == "aside" or p.says == "header" and not article:
        return True
    if p.hint == "aside" and 2 * p.prose < whole.prose:
        return True
    if not p.group:
        return False
    return p.links > p.prose or p.repeated and p.marked and 2 * p.prose < whole.prose


def _article(root: Node, top: Part) -> tuple[list[Node], Part]:
    """The page's elements that hold the article, and their part of the wrapper."""
    nodes, here = [root], top
    while here.says != "main":
        found: dict[str, list[Node]] = {}
        for n in nodes:
            for k in n.kids:
                if not isinstance(k, str) and k.tag not in RAW:
                    found.setdefault(k.key, []).append(k)
        below = {key: p for key in found if (p := _part(here, key)) is not None and p.says != "aside"}
        if not below:
            break
        weight = {key: p.weight / max(p.pages, 1) for key, p in below.items()}
        best = max(weight, key=lambda key: weight[key])
        p = below[best]
        if weight[best] <= 0 or weight[best] < SHARE * (sum(weight.values()) + here.own / max(here.pages, 1)):
            break
        if p.says != "main" and (2 * p.own >= p.prose or p.repeated or any(k.heading and k.prose for k in below.values())):
            break
        nodes, here = found[best], p
    return nodes, here


def _part(p: Part, key: str) -> Part | None:
    return p.kids.get(key) or p.kids.get(key.partition("|")[0])


_GAP = Node("", "gap")


class _Block:
    """A block of the article: its tag, its texts and whether each is the template's; or a gap, where a lesser part was left out."""

    __slots__ = ("tag", "texts", "gap")

    def __init__(self, tag: str = "", gap: bool = False):
        self.tag, self.texts, self.gap = tag, [], gap

    def own(self) -> bool:
        return any(not fixed and not t.isspace() for t, fixed in self.texts)


def _kept(blocks: list[_Block]) -> list[list[str]]:
    """The texts of the blocks that are the article's. Of a paragraph or heading with text of its own all stays; one that is all the template's stays between blocks that stay: a paragraph right between two, a heading right before one and after any."""
    blocks = [b for b in blocks if b.gap or any(not t.isspace() for t, _ in b.texts)]
    own, out, any_before, k = [not b.gap and b.own() for b in blocks], [], False, 0
    while k < len(blocks):
        b = blocks[k]
        if own[k]:
            out.append([t for t, fixed in b.texts if not fixed or b.tag in SAID])
            any_before = True
        elif not b.gap and (b.tag in HEADINGS or b.tag == "p"):
            end = k
            while end < len(blocks) and not own[end] and not blocks[end].gap and (blocks[end].tag in HEADINGS or blocks[end].tag == "p"):
                end += 1
            if end < len(blocks) and own[end] and any_before:
                first = k
                if not own[k - 1]:  # a gap, or something left out, stands before: only the headings right before the text stay
                    first = end
                    while first > k and blocks[first - 1].tag in HEADINGS:
                        first -= 1
                out += [[t for t, _ in x.texts] for x in blocks[first:end]]
            k = end
            continue
        k += 1
    return out


def extract(page: str, wrapper: Part | None = None) -> str:
    """The main text of a page, as its host's wrapper says; without one the page is its own."""
    if wrapper is None:
        wrapper = parts(lift(page))
    nodes, whole = _article(parse(page), wrapper)
    article = whole.says == "main" or whole.hint == "main"
    blocks = [_Block()]
    todo: list = [(n, whole) for n in reversed(nodes)]
    while todo:
        node, p = todo.pop()
        if isinstance(node, str):
            if not node:
                blocks.append(_Block())
            else:
                blocks[-1].texts.append((node, p is not None and bool(p.fixed) and _told(node) in p.fixed))
            continue
        if node is _GAP:
            blocks += [_Block(gap=True), _Block()]
            continue
        if node.tag in BLOCK:
            blocks.append(_Block(node.tag))
            todo.append(("", None))
        for k in reversed(node.kids):
            if isinstance(k, str):
                if k:
                    todo.append((k, p))
            elif k.tag == "br":
                todo.append(("\n", None))
            elif k.tag not in RAW:
                below = _part(p, k.key) if p is not None else None
                if not (_lesser(below, whole, article) if below is not None else kind(k.key)[0] == "aside"):
                    todo.append((k, below))
                elif k.tag in BLOCK:
                    todo.append((_GAP, None))
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in _kept(blocks))
    return " ".join(t for t in texts if t)


def _told(text: str) -> str:
    text = " ".join(text.split())
    return text if len(text) <= KEPT else "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def host(url: str = "url"):
    """Host of a URL, lower case, without user and port; empty for null."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _aligned(wrappers: list[str]) -> str:
    out = None
    for x in sorted(wrappers):
        x = json.loads(x)
        out = x if out is None else merge(out, x)
    return json.dumps(out)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages it is made of): one row a host, from all its pages.

    Tasks align the pages that they read; wrappers of one host are then aligned GROUP at a time, so that a hot host is
    aligned by many tasks.
    """
    p = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (F.col("html") != ""))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string()), pa.array([w[0][4] for w in found.values()], pa.int64())], ["host", "wrapper", "pages"])

        for b in slices(batches, "html"):
            for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                w = lift(page)
                found[h] = merge(found[h], w) if h in found else w
            if len(found) > HOSTS:
                yield told()
                found.clear()
        yield told()

    schema = "host string, wrapper string, pages long"

    def join(t: pa.Table) -> pa.Table:
        return pa.table({"host": [t.column("host")[0].as_py()], "wrapper": [_aligned(t.column("wrapper").to_pylist())], "pages": pa.array([sum(t.column("pages").to_pylist())], pa.int64())})

    w = written(p.mapInArrow(make, schema), "wrappers")
    most = w.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while most > 1:
        groups = -(-most // GROUP)
        w = written(w.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("part")).applyInArrow(lambda k, t: join(t), schema), "wrappers")
        most = groups
    return w


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; repeated rows each get a row; pages without a host share one wrapper. Other
    columns are not read, empty tables stay empty.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)
    size, total = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    near = None
    if size <= BROADCAST_BYTES:
        near = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
    else:  # hosts with more than a thousandth of all pages, a thousand at most, are dealt into parts
        hot = wrappers.where(F.col("pages") * 1000 > total).select("host", F.lit(SALT).alias("salt"))
        salted = p.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("salt", F.lit(1))))
        dealt = wrappers.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salt", F.lit(1)) - 1)))
        p = salted.join(dealt.select("host", F.col("salt").cast("long").alias("salt"), "wrapper"), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Part | None] = {}
        for b in slices(batches, "html"):
            found = [near.value.get(x) for x in b.column("host").to_pylist()] if near is not None else b.column("wrapper").to_pylist()
            out = []
            for page, w in zip(b.column("html").to_pylist(), found, strict=True):
                if w is not None and w not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[w] = parts(json.loads(w))
                out.append(extract(page, known.get(w)) if page else "")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
