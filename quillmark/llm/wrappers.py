"""Wrappers: union-free regular expressions of a host's pages.

A page is a tree of block elements with text slots (inline markup is part of
the text). The children of an element form a sequence of items: an element, a
text slot, or a group of items that repeats. Aligning two sequences keeps what
both have, makes optional what only one has, and folds what comes back after
something else into a repeated group, so every label stands once in a
sequence. A text slot keeps its text while all pages agree on it. Nothing is a
choice between two forms: the expressions are union-free, and they stay as
small as the site's template however many pages are aligned.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|object|canvas|select|textarea)\b.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Fixed values of HTML: elements inside a line of text, elements without an end,
# what an element's start ends, and elements that have headings or no content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter "
                   "nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time "
                   "track tt u var wbr".split())
EMPTY = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
                       "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("table ul ol dl menu html body article section div main aside nav header footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title".split())

# Fixed values of a page's parts that aren't its main text: elements, roles and words of class names or ids.
BOILER_TAGS = frozenset("head title nav header footer aside form menu dialog button input fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                         "menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus dialog footer form gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar warning widget".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
DIGITS = re.compile(r"\d+")

#: Labels of one tag that a sequence tells apart by class or id; beyond, the tag alone is the label.
MAX_LABELS = 64
#: A text of more characters, as written, isn't kept as a template's text: it counts as varying.
MAX_FIXED = 300


@dataclass(slots=True)
class Element:
    """A block element or, with an empty label, a text slot (``pieces``)."""
    label: str
    boiler: bool = False
    children: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """Label of an element and whether it is no part of a main text."""
    boiler = tag in BOILER_TAGS
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    if not found:
        return tag, boiler
    words = {w.lower() for k in ("class", "id") for w in CAMEL.split(found.get(k, ""))}
    boiler = boiler or found.get("role", "").lower() in BOILER_ROLES or (
        tag not in ("html", "body", "article", "main") and not BOILER_WORDS.isdisjoint(words))
    name = found.get("class") or found.get("id") or ""
    role = "main" if tag == "main" or found.get("role", "").lower() == "main" else ""
    name = ".".join(sorted(DIGITS.sub("0", name).split()))[:80]
    return tag + ("!main" if role and tag != "main" else "") + ("." + name if name else ""), boiler


def parse(page: str | None) -> Element:
    """The tree of a page; unclosed elements end where HTML ends them or the page does."""
    root = Element("#page")
    stack: list[tuple[str, Element]] = [("", root)]
    links = 0
    end = 0
    page = page or ""

    def slot() -> Element:
        kids = stack[-1][1].children
        if not kids or kids[-1].label:
            kids.append(Element(""))
        return kids[-1]

    def add(piece: str) -> None:
        if piece:
            if piece.isspace():
                kids = stack[-1][1].children
                if kids and not kids[-1].label:
                    kids[-1].pieces.append(piece)
                return
            s = slot()
            s.pieces.append(piece)
            if links:
                s.linked += len(piece)

    def close(names: frozenset | set, stop: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    for m in TOKEN.finditer(page):
        if m.start() > end:
            add(page[end:m.start()])
        end = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "img"):
                add(" ")
            continue
        if not closing:
            links = 0
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                del stack[-1]
            if tag in PARAGRAPHS:
                close({"p"}, SCOPES)
            if tag in ENDS:
                close(ENDS[tag], SCOPES if tag != "body" else set())
            kids = stack[-1][1].children
            label, boiler = _described(tag, m.group(4))
            if tag in EMPTY:
                if kids and not kids[-1].label:
                    kids.append(Element("hr", True))     # the text before ends here
                continue
            new = Element(label, boiler)
            kids.append(new)
            stack.append((tag, new))
        else:
            links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            else:
                kids = stack[-1][1].children
                if kids and not kids[-1].label:
                    kids.append(Element("hr", True))
    if end < len(page):
        add(page[end:])
    return root


# A wrapper in JSON: an item is [label, n, optional, body]. An element's body is
# [boiler, sequence]; a text slot (label "") has [text or null, characters, linked
# characters, pages that have it]; a group (label "+") has its sequence. n counts pages.


def _labels(item: list) -> list[str]:
    return [x for i in item[3] for x in _labels(i)] if item[0] == "+" else [item[0]]


def _item(e: Element) -> list:
    if not e.label:
        size = sum(map(len, e.pieces))
        return ["", 1, False, [e.text() if size <= MAX_FIXED else None, size, e.linked, 1]]
    return [e.label, 1, False, [e.boiler, fold([_item(c) for c in e.children])]]


def _joined(a: list, b: list, pages: bool) -> list:
    """One item for two that share a label. ``pages``: they are of different pages."""
    n = a[1] + b[1] if pages else max(a[1], b[1])
    if "+" in (a[0], b[0]):
        x, y = (i[3] if i[0] == "+" else [i] for i in (a, b))
        return ["+", n, a[2] or b[2], _general(_once(x, y, pages))]
    if a[0] == "":
        (t, c, k, m), (u, d, l, o) = a[3], b[3]
        return ["", n, a[2] or b[2], [t if t == u else None, c + d, k + l, m + o if pages else max(m, o)]]
    return [a[0], n, a[2] or b[2], [a[3][0] or b[3][0], align(a[3][1], b[3][1], pages)]]


def align(a: list, b: list, pages: bool = True) -> list:
    """The sequence that describes both: what only one of them has is optional."""
    if not a or not b:
        return [[i[0], i[1], True, i[3]] for i in a or b]
    where = {x: k for k, i in enumerate(b) for x in _labels(i)}
    out, at, used = [], 0, set()
    for i in a:
        hits = sorted({where[x] for x in _labels(i) if x in where})
        hits = [k for k in hits if k >= at and k not in used]
        if not hits:
            out.append([i[0], i[1], True, i[3]])
            continue
        out.extend([j[0], j[1], True, j[3]] for j in b[at:hits[0]])
        for k in hits:
            i = _joined(i, b[k], pages)
            used.add(k)
        # What stands between parts of one group belongs to it: the fold sees it come back.
        out.append(i)
        between = [b[k] for k in range(hits[0], hits[-1]) if k not in used]
        out.extend([j[0], j[1], True, j[3]] for j in between)
        at = hits[-1] + 1
    out.extend([j[0], j[1], True, j[3]] for j in b[at:])
    return fold(out)


def fold(items: list) -> list:
    """The items with each label once: stretches between a label's places become one repeated group."""
    places: dict[str, list[int]] = {}
    for k, i in enumerate(items):
        for x in _labels(i):
            places.setdefault(x, []).append(k)
    if all(len(p) == 1 for p in places.values()):
        return _general(items)
    # Overlapping stretches are one.
    reach = list(range(len(items)))
    for p in places.values():
        reach[p[0]] = max(reach[p[0]], p[-1])
    out, k = [], 0
    while k < len(items):
        end, j = reach[k], k
        while j < end:
            j += 1
            end = max(end, reach[j])
        out.append(items[k] if end == k else _group(items[k:end + 1]))
        k = end + 1
    return _general(out)


def _group(items: list) -> list:
    """A repeated group of the rounds in which ``items`` come: a round goes on
    while the labels follow in the order in which they were met first."""
    order: dict[str, int] = {}
    rounds: list[list] = [[]]
    last = -1
    for i in items:
        for part in i[3] if i[0] == "+" else [i]:
            place = order.setdefault(part[0], len(order))
            if place <= last:
                rounds.append([])
            rounds[-1].append(part)
            last = place
        if i[0] == "+":
            last = len(order)
    body: list = rounds[0]
    for r in rounds[1:]:
        body = _once(body, r, False)
    return ["+", max(i[1] for i in items), all(i[2] for i in items), _general(body)]


def _once(a: list, b: list, pages: bool) -> list:
    """Two rounds of a group (or groups of two pages) as one: labels in the order met first, those that a round lacks optional."""
    out = {i[0]: i for i in a}
    seen = {i[0] for i in b}
    for i in b:
        out[i[0]] = _joined(out[i[0]], i, pages) if i[0] in out else [i[0], i[1], True, i[3]]
    return [i if i[0] in seen else [i[0], i[1], True, i[3]] for i in out.values()]


def _general(items: list) -> list:
    """``items``, with the tag alone as label where a sequence has too many classes of one tag."""
    if len(items) <= MAX_LABELS:
        return items
    tags = Counter(i[0].split(".", 1)[0] for i in items if i[0] not in ("+", ""))
    many = {t for t, n in tags.items() if n > MAX_LABELS}
    if not many:
        return items
    return fold([[t, *i[1:]] if (t := i[0].split(".", 1)[0]) in many else i for i in items])


def inferred(root: Element) -> list:
    """The wrapper of one page."""
    return _item(root)


def merged(a: list, b: list) -> list:
    """The wrapper of the pages of both."""
    return _joined(a, b, True)


def dumped(wrapper: list) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression for readers: ``<p>``, ``#`` (varying text), ``"text"``, ``( )+``, ``?``."""
    label, _, optional, body = wrapper
    if label == "":
        s = "#" if body[0] is None else json.dumps(body[0], ensure_ascii=False)
    elif label == "+":
        s = "(" + " ".join(map(expression, body)) + ")+"
    else:
        s = f"<{label}>" + " ".join(map(expression, body[1])) + "</>"
    return f"({s})?" if optional else s


# Which slots of a wrapper are main text. A slot is named by the labels above it.

#: A slot with more of its characters in links than this share is a menu.
MAX_LINKED = 0.5
#: The element that holds this share of its parent's text is looked into for the main text.
MOST = 0.6
#: A text that this many pages, and half of the host's, have in common is the template's.
MIN_PAGES = 5


def _slots(seq: list, above: tuple, boiler: bool):
    """(labels above, slot, boiler) of every text slot."""
    for label, n, _, body in seq:
        if label == "+":
            yield from _slots(body, above, boiler)
        elif label == "":
            yield above, body, boiler
        else:
            yield from _slots(body[1], (*above, label), boiler or body[0])


def _tag(label: str) -> str:
    return label.split(".", 1)[0]


def _main(above: tuple) -> int:
    """How many labels lead to the article or main element that holds a slot; 0: none."""
    tags = [_tag(x) for x in above]
    start = next((k for k, t in enumerate(tags) if t == "main" or t.endswith("!main")), -1)
    article = next((k for k, t in enumerate(tags) if t == "article" and k > start), -1)
    return (article if article >= 0 else start) + 1


def _dense(slots: list) -> tuple:
    """Labels of the element that holds most of the varying text that is no link."""
    region: tuple = ()
    while True:
        weight: Counter = Counter()
        for above, (text, size, linked, _pages) in slots:
            if above[:len(region)] == region and text is None and linked <= MAX_LINKED * size:
                weight[above[:len(region) + 1]] += size - linked
        if not weight:
            return region
        best, most = min(weight.items(), key=lambda x: (-x[1], x[0]))
        # A lone paragraph or heading isn't a region.
        inside = any(len(above) > len(best) and above[:len(best)] == best for above, _ in slots)
        if len(best) == len(region) or most < MOST * sum(weight.values()) or not inside:
            return region
        region = best


def chosen(wrapper: list) -> dict:
    """``main``: names of the slots of main text in article or main elements;
    ``roots``: names of those elements; ``rest``: names of the slots of main text of
    pages without such elements; ``slots``: all names."""
    every = list(_slots(wrapper[3][1], (), False))
    found = [(above, body) for above, body, boiler in every if not boiler]
    inside = [(a, b) for a, b in found if _main(a)]
    # In a host with main elements that hold articles, articles are the main text.
    held = {a[:_main(a)] for a, _ in inside}
    roots = {r for r in held if not any(o != r and o[:len(r)] == r for o in held)}
    main = [(a, b) for a, b in inside if a[:_main(a)] in roots]
    rest = [(a, b) for a, b in found if not _main(a)]
    region = _dense(rest)
    rest = [(a, b) for a, b in rest if a[:len(region)] == region]
    return {"roots": sorted(map(list, roots)), "main": _kept(main, wrapper[1]), "rest": _kept(rest, wrapper[1]),
            "slots": [list(above) for above, _, _ in every]}


def _kept(slots: list, pages: int) -> list:
    varies = any(b[0] is None for _, b in slots)
    out = []
    for above, (text, size, linked, n) in slots:
        template = (text is not None and varies and n >= MIN_PAGES and 2 * n >= pages
                    and not (above and _tag(above[-1]) in HEADINGS))
        if not template and linked <= MAX_LINKED * size:
            out.append(list(above))
    return out


def _named(e: Element, names: set, above: tuple):
    """Text slots of an element in page order, each with its name in the wrapper."""
    for c in e.children:
        if not c.label:
            yield above, c
        else:
            name = (*above, c.label)
            if name not in names and (*above, _tag(c.label)) in names:
                name = (*above, _tag(c.label))
            yield from _named(c, names, name)


def main_text(root: Element, plan: dict) -> str:
    """The blocks of a page that ``plan`` (of :func:`chosen`, as sets of tuples) keeps."""
    slots = list(_named(root, plan["names"], ()))
    has_root = any(above[:k] in plan["roots"] for above, _ in slots for k in range(1, len(above) + 1))
    kept = plan["main"] if has_root else plan["rest"]
    return "\n".join(t for above, s in slots if above in kept and (t := s.text()))


def plan_of(text: str) -> dict:
    """A plan from its JSON."""
    plan = {k: {tuple(x) for x in v} for k, v in json.loads(text).items()}
    plan["names"] = {x[:k] for x in plan.pop("slots") for k in range(1, len(x) + 1)}
    return plan
