"""Main text of web pages by inferred wrappers: union-free regular expressions over the tag streams of each host.

A page is a tree of block elements with its texts as leaves. A host's wrapper begins as its first page and takes in one
page after the other. Child sequences are aligned: equal subtrees are anchors; between them, elements with equal
signatures meet; siblings that repeat become a repeated element or, where they alternate, a repeated group; what one
side lacks becomes optional; unlike names of elements that meet are left out; texts that differ become slots. All steps
are linear or sorted in the number of siblings. Wrappers are merged as pages are, so every partition folds its own
pages, without moving them, and the partitions' wrappers of a host are merged in a tree of groups.

The wrapper of two or more different pages decides: the main region is found from the root by going down to the child
with nearly all slot text, as long as no heading is left behind; constants of the wrapper in it, which half of the pages
have, three at least, are dropped, headings aside. A page is aligned with the wrapper along the way to the region. Menus,
headers, footers, sidebars, notices, adverts, forms and comments that vary from page to page can only be told by their
tags, roles and names, and are left out by them.

Names also choose the region where the wrapper can't: on hosts of one page, where slots hold too little of the text (near
copies of one page), and on pages that don't have the region. It is the articles, main elements or elements named as
content, the first of them that hold half of the text that is no aside (an eighth if there is one only), else the
element with over half of it right below, else the whole body. They also choose within the wrapper's region.

Rules are broadcast up to `most_bytes`; beyond, pages are joined to them by host, with skewed hosts split.

Cases: null and empty html give an empty text; a null or odd url is a host of its own name, all together; text without
tags is one block; cut and unclosed tags end where their parents do; nesting and the number of siblings have no bound;
wrappers of a host are merged in an order that the wrappers themselves give, so the same partitions give the same
result, while other partitions may align otherwise; repeated pages count once in a partition and are extracted alike; an
empty table gives an empty one; other columns are kept, except those named as the new ones, which are replaced.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import quoted, slices, stored

#: Wrappers that a task holds, and nodes of pages that it folds, before it hands them on; memory only.
HOSTS, NODES = 2000, 400_000
MOST_BYTES = 4 << 20
#: Pages that must have a constant before it counts as the host's; the share of slot text below a part for it to be the
#: region; the least share of slots in all text for the wrapper to decide.
PAGES, NEARLY_ALL, VARIED = 3, 0.9, 0.2

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul button caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "tbody", "thead"}, "tfoot": {"tr", "tbody", "thead"}, "body": {"head"}}
LISTS = set("ul ol dl table menu select".split())
ASIDE_TAGS = set("nav footer aside form button select dialog menu head search fieldset".split())
ASIDE_NAMES = set("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promos promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that say where or how a part stands, not what it is: a name's kind is the last of its other words.
PLACE_WORDS = set("0 area articles author bar block body bottom box btn button buttons center cell col column container content copyright div elem field form full group header heading holder icon icons inner item items label left link links list meta outer panel part pane posts primary right row secondary section slot small sticky stories text title top unit wide wrap wrapper zone".split())
#: Words before a name that make it a state of the layout: "has-sidebar" is none.
STATE_WORDS = set("has no with without".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
MAIN_NAMES = set("article articlebody content entry post story maincontent main".split())

# A node: signature, optional, repeated, pages seen, digest of a constant subtree (0: it has slots), characters of text,
# children. Texts are leaves of signature "#text", in pages with the text in place of children. A group of siblings that
# repeats together is a node of signature "(".
SIG, OPTIONAL, REPEATED, SEEN, DIGEST, CHARS, CHILDREN = range(7)
LEAF, GROUP = "#text", "("
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())


def deep() -> None:
    """Nesting is followed by recursion of plain Python functions, which needs no more than memory."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def signature(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag with id and classes, digits as 0, the role, and after "*" what kind of part it is; and whether it is hidden."""
    if not attributes or attributes.isspace():
        return labelled(tag, tag, set(), ""), False
    found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    names = f"{found.get('id', '')} {found.get('class', '')} {found.get('itemprop', '')}".lower().split()
    names = ["".join("0" if c.isdigit() else c for c in n) for n in names]
    role = "_".join(found.get("role", "").lower().split())
    label = tag + "".join(f".{n}" for n in sorted(set(names))) + (f"@{role}" if role else "")
    return labelled(label.replace("*", "-"), tag, {w for n in names for w in n.split(".")}, role), hidden


def names_aside(name: str) -> bool:
    """Whether a name tells a part that is no article: "cookie-notice" and "sidebar-left" do, "legal-history" does not."""
    words = [w for w in re.split(r"[-_:]+", name) if w]
    while words and (words[-1] in PLACE_WORDS or not words[-1].strip("0")):
        words.pop()
    return bool(words) and words[-1] in ASIDE_NAMES and not (len(words) > 1 and words[-2] in STATE_WORDS)


def labelled(label: str, tag: str, names: set[str], role: str) -> str:
    """label with "*" and the kind of part: a for asides, 0 for articles, 1 for main elements, 2 for those named as content."""
    words = {w for n in names for w in re.split(r"[-_:]+", n)}
    aside = role in ASIDE_ROLES or any(map(names_aside, names)) and tag not in ("html", "body", "article", "main")
    main = "0" if tag == "article" or "articlebody" in names else "1" if tag == "main" or role == "main" else "2" if words & MAIN_NAMES and tag in ("div", "section", "td") else ""
    kind = ("a" if aside else "") + main
    return f"{label}*{kind}" if kind else label


def tag_of(sig: str) -> str:
    return re.match("[a-z0-9]+", sig)[0]


_asides: dict[tuple[str, bool], bool] = {}


def is_aside(sig: str, inside: bool) -> bool:
    """Whether an element is no part of an article, by tag, role or names; inside: within a main region."""
    key = (sig, inside)
    if key not in _asides:
        if len(_asides) > 100_000:
            _asides.clear()
        tag = tag_of(sig)
        _asides[key] = tag in ASIDE_TAGS or (tag == "header" and not inside) or "a" in sig.partition("*")[2]
    return _asides[key]


def main_kind(sig: str) -> int | None:
    """0 for articles, 1 for main elements, 2 for elements named as content."""
    kind = sig.partition("*")[2][-1:]
    return int(kind) if kind.isdigit() else None


def events(page: str) -> Iterator[tuple[str, str]]:
    """("open", signature), ("close", ""), ("text", decoded text) of the block elements of a page, well nested.

    Raw and hidden elements are left out, inline elements only give their text; a line break is white space.
    """
    stack: list[str] = []  # tags of open blocks; hidden ones begin with "!"
    places: dict[str, list[int]] = {}  # of each tag in the stack, hidden or not
    hidden, at, paragraphs = 0, 0, 0

    def leave() -> Iterator[tuple[str, str]]:
        nonlocal hidden, paragraphs
        tag = stack.pop()
        places[tag.lstrip("!")].pop()
        paragraphs -= tag == "p"
        if tag[0] == "!":
            hidden -= 1
        elif not hidden:
            yield "close", ""

    while at < len(page):
        m = TAG.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            if not hidden:
                yield "text", html.unescape(text) if "&" in text else text
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in VOID:
            if not hidden and tag in ("br", "hr", "img"):
                yield "text", " "
            continue
        if m[1]:
            if tag in BLOCKS and places.get(tag):
                while stack and stack[-1].lstrip("!") != tag:
                    yield from leave()
                yield from leave()
            elif tag in ("td", "th") and not hidden:
                yield "text", " "
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in BLOCKS or m[3].rstrip().endswith("/") and tag != "p":
            continue
        closes = CLOSES.get(tag, ())
        if paragraphs:  # a block ends an open paragraph
            while stack and stack[-1].lstrip("!") != "p" and stack[-1].lstrip("!") not in LISTS | {"div", "article", "section"}:
                yield from leave()
            if stack and stack[-1].lstrip("!") == "p":
                yield from leave()
        if closes:
            inner = max((places[c][-1] for c in closes if places.get(c)), default=-1)
            if inner > max((places[c][-1] for c in LISTS if places.get(c)), default=-1):
                while len(stack) > inner:
                    yield from leave()
        sig, gone = signature(tag, m[3])
        if not hidden and not gone:
            yield "open", sig
        if gone:
            hidden += 1
        paragraphs += tag == "p" and not gone
        places.setdefault(tag, []).append(len(stack))
        stack.append(f"!{tag}" if gone else tag)
    while stack:
        yield from leave()


_parts: dict[str, tuple[tuple[str, str], frozenset[str]]] = {}


def parts(sig: str) -> tuple[tuple[str, str], frozenset[str]]:
    """What must be equal in elements that meet (tag and kind of part), and the names, which may differ."""
    if sig not in _parts:
        if len(_parts) > 100_000:
            _parts.clear()
        label, _, kind = sig.partition("*")
        tag = tag_of(label) if label[:1].isalnum() else label
        _parts[sig] = (tag, kind), frozenset(re.findall(r"[.@][^.@]*", label[len(tag) :]))
    return _parts[sig]


def general(a: str, b: str) -> str:
    """The signature of both: the names that they share."""
    if a == b:
        return a
    (tag, kind), names = parts(a)
    return tag + "".join(sorted(names & parts(b)[1])) + (f"*{kind}" if kind else "")


def tree(page: str, texts: bool = False) -> list:
    """The page as a wrapper of its own; with texts, leaves keep their text."""
    root = ["", False, False, 1, 0, 0, []]
    stack, buffer = [root], []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                stack[-1][CHILDREN].append([LEAF, False, False, 1, xxhash.xxh64_intdigest(text) or 1, len(text), text if texts else []])

    for kind, what in events(page):
        if kind == "text":
            buffer.append(what)
            continue
        flush()
        if kind == "open":
            stack.append([what, False, False, 1, 0, 0, []])
            stack[-2][CHILDREN].append(stack[-1])
        else:
            close(stack.pop())
    flush()
    close(root)
    return root


def close(node: list) -> None:
    node[CHARS] = sum([c[CHARS] for c in node[CHILDREN]])
    node[DIGEST] = xxhash.xxh64_intdigest(f"{node[SIG]} {[c[DIGEST] for c in node[CHILDREN]]}") or 1


def merged(a: list, b: list, apart: bool = True) -> list:
    """The least wrapper that covers both, of different pages or (not apart) of one."""
    same = a[DIGEST] == b[DIGEST] != 0
    below = [] if a[SIG] == LEAF else aligned(a[CHILDREN], b[CHILDREN], apart)
    seen = a[SEEN] + b[SEEN] if apart else max(a[SEEN], b[SEEN])
    return [general(a[SIG], b[SIG]), a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], seen, a[DIGEST] if same else 0, a[CHARS] + b[CHARS], below]


def optional(n: list) -> list:
    return [n[SIG], True, *n[REPEATED:]]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by their second place, whose first places rise too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [i], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(a: list, b: list, key: Callable[[list], Hashable] = lambda n: n[DIGEST]) -> list[tuple[int, int]]:
    """Places of siblings with equal keys that are alone of their kind on each side, in order."""
    once: list[dict[Hashable, int]] = [{}, {}]
    for nodes, places in zip((a, b), once, strict=True):
        for i, n in enumerate(nodes):
            if k := key(n):
                places[k] = -1 if k in places else i
    return rising([(once[0][k], j) for k, j in once[1].items() if j >= 0 and once[0].get(k, -1) >= 0])


def shape(n: list) -> Hashable:
    """What tells like elements apart: signature and those of the children."""
    return None if n[SIG] == GROUP or n[REPEATED] else (n[SIG], frozenset([s for c in n[CHILDREN] for s in members(c)]) if n[SIG] != LEAF else ())


def aligned(a: list, b: list, apart: bool = True) -> list:
    """Two child sequences as one: equal subtrees first, then what is between them."""
    if len(a) == len(b) == 1 and a[0][SIG] == b[0][SIG]:
        return [merged(a[0], b[0], apart)]
    return split(a, b, apart, anchors(a, b), between)


def split(a: list, b: list, apart: bool, at: list[tuple[int, int]], rest: Callable[[list, list, bool], list]) -> list:
    """Elements at the given places meet, stretches between them by another rule."""
    out: list = []
    i = j = 0
    for p, q in [*at, (len(a), len(b))]:
        out += rest(a[i:p], b[j:q], apart)
        if p < len(a):
            out.append(merged(a[p], b[q], apart))
        i, j = p + 1, q + 1
    return out


def between(a: list, b: list, apart: bool) -> list:
    """Two stretches without common anchors as one: by signatures in order, else by shapes, else by what repeats."""
    sigs = [n[SIG] for n in a]
    if GROUP not in sigs and sigs == [n[SIG] for n in b]:
        return [merged(x, y, apart) for x, y in zip(a, b, strict=True)]
    return split(a, b, apart, anchors(a, b, shape) if a and b else [], repeating)


def repeating(a: list, b: list, apart: bool) -> list:
    """Two stretches as one, with each signature once."""
    a, b = folded(a), folded(b)
    at = {s: i for i, n in enumerate(a) for s in members(n)}
    boxes: list[list[int]] = []  # stretches of a and of b whose elements meet, in order on both sides
    for i, j in sorted({(at[s], j) for j, n in enumerate(b) for s in members(n) if s in at}):
        box = [i, i, j, j]
        while boxes and not (boxes[-1][1] < box[0] and boxes[-1][3] < box[2]):
            p, q, r, s = boxes.pop()
            box = [min(p, box[0]), max(q, box[1]), min(r, box[2]), max(s, box[3])]
        boxes.append(box)
    out: list = []
    i = j = 0
    for p, q, r, s in [*boxes, [len(a), len(a), len(b), len(b)]]:
        out += loose(a[i:p], b[j:r], apart)
        if p < len(a):
            out.append(grouped(a[p : q + 1], b[r : s + 1], apart))
        i, j = q + 1, s + 1
    return out


def members(n: list) -> list[str]:
    return [c[SIG] for c in n[CHILDREN]] if n[SIG] == GROUP else [n[SIG]]


def folded(nodes: list) -> list:
    """Siblings with each signature once: those that repeat as a repeated element, or group where they alternate."""
    last = {s: i for i, n in enumerate(nodes) for s in members(n)}
    if len(last) == sum([len(members(n)) for n in nodes]):
        return nodes
    out, i = [], 0
    while i < len(nodes):
        j = end = i
        while j <= end:
            end = max([end, *[last[s] for s in members(nodes[j])]])
            j += 1
        out.append(nodes[i] if end == i else grouped(nodes[i : end + 1], [], False))
        i = end + 1
    return out


def grouped(a: list, b: list, apart: bool) -> list:
    """The elements of both stretches as one element or as a repeated group with each signature once."""
    if len(a) == len(b) == 1 and a[0][SIG] != GROUP and b[0][SIG] != GROUP:
        return merged(a[0], b[0], apart)
    sides: list[dict[str, list]] = []
    for nodes in (a, b):
        side: dict[str, list] = {}
        for n in nodes:
            for c in n[CHILDREN] if n[SIG] == GROUP else [n]:
                side[c[SIG]] = [*merged(side[c[SIG]], c, False)] if c[SIG] in side else c
        sides.append(side)
    one, two = sides
    out = [merged(n, two[s], apart) if s in two else optional(n) if two else n for s, n in one.items()]
    out += [optional(n) for s, n in two.items() if s not in one]
    if len(out) == 1:
        return [*out[0][:REPEATED], True, *out[0][SEEN:]]
    bare = any([bool(x) and all([n[OPTIONAL] for n in x]) for x in (a, b)])
    return [GROUP, bare, True, max([n[SEEN] for n in out]), 0, sum([n[CHARS] for n in out]), out]


def loose(a: list, b: list, apart: bool) -> list:
    """Stretches with no signature in common: elements of one tag and kind meet in order, the rest is optional."""
    waiting: dict[tuple[str, str], deque[int]] = {}
    for i, n in enumerate(a):
        if n[SIG] != GROUP:
            waiting.setdefault(parts(n[SIG])[0], deque()).append(i)
    new: list = [optional(n) for n in a]
    after: dict[int, list] = {}
    last = -1
    for n in b:
        places = waiting.get(parts(n[SIG])[0]) if n[SIG] != GROUP else None
        while places and (places[0] < last or places[0] == last and (last in after or not new[last][REPEATED])):
            places.popleft()
        if places:
            i = places[0]
            new[i] = merged(new[i] if i == last else a[i], n, apart and i != last)
            last = i
        else:
            after.setdefault(last, []).append(optional(n))
    out = after.get(-1, [])
    for i, n in enumerate(new):
        out += [n, *after.get(i, [])]
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression over tags, #text for slots and #same for constant text."""
    if node[SIG] == LEAF:
        body = "#same" if node[DIGEST] else "#text"
    else:
        inner = " ".join([expression(c) for c in node[CHILDREN]])
        body = f"({inner})" if node[SIG] == GROUP else f"<{node[SIG]}>{inner}</>" if node[SIG] else inner
    return body + ("+" if node[REPEATED] else "") + ("?" if node[OPTIONAL] else "")


def plain(wrapper: list) -> str:
    """A wrapper as text: its nodes in order, each with its depth."""
    rows: list = []
    stack = [(0, wrapper)]
    while stack:
        depth, n = stack.pop()
        rows.append([depth, n[SIG], int(n[OPTIONAL]) + 2 * int(n[REPEATED]), n[SEEN], n[DIGEST], n[CHARS]])
        stack += [(depth + 1, c) for c in reversed(n[CHILDREN])] if n[SIG] != LEAF else []
    return json.dumps(rows, separators=(",", ":"))


def unplain(text: str) -> list:
    path: list = []
    for depth, sig, flags, seen, digest, chars in json.loads(text):
        node = [sig, bool(flags & 1), bool(flags & 2), seen, digest, chars, []]
        del path[depth:]
        if path:
            path[-1][CHILDREN].append(node)
        path.append(node)
    return path[0]


def elements(node: list) -> Iterator[list]:
    """The children of a node, those of groups one by one."""
    for c in node[CHILDREN]:
        if c[SIG] == GROUP:
            yield from c[CHILDREN]
        else:
            yield c


def rules(wrapper: list) -> dict:
    """What extraction needs of a wrapper: the siblings along the way to the region, and constants to be dropped.

    way: for each step the siblings (signature, optional, repeated, digest) and the place of the one to take; drop: pairs of
    a parent's tag and kind and the digest of a constant.
    """
    deep()
    if wrapper[SEEN] < 2 or wrapper[DIGEST]:
        return {}
    slots: dict[int, tuple[int, bool]] = {}  # slot text of each element that is no aside, and whether headings have some

    def weigh(node: list, inside: bool) -> tuple[int, int, bool]:
        """Characters in slots and in all, and whether headings hold slots."""
        if node[SIG] == LEAF:
            return (0 if node[DIGEST] else node[CHARS]), node[CHARS], False
        if node[SIG] and is_aside(node[SIG], inside):
            return 0, 0, False
        inside = inside or main_kind(node[SIG]) is not None
        own = total = 0
        heads = False
        for c in elements(node):
            x, y, z = weigh(c, inside)
            own, total, heads = own + x, total + y, heads or z
        heads = heads or own > 0 and tag_of_node(node) in HEADINGS
        slots[id(node)] = own, heads
        return own, total, heads

    own, total, _ = weigh(wrapper, False)
    if own <= VARIED * total:
        return {}
    way, at, inside = [], wrapper, False
    while True:
        most = slots[id(at)][0]
        below = list(elements(at))
        heavy = max(range(len(below)), key=lambda k: slots.get(id(below[k]), (0,))[0], default=None)
        if heavy is None or tag_of_node(at) == "article":
            break
        best = below[heavy]
        if best[SIG] == LEAF or best[REPEATED] or not any(best is c for c in at[CHILDREN]) or slots.get(id(best), (0,))[0] < NEARLY_ALL * most:
            break
        if any(slots.get(id(c), (0, False))[1] for c in below if c is not best):
            break
        place = next(k for k, c in enumerate(at[CHILDREN]) if c is best)
        way.append([[[c[SIG], c[OPTIONAL], c[REPEATED], c[DIGEST]] if c[SIG] != GROUP else [GROUP, True, True, 0] for c in at[CHILDREN]], place])
        at, inside = best, inside or main_kind(best[SIG]) is not None
    drop: list = []
    constant = [0]

    def constants(node: list, inside: bool) -> None:
        inside = inside or main_kind(node[SIG]) is not None
        for c in elements(node):
            if c[SIG] != LEAF and (is_aside(c[SIG], inside) or tag_of_node(c) in HEADINGS):
                continue
            if c[DIGEST]:
                if c[CHARS] and c[SEEN] >= max(PAGES, node[SEEN] / 2):
                    drop.append([*parts(node[SIG])[0], c[DIGEST]])
                    constant[0] += c[CHARS]
            elif c[SIG] != LEAF:
                constants(c, inside)

    if wrapper[SEEN] >= PAGES:
        constants(at, inside)
    return {"way": way, "drop": drop if constant[0] <= slots[id(at)][0] else []}


def tag_of_node(node: list) -> str:
    return parts(node[SIG])[0][0]


def located(step: list, page: list) -> list | None:
    """The child of a page's element that the wrapper's step takes."""
    siblings, place = step
    wanted = siblings[place]
    kind, names = parts(wanted[0])
    fits = lambda s: parts(s)[0] == kind and names <= parts(s)[1]
    nodes = page[CHILDREN]
    # Between the nearest anchors on either side.
    known = [[s[0], 0, 0, 0, s[3]] for s in siblings]
    low, high, i, j = 0, len(nodes), 0, len(siblings)
    for p, q in anchors(known, nodes):
        if p == place:
            return nodes[q]
        if p < place:
            low, i = q + 1, p + 1
        else:
            high, j = q, p
            break
    here = [n for n in nodes[low:high] if n[SIG] != LEAF and fits(n[SIG])]
    like = [k for k in range(i, j) if siblings[k][0] != GROUP and parts(siblings[k][0])[0] == kind and parts(siblings[k][0])[1] >= names]
    sure = [k for k in like if not siblings[k][1] or k == place]
    rank = (sure if len(here) <= len(sure) else like).index(place)
    return here[min(rank, len(here) - 1)] if here else None


def blocks(node: list, inside: bool, drop: set[tuple[str, str, int]]) -> list[str]:
    """The texts of a part, block by block, without asides and constants."""
    out: list[str] = []
    stack = [(node, inside)]
    while stack:
        n, within = stack.pop()
        if n[SIG] == LEAF:
            out.append(n[CHILDREN])
            continue
        within = within or main_kind(n[SIG]) is not None
        own = parts(n[SIG])[0]
        for c in reversed(n[CHILDREN]):
            if (*own, c[DIGEST]) not in drop and (c[SIG] == LEAF or not is_aside(c[SIG], within)):
                stack.append((c, within))
    return out


def size(texts: list[str]) -> int:
    return sum([len(t) for t in texts])


def extract(page: str | None, told: dict | None = None) -> str:
    """The main text of a page by the rules of its host's wrapper, or by names where they don't tell."""
    root = tree(page or "", True)
    told = told or {}
    drop = {(a, b, d) for a, b, d in told.get("drop", [])}
    at: list | None = root if told.get("way") else None
    inside = False
    for step in told.get("way", []):
        at = located(step, at)
        if at is None:
            break
        inside = inside or main_kind(at[SIG]) is not None
    found = by_names(at, inside, drop) if at is not None else []
    return "\n\n".join(found or by_names(root, False, drop, True))


def by_names(root: list, inside: bool, drop: set[tuple[str, str, int]], alone: bool = False) -> list[str]:
    """The text of the articles, main elements or elements named as content in a part, else of the whole.

    The first kind counts that has half of the text, or an eighth where it is one element. alone: no wrapper has chosen
    the part, so without such elements the one with over half of the text right below it does.
    """
    whole = blocks(root, inside, drop)
    if tag_of_node(root) == "article":
        return whole
    kinds: list[list[list]] = [[], [], []]
    densest: tuple[int, list | None] = (0, None)
    stack = [(root, (inside, False, False, False))]
    while stack:
        n, around = stack.pop()
        kind = main_kind(n[SIG])
        if kind is not None and not around[kind + 1]:
            kinds[kind].append(n)
            around = (*around[: kind + 1], True, *around[kind + 2 :])
        below = 0
        for c in reversed(n[CHILDREN]):
            if c[SIG] != LEAF and not is_aside(c[SIG], any(around)):
                stack.append((c, around))
                below += sum([x[CHARS] for x in c[CHILDREN] if x[SIG] == LEAF])
        if below > densest[0]:
            densest = (below, n)
    for nodes in kinds:
        found = [t for n in nodes for t in blocks(n, True, drop)]
        if found and (2 if len(nodes) > 1 else 8) * size(found) >= size(whole):
            return found
    if not alone or any(kinds) or 2 * densest[0] <= size(whole):
        return whole
    return blocks(densest[1], inside, drop)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a partition; handed on early if there are many hosts or nodes."""
    deep()
    held: dict[str, list] = {}
    met: set[tuple[str, int]] = set()
    nodes = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([plain(w) for w in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                new = tree(page or "")
                if (host, new[DIGEST]) in met:
                    continue
                met.add((host, new[DIGEST]))
                held[host] = merged(held[host], new) if host in held else new
                nodes += (page or "").count("<")
                if len(held) >= HOSTS or nodes >= NODES:
                    yield out()
                    held.clear()
                    met.clear()
                    nodes = 0
    yield out()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    deep()
    wrapper = None
    for text in sorted(rows.wrapper):
        new = unplain(text)
        wrapper = new if wrapper is None else merged(wrapper, new)
    return pd.DataFrame({"host": [rows.host.iloc[0]], "wrapper": [plain(wrapper)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (its nodes as JSON) and rules (as JSON) of every host of pages."""
    folded_ = pages.select(host_of(F.col(quoted(url_col))).alias("host"), F.col(quoted(html_col)).alias("html")).mapInArrow(_fold, "host string, wrapper string")
    whole = folded_
    for groups in (4096, 64):
        whole = whole.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("salt")).applyInPandas(_merge, "host string, wrapper string")
    whole = whole.groupBy("host").applyInPandas(_merge, "host string, wrapper string")

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in batches:
            made = [json.dumps(rules(unplain(w)), separators=(",", ":")) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["host", "wrapper", "rules"])

    return whole.mapInArrow(ruled, "host string, wrapper string, rules string")


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """pages with the main text in text_col."""
    spark = pages.sparkSession
    found = stored(infer_wrappers(pages, url_col, html_col).select("host", "rules"), "rules")
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("rules")), F.lit(0))).first()[0]
    keep = [c for c in pages.columns if c.lower() != text_col.lower()]
    host, source, own = "host_in", "html_in", "rules_in"
    inner = [f"c{i}" for i in range(len(keep))]  # plain names while Python has the rows
    rows = pages.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, inner, strict=True)], host_of(F.col(quoted(url_col))).alias(host), F.col(quoted(html_col)).alias(source))
    small = size <= most_bytes
    told = spark.sparkContext.broadcast({r.host: json.loads(r.rules) for r in found.collect()} if small else {})
    if small:
        rows = rows.withColumn(own, F.lit(None).cast("string"))
    else:
        rows = rows.join(found.withColumnsRenamed({"host": f"{host}_2", "rules": own}), F.col(host) == F.col(f"{host}_2"), "left").drop(f"{host}_2")
    out = T.StructType([f for f in rows.schema.fields if f.name in inner] + [T.StructField("text_out", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                made = []
                for name, page, rule in zip(part.column(host).to_pylist(), part.column(source).to_pylist(), part.column(own).to_pylist(), strict=True):
                    made.append(extract(page, json.loads(rule) if rule else told.value.get(name)))
                heads = [f for f in part.schema if f.name in inner]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in heads] + [pa.array(made, pa.string())], schema=pa.schema([*heads, pa.field("text_out", pa.string())]))

    return rows.mapInArrow(run, out).select(*[F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)], F.col("text_out").alias(text_col))
