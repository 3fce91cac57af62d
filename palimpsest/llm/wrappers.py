"""Main text of web pages by wrappers: union-free regular expressions that same-host pages agree on.

A page's tokens are balanced into elements (inline markup is transparent). Its expression is the sequence of its
elements' tags with class names, in which tandem repeats become repeated groups. Two expressions of one host are aligned in
order: equal tags match and are merged inside, an element that only one side has becomes optional, one that either side
repeats becomes repeated. Pages are folded into their host's expression inside each task, then the tasks' expressions are
folded in two steps, so that a host with a third of all pages never meets in one task page by page.

A text is a constant or a slot. In how many pages of a host a place (the path of tags) has a text, any text, or an element is counted over all
pages, by grouping. Pages are distinct by their own main text, so copies of an article count once: the one with the least
list of places counts. (An expression that is folded by itself, without these counts, keeps the SAMPLE smallest keys of its pages.)

A host's expression decides, once LEAST distinct pages are known:

* The main region is the article or main element with most of the slot text, else the innermost container that holds nine
  tenths of it. Constants and the text of links are no slot text.
* A text that nine tenths of the distinct pages have at the same place (outside article and main, of those with a text there) is
  template and goes, inside the region too. A place is constant if of the texts that its pages have, nine tenths are template. An
  article's own headings stay, and so does everything if more than half of a page's region would go, as in near copies.
* Outside article and main, an element that is mostly links over the host's pages, and on the page, is a menu and goes.
* An element with half of the host's slot text stays, whatever its class names say.

What HTML itself names otherwise goes everywhere: navigation, footers, asides, forms, scripts, and headers outside an
article. Class names that say advert, comment, notice and the like (whole names, or known first words of them) break what
ties are left; they never count on html, body, article, main or what holds these. A page that lacks its host's region is cut
by its own expression; if nothing is left, class names are not regarded.

Rules of at most max_broadcast bytes, which is checked, are broadcast; more are joined by host.

Defined results: null html is empty and gives an empty text. Pages with null or odd URLs share the host "". Repeated rows
repeat. An empty table gives an empty result. Texts of any length and elements of any depth are read; below LEARNT levels
an expression has only text, which changes no page's markup. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Comments, declarations, tags with well or badly quoted attributes, text.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][\w:-]*+)((?:[^\s<>=]++|\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>]*+)|\s++)*+)>|<|[^<]+", re.S)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select button".split())
#: Elements that a following one of the same set ends, unless one of the second set is nearer.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = frozenset("ul ol dl table".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th dt".split())
MAIN = frozenset(("article", "main"))
LEFT_OUT = frozenset("head nav footer aside form menu dialog script style noscript template metadata desc defs".split())
#: Class names, ids and roles of what is not the article; those that an article may have itself; first words of longer
#: names; last words behind a place.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
OWN = frozenset("header modal widget menu".split())
FIRST = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comments cookie cookies consent disqus gdpr nav navbar newsletter pagination popup promo sidebar sponsored subscribe".split())
#: Words for a box or a place, and names that may be what an article is about.
BOX = frozenset("area bar block body bottom box button buttons card center col column container content footer form group header holder icon icons inline inner item items label layer left link links list main outer overlay panel part post posts right row section slot small space text thread title top unit wide wrap wrapper zone 0".split())
SUBJECT = frozenset("comment comments login notice pager promoted related replies share sharing social sponsor sponsored subscribe".split())
LAST, PLACES = frozenset("nav navigation menu footer header sidebar ads banner".split()), frozenset("site page main top bottom left right primary secondary global".split())
#: Distinct pages that are compared, the fewest that decide, and the share of them that makes a text template.
SAMPLE, LEAST, SHARE = 16, 4, 0.9
#: Share of link text from which an element is a menu; levels of an expression; hosts that a task holds.
LINKED, LEARNT, MOST_HOSTS = 0.6, 150, 2000
#: Pairs of equal places that an alignment looks at.
MOST_PAIRS = 1 << 20


class Link(str):
    """Text of a link."""

    __slots__ = ()


class Element:
    __slots__ = ("sig", "kids", "holds")

    def __init__(self, sig: str) -> None:
        self.sig, self.kids, self.holds = sig, [], False


def name_of(sig: str) -> str:
    return sig.partition(" ")[0]


def signature(name: str, attributes: str) -> str:
    words = {re.sub(r"\d+", "0", w) for m in NAMES.finditer(attributes) for w in "".join(filter(None, m.groups())).lower().split()} if attributes else ()
    return " ".join([name, *sorted(words)])


def parse(page: str) -> Element:
    """The balanced page: elements and runs of text."""
    root = Element("#page")
    stack, opened = [root], Counter()
    end, links = 0, 0

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[name_of(e.sig)] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() < end:
            continue
        closing, name = m[1], m[2]
        if name is None:
            if page[m.start()] != "<" or m[0] == "<":
                stack[-1].kids.append(Link(m[0]) if links else m[0])
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        if closing:
            if opened[name] > 0:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if name_of(stack[k].sig) == name))
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, m.end())
            end = close.end() if close else len(page)
            stack[-1].kids.append(" ")
            continue
        if name in VOID:
            stack[-1].kids.append(" ")
            continue
        ends = ENDED.get(name)
        if ends is None:
            if name_of(stack[-1].sig) == "p":
                cut(len(stack) - 1)
        elif any(opened[x] > 0 for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if (open_ := name_of(stack[k].sig)) in ends:
                    cut(k)
                    break
                if open_ in FENCES:
                    break
        e = Element(signature(name, m[3]))
        stack[-1].kids.append(e)
        if name in MAIN:
            for x in reversed(stack):
                if x.holds:
                    break
                x.holds = True
        if not m[3].endswith("/") or name not in ("path", "circle", "rect", "line", "use", "g"):
            stack.append(e)
            opened[name] += 1
    return root


def clean(runs: list[str]) -> str:
    return " ".join(entities.unescape("".join(runs)).split())


def named_out(sig: str, inside: bool) -> bool:
    """Whether class names, ids or roles say that this is not the article. Inside it, a longer name must consist of such words and of words
    for a place or box, and a word that may be the article's own subject must not stand beside another one."""
    words = sig.split(" ")[1:]
    for w in words:
        first, *rest = re.split("[-_]+", w)
        if inside and rest and not all(p in NAMED or p in BOX for p in rest):
            continue
        if inside and w in SUBJECT and not all(p in NAMED or p in BOX for x in words for p in re.split("[-_]+", x)):
            continue
        if (w in NAMED and not (inside and w in OWN)) or (rest and first in FIRST) or (rest and not inside and first in PLACES and rest[-1] in LAST):
            return True
        if rest and first == "related" and rest[0] in ("posts", "articles", "links", "stories", "content"):
            return True
    return False


def left_out(sig: str, holds: bool, inside: bool, keep: frozenset | set = frozenset(), names: bool = True) -> bool:
    """holds: whether article or main is below; inside: whether it is above; keep: what the host's expression keeps."""
    name = name_of(sig)
    if name in LEFT_OUT or (name == "header" and not inside):
        return not (holds and name != "head")
    return names and not holds and name not in ("html", "body", "article", "main") and sig not in keep and named_out(sig, inside)


# An expression is a list of nodes; of a text, sig is "#".
SIG, KIDS, MANY, MAYBE, SEEN, CHARS, LINKS, TEXTS = range(8)


def _hash(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode("utf-8", "replace"))


def _all_text(e: Element) -> list[str]:
    """Runs of text of an element of any depth."""
    out, stack = [], [iter(e.kids)]
    while stack:
        for k in stack[-1]:
            if isinstance(k, str):
                out.append(k)
            else:
                out.append(" ")
                stack.append(iter(k.kids))
                break
        else:
            stack.pop()
            out.append(" ")
    return out


def expression(e: Element, seen: list[str] | None = None, level: int = 0) -> list:
    """The page's own expression: tandem repeats are folded, all nodes share the list of the page's key."""
    kids: list = []
    runs: list[str] = []
    seen = [] if seen is None else seen

    def close() -> None:
        if text := clean(runs):
            linked = len(clean([r for r in runs if isinstance(r, Link)]))
            kids.append(["#", [], 0, 0, seen, len(text), linked, {_hash(text): seen}])
        runs.clear()

    for k in e.kids if level < LEARNT else _all_text(e):
        if isinstance(k, str):
            runs.append(k)
        else:
            close()
            kids.append(expression(k, seen, level + 1))
    close()
    return [e.sig, fold(kids), 0, 0, seen, 0, 0, {}]


def _least(a: list[str], b: list[str]) -> list[str]:
    return a if a is b or a == b else sorted({*a, *b})[:SAMPLE]


def merge(a: list, b: list) -> list:
    seen = _least(a[SEEN], b[SEEN])
    texts: dict = {}
    if a[SEEN] is b[SEEN]:
        texts = {**a[TEXTS], **b[TEXTS]}  # of one page
    elif a[TEXTS] and len(seen) == SAMPLE and seen == a[SEEN] and (not b[SEEN] or b[SEEN][0] > seen[-1]):
        texts = a[TEXTS]  # no compared page is new
    elif a[TEXTS] or b[TEXTS]:
        limit = seen[-1] if len(seen) == SAMPLE else "~"
        for t in a[TEXTS].keys() | b[TEXTS].keys():
            keys = [k for k in _least(a[TEXTS].get(t, []), b[TEXTS].get(t, [])) if k <= limit]
            if keys:  # a text of no compared page decides nothing
                texts[t] = keys
    return [a[SIG], align(a[KIDS], b[KIDS]), a[MANY] | b[MANY], a[MAYBE] | b[MAYBE], seen, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], texts]


def _group(name: str, nodes: list) -> list:
    return [name, nodes, 1, 0, nodes[0][SEEN], 0, 0, {}]


def fold(kids: list) -> list:
    """Neighbours that repeat become one repeated node; repeats of two or three nodes become a repeated group."""
    for period in (1, 2, 3):
        out: list = []
        for node in kids:
            out.append(node)
            if period == 1 and len(out) > 1 and out[-2][SIG] == node[SIG] and node[SIG] != "#":
                out.pop()
                out[-1] = merge(out[-1], node)
                out[-1][MANY] = 1
            elif period > 1 and len(out) >= period:
                name = "(" + ",".join(x[SIG] for x in out[-period:]) + ")"
                if len(out) > period and out[-period - 1][SIG] == name:
                    group = _group(name, out[-period:])
                    del out[-period:]
                    out[-1] = merge(out[-1], group)
                elif len(out) >= 2 * period and [x[SIG] for x in out[-2 * period : -period]] == [x[SIG] for x in out[-period:]]:
                    out[-2 * period :] = [merge(_group(name, out[-2 * period : -period]), _group(name, out[-period:]))]
        kids = out
    return kids


def align(a: list, b: list) -> list:
    """Nodes of equal tags in the longest common order merge; the others are optional."""
    if [x[SIG] for x in a] == [x[SIG] for x in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*common_order([x[SIG] for x in a], [x[SIG] for x in b]), (len(a), len(b))]:
        out += [[*x[:MAYBE], 1, *x[SEEN:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def common_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. By equal places in ascending order of a and descending of b, of which the longest chains
    are kept (a place a length, with links back), so memory goes with the pairs of equal places; where these are more than
    MOST_PAIRS, as with many nodes of few tags, every place takes the first equal one that is left."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [(k, k) for k in range(low)], [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    at: dict[str, list[int]] = {}
    for j in range(low, len(b) - high):
        at.setdefault(b[j], []).append(j)
    own = [i for i in range(low, len(a) - high) if a[i] in at]
    if sum(len(at[a[i]]) for i in own) > MOST_PAIRS:
        return ends[0] + _first_left(a, own, at, low) + ends[1]
    last: list[int] = []  # of the chains of each length, the least end in b
    link: list[tuple] = []
    for i in own:
        for j in reversed(at[a[i]]):
            k = bisect_left(last, j)
            chain = (i, j, link[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                link.append(chain)
            else:
                last[k], link[k] = j, chain
    found, chain = [], link[-1] if link else None
    while chain:
        found.append(chain[:2])
        chain = chain[2]
    return ends[0] + found[::-1] + ends[1]


def _first_left(a: list[str], own: list[int], at: dict[str, list[int]], low: int) -> list[tuple[int, int]]:
    out, free = [], low
    for i in own:
        k = bisect_left(at[a[i]], free)
        if k < len(at[a[i]]):
            out.append((i, at[a[i]][k]))
            free = out[-1][1] + 1
    return out


class Rule:
    """What a host's expression, or one page's own, says: the path to the main region, whether that is an article or main
    element, texts that are template (hashes of path and text), paths of menus, elements kept against their class names."""

    def __init__(self, path: list[str], named: bool, drop: list[str], menus: list[str], keep: list[str]) -> None:
        self.path, self.named, self.drop, self.menus, self.keep = path, named, frozenset(drop), frozenset(menus), frozenset(keep)

    def written(self) -> str:
        return json.dumps([self.path, self.named, sorted(self.drop), sorted(self.menus), sorted(self.keep)])


class Facts:
    """Exact counts of a host's distinct pages: their number, template texts (hashes of place and text), constant places, and
    elements' places in at least LEAST pages."""

    def __init__(self, pages: int, common: list[int], constant: list[int], often: list[int]) -> None:
        self.pages, self.common, self.constant, self.often = pages, [f"{x + (1 << 63):016x}" for x in common], frozenset(constant), frozenset(often)


def _place(path: str, inside: bool) -> int:
    """A place as a long, which is odd within article or main."""
    return (xxhash.xxh64_intdigest(path.encode("utf-8", "replace")) >> 1) & ~1 | inside


#: What a place has: an element, any text, a text, a text of a heading in article or main.
ELEMENT, TEXT, OWN_TEXT, HEADING = range(4)


def places_of(own: list) -> list[tuple[int, int, int]]:
    """What a page has at which place, each once: (place, hash of the place with a text or 0, kind)."""
    found: set[tuple[int, int, int]] = set()
    stack = [(own, "", False)]
    while stack:
        node, at, inside = stack.pop()
        at, inside = _step(at, node[SIG]), inside or name_of(node[SIG]) in MAIN
        kind = HEADING if inside and name_of(node[SIG]) in HEADINGS else OWN_TEXT
        for k in node[KIDS]:
            if k[SIG] == "#":
                here = _place(at, inside)
                found.add((here, 0, TEXT))
                found.update((here, int(_template(at, t), 16) - (1 << 63), kind) for t in k[TEXTS])
            else:
                if not k[SIG].startswith("("):
                    found.add((_place(_step(at, k[SIG]), inside), 0, ELEMENT))
                stack.append((k, at, inside))
    return sorted(found)


def bare(node: list) -> list:
    """The expression without keys and texts, which are counted apart."""
    return [node[SIG], [bare(k) for k in node[KIDS]], *node[MANY:SEEN], [], *node[CHARS:TEXTS], {}]


def _step(path: str, sig: str) -> str:
    return path if sig.startswith("(") else f"{path}>{sig}"


def _template(path: str, text_hash: str) -> str:
    return _hash(f"{path} {text_hash}")


def rule_of(wrapper: list, names: bool = True, facts: Facts | None = None) -> Rule:
    """facts: counts over all pages, with which the expression's own keys are not regarded."""
    pages = set(wrapper[SEEN])
    enough = (facts.pages if facts else len(pages)) >= LEAST
    holds, weight, chars, linked = {}, {}, {}, {}

    def common(keys: list[str], of: set) -> bool:
        return len(of.intersection(keys)) >= max(LEAST, SHARE * len(of))

    def measure(node: list, inside: bool, keep: frozenset | set, path: str = "") -> None:
        at_parent, path = path, _step(path, node[SIG])
        inside = inside or name_of(node[SIG]) in MAIN
        for k in node[KIDS]:
            measure(k, inside, keep, path)
        at = id(node)
        holds[at] = any(name_of(k[SIG]) in MAIN or holds[id(k)] for k in node[KIDS])
        if node[SIG] == "#":
            if facts:
                template = enough and _place(at_parent, inside) in facts.constant
            else:
                template = enough and node[TEXTS] and all(common(t, set(node[SEEN])) for t in node[TEXTS].values())
            weight[at], chars[at], linked[at] = (0 if template else node[CHARS] - node[LINKS]), node[CHARS], node[LINKS]
        else:
            weight[at], chars[at], linked[at] = (sum(d[id(k)] for k in node[KIDS]) for d in (weight, chars, linked))
            if left_out(node[SIG], holds[at], inside, keep):
                weight[at] = 0

    keep: set[str] = set()
    if enough:  # half of the slot text outweighs a class name
        measure(wrapper, False, _Every())
        total = weight[id(wrapper)]

        def heavy(node: list) -> None:
            for k in node[KIDS]:
                if total and weight[id(k)] * 2 >= total:
                    keep.add(k[SIG])
                heavy(k)

        heavy(wrapper)
    measure(wrapper, False, keep if names else _Every())
    path, named = _region(wrapper, weight)
    drop, menus = [], []
    if enough:

        def collect(node: list, at: str, inside: bool) -> None:
            at, inside = _step(at, node[SIG]), inside or name_of(node[SIG]) in MAIN
            for k in node[KIDS]:
                if k[SIG] == "#":
                    of = pages if inside else set(k[SEEN])
                    if not facts and not (inside and name_of(node[SIG]) in HEADINGS):
                        drop.extend(_template(at, t) for t, keys in k[TEXTS].items() if common(keys, of))
                else:
                    often = _place(_step(at, k[SIG]), inside) in facts.often if facts else len(k[SEEN]) >= LEAST
                    if not inside and chars[id(k)] and linked[id(k)] >= LINKED * chars[id(k)] and often and name_of(k[SIG]) not in MAIN:
                        menus.append(_step(at, k[SIG]))
                    collect(k, at, inside)

        collect(wrapper, "", False)
        drop += facts.common if facts else []
    return Rule(path, named, drop, menus, sorted(keep))


class _Every(frozenset):
    def __contains__(self, x: object) -> bool:
        return True


def _region(wrapper: list, weight: dict[int, int]) -> tuple[list[str], bool]:
    """The path of tags to the main region, and whether it is an article or main element."""
    total = weight[id(wrapper)]
    named: list[tuple[int, list[str]]] = []

    def find(node: list, at: list[str]) -> None:
        for k in node[KIDS]:
            if k[SIG] != "#":
                if name_of(k[SIG]) in MAIN or "main" in k[SIG].split(" ")[1:]:
                    named.append((weight[id(k)], [*at, k[SIG]]))
                find(k, [*at, k[SIG]])

    find(wrapper, [])
    if named and (best := max(named, key=lambda x: (x[0], -len(x[1]))))[0] * 2 >= total and (best[0] or not total):
        return best[1], name_of(best[1][-1]) in MAIN
    path, node = [], wrapper
    while total:
        inner = [k for k in node[KIDS] if name_of(k[SIG]) in CONTAINERS and weight[id(k)] * 10 >= total * 9]
        if len(inner) != 1:
            break
        node = inner[0]
        path.append(node[SIG])
    return path, False


def regions_of(root: Element, path: list[str]) -> list[Element]:
    """The elements at the path; names of repeated groups take no step."""
    now = [root]
    for sig in path:
        if not sig.startswith("("):
            now = [k for e in now for k in e.kids if isinstance(k, Element) and k.sig == sig]
    return now


def _menu(e: Element) -> bool:
    runs = _all_text(e)
    whole = len(clean(runs))
    return bool(whole) and len(clean([r if isinstance(r, Link) else " " for r in runs])) >= LINKED * whole


def blocks_of(e: Element, at: str, rule: Rule, names: bool) -> list[tuple[str, bool]]:
    """Block texts in order, and whether they are template."""
    out: list[tuple[str, bool]] = []
    runs: list[str] = []

    def close(at: str) -> None:
        if text := clean(runs):
            out.append((text, bool(rule.drop) and _template(at, _hash(text)) in rule.drop))
        runs.clear()

    stack = [(iter(e.kids), at, rule.named)]
    while stack:
        kids, at, inside = stack[-1]
        for k in kids:
            if isinstance(k, str):
                runs.append(k)
                continue
            close(at)
            below = inside or name_of(k.sig) in MAIN
            if left_out(k.sig, k.holds, below, rule.keep, names) or (rule.menus and _step(at, k.sig) in rule.menus and not k.holds and _menu(k)):
                continue
            stack.append((iter(k.kids), _step(at, k.sig), below))
            break
        else:
            close(at)
            stack.pop()
    return out


def text_by(root: Element, rule: Rule, names: bool = True) -> str:
    at = reduce(_step, rule.path, ">#page")
    blocks = [b for e in regions_of(root, rule.path) for b in blocks_of(e, at, rule, names)]
    template = sum(len(t) for t, drop in blocks if drop)
    whole = rule.named and template * 2 > sum(len(t) for t, _ in blocks)
    return " ".join(t for t, drop in blocks if whole or not drop)


def main_text(page: str, rule: Rule | None) -> str:
    root = parse(page)
    if rule is not None and (text := text_by(root, rule)):
        return text
    own = rule_of(expression(root))
    if rule is not None:
        own = Rule(own.path, own.named, [], [], sorted(rule.keep))
    return text_by(root, own) or text_by(root, Rule([], False, [], [], []), names=False)


def keyed(root: Element) -> list:
    """The page's own expression, its key the hash of its own main text, whatever class names say."""
    own = expression(root, seen := [])
    if text := text_by(root, rule_of(own, names=False), names=False):
        seen.append(_hash(text))
    return own


def _folded(rows: pd.DataFrame) -> list:
    return reduce(merge, (json.loads(w) for w in sorted(rows["wrapper"])))


def infer(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """host, rule (JSON) for pages with a column host, learned from all pages."""

    names = ["host", "wrapper", "page", "places", "texts", "kinds"]
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def batch(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            none = [None] * len(held)
            out = batch(list(held), [json.dumps(w) for w in held.values()], none, none, none, none)
            held.clear()
            return out

        for b in batches:
            out = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                own = keyed(root)
                if own[SEEN]:  # a page without text is no distinct one
                    out.append((host, None, int(own[SEEN][0], 16) - (1 << 63), *map(list, zip(*places_of(own), strict=True))))
                own = bare(own)
                held[host] = merge(held[host], own) if host in held else own
                if len(held) >= MOST_HOSTS:
                    yield flush()
            if out:
                yield batch(*zip(*out, strict=True))
        yield flush()

    def fold_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(_folded(rows))]})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = [rule_of(json.loads(w), facts=Facts(n or 0, *(x or [] for x in lists))).written() for w, n, *lists in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.string())], names=["host", "rule"])

    read = saved(pages.select("host", html_col).mapInArrow(learn, "host string, wrapper string, page long, places array<long>, texts array<long>, kinds array<int>"), "folded")
    parts = read.where("wrapper is not null").select("host", "wrapper")
    some = parts.groupBy("host", F.pmod(F.spark_partition_id(), F.lit(64)).alias("share")).applyInPandas(fold_part, "host string, wrapper string")
    folded = some.groupBy("host").applyInPandas(fold_part, "host string, wrapper string")
    return folded.join(facts_of(read.where("page is not null")), "host", "left").select("host", "wrapper", "pages", "common", "constant", "often").mapInArrow(decide, "host string, rule string")


def facts_of(read: DataFrame) -> DataFrame:
    """host, pages, common, constant, often (Facts) of rows host, page (key), places, texts, kinds: exact counts of distinct pages."""
    one = read.groupBy("host", "page").agg(F.min(F.struct("places", "texts", "kinds")).alias("p"))
    one = one.select("host", "p.*")
    pages = one.groupBy("host").agg(F.count("*").alias("pages"))
    flat = one.select("host", F.explode(F.arrays_zip("places", "texts", "kinds")).alias("x")).select("host", F.col("x.places").alias("place"), F.col("x.texts").alias("text"), F.col("x.kinds").alias("kind"))
    n = flat.groupBy("host", "place", "text", "kind").agg(F.count("*").alias("n"))
    # texts of fewer pages than decide are one row of a place
    rare = (F.col("kind") >= OWN_TEXT) & (F.col("n") < LEAST)
    n = n.select("host", "place", F.when(rare, 0).otherwise(F.col("text")).alias("text"), "kind", F.when(rare, 0).otherwise(F.col("n")).alias("most"), "n")
    n = saved(n.groupBy("host", "place", "text", "kind").agg(F.max("most").alias("most"), F.sum("n").alias("n")), "counts")
    any_ = n.where(F.col("kind") == TEXT).select("host", "place", F.col("n").alias("any"))
    met = n.where(F.col("kind") >= OWN_TEXT).join(any_, ["host", "place"]).join(pages, "host")
    common = lambda of: F.col("most") >= F.greatest(F.lit(float(LEAST)), F.lit(SHARE) * of)
    inside = F.col("place") % 2 == 1
    texts = met.where((F.col("kind") == OWN_TEXT) & common(F.when(inside, F.col("pages")).otherwise(F.col("any")))).groupBy("host").agg(F.collect_list("text").alias("common"))
    shares = met.groupBy("host", "place").agg(F.sum(F.when(common(F.col("any")), F.col("n")).otherwise(0)).alias("_c"), F.sum("n").alias("_n"))
    constant = shares.where(F.col("_c") >= F.lit(SHARE) * F.col("_n")).groupBy("host").agg(F.collect_list("place").alias("constant"))
    often = n.where((F.col("kind") == ELEMENT) & (F.col("n") >= LEAST) & ~inside).groupBy("host").agg(F.collect_list("place").alias("often"))
    return pages.join(texts, "host", "left").join(constant, "host", "left").join(often, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, max_broadcast: int = 8 << 20) -> DataFrame:
    """page_id, url, text."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][\w+.\-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    rules = saved(infer(rows), "wrappers")
    size = rules.agg(F.sum(F.length("host") + F.length("rule") + 32)).first()[0] or 0
    met = rows.join(F.broadcast(rules) if size <= max_broadcast else rules, "host", "left").select("page_id", "url", "html", "rule")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Rule] = {}

        def read(rule: str | None) -> Rule | None:
            if rule is not None and rule not in known:
                if len(known) >= MOST_HOSTS:
                    known.clear()
                known[rule] = Rule(*json.loads(rule))
            return rule and known[rule]

        for b in batches:
            texts = [main_text(page or "", read(rule)) for page, rule in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.mapInArrow(cut, "page_id long, url string, text string")
