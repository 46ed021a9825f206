"""Operator 9, HTML extraction by wrapper induction.

Pages of a host that share a layout (the keys of their upper containers) form a group. Every page is parsed into an outline, the tree of its block
elements with hashes of their own texts. Of each group one page is the reference: of SAMPLE distinct ones, that which matches the others best. All
distinct pages of the group are aligned with it by simple tree matching, and what they have at each of its nodes is counted: a node at which at least
TEMPLATE_SHARE of three or more pages have the same text is template, other nodes are slots. The article or main element, else the innermost container, that holds the bulk of the slots'
text is the group's content element. Every page is then read whole: aligned with its group's wrapper, it gives the texts of its content elements, without
template nodes and without elements that HTML itself marks as something else (nav, header, footer, aside, form and its controls, menu, dialog, hidden ones, roles;
an article inside an article, which is HTML's form of a reader's comment). Names of classes and ids only tell nodes apart. A page that shares its layout with no other page, or whose
group's text doesn't vary, is judged by where its own text lies.

Outlines and references are small (25 bytes an element); they meet in lookups that deal out hot hosts, statistics are combined in tasks before they are shuffled,
and pages travel only if the wrappers are too large to be broadcast (by their measured size). Tree matching is exact: scores are shared between equal
shapes, long lists of children are aligned in linear space.

Blocks are the texts between block-level tags, with character references decoded and each run of white space one space; empty ones are left out, the others
joined by a blank line.

Cases: null html or one without text gives an empty text; a null URL, or one without ``://``, belongs to host ''; repeated rows each give a row, and count once for the
wrapper; broken markup is closed as browsers do, roughly; of an unfinished tag at the end, the name and attributes are dropped and other text is kept; an
empty table gives an empty result; other columns are ignored. Depth, length and number of elements are not bounded.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import SMALL, cut, spread_lookup
from hearthspark.llm.urlfilter import host_and_path

#: Distinct pages of a group among which the reference is chosen. Statistics are of all pages.
SAMPLE = 5
#: Share of the pages at a node that must have one text, and their least number, for a template node.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 3
#: Share of the varying text that an article or main element must hold, and that a container must hold of the one around it, to be the content element.
ARTICLE_SHARE, INNER_SHARE = 0.5, 0.8
#: Levels of the tree, from html and body, whose containers tell layouts apart.
LAYOUT_DEPTH = 4
#: Cells of a table of tree matching that is held at once; larger ones are computed in linear space.
CELLS = 1 << 21

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it ends at their own end tag only.
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "address header footer nav aside form fieldset details summary hr center head menu dialog search".split()
)
#: Elements that HTML itself sets apart from the main text, and those roles.
APART = frozenset("nav header footer aside fieldset menu dialog search head button select datalist noscript template".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
CONTAINERS = frozenset("html body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z/][^<>]*\Z", re.S)
_ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNFINISHED = re.compile(r"""<[A-Za-z/][\w:-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"']+))*""")
#: An opening tag of the key ends open elements of these tags, up to the nearest of the limits.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Flags of a node.
SET_APART, CONTAINER, ARTICLE, MAIN, HEADER, HEADING, TEMPLATE, FORM = (1 << i for i in range(8))
NODE = np.dtype([("key", "<u8"), ("parent", "<i4"), ("text", "<u8"), ("chars", "<i4"), ("flags", "u1")])


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


@lru_cache(1 << 14)
def _key(key: str) -> int:
    return _hash(key)


@lru_cache(1 << 14)
def _element(tag: str, attrs: str) -> tuple[str, int]:
    """Key (tag, class and id names without numbers) and flags."""
    key, apart, main = tag, tag in APART, tag == "main"
    if "=" in attrs or "hidden" in attrs:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        names = re.sub(r"\d+", "#", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
        if names:
            key = tag + "." + ".".join(sorted(set(names)))
        role, style = found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
        main = main or role == "main"
        if tag not in ("html", "body", "article", "main"):
            apart = apart or role in ROLES or "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true"
    flags = SET_APART * apart | CONTAINER * (tag in CONTAINERS) | ARTICLE * (tag == "article") | MAIN * main | HEADER * (tag == "header") | HEADING * (tag in HEADINGS) | FORM * (tag == "form")
    return key, flags


class Outline:
    """Block elements in page order: ``nodes`` (key, parent, hash and length of the own text, flags), ``children`` lists, and ``runs``, (node, text) in page order."""

    def __init__(self, keys: list[str], parents: list[int], flags: list[int], runs: list[tuple[int, str]]) -> None:
        self.runs = runs
        own: dict[int, list[str]] = {}
        for at, text in runs:
            own.setdefault(at, []).append(text)
        self.nodes = np.zeros(len(keys), NODE)
        self.nodes["key"], self.nodes["parent"], self.nodes["flags"] = [_key(k) for k in keys], parents, flags
        for at, texts in own.items():
            self.nodes["text"][at], self.nodes["chars"][at] = _hash("\n".join(texts)) or 1, sum(map(len, texts))
        top: set[str] = set()
        paths = [""] * len(keys)
        depth = [0] * len(keys)
        for i in range(1, len(keys)):
            depth[i] = depth[parents[i]] + 1
            if depth[i] <= LAYOUT_DEPTH and flags[i] & (CONTAINER | SET_APART):
                paths[i] = f"{paths[parents[i]]}/{keys[i]}"
                top.add(paths[i])
        self.layout = f"{_hash('|'.join(sorted(top))):016x}"


def outline(text: str | None) -> Outline:
    """Parses a page, without recursion."""
    text = text or ""
    keys, parents, flags, runs = ["#root"], [-1], [CONTAINER], []
    parts: list[str] = []
    # Per open element: tag, block it belongs to, place of the nearest open block, whether its texts are left out (it is inline and set apart).
    tags, block, near, mute = ["#root"], [0], [0], [False]
    opened: dict[str, int] = {}

    def flush() -> None:
        if parts:
            run = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if run:
                runs.append((block[-1], run))

    def close(i: int) -> None:
        """Ends the open elements from place ``i`` on."""
        if near[-1] >= i:
            flush()
        for t in tags[i:]:
            opened[t] -= 1
        del tags[i:], block[i:], near[i:], mute[i:]

    def last(ends: set[str], limits: set[str]) -> int:
        """Place of the last open element of ``ends`` after any of ``limits``; 0 without one."""
        if any(opened.get(t) for t in ends):
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in limits:
                    break
                if tags[i] in ends:
                    return i
        return 0

    at = 0
    while m := _TOKEN.search(text, at):
        if m.start() > at and not mute[-1]:
            parts.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            if at == len(text) and re.match("<[A-Za-z/]", m[0]) and not m[0].endswith(">") and not mute[-1]:
                parts.append(m[0][_UNFINISHED.match(m[0]).end() :])
            continue
        tag = m[2].lower()
        if m[1]:
            if i := last({tag}, frozenset() if tag in BLOCK else frozenset({"article", "main", "table"})):
                close(i)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in _CLOSES:
            if i := last(*_CLOSES[tag]):
                # The outermost of these ends: a row with its cells.
                while i > 1 and tags[i - 1] in _CLOSES[tag][0]:
                    i -= 1
                close(i)
        elif tag in BLOCK:
            if tags[near[-1]] == "p":
                close(near[-1])
            if (opened.get("button") or opened.get("select")) and (i := last({"button", "select"}, {"form"})):
                close(i)
        if tag == "br":
            parts.append(" ")
        if tag in VOID and tag not in BLOCK:
            continue
        key, flag = _element(tag, m[3])
        if tag in BLOCK:
            flush()
            # What lies in an inline element that is left out is left out too.
            keys.append(key)
            parents.append(block[-1])
            flags.append(flag | SET_APART * mute[-1])
        if tag not in VOID and not m[3].endswith("/"):
            opened[tag] = opened.get(tag, 0) + 1
            is_block = tag in BLOCK
            block.append(len(keys) - 1 if is_block else block[-1])
            near.append(len(tags) if is_block else near[-1])
            mute.append(False if is_block else mute[-1] or bool(flag & SET_APART))
            tags.append(tag)
    if at < len(text) and not mute[-1]:
        parts.append(text[at:])
    flush()
    return Outline(keys, parents, forms(keys, parents, flags, runs), runs)


def forms(keys: list[str], parents: list[int], flags: list[int], runs: list[tuple[int, str]]) -> list[int]:
    """Flags with each form set apart, or a container if it holds an article, a main element, an h1 or over half of the page's text: some pages lie in one form as a whole."""
    if not any(f & FORM for f in flags):
        return flags
    chars, holds = [0] * len(keys), [bool(f & (ARTICLE | MAIN)) or k.split(".")[0] == "h1" for k, f in zip(keys, flags, strict=True)]
    for i, run in runs:
        chars[i] += len(run)
    for i in range(len(keys) - 1, 0, -1):
        chars[parents[i]] += chars[i]
        holds[parents[i]] |= holds[i]
    return [f | (CONTAINER if holds[i] or 2 * chars[i] > chars[0] else SET_APART) if f & FORM else f for i, f in enumerate(flags)]


class Matcher:
    """Simple tree matching: the largest number of node pairs with equal keys that keeps order and ancestry. Trees of equal shape share their scores."""

    def __init__(self) -> None:
        self.age = 0
        self.restart()

    def restart(self) -> None:
        """Forgets all shapes."""
        self.age += 1
        self.ids: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.sizes: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def classes(self, tree: Tree) -> list[int]:
        """Number of each node's shape."""
        out = [0] * len(tree.keys)
        for i in range(len(out) - 1, -1, -1):
            shape = (tree.keys[i], *[out[c] for c in tree.children[i]])
            if shape not in self.ids:
                self.ids[shape] = len(self.shapes)
                self.shapes.append(shape)
                self.sizes.append(1 + sum(self.sizes[c] for c in shape[1:]))
            out[i] = self.ids[shape]
        return out

    def score(self, a: int, b: int) -> int:
        """Of two shapes; 0 if the roots differ."""
        if self.shapes[a][0] != self.shapes[b][0]:
            return 0
        if a == b:
            return self.sizes[a]
        work = [(a, b)]
        while work:
            x, y = work[-1]
            if (x, y) in self.memo:
                work.pop()
                continue
            xs, ys = self.shapes[x][1:], self.shapes[y][1:]
            # Equal shapes at either end match each other in some best matching.
            lo = 0
            while lo < min(len(xs), len(ys)) and xs[lo] == ys[lo]:
                lo += 1
            hi = 0
            while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi] == ys[-1 - hi]:
                hi += 1
            same = sum(self.sizes[c] for c in xs[:lo]) + sum(self.sizes[c] for c in xs[len(xs) - hi :])
            xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
            kinds = set(ys)
            missing = [(p, q) for p in set(xs) for q in kinds if p != q and self.shapes[p][0] == self.shapes[q][0] and (p, q) not in self.memo]
            if missing:
                work += missing
                continue
            if len(xs) * len(ys) <= 400:
                best = _last([[self._known(p, q) for q in ys] for p in xs]) if xs and ys else 0
            else:
                best = int(_rows(self._weights(xs, ys), 0, len(xs), 0, len(ys))[-1])
            self.memo[x, y] = 1 + same + best
            work.pop()
        return self.memo[a, b]

    def _known(self, p: int, q: int) -> int:
        return self.sizes[p] if p == q else self.memo.get((p, q), 0)

    def _weights(self, xs: tuple, ys: tuple):
        """What gives the row of weights of a place in ``xs`` against all of ``ys``."""
        kinds, where = np.unique(np.array(ys), return_inverse=True)
        rows: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if xs[i] not in rows:
                rows[xs[i]] = np.array([self._known(xs[i], q) for q in kinds.tolist()], np.int64)[where]
            return rows[xs[i]]

        return row

    def align(self, a: Tree, b: Tree) -> list[tuple[int, int]]:
        """Matched pairs of two trees' nodes, roots first. Of matchings with as many pairs, one with more equal texts is taken."""
        x, y = a.classes(self), b.classes(self)
        pairs = [(0, 0)] if a.keys[0] == b.keys[0] else []
        for i, j in pairs:
            xs, ys = a.children[i], b.children[j]
            if not xs or not ys:
                continue
            if len(xs) == len(ys) == 1:
                if a.keys[xs[0]] == b.keys[ys[0]]:
                    pairs.append((xs[0], ys[0]))
                continue
            cs, ds = [x[c] for c in xs], [y[c] for c in ys]
            scores = {(p, q): self.score(p, q) for p in set(cs) for q in set(ds)}
            s, t = a.texts, b.texts
            if len(xs) * len(ys) <= 400:
                weights = [[2 * v + (v > 0 and s[k] == t[n] != 0) if (v := scores[c, d]) else 0 for d, n in zip(ds, ys, strict=True)] for c, k in zip(cs, xs, strict=True)]
                pairs += [(xs[k], ys[n]) for k, n in _small(weights)]
                continue
            shapes, texts = self._weights(cs, ds), np.array([t[c] for c in ys], np.int64)
            row = lambda k, xs=xs, shapes=shapes, texts=texts: (r := shapes(k)) * 2 + ((texts == s[xs[k]]) & (texts != 0) & (r > 0))
            pairs += [(xs[k], ys[n]) for k, n in _best(row, len(xs), len(ys))]
        return pairs


class Tree:
    """Nodes of an outline, as lists for matching: ``children``, ``keys``, and ``texts``, a hash of all text at and below each node, 0 without any."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes = nodes
        self.keys, self.parents, self.flags, self.own = (nodes[n].tolist() for n in ("key", "parent", "flags", "text"))
        self.children: list[list[int]] = [[] for _ in self.keys]
        for i, p in enumerate(self.parents):
            if p >= 0:
                self.children[p].append(i)
        self.texts = [t & (2**63 - 1) for t in self.own]
        for i in range(len(self.keys) - 1, -1, -1):
            if self.children[i]:
                found = (self.texts[i], *[self.texts[c] for c in self.children[i]])
                self.texts[i] = hash(found) & (2**63 - 1) or 1 if any(found) else 0
        self._by: Matcher | None = None

    def classes(self, matcher: Matcher) -> list[int]:
        """Number of each node's shape in a matcher, which may have begun anew."""
        if len(matcher.shapes) > 200_000:
            matcher.restart()
        if self._by is not matcher or self._age != matcher.age:
            self._by, self._age, self._classes = matcher, matcher.age, matcher.classes(self)
        return self._classes

    def paths(self) -> list[int]:
        """Hash of each node's path of keys."""
        out, keys, parents = [0] * len(self.keys), self.keys, self.parents
        for i in range(1, len(out)):
            out[i] = hash((out[parents[i]], keys[i])) & (2**63 - 1)
        return out

    def apart(self) -> list[bool]:
        """Whether a node lies in an element that HTML sets apart; headings in an article's header don't."""
        out, flags, parents = [False] * len(self.keys), self.flags, self.parents
        inside = [0] * len(out)  # 1: in an article; 2: in the header of one, where headings stay
        for i in range(1, len(out)):
            f, p = flags[i], parents[i]
            inside[i] = inside[p]
            if inside[p] == 2 and f & HEADING and not f & SET_APART:
                continue
            out[i] = out[p] or bool(f & SET_APART) or bool(f & ARTICLE and inside[p])
            if f & ARTICLE and not out[i]:
                inside[i] = 1
            elif f & HEADER and inside[p] == 1 and not out[p]:
                inside[i] = 2
            elif f & SET_APART and inside[p] != 2:
                inside[i] = 0
        return out


def _rows(row, lo: int, hi: int, left: int, right: int, table: list | None = None, back: bool = False) -> np.ndarray:
    """Last row of the table of best sums of rows lo..hi and columns left..right, or of its mirror image; all rows go to ``table``."""
    now = np.zeros(right - left + 1, np.int64)
    if table is not None:
        table.append(now)
    for i in range(hi - 1, lo - 1, -1) if back else range(lo, hi):
        w = row(i)[left:right]
        new = now.copy()
        np.maximum(new[1:], now[:-1] + (w[::-1] if back else w), out=new[1:])
        now = np.maximum.accumulate(new)
        if table is not None:
            table.append(now)
    return now


def _last(weights: list[list[int]]) -> int:
    """The best sum of a small table of weights."""
    now = [0] * (len(weights[0]) + 1)
    for w in weights:
        before, left = 0, 0
        for j, v in enumerate(w, 1):
            above = now[j]
            if v and before + v > above:
                left = max(left, before + v)
            elif above > left:
                left = above
            before, now[j] = above, left
    return now[-1]


def _small(weights: list[list[int]]) -> list[tuple[int, int]]:
    """What _best() finds, for a small table of weights."""
    table = [[0] * (len(weights[0]) + 1)]
    for w in weights:
        above, now, left = table[-1], [0], 0
        for j, v in enumerate(w):
            left = max(left, above[j + 1], above[j] + v)
            now.append(left)
        table.append(now)
    i, j, found = len(weights), len(weights[0]), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def _best(row, n: int, m: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Pairs (place, place), ascending in both, of the greatest sum of weights; large tables are halved, so that memory stays linear."""
    out, work = [], [(0, n, 0, m)]
    while work:
        lo, hi, left, right = work.pop()
        if lo == hi or left == right:
            continue
        if hi - lo > 1 and (hi - lo + 1) * (right - left + 1) > cells:
            mid = (lo + hi) // 2
            cut_at = left + int(np.argmax(_rows(row, lo, mid, left, right) + _rows(row, mid, hi, left, right, back=True)[::-1]))
            work += [(mid, hi, cut_at, right), (lo, mid, left, cut_at)]
            continue
        table: list[np.ndarray] = []
        _rows(row, lo, hi, left, right, table)
        i, j, found = hi - lo, right - left, []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((lo + i, left + j))
        out += reversed(found)
    return out


def content_path(tree: Tree, weight: list[int], path: list[int], out: list[bool]) -> int:
    """Path of the content element, by the weight (varying text) of each node; 0 if there is no text."""
    parents, flags, nodes = tree.parents, tree.flags, tree.keys
    below = [0 if o else w for o, w in zip(out, weight, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        below[parents[i]] += below[i]
    total: dict[int, int] = {}
    for i, p in enumerate(path):
        if not out[i] and (i == 0 or path[parents[i]] != p):
            total[p] = total.get(p, 0) + below[i]
    if not below[0]:
        return 0
    for kind in (ARTICLE, MAIN):
        found = {path[i]: total[path[i]] for i in range(len(nodes)) if flags[i] & kind and not out[i]}
        best = max(found, key=found.get, default=0)
        if best and found[best] >= ARTICLE_SHARE * below[0]:
            return best
    inner: dict[int, set[int]] = {}
    for i in range(1, len(nodes)):
        if flags[i] & CONTAINER and not out[i]:
            inner.setdefault(path[parents[i]], set()).add(path[i])
    now = 0
    while best := max(sorted(inner.get(now, ())), key=total.get, default=0):
        if total[best] < INNER_SHARE * total[now]:
            break
        now = best
    return now


def induce(reference: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The wrapper (nodes with TEMPLATE set, path of the content element) of a reference and, for each of its nodes, ``counts``: pages there, pages with its text, characters."""
    nodes = reference.copy()
    template = (nodes["text"] != 0) & (counts[:, 0] >= TEMPLATE_PAGES) & (counts[:, 1] >= TEMPLATE_SHARE * counts[:, 0])
    nodes["flags"] |= np.where(template, TEMPLATE, 0).astype("u1")
    tree = Tree(nodes)
    return nodes, content_path(tree, np.where(template, 0, counts[:, 2]).tolist(), tree.paths(), tree.apart())


def tally(matcher: Matcher, reference: Tree, page: Tree, counts: list[list[int]]) -> None:
    """Adds what a page has at the reference's nodes. Text of nodes that match nothing counts for the nearest one around them that does."""
    to = [-1] * len(page.keys)
    for i, j in matcher.align(reference, page):
        to[j] = i
        c = counts[i]
        c[0] += 1
        c[1] += reference.own[i] == page.own[j]
    chars = page.nodes["chars"].tolist()
    for j in range(len(to)):
        if to[j] < 0 and j:
            to[j] = to[page.parents[j]]
        if chars[j] and to[j] >= 0:
            counts[to[j]][2] += chars[j]


def within(tree: Tree, path: list[int], content: int) -> list[bool]:
    """Which nodes are a content element of this path or inside of one."""
    inside = [False] * len(path)
    for i in range(len(path)):
        inside[i] = path[i] == content or (i > 0 and inside[tree.parents[i]])
    return inside


def extract(page: str | Outline | None, wrapper: tuple[Tree, int] | None = None, matcher: Matcher | None = None) -> tuple[str, bool]:
    """Main text of one page, and whether its group's wrapper found the content."""
    page = page if isinstance(page, Outline) else outline(page)
    tree = Tree(page.nodes)
    path, out, skip, content = tree.paths(), tree.apart(), set(), 0
    if wrapper and wrapper[1]:
        reference, content = wrapper
        for i, j in (matcher or Matcher()).align(reference, tree):
            if reference.flags[i] & TEMPLATE and reference.own[i] == tree.own[j]:
                skip.add(j)
    found = bool(content) and any(p == content and not o for p, o in zip(path, out, strict=True))
    if not found:
        skip, content = set(), content_path(tree, page.nodes["chars"].tolist(), path, out)
    inside = within(tree, path, content)
    if found:
        # Pages that are near copies of each other share their article; a wrapper that would take most of an article's text is of no use to it.
        chars = page.nodes["chars"].tolist()
        alone = content_path(tree, chars, path, out)
        whole = within(tree, path, alone) if any(p == alone and f & (ARTICLE | MAIN) for p, f in zip(path, tree.flags, strict=True)) else []
        if 2 * sum(n for i, n in enumerate(chars) if inside[i] and not out[i] and i not in skip) < sum(n for i, n in enumerate(chars) if whole and whole[i] and not out[i]):
            inside, skip, found = whole, set(), False
    return "\n\n".join(t for i, t in page.runs if inside[i] and not out[i] and i not in skip), found


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (grp, page, nodes)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            groups, pages, nodes = [], [], []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = outline(html)
                groups.append(f"{host}|{found.layout}")
                pages.append(_hash(html) - 2**63)
                nodes.append(found.nodes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(pages, pa.int64()), pa.array(nodes, pa.binary())], names=["grp", "page", "nodes"])


def _reference(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a group's sample, the page that matches the others best."""
    rows = rows.sort_values("page")
    trees, matcher = [Tree(np.frombuffer(b, NODE)) for b in rows["nodes"]], Matcher()

    def fit(i: int) -> int:
        return sum(2 * len(p := matcher.align(trees[i], x)) + sum(trees[i].own[a] == x.own[b] != 0 for a, b in p) for k, x in enumerate(trees) if k != i)

    best = max(range(len(trees)), key=lambda i: (fit(i), -i)) if len(trees) > 1 else 0
    return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "reference": [rows["nodes"].iloc[best]]})


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, nodes, reference) to (grp, node, pages, same, chars), combined in the task."""
    matcher, sums, held = Matcher(), {}, 0

    def combined() -> pa.RecordBatch:
        rows = [(g, i, *c) for g, (_, counts) in sums.items() for i, c in enumerate(counts) if c[0] or c[2]]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["grp", "node", "pages", "same", "chars"])

    for batch in batches:
        for grp, nodes, reference in zip(*(batch.column(i) for i in range(3)), strict=True):
            g = grp.as_py()
            if g not in sums:
                tree = Tree(np.frombuffer(reference.as_py(), NODE))
                sums[g] = tree, [[0, 0, 0] for _ in tree.keys]
                held += len(tree.keys)
            tally(matcher, sums[g][0], Tree(np.frombuffer(nodes.as_py(), NODE)), sums[g][1])
            if held > 200_000:
                yield combined()
                sums, held = {}, 0
    yield combined()


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, n, reference, counts) to (grp, n, wrapper): the content path in front of the nodes."""
    for batch in batches:
        out = []
        for reference, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            tree = np.frombuffer(reference, NODE)
            sums = np.zeros((len(tree), 3), np.int64)
            for c in counts:
                sums[c["node"]] = c["pages"], c["same"], c["chars"]
            nodes, path = induce(tree, sums)
            out.append(np.int64(path).tobytes() + nodes.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["grp", "n", "wrapper"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html) to the same with grp for the host."""
    for batch in batches:
        groups = [f"{host}|{outline(html).layout}" for host, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(groups, pa.string()), batch.column(3)], names=["page_id", "url", "grp", "html"])


def _read(blob: bytes | None) -> tuple[Tree, int] | None:
    return (Tree(np.frombuffer(blob[8:], NODE)), int.from_bytes(blob[:8], "little")) if blob else None


def _extract(blobs: dict[str, bytes] | None):
    """(page_id, url, html, and the wrapper or, with ``blobs``, the host) to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(), {}
        for batch in batches:
            texts, by = [], []
            for html, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = outline(html)
                key = last if blobs is None else f"{last}|{page.layout}"
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = _read(key if blobs is None else blobs.get(key))
                text, found = extract(page, known[key], matcher)
                texts.append(text.encode("utf-8", "replace").decode())
                by.append(found)
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(by, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "by_wrapper"])

    return run


def wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(grp, n, wrapper) of each group of two or more distinct pages; n: the rows it has."""
    rows = cut(pages.filter(F.col(html_col).isNotNull()).select(host_col, html_col).mapInArrow(_outlines, "grp string, page long, nodes binary"))
    distinct = cut(rows.groupBy("grp", "page").agg(F.first("nodes").alias("nodes"), F.count(F.lit(1)).alias("n")))
    groups = distinct.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    # The rank's limit is applied in each task before the shuffle, so a group sends at most ``sample`` outlines per task.
    few = distinct.select("grp", "page", "nodes", F.row_number().over(Window.partitionBy("grp").orderBy("page")).alias("rn")).filter(F.col("rn") <= sample)
    found = few.groupBy("grp").applyInPandas(_reference, "grp string, reference binary")
    references = cut(groups.join(found, "grp"))
    met = spread_lookup(distinct, references, "grp", "pages", "page", ["reference"]).filter("reference is not null")
    counts = met.select("grp", "nodes", "reference").mapInArrow(_tallies, "grp string, node int, pages long, same long, chars long")
    counts = counts.groupBy("grp", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "chars")])
    # A group has as many counts as its reference has nodes.
    lists = counts.groupBy("grp").agg(F.collect_list(F.struct("node", "pages", "same", "chars")).alias("counts"))
    return cut(references.join(lists, "grp").select("grp", "n", "reference", "counts").mapInArrow(_wrappers, "grp string, n long, wrapper binary"))


RESULT = "page_id long, url string, text string, n_chars long, by_wrapper boolean"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE, small: int = SMALL) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row, and ``by_wrapper``, whether a wrapper found its content."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    known = wrappers(rows, sample=sample)
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("grp")), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= small:  # measured: they go to the tasks by value, and pages stay where they are
        blobs = {r["grp"]: bytes(r["wrapper"]) for r in known.collect()}
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(blobs), RESULT)
    grouped = rows.mapInArrow(_grouped, "page_id long, url string, grp string, html string")
    met = spread_lookup(grouped, known, "grp", "n", "page_id", ["wrapper"], small=small)
    return met.select("page_id", "url", "html", "wrapper").mapInArrow(_extract(None), RESULT)
