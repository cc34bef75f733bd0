"""Main text of web pages by wrappers inferred per host.

A wrapper is a regular expression without unions over the token stream of a host's pages: elements,
optional parts, repeated groups and text slots. It is inferred by aligning one page after another
with what is known: equal elements are matched, what only one side has becomes optional, adjacent
equal runs become a repeated group, and text that differs becomes a slot. Inference is a fold that
may be done in any grouping, so each task folds the pages it reads into one wrapper per host and
only wrappers, not pages, are shuffled and folded on.

Roots of the main text are found per page: its article elements; without one, its main element;
without one, the element that holds most of the text outside links on the host's pages of this
kind, if it holds half of this page's; else the deepest element that holds most of this page's.
Below the root, elements are left out that are menus, headers, footers, sidebars, notices, adverts,
forms, comments or code by tag or by name (forms and names only where they do not hold most
of the host's text, or all of a page's), and, outside article and main elements, repeated groups that the wrapper shows to be mostly links.
Without an article or main element, text that is the same on all of at least three pages that differ
in their text is part of the template and left out as well, unless nothing else is on the page.

Blocks are the text between block elements; text inside inline elements belongs to the block around
them. Character references are decoded, and white space inside a block, line breaks included,
becomes one space.

Defined results: a null or empty page has an empty text; pages without host share one wrapper;
repeated pages get equal texts; an unclosed element ends with its parent.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Generator, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches
from worktide.llm.urls import host_and_path
from worktide.operators.staging import stage

# Comments, declarations and the beginnings of elements; where an element ends, Ends tells.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
QUOTED = re.compile("[>\"']")
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Kinds of elements (fixed values of the language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "aside button canvas dialog embed footer head header iframe input map menu nav noembed noframes "
    "noscript object script select style svg template textarea title audio video".split()
)
NAMES_LEFT_OUT = frozenset(
    "ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pagination popup promo promoted related reply share sharing sidebar signup social "
    "sponsor sponsored subscribe tags toolbar widget".split()
)
# Left out as the last part of a longer name too, names of boxes behind it aside.
NAME_ENDS_LEFT_OUT = frozenset(
    "ad ads advert adverts advertisement comment comments cookie cookies consent disqus newsletter promo share "
    "sharing sidebar social sponsor sponsored".split()
)
BOXES = frozenset("area block box container list panel section thread wrap wrapper".split())
# Never left out by name.
NAMED_AT_WILL = frozenset("html body main article".split())
ENDS_WITH = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = frozenset("ul ol dl table select div article section main body td th".split())

# Elements of one level before they are folded into one repeated group of optional elements.
LEVEL = 32
# Name of a group of tags, for levels of over twice as many signatures.
BY_TAG = "(*"
# Hosts whose wrappers a task holds at once.
HOSTS = 2000
PAGES_FOR_CONSTANT = 3
# Before the signature of an element that is left out unless it holds most of the text.
DOUBTFUL = "!"
NO_ROOT = ("p", "li", "td")


class Node:
    __slots__ = ("sig", "tag", "kids", "left_out", "doubtful")

    def __init__(self, tag: str, names: list[str]):
        self.tag = tag
        # There is one html and one body, whatever their names.
        self.sig = tag if tag in ("html", "body") else tag + "".join("." + n for n in names)
        self.left_out = tag in LEFT_OUT
        # Left out unless it holds most of the text: a form, and what has a name of the list.
        self.doubtful = not self.left_out and tag not in NAMED_AT_WILL and (
            tag == "form" or any(map(_listed, names))
        )
        if self.doubtful:
            self.sig = DOUBTFUL + self.sig
        # Nodes, and texts as (text, whether in a link).
        self.kids: list = []


def _listed(name: str) -> bool:
    """The whole name, or all of its hyphen parts, are in the list, or it ends in what is never part
    of an article (``post-comments``, ``social-share-box``)."""
    if name in NAMES_LEFT_OUT:
        return True
    parts = re.split("[-_]+", name.strip("-_"))
    if all(part in NAMES_LEFT_OUT for part in parts):
        return True
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    return parts[-1] in NAME_ENDS_LEFT_OUT and parts[0] not in ("has", "no", "with")


def _names(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    found = " ".join(next(filter(None, m), "") for m in CLASS.findall(attributes))
    return [re.sub(r"\d+", "", n) for n in found.lower().split()]


class Ends:
    """Where elements end: at the first ``>`` outside quotes, or, where the quotes do not close, at
    the first one. What was searched in vain is remembered, so a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.vain: set[int] = set()
        self.next = -1

    def after(self, at: int) -> int:
        """Place of the ``>`` that ends the element whose name ends at ``at``; -1 without one."""
        if at > self.last:
            return -1
        if self.next < at:
            self.next = QUOTED.search(self.page, at).start()
        found, tried = self.next, []
        while found not in self.vain:
            if self.page[found] == ">":
                return found
            tried.append(found)
            close = self.page.find(self.page[found], found + 1)
            later = QUOTED.search(self.page, close + 1) if close >= 0 else None
            if later is None:
                break
            found = later.start()
        self.vain.update(tried)
        return self.page.find(">", at)


class Open:
    """Elements open at a place, and where those of a tag are."""

    def __init__(self, root: Node):
        self.stack, self.places, self.keeps = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in KEEPS:
            self.keeps.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """End the element at ``depth`` and all inside it."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in KEEPS:
                self.keeps.pop()

    def deepest(self, tags: set[str] | tuple) -> int:
        """Place of the innermost open element of these tags; 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def tree(page: str) -> Node:
    """Block elements and texts of a page; inline elements only tell whether a text is a link."""
    root = Node("#page", [])
    opened, ends = Open(root), Ends(page)
    stack, links, at, end, text = opened.stack, 0, 0, len(page), 0
    while at < end:
        m = TOKEN.search(page, at)
        stop = -1
        if m and m[2]:
            stop = ends.after(m.end())
            if stop < 0:
                # No element after all: it is read on as text.
                at = m.end()
                continue
        upto = m.start() if m else end
        if upto > text:
            stack[-1].kids.append((page[text:upto], links > 0))
        if not m:
            text = end
            break
        at = text = m.end() if stop < 0 else stop + 1
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attributes = page[m.end() : stop]
        closing = m[1]
        if tag == "br":
            stack[-1].kids.append((" ", links > 0))
        elif tag == "a":
            links = 0 if closing else 1
        elif closing:
            if tag in INLINE:
                if stack[-1].tag == tag:
                    opened.close(len(stack) - 1)
                continue
            depth = opened.deepest((tag,))
            if depth:
                opened.close(depth)
                links = 0
        else:
            names = _names(attributes)
            node = Node(tag, names)
            if tag in INLINE and not (node.left_out or node.doubtful):
                continue
            if tag not in INLINE:
                links = 0
                # A new block ends inline elements and what it cannot stand in.
                ended = ENDS_WITH.get(tag, {"p"} if tag not in VOID else ())
                depth = opened.deepest(ended)
                if depth and depth >= opened.keeps[-1]:
                    opened.close(depth)
            stack[-1].kids.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = text = page.find(">", close.end()) + 1 or end if close else end
            elif tag not in VOID and not attributes.endswith("/"):
                opened.push(node)
    if end > text:
        stack[-1].kids.append((page[text:], links > 0))
    return root


# Wrappers: [signature, least, most, elements, text]; the signature of a group is "(" and those of
# its elements; text is [pages, characters, characters in links, digest of constant text or null].


def _digest(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


Steps = Generator["Steps", Any, Any]


def _run(steps: Steps) -> Any:
    """Result of a recursion whose calls are yielded; pages may nest deeper than Python does."""
    work, result = [steps], None
    while work:
        try:
            work.append(work[-1].send(result))
            result = None
        except StopIteration as done:
            work.pop()
            result = done.value
    return result


def page_wrapper(node: Node) -> list:
    return _run(_page_wrapper(node))


def _page_wrapper(node: Node) -> Steps:
    parts, chars, linked, text = [], 0, 0, []
    for kid in node.kids:
        if isinstance(kid, Node):
            parts.append([kid.sig, 1, 1, [], None] if kid.left_out else (yield _page_wrapper(kid)))
        else:
            squeezed = " ".join(kid[0].split())
            if squeezed:
                text.append(squeezed)
                chars += len(squeezed)
                linked += len(squeezed) if kid[1] else 0
    slot = [1, chars, linked, _digest(" ".join(text))] if chars else None
    return [node.sig, 1, 1, (yield _fold(parts)) if len(parts) > 1 else parts, slot]


def text_digest(top: Node) -> str:
    """Digest of a page's text; copies of a page have the same."""
    texts, work = [], [top]
    while work:
        node = work.pop()
        if isinstance(node, tuple):
            texts += node[0].split()
        elif not (node.left_out or node.doubtful):
            work.extend(reversed(node.kids))
    return _digest(" ".join(texts))


def _fold(parts: list) -> Steps:
    """Adjacent equal runs as repeated groups; a long level as one group of optional elements."""
    for width in (1, 2, 3):
        out: list = []
        for part in parts:
            out.append(part)
            if len(out) >= 2 * width:
                first, second = out[-2 * width : -width], out[-width:]
                if [x[0] for x in first] == [x[0] for x in second]:
                    del out[-2 * width :]
                    both = []
                    for a, b in zip(first, second, strict=True):
                        both.append((yield _merged(a, b)))
                    out += [repeated(both[0])] if width == 1 else [group(both)]
            if width > 1 and len(out) > width and out[-width - 1][0] == group_name(out[-width:]):
                run = out[-width:]
                del out[-width:]
                out[-1] = repeated((yield _merged(out[-1], group(run))))
        parts = out
    if len(parts) > LEVEL:
        known: dict[str, list] = {}
        for own in _elements(parts):
            known[own[0]] = (yield _merged(known[own[0]], own)) if own[0] in known else own
        parts = [(yield _by_tag(parts)) if len(known) > 2 * LEVEL else group(list(known.values()))]
    return parts


def _elements(parts: list) -> Iterator[list]:
    """Elements of a level and of its groups, as optional ones."""
    work = [(part, 1) for part in reversed(parts)]
    while work:
        part, most = work.pop()
        most = max(most, part[2])
        if part[0].startswith("("):
            work.extend((own, most) for own in reversed(part[3]))
        else:
            yield [part[0], 0, most, *part[3:]]


def _by_tag(parts: list) -> Steps:
    """A level of very many signatures as one group of tags."""
    out: dict[str, list] = {}
    for part in _elements(parts):
        tag = bare(part[0])
        part = [tag, *part[1:]]
        out[tag] = (yield _merged(out[tag], part)) if tag in out else part
    return [BY_TAG, 1, 2, [out[tag] for tag in sorted(out)], None]


def bare(sig: str) -> str:
    return sig.partition(".")[0]


def group_name(parts: list) -> str:
    return "(" + " ".join(p[0] for p in parts)


def group(parts: list) -> list:
    return [group_name(parts), 1, 2, parts, None]


def repeated(part: list) -> list:
    return [part[0], part[1], 2, part[3], part[4]]


def _text(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    same = a[3] if a[3] == b[3] else None
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], same]


def merged(a: list, b: list) -> list:
    """The wrapper of both; their signatures are equal."""
    return _run(_merged(a, b))


def _merged(a: list, b: list) -> Steps:
    parts = (yield _aligned(a[3], b[3])) if a[3] or b[3] else []
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), parts, _text(a[4], b[4])]


def _optional(part: list) -> list:
    return [part[0], 0, *part[2:]]


def _aligned(a: list, b: list) -> Steps:
    """Longest common subsequence by signature; the rest is optional."""
    names_a, names_b = [x[0] for x in a], [x[0] for x in b]
    # Once a level goes by tags, it does whatever is aligned with it.
    if BY_TAG in names_a or BY_TAG in names_b:
        return [(yield _by_tag([*a, *b]))]
    if names_a == names_b:
        out = []
        for x, y in zip(a, b, strict=True):
            out.append((yield _merged(x, y)))
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = (
                best[i + 1][j + 1] + 1 if names_a[i] == names_b[j] else max(best[i + 1][j], best[i][j + 1])
            )
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if names_a[i] == names_b[j]:
            out.append((yield _merged(a[i], b[j])))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    out += [_optional(x) for x in a[i:]] + [_optional(x) for x in b[j:]]
    return (yield _fold(out))


def expression(wrapper: list) -> str:
    """The wrapper as text, for people."""
    return _run(_expression(wrapper))


def _expression(wrapper: list) -> Steps:
    name, least, most, parts, text = wrapper
    inner = ""
    for part in parts:
        inner += yield _expression(part)
    slot = "" if text is None else ("#text" if text[3] is None else "'...'")
    body = f"({inner})" if name.startswith("(") else f"<{name}>{slot}{inner}</>"
    return body + {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[least, most]


def written(wrapper: list) -> str:
    """A wrapper as JSON: its elements one after another, each with the number of its parts."""
    rows, work = [], [wrapper]
    while work:
        name, least, most, parts, text = work.pop()
        rows.append([name, least, most, len(parts), text])
        work.extend(reversed(parts))
    return json.dumps(rows)


def read(text: str) -> list:
    done: list = []
    # From the end, the parts of an element are the last ones done.
    for name, least, most, n, slot in reversed(json.loads(text)):
        parts = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append([name, least, most, parts, slot])
    return done[0]


# Decisions


def step(path: str, sig: str, tags: set[str]) -> str:
    """Path of an element below ``path``, of one length however deep the element is; ``tags``:
    paths below which elements go by tag."""
    return xxhash.xxh3_128_hexdigest(f"{path} {bare(sig) if path in tags else sig}")


def _walk(wrapper: list, tags: set[str], out: dict) -> None:
    """Every path of a wrapper, parents first, with its text."""
    work = [(wrapper, "", False, 0)]
    while work:
        (name, _, most, parts, text), up, many, depth = work.pop()
        if name.startswith("("):
            if name == BY_TAG:
                tags.add(up)
            work.extend((part, up, many or most > 1, depth) for part in reversed(parts))
            continue
        path = step(up, name, tags)
        own = out.setdefault(
            path, {"text": None, "many": False, "up": up, "depth": depth, "tag": bare(name).removeprefix(DOUBTFUL),
                   "doubtful": name.startswith(DOUBTFUL)}
        )
        own["text"] = _text(own["text"], text)
        own["many"] |= many or most > 1
        work.extend((part, path, False, depth + 1) for part in reversed(parts))


def _within(paths: dict, some: set[str]) -> set[str]:
    """Paths that are among ``some`` or below one of them."""
    found: set[str] = set()
    for path, own in paths.items():
        if path in some or own["up"] in found:
            found.add(path)
    return found


def decide(wrapper: list, pages: int, different: int | None = None) -> dict:
    """Paths of the root of pages without article and main, of menus and of constant text.

    ``different``: pages that differ in their text, as far as counted; by default all do.
    """
    different = pages if different is None else different
    # Equal paths may have one level by tags and one not; then both go by tags.
    tags: set[str] = set()
    while True:
        paths: dict[str, dict] = {}
        before = len(tags)
        _walk(wrapper, tags, paths)
        if len(tags) == before:
            break

    def sums(own: dict[str, int]) -> dict[str, int]:
        out = dict(own)
        for path in reversed(paths):
            if paths[path]["up"]:
                out[paths[path]["up"]] += out[path]
        return out

    unlinked = {p: x["text"][1] - x["text"][2] if x["text"] else 0 for p, x in paths.items()}
    total, inside = sum(unlinked.values()), sums(unlinked)
    doubtful = {p for p, x in paths.items() if x["doubtful"]}
    kept = {p for p in doubtful if total and 10 * inside[p] >= 7 * total}
    for p in _within(paths, doubtful - kept):
        paths[p]["text"] = None
    chars = sums({p: x["text"][1] if x["text"] else 0 for p, x in paths.items()})
    links = sums({p: x["text"][2] if x["text"] else 0 for p, x in paths.items()})
    menus = {
        p for p, x in paths.items()
        if x["many"] and chars[p] and 10 * links[p] > 8 * chars[p] and x["tag"] not in ("p", "body", "html")
    }
    # Pages with an article or main element need no inferred root.
    others = _within(paths, menus | {p for p, x in paths.items() if x["tag"] in ("article", "main")})
    own = {p: x["text"][1] - x["text"][2] if x["text"] and p not in others else 0 for p, x in paths.items()}
    total, inside = sum(own.values()), sums(own)
    most = [p for p, x in paths.items() if total and 10 * inside[p] >= 7 * total and x["tag"] not in NO_ROOT]
    constant = [
        p for p, x in paths.items()
        if different >= PAGES_FOR_CONSTANT and x["text"] and x["text"][0] == pages and x["text"][3] is not None
    ]
    return {
        "roots": [max(most, key=lambda p: paths[p]["depth"])] if most else [],
        "menus": sorted(menus),
        "constant": sorted(constant),
        "tags": sorted(tags),
        "kept": sorted(kept),
    }


# Text


def _is_out(node: Node, path: str, kept: set) -> bool:
    """``kept``: paths of the wrapper and ids of the page's own elements."""
    return node.left_out or (node.doubtful and path not in kept and id(node) not in kept)


def _roots(top: Node, how: dict) -> tuple[list[Node], bool]:
    """Roots of a page, and whether they are its article or main elements."""
    # (node, path, place of the parent, depth), parents first, and whether it is in a menu.
    places: list[tuple[Node, str, int, int]] = []
    in_menu: list[bool] = []
    work: list[tuple[Node, str, int, int]] = [(top, "", -1, 0)]
    while work:
        node, path, up, depth = work.pop()
        path = step(path, node.sig, how["tags"])
        if _is_out(node, path, how["kept"]):
            continue
        at = len(places)
        places.append((node, path, up, depth))
        in_menu.append(path in how["menus"] or (up >= 0 and in_menu[up]))
        work.extend((kid, path, at, depth + 1) for kid in reversed(node.kids) if isinstance(kid, Node))
    some = [any(isinstance(k, tuple) and not k[0].isspace() for k in x[0].kids) for x in places]
    for i in range(len(places) - 1, 0, -1):
        some[places[i][2]] |= some[i]

    def outermost(wanted: Callable[[int], bool]) -> list[int]:
        found, inside = [], [False] * len(places)
        for i, place in enumerate(places):
            inside[i] = i > 0 and inside[place[2]]
            if not inside[i] and some[i] and not in_menu[i] and wanted(i):
                inside[i] = True
                found.append(i)
        return found

    for tag in ("article", "main"):
        found = outermost(lambda i, tag=tag: places[i][0].tag == tag)
        if found:
            return [places[i][0] for i in found], True
    # Characters outside links and template text.
    plain = [
        0 if menu or path in how["constant"] else
        sum(len(k[0].strip()) for k in node.kids if isinstance(k, tuple) and not k[1])
        for (node, path, _, _), menu in zip(places, in_menu, strict=True)
    ]
    for i in range(len(places) - 1, 0, -1):
        plain[places[i][2]] += plain[i]
    found = outermost(lambda i: places[i][1] in how["roots"])
    # On a page of another template the same path may hold a part only.
    if found and 2 * sum(plain[i] for i in found) >= plain[0]:
        return [places[i][0] for i in found], False
    most = [
        i for i in range(len(places))
        if plain[0] and 10 * plain[i] >= 7 * plain[0] and places[i][0].tag not in NO_ROOT
    ]
    return [places[max(most, key=lambda i: places[i][3])][0] if most else top], False


def _read(top: Node, how: dict) -> str:
    found, marked = _roots(top, how)
    roots = {id(x) for x in found}
    constant = () if marked else how["constant"]
    blocks: list[str] = []
    held: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    # (node, path, inside a root); None ends a block.
    work: list = [(top, "", False)]
    while work:
        item = work.pop()
        if item is None:
            end_block()
            continue
        node, path, inside = item
        if isinstance(node, tuple):
            if inside:
                held.append(node[0])
            continue
        inline = node.tag in INLINE
        path = step(path, node.sig, how["tags"])
        if _is_out(node, path, how["kept"]):
            if inside and not inline:
                end_block()
            continue
        inside = inside or id(node) in roots
        if path in how["menus"] and not (marked and inside):
            end_block()
            continue
        if not inline:
            end_block()
            work.append(None)
        # Template text goes, the elements beside it stay.
        dropped = path in constant
        work.extend(
            (kid, path, inside) for kid in reversed(node.kids) if not (dropped and isinstance(kid, tuple))
        )
    end_block()
    return "\n".join(blocks)


def prepared(decision: dict) -> dict:
    return {k: frozenset(v) for k, v in decision.items()}


def _kept(top: Node) -> set[int]:
    """Ids of the doubtful elements that hold most of the page's text."""
    nodes, above = [top], [-1]
    for i, node in enumerate(nodes):
        some = [k for k in node.kids if isinstance(k, Node) and not k.left_out]
        nodes += some
        above += [i] * len(some)
    plain = [sum(len(k[0].strip()) for k in x.kids if isinstance(k, tuple) and not k[1]) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        plain[above[i]] += plain[i]
    return {id(x) for x, n in zip(nodes, plain, strict=True) if x.doubtful and n and 10 * n >= 7 * plain[0]}


def main_text(page: str, decision: dict) -> str:
    top, how = tree(page), prepared(decision)
    text = _read(top, how)
    # A page of nothing but template text keeps it, and one of nothing but a doubtful element that.
    if not text and how["constant"]:
        text = _read(top, how := how | {"constant": frozenset()})
    if not text:
        kept = _kept(top)
        text = _read(top, how | {"kept": how["kept"] | kept}) if kept else ""
    return text


# Spark


def _different(a: list[str], b: list[str]) -> list[str]:
    """Digests of different pages, as many as constant text needs."""
    return sorted({*a, *b})[:PAGES_FOR_CONSTANT]


def _folder(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, list[str], list]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, n, seen, written(w)) for h, (n, seen, w) in known.items()]
        known.clear()
        hosts, pages, digests, wrappers = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.string()), pa.array(pages, pa.int64()),
                pa.array(digests, pa.list_(pa.string())), pa.array(wrappers, pa.string()),
            ],
            ["host", "pages", "different", "wrapper"],
        )

    for batch in parts:
        hosts = batch.column("host").to_pylist()
        for host, page in zip(hosts, batch.column("html"), strict=True):
            top = tree(page.as_py() or "")
            own = page_wrapper(top)
            n, seen, old = known.get(host, (0, [], None))
            if len(seen) < PAGES_FOR_CONSTANT:
                seen = _different(seen, [text_digest(top)])
            known[host] = (n + 1, seen, own if old is None else merged(old, own))
            if len(known) >= HOSTS:
                yield flush()
    if known:
        yield flush()


def _refolder(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of equal hosts, next to each other, into one."""
    held: tuple[str, int, list[str], list] | None = None

    def row() -> pa.RecordBatch:
        host, n, seen, wrapper = held
        return pa.RecordBatch.from_arrays(
            [
                pa.array([host], pa.string()), pa.array([n], pa.int64()),
                pa.array([seen], pa.list_(pa.string())), pa.array([written(wrapper)], pa.string()),
            ],
            ["host", "pages", "different", "wrapper"],
        )

    for batch in parts:
        columns = [batch.column(c).to_pylist() for c in ("host", "pages", "different", "wrapper")]
        for host, n, seen, text in zip(*columns, strict=True):
            wrapper = read(text)
            if held and held[0] == host:
                held = (host, held[1] + n, _different(held[2], seen), merged(held[3], wrapper))
            else:
                if held:
                    yield row()
                held = (host, n, seen, wrapper)
    if held:
        yield row()


WRAPPER_DDL = "host string, pages bigint, different array<string>, wrapper string"
SALTS = 32


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pages, different, wrapper) of every host, as a written table."""
    host, _ = host_and_path(url)
    first = pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(_folder, WRAPPER_DDL)
    # A host of very many pages is folded in two steps, so no task gets all its partial wrappers.
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper", "pages"), F.lit(SALTS)))
    some = (
        salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "pages", "wrapper")
        .select("host", "pages", "different", "wrapper").mapInArrow(_refolder, WRAPPER_DDL)
    )
    last = (
        some.repartition("host").sortWithinPartitions("host", "pages", "wrapper")
        .mapInArrow(_refolder, WRAPPER_DDL)
    )
    return stage(last)


def _decider(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        rows = zip(*(c.to_pylist() for c in part), strict=True)
        yield pa.array([json.dumps(decide(read(w), n, d)) for w, n, d in rows], pa.string())


_decider.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def _extractor() -> Callable:
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, dict] = {}
        for html, decision in parts:
            out, done = [], 0
            for part in batches.slices(html):
                texts = []
                for page, how in zip(part, decision.slice(done, len(part)).to_pylist(), strict=True):
                    if how not in known:
                        if len(known) >= HOSTS:
                            known.clear()
                        known[how] = prepared(json.loads(how))
                    texts.append(main_text(page.as_py() or "", known[how]))
                done += len(part)
                out.append(pa.array(texts, pa.string()))
            yield batches.joined(out, pa.string())

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return run


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text ``out``; a column of that name is replaced."""
    decider: Column = F.arrow_udf(_decider, "string")("wrapper", "pages", F.size("different"))
    # Written, so that its size decides how Spark joins it; hot hosts are split where it shuffles.
    decisions = stage(
        wrappers(pages, url, html).select(F.col("host").alias("__host"), decider.alias("__decision"))
    )
    host, _ = host_and_path(url)
    columns = [c for c in pages.columns if c != out]
    rows = pages.withColumn("__host", host).join(decisions, "__host", "left")
    text = F.arrow_udf(_extractor(), "string")(F.col(html), F.col("__decision"))
    return rows.withColumn("__text", text).select(*columns, F.col("__text").alias(out))
