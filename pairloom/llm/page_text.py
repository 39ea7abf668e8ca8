"""Main text of web pages by equivalence classes of template tokens.

1. Every page is read as a row of tokens: its structural elements with their path from the body, and
   its texts with the path of the element they stand in.
2. For each host, tokens with the same occurrence vector over its pages (the same number of
   occurrences on every page) form an equivalence class.  Vectors are compared by an order-free
   digest, so a host's pages never meet in one task.  A class is valid if it is frequent (on at least
   half of the host's pages and on at least ``LEAST_PAGES``) and large (two tokens or more).  Pages with
   equal html count as one page: copies of an article are no template.
3. Valid classes nest: a token lies in the next element around it that is in a valid class, or else in
   the page.  That tree is the host's template, and what stands between its tokens are slots.  A text
   token is fixed if it is on most of the pages that have the element it lies in.  A slot is
   boilerplate if most of its text on all pages is links.
4. The main slot of a host is the innermost element of its template that holds most of the text that is
   neither fixed nor links, step by step from the page.  Slots outside of it are boilerplate, with all
   rare elements in them.
5. Fixed texts, link slots and outer slots are dropped on every page, the first two inside article and
   main too.  Elements and names tell of the slots that are left which are comments and the like.  If an
   article or main element keeps any text, its slots are taken.

A host with too few pages has no template; its pages are judged by elements, names and their own links.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written

#: A template token is on this share of a host's pages, and on so many pages.
SHARE, LEAST_PAGES = 0.5, 4
#: A template text is on this share of the pages that have the element around it.
TEXT_SHARE = 0.8
#: A slot with a larger share of link text is boilerplate.
LINKS = 0.6
#: An element holds most of the text of the one around it with this share.
MAIN_SHARE = 0.8
#: Most template tokens that are broadcast to all pages; with more, pages and templates are joined by host.
BROADCAST_TOKENS = 1_000_000
#: Distinct pages with copies that are broadcast; with more, they are joined by host and digest.
BROADCAST_COPIES = 1_000_000
#: Templates that a task keeps ready.
KNOWN_HOSTS = 64
#: Slots' paths and template texts.
TEMPLATE = "array<struct<token:bigint,kind:int>>"
PATH, LINK_SLOT, TEXT, OUTER = 0, 1, 2, 3

# Elements by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "canvas", "object"}
#: Those of them that may hold others of their kind, and those that last to the end of the page if they are left open.
NESTING, TO_THE_END = {"template", "svg", "canvas", "object"}, {"script", "style", "textarea"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "label", "datalist", "map", "audio", "video"}
STRUCTURE = SKIPPED | {"html", "body", "article", "main", "section", "div", "header", "ul", "ol", "dl", "table", "figure", "details"}
BLOCKS = STRUCTURE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "address", "hr", "figcaption", "summary", "center", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
# words that name boilerplate; those of headers do so outside of articles only
NAMES = set(
    "ad ads adsense advert adverts advertisement advertisements advertising advertorial banner banners promo promos promoted sponsor sponsors sponsored cookie cookies consent gdpr notice "
    "alert alerts sidebar sidebars leftside rightside widget widgets menu menus nav navs navbar navigation navmenu breadcrumb breadcrumbs comment comments respond disqus reply replies "
    "footer footers foot share sharing social related recommend recommended recommendation recommendations newsletter subscribe signup login popup modal overlay search toolbar pagination "
    "pager tags copyright legal skip".split()
)
HEADERS = {"header", "masthead", "topbar"}
# words that may stand beside those in a name with hyphens; with any other word a name is that of a subject
BESIDE = set(
    "site page pages main post posts entry entries article articles story stories blog single global top bottom left right center upper lower primary secondary sub mobile desktop user "
    "block section area box bar panel wrap wrapper container content contents list lists item items link links icon icons button buttons btn group holder inner outer row col column "
    "columns unit slot frame text title heading label toggle form field header head body dropdown collapse trail line message fixed sticky floating wp js id".split()
)
# a quote without a second one is a sign like others
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*+"|'[^']*+'|["'])*+)>""")
# if the quotes swallow the end of the tag: quotes are signs like others
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|"[^"]*+"|'[^']*+'""")


def _names(attributes: str) -> str:
    """The values of class, id and role; what other attributes hold in quotes is no attribute."""
    return " ".join(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1] and m[1].lower() in ("class", "id", "role"))


class _Ends:
    """Where the elements of RAW end in a page; each page is searched once for each kind."""

    def __init__(self, html: str):
        self.html, self.open, self.nested = html, set(), {}

    def behind(self, name: str, start: int, at: int) -> int:
        """The place behind the end tag of an element whose tag goes from ``start`` to ``at``."""
        if name in NESTING:
            return self._pairs(name, start).get(start, at)
        end = None if name in self.open else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(self.html, at)
        if end:
            return end.end()
        self.open.add(name)  # nor is there an end tag behind later ones
        return len(self.html) if name in TO_THE_END else at

    def _pairs(self, name: str, start: int) -> dict[int, int]:
        if name not in self.nested:
            self.nested[name], stack = {}, []
            for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(self.html, start):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        stack.append(m.start())
                elif stack:
                    self.nested[name][stack.pop()] = m.end()
        return self.nested[name]


def _events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", element, names) and ("close", element, "") in page order."""
    at, held, ends = 0, [], _Ends(html)
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        held.append(html[at:lt])
        if lt == len(html):
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = len(html) if end < 0 else end + 1
            continue
        tag = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not tag:
            held.append("<")
            at = lt + 1
            continue
        if any(held):
            yield "text", "".join(held), ""
        held, at, name = [], tag.end(), tag[2].lower()
        if tag[1]:
            yield "close", name, ""
        elif name in RAW:
            if not tag[3].endswith("/"):
                at = max(at, ends.behind(name, lt, at))
        else:
            yield "open", name, _names(tag[3]) if tag[3] and name in STRUCTURE else ""
    if any(held):
        yield "text", "".join(held), ""


def page_blocks(html: str, opened: Counter | None = None) -> Iterator[tuple[tuple, bool, str, int]]:
    """(path, skipped, text, characters in links) of each block of text in page order.

    A path is a row of (element, names); an element is left by its end or by the end of one around it.
    ``opened`` counts the elements by their paths.
    """
    path: list[tuple[str, str]] = []
    at_event: list[tuple[str, int]] = []  # the element and its event, for each place of the path
    events = list(_events(html))
    given_up: tuple[set[int], set[int]] | None = None
    text: list[str] = []
    links = linked = 0

    def block() -> Iterator[tuple[tuple, bool, str, int]]:
        nonlocal linked
        own = " ".join(unescape("".join(text)).split())
        text.clear()
        if own:
            at = tuple(path)
            yield at, _slot(at)[1], own, min(linked, len(own))
        linked = 0

    for i, (kind, value, names) in enumerate(events):
        if kind == "text":
            text.append(value)
            if links:
                linked += len(value)
            continue
        if value == "br":
            text.append(" ")
        if value == "a":
            links = int(kind == "open")
        if value in BLOCKS:
            yield from block()
        if value in STRUCTURE:
            if kind == "open":
                if value == "body":  # what isn't closed before it was left open by mistake
                    stay = [k for k, x in enumerate(path) if not _apart(x)]
                    path, at_event = [path[k] for k in stay], [at_event[k] for k in stay]
                elif value in ("article", "main") and any(map(_apart, path)):
                    unclosed, wrappers = given_up = given_up or _given_up(events)
                    stay = [k for k, x in enumerate(path) if not (_apart(x) and at_event[k][1] in unclosed)]
                    path, at_event = [path[k] for k in stay], [at_event[k] for k in stay]
                    path = [("div", "") if e[1] in wrappers else x for x, e in zip(path, at_event, strict=True)]
                path.append((value, names))
                at_event.append((value, i))
                if opened is not None:
                    opened[tuple(path)] += 1
            elif any(e == value for e, _ in at_event):
                while path.pop() and at_event.pop()[0] != value:
                    pass
    yield from block()


def _given_up(events: list[tuple[str, str, str]]) -> tuple[set[int], set[int]]:
    """Boilerplate elements that don't count as such for the articles inside: those never closed, and wrappers.

    A form, or an element that is boilerplate by its names only, wraps the main text if it holds the
    page's first h1, or if no article or main stands free outside of it.  Elements are named by their event.
    """
    stack: list[int] = []
    ends: dict[int, int] = {}
    around: dict[int, list[int]] = {}
    title = -1
    for i, (kind, value, _) in enumerate(events):
        if kind == "open":
            if value in STRUCTURE:
                if value in ("article", "main"):
                    around[i] = list(stack)
                stack.append(i)
            elif value == "h1" and title < 0:
                title = i
        elif kind == "close" and any(events[k][1] == value for k in stack):
            while events[k := stack.pop()][1] != value:
                pass
            ends[k] = i
    leaving = {k for own in around.values() for k in own if _apart(events[k][1:])}
    unclosed = {k for k in leaving if k not in ends}
    loose = {k for k in leaving - unclosed if events[k][1] == "form" or events[k][1] not in SKIPPED}
    wrappers = {k for k in loose if k < title < ends[k]}
    kept = leaving - unclosed - wrappers
    free = [i for i, own in around.items() if kept.isdisjoint(own)]
    wrappers |= {k for k in loose - wrappers if all(k < i < ends[k] for i in free)}
    return unclosed, wrappers


@lru_cache(1 << 14)
def _named(names: str) -> tuple[bool, bool]:
    """Whether names tell of boilerplate, and of a header: whole names, or such with common words and numbers beside them."""
    found = [False, False]
    for name in names.lower().split():
        parts = {p for p in re.split("[_-]+", name) if p and not p.isdigit()}
        for k, words in enumerate((NAMES, HEADERS)):
            found[k] |= not parts.isdisjoint(words) and parts <= words | BESIDE
        found[0] |= "side" in parts and parts <= {"side", "left", "right"}
    return found[0], found[1]


def _apart(element: tuple[str, str]) -> bool:
    """Whether an element around an article is boilerplate by its kind or names."""
    return element[0] == "header" or _named(element[1])[1] or _leaves([element])


def _leaves(path) -> bool:
    """Whether any element of a path is boilerplate by its kind or names wherever it stands."""
    return any(e in SKIPPED or names and _named(names)[0] for e, names in path)


def _in_article(path) -> bool:
    return any(e in ("article", "main") for e, _ in path)


def _skipped(path) -> bool:
    if _leaves(path):
        return True
    # a header of the page, not one inside the article
    return any((e == "header" or _named(names)[1]) and not _in_article(path[:k]) for k, (e, names) in enumerate(path))


def _name(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _slot(path: tuple) -> tuple[int, bool, bool]:
    """The token of a path, whether its texts are skipped and whether it is inside an article or main."""
    return _name(path), _skipped(path), _in_article(path)


def _text_name(slot: int, text: str) -> int:
    key = slot.to_bytes(8, "little", signed=True)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=key).digest(), "little", signed=True)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _copies(pages: DataFrame) -> DataFrame:
    """(host, digest, copies) of the html that several pages of a host share."""
    rows = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("html").alias("digest"))
    return rows.groupBy("host", "digest").agg(F.count("*").alias("copies")).where("copies > 1")


def template_tokens(pages: DataFrame, broadcast_copies: int = BROADCAST_COPIES, by_names: bool = True) -> DataFrame:
    """(host, token, kind, parent, text characters, link characters, held, times, page, weight) of each token of each page.

    The parent of a text is its slot, the parent of an element the one around it.  ``held`` are the
    characters of an element and all in it that are no links; what elements and names tell to be
    boilerplate doesn't count in it, unless ``by_names`` is false.  Copies of a page weigh one together.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _slot(())[0]
        for batch in batches:
            for host, page, html, copies in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                opened, texts, chars, link_chars, held = Counter(), Counter(), Counter(), Counter(), Counter()
                for path, skipped, text, linked in page_blocks(html or "", opened):
                    slot = _slot(path)[0]
                    if not (skipped and by_names):
                        held[slot, text] += len(text)
                        for k in range(len(path) + 1):
                            held[path[:k]] += len(text) - linked
                    chars[slot] += len(text)
                    link_chars[slot] += linked
                    texts[slot, text] += 1
                own = [(root, PATH, 0, chars[root], link_chars[root], held[()], 1)]
                for path, n in opened.items():
                    slot = _slot(path)[0]
                    own.append((slot, PATH, _slot(path[:-1])[0], chars[slot], link_chars[slot], held[path], n))
                own += [(_text_name(slot, text), TEXT, slot, 0, 0, held[slot, text], n) for (slot, text), n in texts.items()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([host] * len(own)),
                        *(pa.array(x, t) for x, t in zip(zip(*own, strict=True), kinds, strict=True)),
                        pa.array([page] * len(own), pa.int64()),
                        pa.array([1 / (copies or 1)] * len(own), pa.float64()),
                    ],
                    ["host", "token", "kind", "parent", "chars", "links", "held", "times", "page", "weight"],
                )

    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
    copies = written(_copies(pages), "copies")
    rows = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), "html", F.xxhash64("html").alias("digest"))
    rows = rows.join(F.broadcast(copies) if copies.count() <= broadcast_copies else copies, ["host", "digest"], "left").select("host", "page", "html", "copies")
    return rows.mapInArrow(read, "host string, token long, kind int, parent long, chars long, links long, held long, times long, page long, weight double")


def nested(tokens: list[dict]) -> list[dict]:
    """The template of a host, as TEMPLATE, from its frequent tokens (token, kind, parent, pages, chars, links, held, vector)."""
    size = Counter(t["vector"] for t in tokens)
    elements = {t["token"]: t for t in tokens if t["kind"] == PATH}
    root = elements[_slot(())[0]]
    out, fixed = [], []
    for t in tokens:
        if size[t["vector"]] < 2:
            continue
        around = elements.get(t["parent"], root)
        while size[around["vector"]] < 2 and around is not root:
            around = elements.get(around["parent"], root)
        if t["kind"] == PATH:
            out.append({"token": t["token"], "kind": LINK_SLOT if t["links"] > LINKS * t["chars"] else PATH})
        elif t["pages"] >= TEXT_SHARE * around["pages"] - 1e-6:
            out.append({"token": t["token"], "kind": TEXT})
            fixed.append(t)
    outer = _outer(elements, fixed, root["token"])
    return [t | {"kind": OUTER} if t["token"] in outer else t for t in out]


def _outer(elements: dict[int, dict], fixed: list[dict], root: int) -> set[int]:
    """The elements that are neither around the main slot nor in it; one in an element that isn't known is neither."""
    held = {k: t["held"] for k, t in elements.items()}
    for t in fixed:
        at = t["parent"]
        while at in held:
            held[at] -= t["held"]
            at = elements[at]["parent"]
    inside: dict[int, list[int]] = {}
    for k, t in elements.items():
        inside.setdefault(t["parent"], []).append(k)
    main, around = root, {root}
    while inside.get(main):
        most = max(inside[main], key=lambda k: (held[k], k))
        if held[most] <= 0 or held[most] < MAIN_SHARE * held[main]:
            break
        main = most
        around.add(main)

    def below(top: int) -> set[int]:
        found, todo = {top}, [top]
        while todo:
            own = inside.get(todo.pop(), [])
            found.update(own)
            todo += own
        return found

    return below(root) - below(main) - around


def templates(pages: DataFrame, broadcast_copies: int = BROADCAST_COPIES, by_names: bool = True) -> DataFrame:
    """(host, template): the paths, link slots, outer slots and fixed texts in the nested classes of each host."""
    tokens = template_tokens(pages, broadcast_copies, by_names).groupBy("host", "token", "kind").agg(
        F.sum("weight").alias("pages"),
        # equal for equal occurrence vectors, whatever the order of pages
        F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).alias("vector"),
        F.min("parent").alias("parent"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
        F.sum("held").alias("held"),
    )
    # weights of copies don't add up to whole numbers exactly
    often = written(tokens.where(F.col("pages") >= LEAST_PAGES - 1e-6), "tokens")  # read twice below
    hosts = often.where(F.col("token") == _slot(())[0]).select("host", F.col("pages").alias("all"))
    often = often.join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all") - 1e-6)
    own = F.struct("token", "kind", "parent", "pages", "chars", "links", "held", F.col("vector").cast("string").alias("vector"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("token", pa.int64()), ("kind", pa.int32())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([nested(t) for t in batch.column(1).to_pylist()], kind)], ["host", "template"])

    # a host has at most twice as many frequent tokens as its pages have on average
    return often.groupBy("host").agg(F.collect_list(own).alias("own")).mapInArrow(nest, f"host string, template {TEMPLATE}")


def main_text(html: str | None, template: list[dict] | None, by_names: bool = True) -> str:
    """The main text of a page under the template of its host; without ``by_names`` by the template alone."""
    return _main_text(html, {t["token"]: t["kind"] for t in template or ()}, by_names)


def _is_outer(path: tuple, known: dict[int, int]) -> bool:
    """Whether the innermost element of a path that the template knows is outside of the main slot."""
    for k in range(len(path), -1, -1):
        kind = known.get(_slot(path[:k])[0])
        if kind is not None:
            return kind == OUTER
    return False


def _main_text(html: str | None, known: dict[int, int], by_names: bool = True) -> str:
    chars, links, left = Counter(), Counter(), []
    for path, skipped, text, linked in page_blocks(html or ""):
        chars[path] += len(text)
        links[path] += linked
        slot, _, inside = _slot(path)
        if not (skipped and by_names) and not (known and (known.get(slot) == LINK_SLOT or _text_name(slot, text) in known)):
            left.append((path, slot in known, inside, text))
    if by_names and any(inside for _, _, inside, _ in left):
        return "\n".join(text for _, _, inside, text in left if inside)
    inner = [x for x in left if not _is_outer(x[0], known)] if known else left
    # a page of another layout than its host's others may have all of its text outside
    return "\n".join(text for path, slot, _, text in inner or left if slot or links[path] <= LINKS * chars[path])


def extract_pages(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Null or empty html gives an empty text, however long html is read whole; a null url is a host of
    its own; a null page_id is kept; repeated rows are read each; an empty table gives no rows; other
    columns are not looked at.  Templates are broadcast if they have at most ``broadcast_tokens``
    tokens in all, and else joined by host.
    """
    found = written(templates(pages), "templates")
    small = (found.agg(F.sum(F.size("template") + 1)).first()[0] or 0) <= broadcast_tokens
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "host", "template")
    kinds = dict(rows.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}  # of the hosts met last
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, texts = batch.slice(k, 256), []
                for html, host, template in zip(part.column(2), part.column(3).to_pylist(), part.column(4), strict=True):
                    if host not in known:
                        if len(known) >= KNOWN_HOSTS:
                            known.clear()
                        known[host] = {t["token"]: t["kind"] for t in template.as_py() or ()}
                    texts.append(_main_text(html.as_py(), known[host]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
