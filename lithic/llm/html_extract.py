"""Main text of web pages by equivalence-class template deduction.

Pages of a host come out of a template.  A page's tokens are its elements, named by their path from
the root with classes, and its blocks of text.  Each has an occurrence vector:
how often it is on each of the host's distinct pages.  Tokens that share a vector and
are on enough pages are an equivalence class; one whose elements' parents
are in valid classes of equal or greater support is nested, and the nested valid classes make
the host's template.  Text blocks that are tokens of the template are its constants; what hangs on
its elements otherwise are slots.

The main slot is the deepest template container that is there once a page and holds most of the host's text; the
constants in it are left out, unless they are half of a page's text or more: such pages share an article.  What elements say they are (article, nav, footer, form, ...) checks that: an article around the
slot or with most of the slot's text is taken instead, and asides are never main.  Pages without
the slot are told by such names alone; on hosts with too few pages for a template, main elements come before the slot.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.store import map_arrow, materialize

#: A class is frequent enough from this share of its host's pages on, and this many pages.
SUPPORT, PAGES = 0.5, 4
#: The main slot holds this share of the host's text, menus and the like left out.
MAIN_SHARE = 0.6
#: An element is a slot if it is there just once on this share of its pages.
ONCE = 0.9
#: Contents that several pages have, up to which their counts are broadcast.
BROADCAST_COPIES = 1_000_000
#: Template rows up to which all of them are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 200_000

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "option optgroup", "thead": "tbody tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
SIBLINGS = {k: frozenset(v.split()) for k, v in SIBLINGS.items()}
#: Elements of running text: never slots.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd pre blockquote figure figcaption summary address legend".split())
SCOPES = frozenset("html body article section div main table ul ol dl td th aside nav header footer form button".split())

#: Elements that are never main text, by name and role.
ASIDE = frozenset("head nav footer aside script style noscript template svg math button select option textarea input iframe object canvas audio video menu dialog title".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MAIN = frozenset(["article", "main"])
#: Elements that are taken for asides by a word of their class or id, unless the page's text says otherwise; see settle().
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social related recommended recommendations footer masthead "
    "pagination pager toolbar login search skip".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed)


#: Kinds of elements: articles, main elements, articles that may be comments; asides by standard, by a word, and comments by a word.
NEITHER, ARTICLE, MAIN_PART, COMMENT_ARTICLE, NEVER, SOFT, COMMENTS = range(7)


def _kind(tag: str, raw: str) -> tuple[str, int]:
    """An element's name with its classes, and its kind."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}
    name = f"{tag}.{found.get('class', '').strip().lower()}"
    role = found.get("role", "").lower()
    if tag in ASIDE or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return name, NEVER
    words = () if tag in ("html", "body") else _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
    comments = not COMMENT_WORDS.isdisjoint(words)
    if tag in MAIN or role in ("main", "article"):
        return name, MAIN_PART if tag == "main" or role == "main" else COMMENT_ARTICLE if comments else ARTICLE
    if comments:
        return name, COMMENTS
    return name, SOFT if tag == "form" or role == "form" or not ASIDE_WORDS.isdisjoint(words) else NEITHER


class Element:
    """An open element: its path's hash, its kind, and what it lies in; main, aside and is_main are settle()'s."""

    __slots__ = ("tag", "path", "kind", "up", "depth", "never", "main", "aside", "is_main", "mass", "most")

    def __init__(self, tag: str, path: int, kind: int, up: Element | None):
        self.tag, self.path, self.kind, self.up = tag, path, kind, up
        self.depth = up.depth + 1 if up else 0
        self.never = bool(up and up.never) or kind == NEVER
        self.main = self.aside = self.is_main = False
        #: Characters of text in it, and in the largest article or main element that it is or holds.
        self.mass = self.most = 0

    def inside(self, *kinds: int) -> bool:
        up = self.up
        while up and up.kind not in kinds:
            up = up.up
        return up is not None


def settle(found: list[tuple[Element, str | None]]) -> list[tuple[Element, str | None]]:
    """Tells which of a page's elements are main and which are asides, from their kinds and how much text they hold.

    A word of class or id, or being a form or the page's header, makes an element an aside unless it holds the page's largest article or,
    on pages without one, most of the text; inside an article, unless it holds most of that.  Comments
    never count by their own text.  If all of a page's text were in such asides, none of them is one.
    """
    elements = [el for el, text in found if text is None]
    if not elements:
        return found
    root = elements[0]
    while root.up:
        root = root.up
    for el, text in found:
        if text and not el.never:
            el.mass += len(" ".join(text.split()))
    for el in reversed(elements):
        el.up.mass += el.mass
    # Articles with comment words are comments in articles, and in comments beside an article.
    article = any(el.kind == ARTICLE and el.mass and not el.inside(COMMENTS) for el in elements)
    for el in elements:
        if el.kind == COMMENT_ARTICLE:
            el.kind = COMMENTS if el.inside(ARTICLE) or article and el.inside(COMMENTS) else ARTICLE
    for el in reversed(elements):
        if el.kind in (ARTICLE, MAIN_PART):
            el.most = el.mass
        el.up.most = max(el.up.most, el.most)
    within: dict[int, int] = {}
    for el in elements:
        up = el.up
        over = within.get(id(up))
        kind = SOFT if el.tag == "header" and el.kind == NEITHER and not up.main else el.kind
        el.aside = up.aside or el.never
        if not el.aside and kind in (SOFT, COMMENTS):
            if over is None:
                kept = root.most and el.most == root.most or not root.most and kind == SOFT and 2 * el.mass > root.mass
            else:
                kept = 2 * el.most > over or kind == SOFT and 2 * el.mass > over
            el.aside = not kept
        el.is_main = not el.aside and kind in (ARTICLE, MAIN_PART)
        el.main = not el.aside and (up.main or el.is_main)
        if el.main:
            within[id(el)] = el.mass if el.is_main else over
    if root.mass and not any(text and not text.isspace() and not el.aside for el, text in found):
        for el in elements:
            el.aside = el.never
            el.is_main = not el.aside and el.kind in (ARTICLE, MAIN_PART)
            el.main = not el.aside and (el.up.main or el.is_main)
    return found


def nodes(page: str) -> Iterator[tuple[Element, str | None]]:
    """Each element as it opens (with None), and each text node with the element that holds it; ("", element) where a block begins or ends."""
    root = Element("", 0, NEITHER, None)
    at, here = 0, root
    end = len(page)
    known: dict[tuple[int, str, str], tuple[int, int]] = {}
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield here, page[at:]
            return
        if m.start() > at:
            yield here, page[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = here
            while up.up and up.tag != tag:
                up = up.up
            if up.up:
                here = up.up
            if tag not in INLINE:
                yield here, ""
            continue
        close = SIBLINGS.get(tag, frozenset(["p"]) if tag in CLOSES_P else None)
        if close:
            up = here
            while up.up and up.tag not in close and up.tag not in SCOPES:
                up = up.up
            if up.up and up.tag in close:
                here = up.up
        raw = m[3] if m[2] else m[6]
        if tag in VOID:
            if tag not in INLINE:
                yield here, ""
            continue
        key = (here.path, tag, raw)
        if key not in known:
            name, kind = _kind(tag, raw)
            known[key] = _hash(name, here.path), kind
        path, kind = known[key]
        if tag not in INLINE:
            yield here, ""
        inner = Element(tag, path, kind, here)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            yield inner, None
            at = stop.end() if stop else end
            continue
        if not raw.rstrip().endswith("/") or tag not in ("path", "circle", "rect", "use"):
            here = inner
        yield inner, None


def _blocks(found: list[tuple[Element, str | None]]) -> Iterator[tuple[Element, list[str]]]:
    """The pieces of text between two block boundaries, asides left out, and the block element that holds the first."""
    holder: Element | None = None
    pieces: list[str] = []
    for el, text in [*found, (Element("", 0, NEITHER, None), "")]:
        if text == "":
            if holder:
                yield holder, pieces
            holder, pieces = None, []
        elif text and not el.aside:
            pieces.append(text)
            if not holder and not text.isspace():
                holder = el
                while holder.up and holder.tag in INLINE and not holder.is_main:
                    holder = holder.up


def _token(holder: Element, pieces: list[str]) -> int:
    return _hash(" ".join("".join(pieces).split()), holder.path)


def page_tokens(page: str) -> dict[int, list[int]]:
    """Token -> [times, characters of main-like text below it, depth, parent's path, kind]: 0 for an element, 1 for a text block, 2 for an element of running text.

    Token 0 is the page itself.
    """
    found: dict[int, list[int]] = {0: [1, 0, 0, 0, 3]}
    known = settle(list(nodes(page)))
    for el, text in known:
        if text is None:
            found.setdefault(el.path, [0, 0, el.depth, el.up.path if el.up else 0, 2 if el.tag in TEXT_TAGS else 0])[0] += 1
    for holder, pieces in _blocks(known):
        found.setdefault(_token(holder, pieces), [0, 0, holder.depth, holder.path, 1])[0] += 1
        n = len(" ".join("".join(pieces).split()))
        up: Element | None = holder
        while up:
            found[up.path][1] += n
            up = up.up
    return found


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, all, main, constants): a row for each host.

    all counts the host's distinct pages, main is the path of the main slot (null if none holds enough), constants the template's text blocks.
    Copies of a page are no evidence of a template, so they count as one.
    """
    marked = pages.select("host", F.xxhash64("host", F.coalesce("html", F.lit(""))).alias("content"), "html")
    contents = materialize(marked.groupBy("host", "content").agg(F.count("*").alias("copies")), "contents")
    totals = contents.groupBy("host").agg(F.count("*").alias("all"))
    copied = contents.where("copies > 1").select("content", "copies")
    if copied.count() <= BROADCAST_COPIES:
        copied = F.broadcast(copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for host, content, copies, page in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "copies", "html")), strict=True):
                for token, (times, mass, depth, parent, kind) in page_tokens(page or "").items():
                    # So few bits that the sum over 2^25 pages is a long.
                    mark = _hash(f"{content}:{times}", 1) >> 26
                    for column, value in zip(columns, (host, token, mark, mass, depth, parent, kind, times == 1, copies), strict=True):
                        column.append(value)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *map(as_long, columns[1:])], ["host", "token", "mark", "mass", "depth", "parent", "kind", "once", "copies"])

    spec = "host string, token long, mark long, mass long, depth long, parent long, kind long, once long, copies long"
    tokens = map_arrow(marked.join(copied, "content", "left").select("host", "content", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "html"), run, spec)
    # An occurrence vector is named by the sum of a mark for each page and count; a page's copies share their page's count of one.
    sums = [F.sum("mark").alias("vector"), F.round(F.sum(F.lit(1.0) / F.col("copies"))).cast("long").alias("pages"), F.sum("mass").alias("mass"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("kind").alias("kind"), F.avg("once").alias("once")]
    vectors = tokens.groupBy("host", "token").agg(*sums)
    enough = (F.col("pages") >= F.col("all") * SUPPORT) & (F.col("pages") >= F.least(F.lit(PAGES), F.col("all"))) & ((F.col("kind") != 1) | (F.col("all") >= PAGES))
    kept = materialize(vectors.join(totals, "host").where(enough), "tokens")
    whole = kept.where("token = 0").select("host", F.col("mass").alias("whole"))
    often = kept.where("token <> 0")
    members = F.count("*").over(Window.partitionBy("host", "vector"))
    valid = often.withColumn("members", members).where((F.col("members") > 1) | (F.col("pages") == F.col("all")))
    # Nested: the parent is in a valid class that is on as many pages at least, or is the root.
    parents = valid.select("host", F.col("token").alias("parent"), F.col("pages").alias("parent_pages"))
    template = valid.join(parents, ["host", "parent"], "left").where("parent = 0 or parent_pages >= pages")
    slots = template.where((F.col("kind") == 0) & (F.col("once") >= ONCE)).join(whole, "host").where(F.col("mass") >= MAIN_SHARE * F.col("whole"))
    main = slots.groupBy("host").agg(F.max(F.struct("depth", "mass", "token"))["token"].alias("main"))
    # A page's constants are no more than its text blocks, and each is on SUPPORT of the pages, so the list is bounded by two pages' blocks.
    constants = template.where("kind = 1").groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("constants"))
    return totals.join(main, "host", "left").join(constants, "host", "left")


def main_text(page: str, pages: int, main: int | None, constants: frozenset[int]) -> tuple[str, bool]:
    """The text of a page's main slot without the host's constants, and whether it is the slot's; see the module for what names decide."""
    found = settle(list(nodes(page)))
    blocks = list(_blocks(found))
    own = any(el.main and not el.aside for el, _ in found)
    slot = None if main is None or all(el.path != main for el, _ in found) else main
    if own and pages < PAGES:
        slot = None
    if slot is not None:
        tops = [_within(holder, slot) for holder, _ in blocks]
        # An article in the slot with most of its text is taken instead.
        sizes = [(sum(map(len, pieces)), holder.main) for (holder, pieces), top in zip(blocks, tops, strict=True) if top]
        size, of_main = sum(n for n, _ in sizes), sum(n for n, inner in sizes if inner)
        taken = [bool(top) and (holder.main or 2 * of_main < size) for (holder, _), top in zip(blocks, tops, strict=True)]
        # An article around the slot is taken whole.
        around = {id(up) for top in tops if top and (up := _article(top))}
        taken = [t or _below(holder, around) for (holder, _), t in zip(blocks, taken, strict=True)] if around else taken
    if slot is None or not any(taken):
        slot = None
        taken = [holder.main or not own for holder, _ in blocks]
    chosen = [(sum(map(len, pieces)), pieces, bool(constants) and _token(holder, pieces) in constants) for (holder, pieces), t in zip(blocks, taken, strict=True) if t]
    # Pages that share most of their text share an article, not a template's notes in it.
    shared = 2 * sum(n for n, _, constant in chosen if constant) >= sum(n for n, *_ in chosen)
    out = ["".join(map(html_.unescape, pieces)) for _, pieces, constant in chosen if shared or not constant]
    return " ".join(" ".join(out).split()), slot is not None


def _within(el: Element, path: int) -> Element | None:
    """The element of this path that el is or lies in."""
    up: Element | None = el
    while up and up.path != path:
        up = up.up
    return up


def _article(el: Element) -> Element | None:
    """The innermost main element that el is or lies in."""
    up: Element | None = el if el.main else None
    while up and not up.is_main:
        up = up.up
    return up


def _below(el: Element, tops: set[int]) -> bool:
    up: Element | None = el
    while up and id(up) not in tops:
        up = up.up
    return up is not None


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars, host_pages, from_template.

    host_pages counts the host's distinct pages; from_template tells whether the text is that of the template's main slot.  pages has page_id, url and html; other columns are ignored.  Null and empty pages
    have an empty text.  Blocks are joined by one space, white space inside them is one space,
    character references are decoded.  Hosts are told by the url, in lower case; rows with a null
    url are of one host.  Repeated rows are extracted each, whole pages however long; elements left open
    end with their parents; an empty table gives no rows.

    A host with any number of pages is no group that meets in a task: its tokens' vectors are combined
    before they are shuffled, and its pages stay where they are read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    templates = materialize(host_templates(rows.select("host", "html")), "templates")
    small = templates.select(F.coalesce(F.sum(F.lit(1) + F.coalesce(F.size("constants"), F.lit(0))), F.lit(0))).first()[0] <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(templates) if small else templates, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of_slot = [], []
            for page, n, main, constants in zip(*(batch.column(c) for c in ("html", "all", "main", "constants")), strict=True):
                at = main.as_py()
                some = frozenset(x & (1 << 64) - 1 for x in constants.as_py() or ())
                text, found = main_text(page.as_py() or "", n.as_py(), None if at is None else at & (1 << 64) - 1, some)
                texts.append(text)
                of_slot.append(found)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), batch.column("all"), pa.array(of_slot, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "host_pages", "from_template"])

    return map_arrow(joined.select("page_id", "url", "html", "all", "main", "constants"), run, "page_id long, url string, text string, n_chars long, host_pages long, from_template boolean")
