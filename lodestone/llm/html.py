"""Main text of web pages, with site templates removed.

Two passes over the pages. The first parses each page and hashes its element subtrees in two ways: with their text, and
as frames, the tag, class, id, role and kinds of children of a container without its text, beside the number of its
words and of those in links. Spark counts for each host in how many different pages a subtree stands. The second pass
parses again, deletes the subtrees that recur on the page's host, and writes out what is left block by block. A task
holds one page at a time; hosts are never gathered in a task: counts are combined before the shuffle, and a hot host is
salted in the join of pages with their templates.

A template stands in at least MIN_PAGES of a host's different pages and in a share of them: SHARE for subtrees inside
an article, which an article must not lose because it was reprinted, SHARE_AROUND for what stands around it. A frame
must be made of links for the most part or hold WORDS words at most on average, as menus, adverts and footers do whose
text changes from page to page. Copies of a page count once, so an article copied many times is no template. Paragraphs,
headings, articles and what holds an article are never frames.

What recurs too little to be a template, as on hosts of few pages, falls back on names: elements that HTML keeps for
other things than the article, and words that sites use in classes and ids.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.scratch import materialise

MIN_PAGES = 8
SHARE = 0.5
SHARE_AROUND = 0.1
#: Words of a frame on average up to which it is furniture of the page.
WORDS = 25
#: A host with more than this part of all pages is dealt to several tasks.
PARTS = 500

# Names of HTML elements and of roles, and words that sites use in classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head script style noscript template title textarea iframe object embed svg math canvas audio video nav aside footer form button select option input dialog menu label fieldset map noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt html body legend summary".split()) | frozenset(["li", "dd", "dt"])
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)),
    "tfoot": ("tbody thead tfoot tr td th", ("table",)),
}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert alerts "
    "popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar "
    "footer share sharing social related recommended recommendations comment comments respond replies disqus login search toolbar".split()
)
NOISE_IN_PAGE = frozenset(["header"])  # an article's own header holds its title
ARTICLE_WORDS = frozenset(["article", "content", "entry", "post", "story"])
NO_TEXT = frozenset("head script style noscript template title textarea iframe object embed svg math canvas audio video select option noembed noframes xmp".split())
FRAMES = frozenset("div section nav aside header footer form ul ol dl menu table".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "marks")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.hash, self.marks = tag, attrs, [], 0, ()


_TAG = re.compile(r"<(?:!--|[/!?]?[A-Za-z?!])")
_NAME = re.compile(r"[^\s/>]+")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class _Quotes:
    """Finds the ends of the tags of a page; a quote that is never closed does not swallow the page."""

    _mark = re.compile(r"""[>"']""")

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """Index of the > that ends the tag at ``at``, quoted ones left out; -1 if the page ends first."""
        page, i = self.page, at
        while m := self._mark.search(page, i):
            i = m.end()
            if m[0] == ">":
                return m.start()
            if page[m.start() - 1] in "= \t\n\r\f":
                if self.last[m[0]] < i:
                    return page.find(">", at)
                i = page.find(m[0], i) + 1
        return page.find(">", at)


def parse(page: str) -> Node:
    """The element tree of a page, tolerant of what browsers tolerate. Comments, declarations and cut tags vanish."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    quotes = _Quotes(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        start = m.start()
        if start > at:
            stack[-1].kids.append(page[at:start])
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        end = quotes.tag_end(start + 1)
        if end < 0:
            break
        at = end + 1
        if page[start + 1] in "!?":
            continue
        closing = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        tag = name[0].lower() if name else ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            shut, walls = CLOSES[tag]
            shut = shut.split()
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in walls:
                if stack[i].tag in shut:
                    del stack[i:]
                i -= 1
        node = Node(tag, page[name.end() : end])
        stack[-1].kids.append(node)
        if tag in RAW:
            m = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            node.kids.append(page[at : m.start()] if m else page[at:])
            shut_at = page.find(">", m.start()) if m else -1
            at = n if shut_at < 0 else shut_at + 1
        elif tag not in VOID and not node.attrs.endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCK:
            stack.append(node)  # <div/> opens an element
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(node.attrs)} if node.attrs.strip(" /") else {}


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))


def noisy(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of an article by its tag, role, class or id."""
    if node.tag in DROP or node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in NOISE_ROLES:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    words = _words(f"{a.get('class', '')} {a.get('id', '')}")
    if node.tag == "article":
        return bool(words & {"comment", "comments", "ad", "ads", "advert", "related", "promo", "sponsored"})
    return bool(words & NOISE_WORDS) or not in_article and bool(words & NOISE_IN_PAGE)


def prune(root: Node) -> None:
    """Remove noise below ``root``."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        kept = []
        for k in node.kids:
            if isinstance(k, str):
                kept.append(k)
            elif not noisy(k, inside or k.tag in ("article", "main")):
                kept.append(k)
                todo.append((k, inside or k.tag in ("article", "main")))
        node.kids = kept


def strip(root: Node) -> None:
    """Remove scripts, styles and other elements without text of the page."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in NO_TEXT]
        todo += [k for k in node.kids if not isinstance(k, str)]


def _signed(v: int) -> int:
    return v - (1 << 64 if v >> 63 else 0)


def hash_subtrees(root: Node) -> dict[int, tuple[int, int, int]]:
    """hash -> (kind, words, words in links) of what may be a template below ``root``; hashes are kept on the nodes.

    Kind 1 is a container with its text outside an article, 0 any other block with its text, 2 a frame. An element has
    a hash of its text and, if it can be a frame, one of its shape; elements that hold no text have none.
    """
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        article = node.tag in ("article", "main") or _container(node)
        order.append((node, inside, article))
        inside = inside or article
        todo += [(k, inside) for k in node.kids if not isinstance(k, str)]
    found: dict[int, tuple[int, int, int]] = {}
    facts: dict[int, tuple[int, int, bool]] = {}  # words, words in links, whether an article is below
    for node, inside, holds in reversed(order):
        h, words, links = xxhash.xxh64(node.tag.encode()), 0, 0
        for k in node.kids:
            if isinstance(k, str):
                t = k.split()
                words += len(t)
                h.update(b"\0" + " ".join(t).encode("utf-8", "replace"))
            elif k.hash:
                w, l, x = facts.pop(id(k))  # noqa: E741
                words, links, holds = words + w, links + l, holds or x
                h.update(b"\1" + k.hash.to_bytes(8, "little", signed=True))
        links = words if node.tag == "a" else links
        if not words:
            continue
        facts[id(node)] = (words, links, holds)
        node.hash = _signed(h.intdigest())
        if node.tag in BLOCK and node.tag not in ("html", "body") and not holds:
            node.marks = [node.hash ^ inside]
            found[node.marks[0]] = (int(not inside and node.tag in FRAMES), words, links)
            if node.tag in FRAMES and not inside:
                a = attributes(node)
                shape = [node.tag, *(a.get(x, "") for x in ("class", "id", "role")), *sorted({k.tag for k in node.kids if not isinstance(k, str)})]
                node.marks.append(_signed(xxhash.xxh64_intdigest("\x1f".join(shape).encode("utf-8", "replace"), 1)))
                found[node.marks[1]] = (2, words, links)
    return found


def delete_templates(root: Node, templates: set[int]) -> None:
    """Remove the subtrees that are templates."""
    if not templates:
        return
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or templates.isdisjoint(k.marks)]
        todo += [k for k in node.kids if not isinstance(k, str)]


def _container(node: Node) -> bool:
    """Whether an element is named as one that holds an article."""
    if node.tag not in ("div", "section") or not node.attrs:
        return False
    a = attributes(node)
    return not ARTICLE_WORDS.isdisjoint(_words(f"{a.get('class', '')} {a.get('id', '')}"))


def _outermost(root: Node, test) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        for k in reversed(node.kids):
            if not isinstance(k, str):
                todo.append(k)
        if node is not root and test(node):
            found.append(node)
            drop = sum(not isinstance(k, str) for k in node.kids)
            if drop:
                del todo[-drop:]
    return found


def main_nodes(root: Node) -> list[Node]:
    """The elements that hold the article: article, else main or role=main, else a content container, else all."""
    for test in (
        lambda x: x.tag == "article",
        lambda x: x.tag == "main" or "role" in x.attrs and attributes(x).get("role") == "main",
        _container,
        lambda x: x.tag == "body",
    ):
        if found := _outermost(root, test):
            return found
    return [root]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order."""
    out, piece, todo = [], [], [node]

    def shut() -> None:
        text = " ".join("".join(piece).split())
        if text:
            out.append(text)
        piece.clear()

    while todo:
        x = todo.pop()
        if x is None:
            shut()
        elif isinstance(x, str):
            piece.append(html.unescape(x))
        elif x.tag == "br":
            piece.append(" ")
        else:
            if x.tag in BLOCK:
                shut()
                todo.append(None)
            todo += reversed(x.kids)
    shut()
    return out


def main_text(page: str | None, templates: set[int] | None = None, names: bool = True) -> str:
    """The main text of a page without the subtrees marked in ``templates``. Null and empty pages give ''.

    With ``names``, what is left is cut to the article and freed of elements that are noise by their name. A page of
    any length is held and read whole.
    """
    if not page:
        return ""
    root = parse(page)
    strip(root)
    if templates:
        hash_subtrees(root)
        delete_templates(root, templates)
    if not names:
        return "\n".join(blocks(root))
    prune(root)
    return "\n".join(b for node in main_nodes(root) for b in blocks(node))


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; '' for a null or relative one."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:\d*$", ""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, around: float = SHARE_AROUND) -> DataFrame:
    """(host, templates array<long>): the subtrees that recur on each host. The array is bounded: at least ``around``
    of a host's pages hold each entry, so it is at most 1 / around times as long as an average page has elements."""
    src = pages.select(host(F.col("url")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], []
            for row, page in enumerate(batch["html"]):
                if text := page.as_py():
                    root = parse(text)
                    strip(root)
                    found = hash_subtrees(root) | {0: (3, 0, 0)}  # 0 counts the page itself
                    rows += [row] * len(found)
                    cols += [(root.hash, h, *v) for h, v in found.items()]
            kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32()]
            made = [pa.array(c, k) for c, k in zip(list(zip(*cols, strict=True)) or [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"].take(pa.array(rows, pa.int64())), *made], ["host", "sig", "hash", "kind", "words", "links"])

    once = src.mapInArrow(run, "host string, sig long, hash long, kind byte, words int, links int").dropDuplicates(["host", "sig", "hash"])
    seen = once.groupBy("host", "hash", "kind").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("links").alias("links"))
    seen = materialise(seen.where(f"hash = 0 OR n >= {int(min_pages)}"), "site-subtrees")  # pages are parsed once for it
    total = seen.where("hash = 0").select("host", F.col("n").alias("pages"))
    part = F.when(F.col("kind") == 0, F.lit(share)).otherwise(F.lit(around))
    furniture = (F.col("kind") < 2) | (2 * F.col("links") >= F.col("words")) | (F.col("words") <= WORDS * F.col("n"))
    often = seen.where("hash <> 0").join(total, "host").where((F.col("n") > part * F.col("pages")) & furniture)
    return often.groupBy("host").agg(F.collect_set("hash").alias("templates"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, around: float = SHARE_AROUND, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null html is an empty page; a null url belongs to the host ''; repeated rows are kept and count once for
    templates; null ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    src = pages.select("page_id", "url", "html", host(F.col("url")).alias("_host"))
    known = site_templates(pages, min_pages, share, around).withColumnRenamed("host", "_host")
    sizes = src.groupBy("_host").agg(F.count("*").alias("n"))
    total = pages.count()
    # Hosts of over 1 / PARTS of all rows, fewer than PARTS of them, are dealt to so many tasks as they have such shares.
    hot = F.broadcast(sizes.where(F.col("n") * PARTS > total).select("_host", F.ceil(F.col("n") * PARTS / max(total, 1)).alias("_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("_parts")), F.lit(0).cast("long"))
    src = src.join(hot, "_host", "left").withColumn("_salt", salt).drop("_parts")
    known = known.join(hot, "_host", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1))).drop("_parts")
    rows = src.join(known, ["_host", "_salt"], "left").select("page_id", "url", "html", "templates")

    @F.pandas_udf(T.StringType())
    def text(html_: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, None if t is None else {int(x) for x in t}, names) for p, t in zip(html_, templates, strict=True)], dtype="object")

    return rows.withColumn("text", text("html", "templates")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
