"""Main text of web pages, with site template removal.

Every element's subtree is hashed (tag, class, and the hashes and words below it). Spark counts, for
each host and for each section of it (the first part of the path), on how many different pages a
subtree occurs; those on many are template and are cut from the pages there, wherever they stand.
Copies of a page count once, so what is on a page often copied isn't template for that.

A subtree hash can't recur where the content is drawn anew on every page, as in adverts, notices and
comments. So places are counted too, the tags and classes from the page's root to an element: of what stands
beside an article, and, within an article or where there is none, of what is named like an advert or a
part of a page's frame. What is in a place that recurs on the host or section is cut, but not a named
element that holds over half of the words of its pages on average, as a wrapper may be named like a
sidebar. Where a host has too few pages to count, the article or the name alone decides, within the same limit on the page.

Within an article a subtree must be on more pages to be template, as articles may quote what others
quote, and fewer names count. Elements whose tag says that they aren't text (script, nav, footer and such) go everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import bound_batches, column, forget, packed, saved

#: A subtree is template if it is on so many different pages of its host or section, and on such a share of them.
MIN_PAGES, MIN_SHARE = 3, 0.1
#: The same for the place of something beside an article.
BESIDE_PAGES, BESIDE_SHARE = 2, 0.01
#: As before, for parts of an article.
OWN_PAGES, OWN_SHARE = 5, 0.5

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of an article's text, and such that aren't if they hold under half of a page's words.
_DROPPED = frozenset("head script style noscript template iframe noembed noframes nav footer select input textarea svg canvas object embed audio video dialog menu title map annotation annotation-xml".split())
_MINOR = frozenset("aside form header".split())
#: Elements that are text within a line of text, and controls elsewhere.
_INLINE, _LINES = frozenset("button label".split()), frozenset("p li dt dd td th caption figcaption blockquote pre summary h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: What adverts, notices, comments and the like are called, and what else the frame of a page is called outside articles.
_STRONG = r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|navbar|nav|navigation|breadcrumbs?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|widget|pagination|pager|skip-link|sr-only)"
_FRAME = rf"(?:{_STRONG[3:-1]}|banner|side|menu|footer|header|masthead|notice|notification|login|signup|signin|search|toolbar|skip|hidden|alert)"
_PARTS = r"(?:[_-](?:area|bar|block|box|buttons?|container|form|icons?|items?|links?|list|posts|articles|slot|unit|widget|wrap|wrapper))*"
#: A class or id must be such a name as a whole, or have only words for a container beside it.
_INSIDE, _OUTSIDE = (re.compile(rf"(?:site[_-]|page[_-]|main[_-]|global[_-])?{name}(?:[_-]{name})*{_PARTS}", re.I) for name in (_STRONG, _FRAME))
#: Elements of an article that aren't judged by their names; of a section the id isn't.
_UNNAMED = frozenset("p h1 h2 h3 h4 h5 h6 table thead tbody tr td th pre blockquote figure math".split())
#: Classes of article elements that hold a reader's comment.
_COMMENT = frozenset("comment comments comment-body comment-item comment-reply reply replies".split())
#: A place that holds such a share of the words isn't cut.
MOST = 0.5


class Node:
    __slots__ = ("attributes", "children", "digest", "tag", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.digest, self.words = tag, attributes, [], 0, 0

    def named(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)} if self.attributes.strip(" /") else {}


def parse(page: str) -> Node:
    """A tree of elements and strings. Unclosed and misnested elements end where their parents do."""
    root = Node("#root", "")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or (at == end and not m[0].endswith(">")):
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag in _CLOSES_P:
            _close(stack, {"p"}, {"table", "td", "th", "button"})
        if tag in _SIBLING:
            _close(stack, *_SIBLING[tag])
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : close.start()] if close else page[at:]
            if tag in ("title", "textarea"):
                inside = unescape(inside)
            if inside:
                node.children.append(inside)
            at = close.end() if close else end
        elif tag not in _VOID:
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], within: set[str]) -> None:
    """End the innermost open element of these tags, unless one of ``within`` is opened inside it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            if not ({"tr"} & tags):
                return
            continue
        if stack[i].tag in within or stack[i].tag in ("article", "section", "div", "body"):
            return


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    return out[::-1]


def digest(root: Node) -> list[Node]:
    """Hash every subtree and count its words, scripts and such left out; the nodes, children first."""
    nodes = _post_order(root)
    for node in nodes:
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        names = _ATTRIBUTE.findall(node.attributes) if "class" in node.attributes or "id" in node.attributes else ()
        h.update("|".join(sorted(f"{n}={a or b or c}" for n, a, b, c in names if n.lower() in ("class", "id"))).encode("utf-8", "replace"))
        count = 0
        for child in node.children:
            if isinstance(child, Node):
                h.update(b"<" + (child.digest & (2**64 - 1)).to_bytes(8, "big"))
                count += child.words
            elif words := child.split():
                h.update(b">" + " ".join(words).encode("utf-8", "replace"))
                count += len(words)
        node.digest = int.from_bytes(h.digest(), "big", signed=True)
        node.words = 0 if node.tag in _DROPPED else count
    return nodes


def _comment(node: Node) -> bool:
    return node.tag == "article" and "class" in node.attributes and not _COMMENT.isdisjoint(node.named().get("class", "").lower().split())


def _never(node: Node, inside: bool, whole: int) -> bool:
    """Whether an element is no text by its tag or because it is hidden. whole: the page's words."""
    if node.tag in _DROPPED:
        return True
    if node.tag in _MINOR:
        return node.words <= MOST * whole and not (inside and node.tag == "header")
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    if _comment(node):
        return True
    named = node.named()
    return "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", named.get("style", ""), re.I))


def _named(node: Node, inside: bool) -> bool:
    """Whether an element is named like a part of a page's frame, an advert, a notice or a comment."""
    if not node.attributes or node.tag in ("html", "body", "main", "article") or (inside and node.tag in _UNNAMED):
        return False
    named = node.named()
    if named.get("role", "").lower() in _ROLES:
        return True
    names = ("class",) if inside and node.tag == "section" else ("class", "id")
    return any((_INSIDE if inside else _OUTSIDE).fullmatch(x) for name in names for x in named.get(name, "").split())


def _label(node: Node) -> str:
    """A tag and its classes; numbers in them count as one, since many are ids."""
    return f"{node.tag}.{re.sub('[0-9]+', '0', ' '.join(sorted(node.named().get('class', '').split())))}" if "class" in node.attributes else node.tag


def _scopes(root: Node) -> tuple[list[Node], set[int]]:
    """The article elements that aren't in another, else main elements, else none; and the identities of what holds one.

    Those in something that is named like a frame count only if there are no others.
    """
    for wanted in ("article", "main"):
        for strict in (True, False):
            found, around, todo = [], set(), [(root, ())]
            while todo:
                node, above = todo.pop()
                if node is not root and (_never(node, False, root.words) or (strict and _named(node, False))):
                    continue
                if node.tag == wanted:
                    found.append(node)
                    around.update(above)
                else:
                    todo.extend((c, (*above, id(node))) for c in reversed(node.children) if isinstance(c, Node))
            if found:
                return found, around
    return [], set()


NAMED, BESIDE = 1, 2


def places(root: Node, scoped: tuple[list[Node], set[int]]) -> list[tuple[Node, int, int]]:
    """The elements whose place is counted, with a hash of it and a kind. Needs digest() first.

    With an article, the elements beside what holds it (BESIDE); in it, or if there is none in the
    whole page, those that are named like no text (NAMED). None within what never is text.
    """
    scopes, around = scoped
    inner = {id(s) for s in scopes}
    out, todo = [], [(root, "", False)]
    while todo:
        node, path, inside = todo.pop()
        inside = inside or id(node) in inner
        for child in node.children:
            if not isinstance(child, Node) or _never(child, inside, root.words):
                continue
            own = f"{path}>{_label(child)}"
            beside = bool(scopes) and not inside and id(child) not in around and id(child) not in inner
            if beside or ((inside or not scopes) and _named(child, inside)):
                kind = BESIDE if beside else NAMED
                out.append((child, int.from_bytes(hashlib.blake2b(f"{kind}{own}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True), kind))
            if not beside:
                todo.append((child, own, inside))
    return out


class Template:
    """What is cut on a host's pages: subtrees, subtrees within articles, and places; few: too few pages to count."""

    def __init__(self, subtrees: Iterable[int] = (), within: Iterable[int] = (), places: Iterable[int] = (), few: bool = True):
        self.subtrees, self.within, self.places, self.few = frozenset(subtrees), frozenset(within), frozenset(places), few

    def cut(self, root: Node, scoped: tuple[list[Node], set[int]]) -> set[int]:
        """Identities of the elements of a page that are cut for their place; with few pages all beside an article are."""
        return {id(node) for node, place, kind in places(root, scoped) if place in self.places or (self.few and (kind == BESIDE or node.words <= MOST * root.words))}


def blocks(root: Node, template: Template) -> list[str]:
    """Text blocks of the main text in page order, without what the template cuts. Needs digest() first."""
    scopes, around = scoped = _scopes(root)
    out, words, cut = [], [], template.cut(root, scoped)
    inner = {id(s) for s in scopes}

    def flush() -> None:
        if text := " ".join("".join(words).split()):
            out.append(text)
        words.clear()

    # What holds an article has no text of its own.
    todo: list = [(iter(root.children), False, False, id(root) in around)]
    ends: list[bool] = [True]
    while todo:
        children, in_line, inside, holds = todo[-1]
        for child in children:
            if isinstance(child, str):
                if not holds:
                    words.append(child)
                continue
            if child.tag == "br" or child.tag == "hr":
                words.append(" ")
                if child.tag == "hr":
                    flush()
                continue
            block = child.tag in _BLOCK or id(child) in inner
            if block:
                flush()
            if id(child) not in around and id(child) not in inner:
                recurring = template.within if inside else template.subtrees
                if _never(child, inside, root.words) or id(child) in cut or child.digest in recurring or (child.tag in _INLINE and not in_line):
                    continue
            todo.append((iter(child.children), child.tag in _LINES or (in_line and not block), inside or id(child) in inner, id(child) in around))
            ends.append(block)
            break
        else:
            todo.pop()
            if ends.pop():
                flush()
    flush()
    return out


_FOUND = "host string, section string, kind int, digest long, share double, whole long"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different subtrees and named places of each page, with a hash of the page; one row without a digest for the page itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            host, section, kinds, found, share, whole = [], [], [], [], [], []
            for h, s, page in zip(*(some.column(c).to_pylist() for c in ("host", "section", "page"))):
                root = parse(page or "")
                nodes = digest(root)
                own = {n.digest for n in nodes if n.children and n.tag not in ("#root", "html", "body")}
                held: dict[int, list] = {}
                for node, path, kind in places(root, _scopes(root)):
                    held.setdefault(path, [kind, 0.0])[1] += node.words / max(1, root.words)
                n = len(own) + len(held) + 1
                host.extend([h] * n)
                section.extend([s] * n)
                kinds.extend([0] * len(own) + [kind for kind, _ in held.values()] + [None])
                found.extend([*own, *held, None])
                share.extend([0.0] * len(own) + [round(x, 4) for _, x in held.values()] + [0.0])
                whole.extend([root.digest] * n)
            yield pa.record_batch({"host": pa.array(host, pa.string()), "section": pa.array(section, pa.string()), "kind": pa.array(kinds, pa.int32()), "digest": pa.array(found, pa.int64()), "share": pa.array(share, pa.float64()), "whole": pa.array(whole, pa.int64())})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page", "subtrees", "within", "places", "section_subtrees", "section_within", "section_places", "few")
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some, out = batch.slice(at, 512), []
            for page, *lists, few in zip(*(some.column(c).to_pylist() for c in names)):
                root = parse(page or "")
                digest(root)
                host, section = lists[:3], lists[3:]
                out.append(blocks(root, Template(*([*(x or ()), *(y or ())] for x, y in zip(host, section, strict=True)), few is not False)))
            yield pa.record_batch([some.column("rest"), some.column("page"), pa.array(out, pa.list_(pa.string()))], names=["rest", "page", "blocks"])


def _template(counts: DataFrame, by: list[str], prefix: str, limits: tuple[int, float, int, float]) -> DataFrame:
    """by, few, and the subtrees, subtrees within articles and places that are cut. counts: by, kind, digest (null: the pages), n, share.

    At most 1 / share times as many as a page has, for each host or section.
    """
    pages = counts.where("digest is null").select(*by, F.col("n").alias("pages"))
    least, share, own_least, own_share = limits
    often = counts.where(F.col("digest").isNotNull() & (F.col("n") >= min(least, own_least, BESIDE_PAGES))).join(pages, by)
    kind, enough = F.col("kind"), lambda n, s: (F.col("n") >= n) & (F.col("n") >= F.lit(s) * F.col("pages"))
    tests = {
        "subtrees": (kind == 0) & enough(least, share), "within": (kind == 0) & enough(own_least, own_share),
        "places": ((kind == BESIDE) & enough(BESIDE_PAGES, BESIDE_SHARE)) | ((kind == NAMED) & enough(least, share) & (F.col("share") <= MOST * F.col("n"))),
    }
    listed = [F.collect_list(F.when(test, F.col("digest"))).alias(prefix + name) for name, test in tests.items()]
    lists = often.where(reduce(Column.__or__, tests.values())).groupBy(*by).agg(*listed)
    return pages.select(*by, (F.col("pages") < least).alias(prefix + "few")).join(lists, by, "left")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, own_pages: int = OWN_PAGES, own_share: float = OWN_SHARE) -> DataFrame:
    """pages with ``blocks`` added, the text blocks of the main text of each.

    The main text is that of the article elements, else of main elements, else of the whole page,
    without navigation, headers, footers, asides, notices, adverts, forms, scripts, comments of
    readers and the template of the host and its section. A null or empty page has no blocks. Pages
    without a host (null url) are one host. Rows with equal pages of one section count as one page.
    A host with fewer than ``min_pages`` different pages has no template; there, names decide. An
    empty table gives no rows; a column named blocks is replaced, others may have any name.
    """
    bound_batches(pages.sparkSession)
    cols = [c for c in pages.columns if c != "blocks"]
    address = F.coalesce(column(url).cast("string"), F.lit(""))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*/?([^/?#]*)"
    base = pages.select(F.lower(F.regexp_extract(address, pattern, 1)).alias("host"), F.regexp_extract(address, pattern, 2).alias("section"), column(html).cast("string").alias("page"), packed(pages, [c for c in cols if c != html]))
    found = base.select("host", "section", "page").mapInArrow(_subtrees, _FOUND)
    counts = saved(found.distinct().groupBy("host", "section", "kind", "digest").agg(F.count("*").alias("n"), F.sum("share").alias("share")), "subtrees")
    limits = (min_pages, min_share, own_pages, own_share)
    by_host = saved(_template(counts.groupBy("host", "kind", "digest").agg(F.sum("n").alias("n"), F.sum("share").alias("share")), ["host"], "", limits), "template")
    by_section = saved(_template(counts, ["host", "section"], "section_", limits), "template")
    forget(counts)
    out = T.StructType([base.schema["rest"], T.StructField("page", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType()))])
    rows = base.join(by_host, "host", "left").join(by_section, ["host", "section"], "left")
    got = rows.select("page", "rest", *(p + c for p in ("", "section_") for c in ("subtrees", "within", "places")), "few").mapInArrow(_extract, out)
    return got.select(*((F.col("page") if c == html else F.col("rest").getField(c)).alias(c) for c in cols), "blocks")
