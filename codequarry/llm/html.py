"""Main text of web pages, without what a site repeats on its pages.

Every element box (a container such as a div, list or section, not a paragraph
of prose) is hashed with all it holds. Spark counts, per host, on how many
different articles' pages each box occurs, and boxes on many of them are
templates, which are deleted. Copies of one article count once, so an article
is no template of its own copies. From the rest, the main element is taken, less
the parts that are by name or role no article text. A name tells nothing about the
page, an article, a main or an inline element, nor about a box that holds the main
element or most of the page's paragraph text: sites name their frames after what
else is in them. A form is dropped unless it is such a frame.

Where an element, role or name tells the main element, pages are different
articles if it differs, and it and the boxes that hold it are not counted. Where
nothing tells it, all boxes are counted, each over the different texts outside
of it: those differ around a template and agree around copies of an article. There
the main element is the box with most paragraph text among what is left, and its
siblings with paragraphs belong to it. Copies of such an article between varying
frames are not told from templates.

A host's templates are at most containers per page / ``share``, so the set that
joins its pages is bounded. Counts are pre-aggregated; the join on hosts is an
outer join from the pages, which adaptive execution splits for a hot host.

Defined results: null, blank and tag-less html is read as text of one page; pages
of templates only keep them; pages without text give an empty string; a null or hostless url has no templates;
repeated rows stay; unknown and unclosed tags are tolerated at any depth. Parsing and
extraction take time in proportion to the page, whatever its nesting.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm import kernels
from codequarry.llm.shared import free_name, schema_with, with_column, written

# Names of the HTML standard and names that sites use for what is no article text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math select object canvas".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_BOXES = frozenset("div section aside nav header footer ul ol dl table form figure details main article blockquote".split())
_DROPPED = frozenset("head nav header footer aside form button dialog menu label fieldset video audio map".split()) | _RAW
_OFF_PAGE = _DROPPED - {"form"}
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPES = frozenset("table ul ol dl select body html article div section".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner\w*|promo\w*|sponsor\w*|sidebar\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|"
    r"masthead|cookies?|consent|notices?|notification\w*|alerts?|popup|modal|newsletter|subscri\w+|signup|share|sharing|"
    r"social|related|recommend\w*|widgets?|toolbar|pager|pagination|login|search\w*|"
    r"skip|hidden|gdpr|paywall)(?:$|[\s_-])", re.I,
)
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|repl(?:y|ies))(?:$|[\s_-])", re.I)
#: Elements about which a name tells nothing.
_UNNAMED = frozenset(("", "html", "body", "article", "main")) | _INLINE
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main)(?:$|[\s_-]|-?body)", re.I)

_MARKUP = re.compile(r"<!--|<[!?]|</?[A-Za-z]")
_STOP = re.compile("[>\"']")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)


class Node:
    __slots__ = ("attributes", "children", "digest", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], b""

    def off_page(self) -> bool:
        """No article text by element, role or style."""
        a = self.attributes
        return self.tag in _OFF_PAGE or bool(a) and (
            a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            or "display:none" in a.get("style", "").replace(" ", "").lower()
        )

    def names(self) -> str:
        return f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"

    def of_readers(self) -> bool:
        return bool(self.attributes) and self.tag not in _UNNAMED and bool(_READERS.search(self.names()))

    def aside(self) -> bool:
        """No article text by name, or a form."""
        return self.tag == "form" or bool(self.attributes) and self.tag not in _UNNAMED and bool(_NAMES.search(self.names()))

    def may_be_main(self) -> bool:
        a = self.attributes
        return a.get("role") == "main" or a.get("itemprop") == "articleBody" or bool(
            self.tag in _BOXES and _MAIN.search(f"{a.get('class', '')} {a.get('id', '')}"))


def _tag_end(source: str, at: int, last: int) -> int:
    """End of the tag that begins at ``at``, ``>`` in quotes left out; -1 if no ``>`` follows, ``last`` being the last one."""
    if at > last:
        return -1
    place = at
    while stop := _STOP.search(source, place):
        if stop[0] == ">":
            return stop.end()
        close = source.find(stop[0], stop.end())
        # A quote without its partner is a plain character.
        place = close + 1 if close >= 0 else stop.end()
    return source.find(">", at) + 1


class _Open:
    """The open elements, where each name and the nearest scope lie among them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def close(self, name: str, scoped: bool = False) -> None:
        """Close the last open element ``name`` and all in it; with ``scoped`` not across a scope."""
        places = self.places.get(name)
        if not places or scoped and self.scopes and self.scopes[-1] > places[-1]:
            return
        to = places[-1]
        while len(self.stack) > to:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in _SCOPES:
                self.scopes.pop()


def parse(source: str) -> Node:
    """Tree of elements and decoded texts; raw elements keep no text."""
    root = Node("", {})
    opened, at, last = _Open(root), 0, source.rfind(">")

    while at < len(source):
        match = _MARKUP.search(source, at)
        tag = _TAG.match(source, match.start()) if match and match[0][-1] not in "-!?" else None
        if tag and (end := _tag_end(source, tag.end(), last)) < 0:
            # No tag is closed from here on; a declaration or comment would reach to the end.
            tag, match = None, re.compile("<[!?]").search(source, match.start())
        text = source[at : match.start() if match else len(source)]
        if text:
            opened.stack[-1].children.append(html.unescape(text))
        if not match:
            break
        if not tag:
            mark = "-->" if source.startswith("<!--", match.start()) else ">"
            found = source.find(mark, match.start() + (4 if mark == "-->" else 2))
            at = found + len(mark) if found >= 0 else len(source)
            continue
        at = end
        name = tag[2].lower()
        if tag[1]:
            opened.close(name)
            continue
        inside = source[tag.end() : end]
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(inside)}
        if name in _CLOSES_P:
            opened.close("p", True)
        for sibling in _SIBLINGS.get(name, ()):
            opened.close(sibling, True)
        node = Node(name, attributes)
        opened.stack[-1].children.append(node)
        if name in _RAW:
            closing = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(source, at)
            at = closing.end() if closing else len(source)
        elif name not in _VOID and not inside.endswith("/>"):
            opened.push(node)
    return root


def nodes(root: Node, kept=None) -> Iterator[Node]:
    """All elements below ``root``, parents first; ``kept`` says which to go into."""
    pending = [root]
    while pending:
        node = pending.pop()
        yield node
        pending += [c for c in reversed(node.children) if isinstance(c, Node) and (kept is None or kept(c))]


def hash_subtrees(root: Node) -> None:
    """Digest of every element from its tag, its attributes and all that it holds, children first."""
    for node in reversed(list(nodes(root))):
        parts = [node.tag, node.attributes.get("class", ""), node.attributes.get("id", "")]
        parts += [c.digest.hex() if isinstance(c, Node) else f"={' '.join(c.split())}" for c in node.children]
        node.digest = blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest()


def blocks(root: Node, kept) -> list[str]:
    """Texts of the blocks in page order, white space made single spaces."""
    found, piece = [], []

    def end() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            found.append(text)

    pending: list = [root]
    while pending:
        item = pending.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            piece.append(item)
        elif item.tag == "br":
            piece.append(" ")
        elif item is root or kept(item):
            inline = item.tag in _INLINE
            if not inline:
                end()
                pending.append(None)
            pending += reversed(item.children)
    end()
    return found


class Page:
    """A parsed page with sizes of what each element holds, counted once."""

    def __init__(self, root: Node):
        self.root, self.every = root, list(nodes(root))
        self.above = {id(c): n for n in self.every for c in n.children if isinstance(c, Node)}
        self.off = {id(n) for n in self.every if n.off_page()}
        self.dropped = self.off | {id(n) for n in self.every if n.of_readers()}
        self.asides = {id(n) for n in self.every if n.aside()}
        prose = self.sizes(lambda node: id(node) not in self.dropped, "p")
        self.frames = {id(n) for n in self.every if prose[id(n)] * 2 > prose[id(root)]}

    def sizes(self, kept, within: str = "") -> dict[int, int]:
        """Characters that each element holds in parts that are kept, of those in elements ``within`` if given."""
        total: dict[int, int] = {}
        for node in reversed(self.every):
            if node is not self.root and not kept(node):
                total[id(node)] = 0
            elif within and node.tag != within:
                total[id(node)] = sum(total[id(c)] for c in node.children if isinstance(c, Node))
            else:
                own = total if not within else self._plain
                total[id(node)] = sum(own[id(c)] if isinstance(c, Node) else len(c.strip()) for c in node.children)
        return total

    @cached_property
    def _plain(self) -> dict[int, int]:
        return self.sizes(lambda node: True)

    def kept(self, node: Node) -> bool:
        """Whether an element may hold article text."""
        return id(node) not in self.dropped and (id(node) not in self.asides or id(node) in self.frames)

    def ancestors(self, node: Node) -> Iterator[Node]:
        while (node := self.above.get(id(node))) is not None:
            yield node

    def main(self, deleted: set[int] = frozenset()) -> tuple[Node, bool]:
        """The article, and whether it is told: by element, else by role or name; else the box with most paragraph text, else the page."""
        by_name = lambda node: id(node) not in deleted and self.kept(node)
        by_kind = lambda node: id(node) not in deleted and id(node) not in self.off
        for kept in (by_name, by_kind):
            size = self.sizes(kept)
            reached = list(nodes(self.root, kept))
            tests = (lambda n: n.tag == "article", lambda n: n.tag == "main", Node.may_be_main)
            # Frames' names tell nothing, so an article or main element in them is told all the same.
            for test in tests if kept is by_name else tests[:2]:
                chosen = [n for n in reached if test(n) and size[id(n)]]
                if chosen:
                    best = max(chosen, key=lambda n: size[id(n)])
                    self.frames |= {id(n) for n in self.ancestors(best)}
                    return best, True
        size = self.sizes(by_name)
        reached = list(nodes(self.root, by_name))
        direct = lambda n: sum(size[id(c)] for c in n.children if isinstance(c, Node) and c.tag == "p")
        most = max(reached, key=direct)
        if not direct(most) or most is self.root:
            return self.root, False
        prose = self.sizes(by_name, "p")
        around = self.above[id(most)]
        several = sum(bool(prose[id(c)]) for c in around.children if isinstance(c, Node)) > 1
        return around if several else most, False


def texts_outside(root: Node, boxes: list[Node]) -> dict[int, int]:
    """For each box by its id, and for the page, a hash of the texts that are outside of it."""
    inside: dict[int, int] = {}
    for node in reversed(list(nodes(root))):
        total = 0
        for child in node.children:
            if isinstance(child, Node):
                total += inside[id(child)]
            elif text := " ".join(child.split()):
                total += int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
        inside[id(node)] = total
    return {id(n): (inside[id(root)] - inside[id(n)]) % (1 << 64) for n in boxes} | {0: inside[id(root)] % (1 << 64)}


def page_parts(source: str | None) -> tuple[Page, Node, bool, list[Node]]:
    """Page, main element, whether it is told, and the boxes that may be templates: all, or those that neither are nor hold a told one."""
    root = parse(source or "")
    hash_subtrees(root)
    page = Page(root)
    main, told = page.main()
    exempt = {id(main), *(id(n) for n in page.ancestors(main))} if told else ()
    return page, main, told, [n for n in page.every if n.tag in _BOXES and id(n) not in exempt]


def extract(source: str | None, templates: set[bytes]) -> str:
    """Main text of a page without its boxes among ``templates``."""
    page, main, told, boxes = page_parts(source)
    deleted = {id(n) for n in boxes if n.digest in templates}
    kept = lambda node: id(node) not in deleted and page.kept(node)
    if not told and deleted:
        left = "\n".join(blocks(page.main(deleted)[0], kept))
        return left or "\n".join(blocks(main, page.kept))
    return "\n".join(blocks(main, kept))


def _host(url: str):
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def site_templates(pages: DataFrame, url: str = "url", source: str = "html", share: float = 0.05, least: int = 5) -> DataFrame:
    """One row per host with templates: host, array of subtree hashes on at least ``least`` and ``share`` of its articles."""

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 1):
            rows = []
            for host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, main, told, found = page_parts(text)
                if told:
                    rows += [(host, digest, main.digest) for digest in {b"", *(n.digest for n in found)}]
                    continue
                outside = texts_outside(page.root, found)
                seen_by = {(n.digest, outside[id(n)]) for n in found} | {(b"", outside[0])}
                rows += [(host, digest, around.to_bytes(8)) for digest, around in seen_by]
            hosts, subtrees, mains = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(subtrees, pa.binary()), pa.array(mains, pa.binary())],
                names=["host", "subtree", "main"])

    rows = pages.select(_host(url).alias("host"), F.col(source).alias("html")).where("host is not null")
    seen = rows.mapInArrow(boxes, "host string, subtree binary, main binary").distinct()
    # The empty subtree is on every page and counts a host's articles.
    counts = written(seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    articles = counts.where("subtree = x''").select("host", F.col("n").alias("articles"))
    many = counts.where("subtree <> x''").join(articles, "host").where(F.col("n") >= F.col("articles") * share)
    return many.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def with_main_text(pages: DataFrame, name: str = "text", url: str = "url", source: str = "html", **counts) -> DataFrame:
    """``pages`` with their main text as a further column."""
    taken = [*pages.columns, name]
    host, known, listed = (free_name(taken, n) for n in ("host", "template_host", "templates"))
    sites = written(site_templates(pages, url, source, **counts))
    sites = sites.select(F.col("host").alias(known), F.col("templates").alias(listed))
    joined = pages.withColumn(host, _host(url))
    joined = joined.join(sites, F.col(host) == F.col(known), "left").select(*pages.columns, listed)
    at = pages.columns.index(source)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, at):
            rows = zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            found = pa.array([extract(page, set(sets or ())) for page, sets in rows], pa.string())
            yield with_column(batch.select(range(batch.num_columns - 1)), name, found)

    return joined.mapInArrow(texts, schema_with(pages, name, "string"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    texts = with_main_text(pages.select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
