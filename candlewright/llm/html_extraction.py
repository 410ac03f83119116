"""Main text of web pages, with the templates of their site removed.

Element subtrees are hashed twice: by the words below them, and, where links hold most of these words, by their
structure, since menus of a site recur in shape but not in words. Both are counted once a page for each host, in
Spark. Before anything else, subtrees that recur on most pages of their host are deleted: by their words
wherever they stand, by their structure outside of articles, where a list of links may be the text. What is left
of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments goes by element
or names. What remains of the article, or of the body where no element is one, is cut into blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_chunks

#: A subtree is template from so many pages of a host on, and from this share of them.
MIN_PAGES, MIN_SHARE = 8, 0.5
#: A subtree of links has at least so many, and this share of its words in them.
MIN_LINKS, LINK_SHARE = 2, 0.5
#: Templates that are broadcast at most; beyond, pages are joined with those of their host.
BROADCAST_ROWS = 100_000
#: Parts that the pages of a host are spread over in that join.
SALTS = 64

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
CLASSES = re.compile(r"""(?:class|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset(("svg", "math"))
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose mtable mtr mtd semantics annotation "
    "svg g text tspan map object canvas".split()
)
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split()
)
#: Opening the first closes an open one of the second, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
DROPPED = RAW | frozenset("head nav footer aside form button select input dialog menu audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = (
    "nav navbar navigation menu submenu header masthead topbar footer bottombar sidebar aside ad ads adv advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager widget widgets toolbar disclaimer alert skip"
).split()
NAMED = re.compile(rf"(?:{'|'.join(NAMES)})|(?:{'|'.join(NAMES)})[-_].*|(?!(?:.*[-_])?(?:with|has|no|without)[-_]).*[-_](?:{'|'.join(NAMES)})", re.IGNORECASE)
#: Names of an article's own head, by which nothing in an article goes.
HEADS = re.compile(r"header|header[-_].*|.*[-_]header", re.IGNORECASE)
#: Never dropped for a name of theirs, for layouts name the page after its sidebar.
SAFE = frozenset("html body main".split())


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parts: list = field(default_factory=list)
    hash: int = 0  # by words
    shape: int = 0  # by structure, of links


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and misnested elements end where their parent does; raw elements stay empty."""
    root = Node("#root")
    stack, at = [root], 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            _close(stack, name)
            continue
        if name in ENDS_P:
            _close_open(stack, {"p"}, {"table", "button", "#root", "div", "article", "section", "li", "td", "blockquote"})
        if name in IMPLIED:
            _close_open(stack, *IMPLIED[name])
        node = Node(name, attributes)
        stack[-1].parts.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
        elif name not in VOID and not (attributes.endswith("/") and (name in FOREIGN or any(n.tag in FOREIGN for n in stack))):
            stack.append(node)  # a slash closes no element of HTML
    return root


def _close(stack: list[Node], name: str) -> None:
    """Closes the nearest open element of this name; an inline one does not reach past a block."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if name in INLINE and stack[i].tag not in INLINE:
            return


def _close_open(stack: list[Node], names: set[str], walls: set[str]) -> None:
    found = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in walls:
            break
        if stack[i].tag in names:
            found = i
    if found:
        del stack[found:]


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        open_ += [p for p in node.parts if isinstance(p, Node)]
    return out


def hashed(root: Node) -> list[Node]:
    """Elements with words below them, their hashes set.

    The hash of words covers names and words, not attributes. The shape covers names, classes and roles of the subtree
    and of what holds it; equal neighbours count as one, so that menus of any length are alike; only subtrees of
    links have one.
    """
    out, sizes, forms, walk = [], {}, {}, _walk(root)
    heads = {id(node): " ".join([node.tag, *CLASSES.findall(node.attributes)]) if node.attributes else node.tag for node in walk}
    places = {id(root): 0}
    for node in walk:
        for p in node.parts:
            if isinstance(p, Node):
                places[id(p)] = xxhash.xxh3_64_intdigest(f"{places[id(node)]} {heads[id(node)]}")
    for node in reversed(walk):
        words, form = [], [heads[id(node)]]
        count = linked = links = 0
        for p in node.parts:
            if isinstance(p, Node):
                words.append(f"<{p.hash}>")
                n, in_links, of_links = sizes.pop(id(p))
                count, linked, links = count + n, linked + in_links, links + of_links
                if n and (own := forms.pop(id(p))) != form[-1]:
                    form.append(own)
            else:
                text = html.unescape(p).split()
                words.append(" ".join(text))
                count += len(text)
        if node.tag == "a":
            linked, links = count, links + 1
        sizes[id(node)] = (count, linked, links)
        if count:
            node.hash = xxhash.xxh3_64_intdigest(f"{node.tag} {' '.join(words)}") >> 1 or 1
            forms[id(node)] = f"({xxhash.xxh3_64_hexdigest(' '.join(form))})"
            if links >= MIN_LINKS and linked >= LINK_SHARE * count:
                node.shape = xxhash.xxh3_64_intdigest(f"shape {places[id(node)]} {' '.join(form)}") >> 1 or 1
            out.append(node)
    return out


def boilerplate(node: Node, in_article: bool, by_name: bool = True) -> bool:
    """Whether the element, by its name, role or, with ``by_name``, names, is not part of the article."""
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    if not node.attributes:
        return False
    said = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(node.attributes)}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.IGNORECASE):
        return True
    if node.tag in SAFE:
        return False
    if said.get("role", "").lower() in ROLES:
        return True
    names = f"{said.get('class', '')} {said.get('id', '')}".split()
    return by_name and any(NAMED.fullmatch(n) and not (in_article and HEADS.fullmatch(n)) for n in names)


def _is_template(node: Node, templates: frozenset[int], in_article: bool) -> bool:
    """Whether the subtree is one of the site's; a word in bold that recurs is not, nor is a whole page."""
    known = node.hash in templates or (not in_article and node.shape in templates)
    return known and node.tag not in INLINE and node.tag not in SAFE


def _is_main(node: Node) -> bool:
    return node.tag == "main" or bool(re.search(r"""role\s*=\s*["']?main\b""", node.attributes, re.IGNORECASE))


def _kept(root: Node, templates: frozenset[int], lists: bool) -> list[Node]:
    """Outermost articles, else main elements, else the whole page, outside of boilerplate and template.

    Names do not drop what holds the main element, nor what holds the article where no other stands outside.
    """
    articles, mains = _tops(root, templates, {"main"}, lists)
    if not articles and not mains:
        articles, mains = _tops(root, templates, {"main", "article"}, lists)
    return articles or mains[:1] or [root]


def _holders(root: Node, tags: set[str]) -> set[int]:
    """Elements that are one of these or have one below them."""
    out: set[int] = set()
    for node in reversed(_walk(root)):
        if node.tag in tags or ("main" in tags and _is_main(node)) or any(isinstance(p, Node) and id(p) in out for p in node.parts):
            out.add(id(node))
    return out


def _tops(root: Node, templates: frozenset[int], spared: set[str], lists: bool) -> tuple[list[Node], list[Node]]:
    """Articles and main elements outside of boilerplate and template; names do not drop what holds one of ``spared``."""
    holders = _holders(root, spared)
    articles, mains, open_ = [], [], [root]
    while open_:
        node = open_.pop()
        if node is not root and ((node.tag != "article" and _is_template(node, templates, False)) or (lists and boilerplate(node, False, id(node) not in holders))):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if _is_main(node):
            mains.append(node)
        open_ += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return articles, mains


def extract(page: str, templates: frozenset[int] = frozenset(), lists: bool = True) -> str:
    """Blocks of the article in page order, joined by a line feed; empty if there is none.

    Without ``lists`` only templates are removed, and what is no text.
    """
    root = parse(page)
    if templates:
        hashed(root)
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            blocks.append(text)

    for top in _kept(root, templates, lists):
        in_article = top.tag == "article"
        open_: list[Node | str | None] = [top]
        while open_:
            part = open_.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                buffer.append(html.unescape(part))
            elif part.tag == "br":
                buffer.append(" ")
            elif part is top or not (_is_template(part, templates, in_article) or (part.tag in DROPPED and part.tag in RAW) or (lists and boilerplate(part, in_article))):
                block = part.tag not in INLINE
                if block:
                    flush()
                    open_.append(None)
                open_ += reversed(part.parts)
            elif part.tag not in INLINE:
                flush()
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host of a URL in small letters, without port; an empty string where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of subtrees on at least ``min_pages`` pages and ``min_share`` of all pages of their host.

    Copies of a page are one page, in the share too. Only pages that have copies are dealt out for that.
    A host has at most 1/min_share times as many as one of its pages has elements. Tasks add up counts
    before the shuffle; the count of pages stands under hash 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], ["host", "hash", "n"]
            )

        for chunk in text_chunks(batches, "html"):
            for host, page in zip(chunk.column("host").to_pylist(), chunk.column("html").to_pylist(), strict=True):
                counts[host, 0] += 1
                nodes = [node for node in hashed(parse(page or "")) if node.tag != "#root" and node.tag not in INLINE]
                counts.update({(host, h) for node in nodes for h in (node.hash, node.shape) if h})
            if len(counts) > 200_000:
                yield rows()
                counts.clear()
        yield rows()

    named = pages.select(host_of(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("page"))
    copied = stored(named.groupBy("host", "page").count().where("count > 1").select("host", "page"))
    known = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    once = named.join(known, ["host", "page"], "left_anti").union(named.join(known, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]))
    seen = once.select("host", "html").mapInArrow(run, "host string, hash long, n long")
    counted = stored(seen.groupBy("host", "hash").agg(F.sum("n").alias("n")).where((F.col("n") >= min_pages) | (F.col("hash") == 0)))
    total = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    return counted.where("hash <> 0").join(total, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "hash")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of each page of (page_id, url, html).

    Null and empty pages have an empty text. Pages without a host share one. Repeated rows count as one page
    and are extracted alike; whole pages are read however long; an empty table gives an empty result; other columns
    are not looked at. ``lists`` as in extract.
    """
    templates = stored(site_templates(pages, min_pages, min_share).groupBy("host").agg(F.collect_set("hash").alias("hashes")))
    size = templates.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    known = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if size <= BROADCAST_ROWS:
        joined = known.join(F.broadcast(templates), "host", "left")
    else:  # a host may have a third of all pages: its pages are dealt to SALTS parts, and its templates copied to each
        dealt = known.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        copies = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = dealt.join(copies, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "html"):
            texts = [extract(page or "", frozenset(known or ()), lists) for page, known in zip(chunk.column("html").to_pylist(), chunk.column("hashes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("page_id"), chunk.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    out = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "hashes")
    return out.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
