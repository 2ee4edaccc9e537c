"""Main text of pages by site style trees.

The pages of a host are merged into a tree. A node is an element's place: the path of steps from the root, a step
being the tag, its class and how many siblings with the same tag and class stand before it. Each page adds to a node
its presentation (the sequence of its child elements) and its content (all text below it, built up from its children).
A node whose pages all look and read alike has an entropy near zero and is of low importance: a branch that starts
there is template and goes, wherever it stands, inside an article too.

HTML's own elements for menus, footers, asides and forms, hidden elements and those that their class or role names as
boilerplate go by their meaning, as their words may differ from page to page. Running text that stands directly in an
``article`` or ``main`` (paragraphs, headings, lists, tables with no ``div`` or the like between) is never template.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

#: Branches below this importance go, where at least so many different pages have the node.
IMPORTANCE, MIN_PAGES = 0.4, 5
#: Weight of content against presentation.
CONTENT_SHARE = 0.9
#: The share of a page's text from which on an article, or what is in ``main``, is taken to be all of its main text.
ROOT_SHARE = 0.5

#: Comments and the like, or a tag: end mark, name, attributes. Quotes count after an equals sign only, as browsers
#: have it. Every alternative takes what it scanned, so a page is read once.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)(>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_WHITE = re.compile(r"[ \t\n\r\f\v]+")
_SPACES = " \t\n\r\f\v"
#: Elements whose text is never read, that have no end tag, that start a block, that are no content.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form menu button select option dialog svg canvas object audio video map head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: directly in an article they are content by their meaning.
RUNNING = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
ROOTS = frozenset("html body article main".split())
#: Words that name boilerplate, and words that only say what kind of box an element is.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertising adsbygoogle adsense banner promo promotion sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus respond reply replies share sharing social related recommended widget pagination pager toolbar copyright legal skip search contentinfo complementary".split())
#: Those of them that name what readers wrote; those that may name what a header or a line of running text is about.
READERS, TOPICS = frozenset("comment comments disqus respond reply replies".split()), frozenset("legal search".split())
BOX_WORDS = frozenset("area articles bar block bottom box buttons card container content form group inner item items left link links list main news outer page panel post posts right row section site slot stories thread title top unit user users visitor visitors reader readers wrap wrapper".split())
#: A start of one of these ends an open paragraph.
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
#: Start tags that end open elements of the same group.
_CELLS = frozenset(("td", "th"))
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}, **dict.fromkeys(("tbody", "thead", "tfoot"), _CELLS | {"tr", "tbody", "thead", "tfoot"}), "option": {"option"}}


def _names_boilerplate(value: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role has a name all of whose parts are boilerplate words or words for boxes, with at
    least one of the former that is in ``words``: ``ad``, ``cookie-notice`` and ``related-posts`` do, ``related-work``
    does not."""
    for name in value.lower().split():
        parts = [p for p in re.split("[^a-z0-9]+", name) if p and not p.isdigit()]
        named = [p for p in parts if p in words]
        if named and all(p in NOT_CONTENT or p in BOX_WORDS for p in parts):
            return True
    return False


def _judge_markup(tag: str, attributes: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is boilerplate by its meaning; its class, for the step. Inside an article a header is a title,
    running text may be about legal matters, and an id may name a part of the text: there ids are evidence on plain boxes,
    on sections only of readers' comments."""
    label = ""
    words = NOT_CONTENT if not inside_article else NOT_CONTENT - {"header"} - (TOPICS if tag in RUNNING and tag not in ("ul", "ol", "dl", "table") else frozenset())
    unwanted = tag in DROPPED or (tag == "header" and not inside_article)
    if attributes and not unwanted and _TELLING.search(attributes):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "class":
                label = label or " ".join(value.split())
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                return True, label
            telling = words if name in ("class", "role") or (name == "id" and (not inside_article or tag in ("div", "ul", "ol"))) else READERS if name == "id" and tag == "section" else None
            if telling and tag not in ROOTS and _names_boilerplate(value, telling):
                return True, label
    return unwanted, label


@dataclass
class Page:
    """What a page holds: its text blocks (text, node, whether a heading) and its nodes, parents before children."""

    blocks: list[tuple[str, int, bool]] = field(default_factory=list)
    name: list[int] = field(default_factory=list)  # a hash of the path
    parent: list[int] = field(default_factory=list)
    content: list[int] = field(default_factory=list)
    style: list[int] = field(default_factory=list)
    fixed: list[bool] = field(default_factory=list)  # never template
    root: list[int] = field(default_factory=list)  # 2 in an article, 1 in main, 0 elsewhere


_MASK = (1 << 64) - 1
_K = 0x9E3779B97F4A7C15


def parse(text: str) -> Page:
    """Reads a page as browsers do: end tags close what is open above them, a start of a block ends a paragraph, a
    tag that the page's end cuts off is no text. Linear in the page: open elements are found by tables of their
    places, never by walks over the stack."""
    from xxhash import xxh64_intdigest as h

    page = Page()
    blocks, name, parent, content, style, fixed, root = page.blocks, page.name, page.parent, page.content, page.style, page.fixed, page.root
    seen: list[dict[str, int]] = []  # per node: children so far, by step

    def node(above: int, step: str, is_fixed: bool, kind: int) -> int:
        if above >= 0:
            turn = seen[above].get(step, 0)
            seen[above][step] = turn + 1
            value = h(f"{name[above]}/{step}/{turn}")
            style[above] = (style[above] * _K + h(step)) & _MASK
        else:
            value = h(step)
        name.append(value), parent.append(above), content.append(0), style.append(1), fixed.append(is_fixed), root.append(kind), seen.append({})
        return len(name) - 1

    here = node(-1, "", True, 0)
    stack: list[tuple[str, int, bool, int]] = []  # tag, node, dropped, root kind
    opened: dict[str, list[int]] = {}  # places on the stack, by tag
    special: list[int] = []  # places of blocks other than p, div, address
    blocky: list[int] = []  # places of all blocks
    dropped, kind = False, 0
    buffer: list[str] = []
    heading = 0

    def flush():
        if buffer:
            found = _WHITE.sub(" ", html.unescape("".join(buffer))).strip(_SPACES)
            if found:
                blocks.append((found, here, heading > 0))
                content[here] = (content[here] * _K + h(found)) & _MASK
            buffer.clear()

    def close(to: int):
        nonlocal here, dropped, kind, heading
        if blocky and blocky[-1] >= to:
            flush()
        while len(stack) > to:
            tag, at, _, _ = stack.pop()
            opened[tag].pop()
            place = len(stack)
            if special and special[-1] == place:
                special.pop()
            if blocky and blocky[-1] == place:
                blocky.pop()
            heading -= tag in HEADINGS
            below = stack[-1][1] if stack else 0
            if at != below:  # its text is its parent's too
                content[below] = (content[below] * _K + content[at]) & _MASK
        here, dropped, kind = stack[-1][1:] if stack else (0, False, 0)

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            if not dropped:
                buffer.append(text[at:])
            break
        if m.start() > at and not dropped:
            buffer.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or not m[4]:
            continue
        tag = tag.lower()
        if m[1]:  # end
            if tag == "br" and not dropped:
                buffer.append(" ")
            places = opened.get(tag)
            if not places:
                if tag == "p" and not dropped:
                    flush()
                continue
            to = places[-1]
            if tag not in BLOCK and blocky and blocky[-1] > to and not (stack[to][2] and not (to and stack[to - 1][2])):
                continue  # an inline element ends above an open block: nothing to do but for one that was left out
            close(to)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if not dropped:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    buffer.append(" ")
            continue
        if tag in CLOSES_P and (places := opened.get("p")) and (not special or places[-1] > special[-1]):
            close(places[-1])
        ends = _SIBLINGS.get(tag)
        if ends:
            while special and stack[special[-1]][0] in ends:
                close(special[-1])
        is_block = tag in BLOCK
        if is_block:
            flush()
        elif m[3].endswith("/") and tag in ("path", "circle", "rect", "use", "line", "polygon"):
            continue  # ends itself
        unwanted, label = (False, "") if dropped else _judge_markup(tag, m[3], kind > 0)
        if unwanted:
            flush()
        own = here
        inside = 2 if tag == "article" else max(kind, 1) if tag == "main" else kind
        if not dropped and not unwanted and is_block:
            own = node(here, f"{tag}.{label}" if label else tag, tag in ROOTS or (tag in RUNNING and kind > 0 and fixed[here]), inside)
        elif unwanted and is_block:  # in its parent's presentation all the same
            style[here] = (style[here] * _K + h(tag)) & _MASK
        place = len(stack)
        stack.append((tag, own, dropped or unwanted, inside))
        opened.setdefault(tag, []).append(place)
        if is_block:
            blocky.append(place)
            if tag not in ("p", "div", "address"):
                special.append(place)
        heading += tag in HEADINGS
        here, dropped, kind = own, dropped or unwanted, inside
    flush()
    close(0)
    return page


def main_blocks(text: str | None, low: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """A page's blocks without those below a node in ``low`` (path hashes, as signed longs). If that leaves nothing
    but headings, all of the page is alike over the host and nothing is taken for template. Of what is left, the
    articles' blocks if they are at least ROOT_SHARE of the text, else those in ``main`` on the same terms, else all."""
    page = parse(text or "")
    left = page.blocks
    if low:
        gone: list[bool] = []
        for name, parent, fixed in zip(page.name, page.parent, page.fixed):
            gone.append(parent >= 0 and gone[parent] or (not fixed and name - (1 << 63) in low))
        left = [b for b in page.blocks if not gone[b[1]]]
        if all(heading for _, _, heading in left):
            left = page.blocks
    size = sum(len(t) for t, _, _ in left)
    for kind in (2, 1):
        inside = [b for b in left if page.root[b[1]] >= kind]
        if inside and sum(len(t) for t, _, _ in inside) >= ROOT_SHARE * size:
            return [t for t, _, _ in inside]
    return [t for t, _, _ in left]


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[^/?#]*://([^/?#]*)", 1))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, parent, pages, importance, fixed): the merged tree of each host, over all its pages.

    A node's ``pages`` are the different pages that have it; copies of a page say nothing about a template and count
    once. With m pages, the importance of a node is the entropy of its contents and of its presentations over them,
    to the base m, weighted by CONTENT_SHARE. Running text directly in an article has no node of its own; it is
    content of the element around it. A page sends one row for each node; rows are added up before each shuffle, so a
    host's size costs no task."""

    def judge():
        def one(texts):
            rows = []
            for text in texts:
                page = parse(text or "")
                whole = page.content[0] - (1 << 63)
                found = [
                    {"node": v - (1 << 63), "parent": page.name[p] - (1 << 63), "content": c - (1 << 63), "style": s - (1 << 63), "fixed": f, "page": whole}
                    for v, p, c, s, f, k in zip(page.name, page.parent, page.content, page.style, page.fixed, page.root)
                    if p >= 0 and not (f and k and page.root[p] and page.fixed[p])
                ]
                rows.append((found,))
            return rows

        return one

    source = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("text")).where("host <> ''")
    seen = map_texts(source, "nodes array<struct<node:bigint,parent:bigint,content:bigint,style:bigint,fixed:boolean,page:bigint>>", judge, keep=("host",))
    rows = seen.select("host", F.explode("nodes").alias("x")).select("host", "x.*").distinct()
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("style").alias("value")))
    # All rows of a node agree on its parent and on whether it is fixed: both follow from the path.
    keys = ["host", "node", "parent", "fixed"]
    counts = rows.select(*keys, F.explode(kinds).alias("x")).groupBy(*keys, "x.kind", "x.value").agg(F.count("*").alias("n"))
    parts = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("content"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("style"),
    )
    size = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    reads, looks = (1 - F.col(x) / F.col("pages") / size for x in ("content", "style"))
    return parts.select("host", "node", "parent", "pages", (CONTENT_SHARE * reads + (1 - CONTENT_SHARE) * looks).alias("importance"), "fixed")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", importance: float = IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars: the main text, its blocks joined by an empty line.

    Branches of low importance in the host's style tree go from each page, wherever they stand; on hosts with fewer
    than ``min_pages`` different pages at a node, only markup decides. A null page has an empty text, so has one
    without content; a null url has no host and no tree. Pages of any length and depth are taken whole, in time
    linear in their length. Repeated rows each give a row; a null id is kept; other columns are ignored; an empty
    table gives no rows. A host may have any share of the pages: its low nodes, few, are joined to its pages, and a
    skewed join is split."""
    low = style_tree(pages, url_col, html_col).where((F.col("pages") >= min_pages) & (F.col("importance") < importance) & ~F.col("fixed")).groupBy("host").agg(F.collect_set("node").alias("low"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"), host_of(url_col).alias("host"))
    joined = rows.join(stored(low), "host", "left").select("page_id", "url", F.struct("text", "low").alias("page"))

    def judge():
        def one(found):
            out = []
            for page in found:
                text = "\n\n".join(main_blocks(page["text"], set(page["low"] or ())))
                out.append((text, len(text)))
            return out

        return one

    return map_texts(joined, "text string, n_chars long", judge, keep=("page_id", "url"), text="page")
