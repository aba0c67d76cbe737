"""HTML main text with site template removal.

1. Every page is cut into its element subtrees, those inside articles as well; a subtree of some text gets a hash of its
   tags and folded text. Inside an article only boxes (``BOXES``: divisions, sections, lists, tables, figures) of
   ``INSIDE_CHARS`` or more that hold at most half of its text count: a paragraph that many articles share, such as a
   licence line or a quotation, is their own wording. The outermost subtrees beside the article get a second hash, of their
   skeleton: tags, class words, the skeletons of their children (equal neighbours once) and the share of linked text, but no
   wording, so menus, adverts and footers whose words change from page to page recur as well. On pages without an article
   only subtrees of mostly linked text have one that counts. Per host Spark counts the pages that hold each hash; pages
   (inside articles: articles) that are copies count once, so that an article published many times is no template.
2. Hashes on many pages of their host are template: ``min_pages``, whatever the size of the host; half of the pages, but
   ``SMALL_HOST`` at least, if that is less. They go back to the pages that hold them, and the extraction leaves out those subtrees.
3. What is left of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments goes by tag,
   role and class. Inside an article its own header, figures, paragraphs, captions and labels stay; there a class says so
   only as a whole word (or the last part of one) on a box, and classes for links and sharing decide nothing: such boxes go
   only where they recur. If a page has a main element, its text is that of these elements; else that of its articles, but
   for those less than half as long as the longest (teasers); else that of the body. ``lists=False`` leaves this step out, to
   see what the counts alone remove.

Reading and walking a page take time in proportion to its length, and no depth of nesting is too deep.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are tolerated, ``p`` and ``li`` close by
themselves; a tag without an end closes at the next ``>``, and without one it is dropped with the rest of the page;
repeated rows are separate rows but one page_id counts once per hash; a null url is a host of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import row_blocks, table, written

# HTML's elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
SKIP = RAW | frozenset("head nav footer aside form button select option dialog menu object video audio canvas".split())
BLOCK = frozenset(
    "address article blockquote body br caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html label legend li main ol p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
BOXES = frozenset("div section ul ol dl table details figure blockquote address header".split())
LISTED = (BOXES - frozenset("figure blockquote address header".split())) | {"article", "span"}  # what a class can remove inside an article
#: An opening tag closes open elements of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "summary", "caption", "label", "legend"} | frozenset("nav footer aside form".split())
SCOPES = frozenset("article main div section ul ol table dl body select td".split())  # what an opening tag does not close beyond
PAGE_PARTS = frozenset("article main body".split())  # what the stray end of an inline element does not close
INLINE = frozenset("b i em strong span a p li".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WITHIN = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|nav\w*|menu\w*|breadcrumbs?"
    r"|sidebar|widget|footer|comments?|commentlist|disqus|reply|replies|login|signup|toolbar|pagination|pager"
)
AROUND = WITHIN + r"|header|masthead|share|sharing|social|related|recommended|skip\w*"
BOILER = {True: re.compile(rf"(?:^|[\s_-])(?:{WITHIN})(?:$|\s)"), False: re.compile(rf"(?:^|[\s_-])(?:{AROUND})(?:$|[\s_-])")}
START = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*+))")
TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTR = re.compile(r"([A-Za-z-]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAIN_ROLE = re.compile(r"role\s*+=\s*+[\"']?(?:main|article)\b")
END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HUGE_REFERENCE = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{7,});?")


INSIDE_CHARS = 20  # inside an article, shorter subtrees are never template
BLOCK_CHARS = 4_000_000
SMALL_HOST = 3  # on hosts of fewer than 2 x min_pages pages, half of the pages and this many are many


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    skip: bool = False
    main: bool = False
    parts: list = field(default_factory=list)  # strings and nodes, in page order
    words: str = ""  # its class words, sorted
    hash: bytes = b""
    chars: int = 0
    linked: int = 0  # characters of its text inside links
    skeleton: bytes = b""


def _is_boiler(tag: str, attrs: str, inside: bool) -> bool:
    if tag in SKIP or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main") or (tag == "article" and not inside):
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and (not inside or tag in LISTED) and BOILER[inside].search(value):
            return True
    return False


def _class_words(attrs: str) -> str:
    """The class words of a tag, sorted; numbers in them are left out, as they tell copies of a box apart."""
    for m in ATTR.finditer(attrs):
        if m[1].lower() == "class":
            return " ".join(sorted({re.sub("[0-9]+", "", w) for w in (m[2] or m[3] or m[4] or "").lower().split()}))
    return ""


class _Open:
    """The open elements, and where each kind of them was opened last."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.parts: list[int] = [0]
        self.mains = 0

    def push(self, node: Node) -> None:
        place = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(place)
        if node.tag in SCOPES:
            self.scopes.append(place)
        if node.tag in PAGE_PARTS:
            self.parts.append(place)
        self.mains += node.main

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in SCOPES:
                self.scopes.pop()
            if node.tag in PAGE_PARTS:
                self.parts.pop()
            self.mains -= node.main

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, 0 without one."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)


def parse(page: str) -> Node:
    """A tree of elements; raw elements (scripts and the like) are dropped with their content."""
    root = Node("#root")
    open_, at, unquoted = _Open(root), 0, 0
    while p := START.search(page, at):
        if p.start() > at:
            open_.stack[-1].parts.append(page[at : p.start()])
        if p[0] == "<!--":
            at = end if (end := page.find("-->", p.end()) + 3) > 2 else len(page)
            continue
        # A quote that nothing ends: up to it, quotes are not looked at again.
        stop = p.end()
        if p[2] and stop >= unquoted:
            stop = TAG_END.match(page, stop).end()
            if page[stop : stop + 1] != ">":
                unquoted, stop = stop, p.end()
        stop = page.find(">", stop)
        if stop < 0:
            return root
        at = stop + 1
        if not p[2]:
            continue
        tag, attrs = p[2].lower(), page[p.end() : stop]
        if p[1]:
            place = open_.last(tag)
            if tag == "p" and not place:
                open_.stack[-1].parts.append(Node("br"))
            if place and not (tag in INLINE and open_.parts[-1] > place):
                open_.close(place)
        elif tag in RAW:
            end = END_RAW[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            if not at:
                return root
        elif tag in VOID:
            if tag in BLOCK:
                open_.stack[-1].parts.append(Node("br"))
        else:
            place = open_.last(*CLOSES.get(tag, ()), *(("p",) if tag in CLOSES_P else ()))
            if place and place >= open_.scopes[-1]:
                open_.close(place)
            main = tag in ("article", "main") or bool(MAIN_ROLE.search(attrs))
            node = Node(tag, _is_boiler(tag, attrs, open_.mains > 0), main, words=_class_words(attrs) if "class" in attrs.lower() else "")
            open_.stack[-1].parts.append(node)
            if not attrs.rstrip().endswith("/"):
                open_.push(node)
    if at < len(page):
        open_.stack[-1].parts.append(page[at:])
    return root


def digest(root: Node) -> tuple[list[tuple[Node, Node | None]], list[Node]]:
    """Sets the hashes and text lengths of every node; returns those without an article below, each with the outermost
    article around it (or itself), and those whose skeleton counts."""
    order: list[tuple[Node, Node | None]] = [(root, root if root.main else None)]
    for node, article in order:
        order.extend((x, article or (x if x.main else None)) for x in node.parts if isinstance(x, Node))
    holds_main: set[int] = set()
    for node, _ in reversed(order):
        h, n, main = xxhash.xxh3_64(node.tag.encode()), 0, node.main
        bones, last, linked = xxhash.xxh3_64(f"{node.tag} {node.words}".encode()), b"", 0
        for part in node.parts:
            if isinstance(part, str):
                text = " ".join(part.split())
                n += len(text)
                h.update(text.encode("utf-8", "surrogatepass") + b"\0")
            else:
                h.update(part.hash + b"\1")
                n, main, linked = n + part.chars, main or id(part) in holds_main, linked + part.linked
                if part.skeleton != last:
                    bones.update(part.skeleton)
                    last = part.skeleton
        node.hash, node.chars, node.linked = h.digest(), n, n if node.tag == "a" else linked
        bones.update(bytes([4 * node.linked // max(n, 1)]))
        node.skeleton = bones.digest()
        if main:
            holds_main.add(id(node))
    return [(node, article) for node, article in order if article or id(node) not in holds_main], _beside(root, holds_main)


def _beside(root: Node, holds_main: set[int]) -> list[Node]:
    """The outermost elements with some text that hold no article: the frame of a page that has one. Without an article,
    elements of mostly linked text that hold less than half of the page's."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        for part in node.parts:
            if not isinstance(part, Node) or part.main:
                continue
            if id(part) in holds_main or part.tag in ("html", "body"):
                todo.append(part)
            elif part.chars and (id(root) in holds_main or (2 * part.linked >= part.chars and 2 * part.chars < root.chars)):
                out.append(part)
            elif part.chars:
                todo.append(part)
    return out


def _number(hash_: bytes) -> int:
    return int.from_bytes(hash_, "big") - 2**63


def subtrees(root: Node, min_chars: int, inside_chars: int = INSIDE_CHARS) -> dict[int, tuple[list[Node], int]]:
    """The subtrees that may be template, by hash: their nodes and the hash of what must differ between copies.

    That is the page, or the article around the subtree. Inside an article only boxes of some length qualify that hold at
    most half of its text: inline wording, paragraphs and the body of an article are content.
    """
    out: dict[int, tuple[list[Node], int]] = {}
    nodes, frame = digest(root)
    for node in frame:
        out.setdefault(_number(xxhash.xxh3_64(b"skeleton" + node.skeleton).digest()), ([], _number(root.hash)))[0].append(node)
    for node, article in nodes:
        if article is None:
            if node.chars >= min_chars and node.tag not in ("html", "body", "#root"):
                out.setdefault(_number(node.hash), ([], _number(root.hash)))[0].append(node)
        elif node is not article and node.tag in BOXES and node.chars >= inside_chars and 2 * node.chars <= article.chars:
            out.setdefault(_number(node.hash), ([], _number(article.hash)))[0].append(node)
    return out


def _mains(root: Node) -> list[Node]:
    """The elements whose text is the page's: main elements, else articles that are no teasers; none without either."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            found.append(node)
        else:
            todo.extend(x for x in node.parts if isinstance(x, Node) and not x.skip)
    mains = [x for x in found if x.tag != "article"]
    if mains or len(found) < 2:
        return mains or found
    size = {id(x): _length(x) for x in found}
    return [x for x in found if 2 * size[id(x)] >= max(size.values())]


def _length(root: Node) -> int:
    total, todo = 0, [root]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, str):
                total += len(part.strip())
            elif not part.skip:
                todo.append(part)
    return total


def _unlisted(root: Node) -> None:
    """Take back what tags, roles and classes decided, but for the head."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.skip = node.tag == "head"
        todo.extend(x for x in node.parts if isinstance(x, Node))


def decoded(text: str) -> str:
    """Character references decoded and white space folded; a numeric reference beyond Unicode is a replacement sign."""
    return " ".join(html.unescape(HUGE_REFERENCE.sub("\ufffd", text)).split())


def main_text(page: str, template: set[int] = frozenset(), min_chars: int = 1, lists: bool = True) -> str:
    """Text of the page without the subtrees whose hash is in ``template``."""
    root = parse(page)
    if not lists:
        _unlisted(root)
    if template:
        for h, (nodes, _) in subtrees(root, min_chars).items():
            for node in nodes:
                node.skip = node.skip or h in template
    mains = {id(x) for x in _mains(root)} if lists else set()
    wanted, inside = bool(mains), 0
    blocks: list[str] = []
    open_: list[str] = []

    def close() -> None:
        if open_ and (text := decoded("".join(open_))):
            blocks.append(text)
        open_.clear()

    todo: list[tuple[str | Node, bool]] = [(root, False)]
    while todo:
        node, left = todo.pop()
        if isinstance(node, str):
            if inside or not wanted:
                open_.append(node)
        elif left or not node.skip:
            if node.tag in BLOCK or node.main:
                close()
            inside += (id(node) in mains) * (-1 if left else 1)
            if not left:
                todo.append((node, True))
                todo.extend((part, False) for part in reversed(node.parts))
    close()
    return " ".join(blocks)


def _hashes(min_chars: int):
    """The subtree hashes of the pages of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, pages in ((b, r.values) for batch in batches for b, r in zip(*batch.columns, strict=True)):
            at, keys, around = [], [], []
            for row, page in enumerate(pages.field("_html")):
                own = subtrees(parse(page.as_py() or ""), min_chars)
                keys.extend(own)
                around.extend(x for _, x in own.values())
                at.extend([row] * len(own))
            rows = pa.array(at, pa.int32())
            blocks = pa.array([block.as_py()] * len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pages.field("_host").take(rows), pages.field("_c0").take(rows), blocks, rows, pa.array(keys, pa.int64()), pa.array(around, pa.int64())],
                ["_host", "_page", "_block", "_at", "_key", "_around"],
            )

    return run


def _texts(min_chars: int, lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages, marks in ((r.values, m) for batch in batches for r, m in zip(*batch.columns, strict=True)):
            template: dict[int, set[int]] = {}
            for m in marks.as_py() or ():
                template.setdefault(m["_at"], set()).add(m["_key"])
            texts = [main_text(p.as_py() or "", template.get(i, frozenset()), min_chars, lists) for i, p in enumerate(pages.field("_html"))]
            yield pa.RecordBatch.from_arrays([pages.field("_c0"), pages.field("_c1"), pa.array(texts, pa.string())], ["_c0", "_c1", "_out"])

    return run


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10, min_chars: int = 1, lists: bool = True
) -> DataFrame:
    """Per row of ``pages``: id, url and ``text``. Pages are written once in blocks and stay there; what is template comes to
    the blocks."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), F.lit("")))
    base = pages.select(F.col(id_col).alias("_c0"), F.col(url_col).alias("_c1"), F.xxhash64(host).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    (_, id_kind), (_, url_kind) = base.dtypes[:2]
    blocks = row_blocks(base, BLOCK_CHARS)
    held = written(blocks.mapInArrow(_hashes(min_chars), f"_host long, _page {id_kind}, _block long, _at int, _key long, _around long"))
    sizes = base.select("_host", F.col("_c0").alias("_page")).groupBy("_host").agg(F.count_distinct("_page").alias("_pages"))
    # Copies of one page, or of one article, count once.
    once = held.groupBy("_host", "_key", "_around").agg(F.min("_page").alias("_page"))
    counts = once.groupBy("_host", "_key").agg(F.count_distinct("_page").alias("_n")).filter(F.col("_n") >= min(min_pages, SMALL_HOST))
    many = F.least(F.lit(min_pages), F.greatest(F.lit(SMALL_HOST), F.ceil(F.col("_pages") / 2)))
    template = counts.join(sizes, "_host").filter(F.col("_n") >= many).select("_host", "_key")
    marks = held.join(template, ["_host", "_key"]).groupBy("_block").agg(F.collect_list(F.struct("_at", "_key")).alias("_marks"))
    met = blocks.join(marks.hint("shuffle_merge"), "_block", "left").select("_rows", "_marks")
    out = met.mapInArrow(_texts(min_chars, lists), f"_c0 {id_kind}, _c1 {url_kind}, _out string")
    return out.select(F.col("_c0").alias(id_col), F.col("_c1").alias(url_col), F.col("_out").alias("text"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
