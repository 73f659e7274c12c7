"""Main text of web pages by a consensus of each host's pages.

Each page's containers are scored: from the root, the walk goes down while one container
holds most of the text that is neither in links nor in parts that say what they are
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments).  It stops at
an article or main element, and where a headline or a lead stands beside that container.
The path where it ends (tags and classes, digits dropped) is the page's vote.  Spark counts
votes for each host and meets them with the paths that each page has, by equality; a page
whose host votes more for another of its paths has its text taken from that path's
containers in a second reading, any other page from its own vote's.

A class or id that names a part beside the article condemns an element, but never html,
body, main, an article (but a reader's comment) or an article's wrapper (an element with a main, an h1 or an article in it that
no name condemns), and not the only parts that hold text.

Null and empty pages, and pages without text, give an empty text.  A null url is a host
of its own.  Rows that repeat are extracted each; ties among paths go to the one with more
text, then to the smaller hash; pages of any length are read whole; further columns of any
name are ignored; an empty table gives an empty result.  Nothing of the chosen containers
is cut off.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import frugal, materialize, prepare

#: A container that holds this share of the text is entered.
MOST = 0.6
#: What else a container holds may be this share of its text, in scraps without a headline, for the walk to go on.
BESIDES = 0.1
#: Rows of three numbers (host, path, votes; or page, path) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# Element names.
CONTAINERS = frozenset("main article section div td center blockquote".split())
DROPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea iframe object svg canvas video audio map dialog menu fieldset label input".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = CONTAINERS | DROPPED | frozenset("html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table tbody thead tfoot tr th figure figcaption hr address details summary caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that an opening tag closes if they are open and no closer container is.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words of classes and ids that name parts beside the article.
BESIDE = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|widgets?|ads?|advert|adverts|advertisement|sponsor|sponsored|promo|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|comments?|commentlist|disqus|replies|reply|respond|toolbar|skip|copyright|legal|tags)(?:$|[-_ ])"
)

# Words that name a reader's comment; an article element is one of those only by such a name.
COMMENT = re.compile(r"(?:^|[-_ .#])(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|[-_ .#])")

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """A container: what names it (by a tag or role: ``dropped``; by a class or id: ``suspect``), and its own text."""

    __slots__ = ("beside", "blocks", "chars", "dropped", "free", "headline", "kids", "parent", "path", "suspect", "tag")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool = False, suspect: bool = False) -> None:
        self.tag, self.path, self.parent, self.dropped, self.suspect = tag, path, parent, dropped, suspect
        self.beside = False  # settled by judge
        self.kids: list[Node] = []
        self.blocks: list[tuple[int, str]] = []  # (order in the page, text)
        self.free = 0  # characters of its own blocks outside links
        self.chars = 0  # the same with its containers that are not beside the article
        self.headline = False  # an h1 or h2 of its own


def named(attributes: str) -> tuple[str, bool, bool]:
    """Generalised classes and id, whether a role or style drops the element, and whether a name condemns it."""
    if not attributes:
        return "", False, False
    classes, dropped = [], False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if name == "class":
            classes += value.split()
        elif name == "id":
            classes.append("#" + value.strip())
        elif name == "role":
            dropped |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "alert", "dialog")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            dropped = True
    suspect = any(BESIDE.search(x.lstrip("#")) for x in classes)
    return "".join("." + _DIGITS.sub("0", x) for x in sorted(set(classes))), dropped, suspect


def parse(page: str) -> Node:
    """The containers of a page, each with its own blocks of text."""
    root = Node("", "", None)
    # Open elements: (tag, container that it lies in or is).
    stack: list[tuple[str, Node]] = [("", root)]
    text: list[str] = []
    linked = order = at = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked, order
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            node = stack[-1][1]
            node.blocks.append((order, whole))
            order += 1
            free = max(0, len(whole) - linked)
            # Short scraps say little of where the article is.
            node.free += free if free >= 25 else free // 4
            node.headline |= stack[-1][0] in ("h1", "h2")
        text.clear()
        linked = 0

    end = len(page)
    position = 0
    while position < end:
        m = _TAG.search(page, position)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = position = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS:
            if tag not in RAW:
                continue
        else:
            flush()
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = position = close.end() if close else end
            continue
        if tag in VOID:
            continue
        in_link = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p":
                del stack[k:]
                break
            if stack[k][0] in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "dl", "table"):
                break
        node = stack[-1][1]
        names, dropped, suspect = named(m.group(3))
        title = tag == "header" and node.tag in ("article", "main")  # the article's own head
        dropped |= tag in DROPPED and not title
        suspect &= not title and tag not in ("html", "body", "main") and (tag != "article" or COMMENT.search(names) is not None)
        if tag in CONTAINERS or dropped or (suspect and tag in BLOCKS):
            inside = Node(tag, f"{node.path}>{tag}{names}", node, dropped, suspect)
            node.kids.append(inside)
            node = inside
        stack.append((tag, node))
    flush()
    return root


def _down(root: Node) -> list[Node]:
    """All containers, parents first; without recursion, as pages nest without limit."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    return order


def judge(root: Node) -> None:
    """Settles which containers are beside the article, and sums what the others hold."""
    order = _down(root)
    # Wrappers: a main, a headline of the first order, or an article that no name condemns stands in them.
    wraps = {n: n.tag == "main" or (n.tag == "article" and not n.suspect and not n.dropped) for n in order}
    for n in reversed(order):
        if n.parent is not None and not n.dropped and (wraps[n] or (n.headline and not n.suspect)):
            wraps[n.parent] = True

    def settle(believe: bool) -> None:
        for n in order:
            n.beside = (n.parent is not None and n.parent.beside) or n.dropped or (believe and n.suspect and not wraps[n])
            n.chars = 0 if n.beside else n.free
        for n in reversed(order):
            if n.parent is not None and not n.beside:
                n.parent.chars += n.chars

    settle(True)
    if not root.chars:  # all that there is stands in parts that names condemn
        settle(False)


def vote(root: Node) -> Node:
    """The page's main container."""
    judge(root)
    node = root
    while node.tag not in ("article", "main"):
        best = max(node.kids, key=lambda n: n.chars, default=None)
        if best is None or best.beside or best.chars < MOST * node.chars or not best.chars:
            break
        others = [n for n in node.kids if n is not best and not n.beside]
        if node.parent is not None and (node.headline or any(n.headline for n in others) or node.chars - best.chars > BESIDES * node.chars):
            break
        node = best
    return node


def paths(root: Node) -> dict[int, str]:
    """The paths of the page's containers that hold text of the article, by hash."""
    return {path_hash(n.path): n.path for n in _down(root) if n.chars and not n.beside}


def path_hash(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def take(root: Node, path: str) -> str:
    """The text of all containers on a path."""
    blocks: list[tuple[int, str]] = []
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.path == path
        if n.beside:
            continue
        if inside:
            blocks += n.blocks
        todo += [(k, inside) for k in n.kids]
    return "\n\n".join(t for _, t in sorted(blocks))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and 64-bit keys of the page (equal pages of one url share it) and of its host."""
    body = F.col("html").cast("string")
    return pages.select("page_id", "url", body.alias("html"), F.xxhash64(F.col("url").cast("string"), body).alias("page"), F.xxhash64(host(F.col("url"))).alias("host"))


def ballots(pages: DataFrame) -> DataFrame:
    """page, host, the path voted for (a hash), the characters there, and all paths of the page with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voted, chars, own = [], [], []
            for x in batch.column("html").to_pylist():
                root = parse(x or "")
                best = vote(root)
                voted.append(path_hash(best.path))
                chars.append(best.chars)
                own.append(list(paths(root)))
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("host"), pa.array(voted, pa.int64()), pa.array(chars, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["page", "host", "path", "chars", "own"])

    return pages.select("page", "host", "html").mapInArrow(frugal(run), "page long, host long, path long, chars long, own array<long>").filter("chars > 0")


def _side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def overruled(votes: DataFrame) -> DataFrame:
    """(page, path) of the pages whose host votes more for another of their paths than for their own vote's."""
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    counted = materialize(counted, "host-votes")
    mine = votes.select("page", "host", F.col("path").alias("mine"), F.explode("own").alias("path")).distinct()
    known = mine.join(_side(counted), ["host", "path"])
    best = known.groupBy("page").agg(F.max_by("path", F.struct("votes", "chars", -F.col("path"))).alias("path"), F.first("mine").alias("mine"))
    return best.filter("path != mine").select("page", "path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and by_consensus (whether its host's votes put another path in place of the page's own)."""
    prepare(pages.sparkSession)
    rows = keyed(pages)
    votes = materialize(ballots(rows), "votes")
    other = materialize(overruled(votes), "overruled")
    rows = rows.drop("host").join(_side(other), "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                root = parse(page or "")
                best = vote(root)
                texts.append(take(root, best.path if path is None else paths(root)[path]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("path").is_valid()], ["page_id", "url", "text", "by_consensus"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.select("page_id", "url", "html", "path").mapInArrow(frugal(run), f"{kinds}, text string, by_consensus boolean")
