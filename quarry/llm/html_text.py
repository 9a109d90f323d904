"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches
from quarry.llm.pieces import WHITE

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(f"[{WHITE}]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())  # up to their own end tag
# Elements that never hold the article.
DROPPED = frozenset("head script style title noscript template iframe object svg math canvas button select textarea label "
                    "nav aside footer menu dialog noembed noframes xmp audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
# Words of class, id or role that mark furniture of a page.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
                      "contentinfo cookie cookies consent copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
                      "notice notices notification overlay pagination pager popup promo promoted promotion related reply replies respond "
                      "search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
HEADER_WORDS = frozenset("header".split())
# Beside one of these in the same name, a word of FURNITURE tells of a layout or a topic ("has-sidebar", "related-work").
NO_FURNITURE = frozenset("has no with without work works".split())
# Readers' words: such an element is never a wrapper of the article.
READERS = frozenset("comment comments disqus replies reply respond".split())
# Words of a page's layout: with one of FRAMES in the same name, the element may be the wrapper of article and the other.
LAYOUT = frozenset("banner footer header masthead menu nav navbar navigation overlay related search share sharing sidebar sidebars toolbar".split())
FRAMES = frozenset("container content layout main outer page site wrap wrapper".split())
MARKS = frozenset("article main h1".split())  # they tell where the article is
# What an element's name says of it.
PLAIN, WEAK, NAMED, FRAME, OF_READERS = range(5)
# Words that alone prove little: what is called so goes only if it is thin (``take_off``).
WEAK_WORDS = frozenset("overlay pagination pager related search share sharing skip social toolbar widget".split())
FAR_MORE = 4              # so many times the text outside makes an element with the article's marks its wrapper
THIN = 0.5                # holds no node with this share of the page's greatest density sum
# Opening one of these ends an open one of the second set (elements whose end tag may be left out).
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
          "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("table td th ul ol dl body article section main div".split())


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "order", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: int = PLAIN):
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.children: list = []  # nodes and strings in page order


def _furniture(tag: str, inside_article: bool) -> bool:
    """Furniture by its element alone."""
    return tag in DROPPED or tag == "header" and not inside_article


def _named(tag: str, attributes: str, inside_article: bool) -> int:
    """What class, id and role call the element; where the article is decides what becomes of it (``take_off``). A
    form is treated as if it was called furniture."""
    out = NAMED if tag == "form" else PLAIN
    if not attributes or tag in ("html", "body", "article", "main"):
        return out
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            words = set(re.split(r"[^a-z0-9]+", name))
            found = words & (FURNITURE if inside_article else FURNITURE | HEADER_WORDS)
            if found and not words & NO_FURNITURE:
                out = max(out, OF_READERS if found & READERS else WEAK if found <= WEAK_WORDS else FRAME if found <= LAYOUT and words & FRAMES else NAMED)
    return out


def parse(page: str) -> Node:
    """A tolerant tree: unknown end tags are skipped, an end tag closes what is open inside it, the end of
    the page closes everything; a paragraph ends where the next block of its parent begins."""
    root = Node("#root", None, False)
    at, cur, article = 0, root, 0
    lower = None
    while True:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            cur.children.append(text)
        if not m:
            return root
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                cur.children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if m[1]:
            up = cur
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                if tag in INLINE and any_block_between(cur, up):
                    continue  # an inline end tag does not close blocks
                while cur is not up.parent:
                    article -= cur.tag in ("article", "main")
                    cur = cur.parent
            continue
        if tag not in INLINE:
            up = cur  # a block ends an open paragraph, also through inline elements left open in it
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                cur = up.parent
        if tag in CLOSES:
            up = cur
            while up is not root and up.tag not in CLOSES[tag] and up.tag not in SCOPE:
                up = up.parent
            if up is not root and up.tag in CLOSES[tag]:
                cur = up.parent
        node = Node(tag, cur, _furniture(tag, article > 0), _named(tag, m[3], article > 0))
        cur.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "article", "section", "body", "a", "b", "i", "span"):
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + tag, at) if len(lower) == len(page) else page.find("</" + tag, at)
            if end < 0:
                at = len(page)
            else:
                close = page.find(">", end)
                at = len(page) if close < 0 else close + 1
            continue
        article += tag in ("article", "main")
        cur = node


def any_block_between(cur: Node, up: Node) -> bool:
    while cur is not up:
        if cur.tag not in INLINE:
            return True
        cur = cur.parent
    return False


def _order(root: Node) -> list[Node]:
    """All kept nodes, parents first (no recursion: pages can be nested deeply)."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node) and not c.drop]
    return out


def measure(root: Node) -> list[Node]:
    """Composite text density of every kept node: characters per tag, made smaller where they are link
    characters, and the sum of the children's densities."""
    nodes = _order(root)
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, Node) and not c.drop]
        own = sum(len(SPACE.sub("", c)) for c in n.children if isinstance(c, str))
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + 1 for k in kids)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        else:
            n.link_chars, n.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if not n.chars:
            n.density = 0.0
            continue
        plain, links = max(n.chars - n.link_chars, 1), max(n.link_chars, 1)
        base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
        tags, link_tags = max(n.tags, 1), max(n.link_tags, 1)
        n.density = n.chars / tags * max(math.log(max(n.chars / links * tags / link_tags, 1.0 + 1e-9)), 1e-9) / base
    for n in nodes:
        n.density_sum = sum(c.density for c in n.children if isinstance(c, Node) and not c.drop)
    return nodes


def take_off(root: Node) -> None:
    """Drop what is called furniture; its place relative to the article decides, not its size alone.

    Outermost such elements are held against the page outside all of them. Without any text outside, the one
    with the greatest density sum is a wrapper. Else an element is a wrapper if its name speaks of a frame and it
    has more text than the outside, or if it has far more, holds the article's marks, and no article or main element
    stands outside; readers' comments are none. Wrappers stay, and what is in them is judged in the same way;
    all others go, however dense they are. What only a weak word names goes if it is thin beside the article."""
    while True:
        outer, chars, marked, todo = [], 0, False, [root]
        while todo:
            n = todo.pop()
            if n.named > WEAK:
                outer.append(n)
                continue
            marked = marked or n.tag in ("article", "main")
            if n.tag != "a":
                chars += sum(len(SPACE.sub("", c)) for c in n.children if isinstance(c, str))
                todo += [c for c in n.children if isinstance(c, Node) and not c.drop]
        if not outer:
            break
        nodes = measure(root)
        if not chars:
            best = max(nodes, key=lambda n: n.density_sum if n.chars else -1.0)
            while best is not None and best not in outer:
                best = best.parent
        for n in outer:
            if not chars:
                stays = n is best
            else:
                own = n.chars - n.link_chars
                stays = n.named == FRAME and own > chars or n.named == NAMED and not marked and own > FAR_MORE * chars and any(x.tag in MARKS for x in _order(n))
            n.drop, n.named = not stays, PLAIN
    nodes = measure(root)
    if any(n.named for n in nodes):
        least, holds = THIN * max(n.density_sum for n in nodes), set()
        for n in nodes:
            if n.density_sum >= least:
                while n is not None and n not in holds:
                    holds.add(n)
                    n = n.parent
        for n in nodes:
            n.drop = n.drop or bool(n.named) and n not in holds


def is_menu(n: Node, threshold: float) -> bool:
    """Mostly links and less dense than the threshold."""
    return n.link_chars * 2 > n.chars and n.density < threshold


def choose(root: Node) -> tuple[Node, float]:
    """The subtree of the article and the threshold of its body path.

    From the node with the greatest density sum (the first of equal ones; without markup the whole page) the
    path to the body gives the threshold, its smallest density; the subtree is the highest node of that path
    that is not the page itself, so that all siblings of the densest blocks come along."""
    take_off(root)
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.density_sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    frame = [n for n in path if n.tag not in ("#root", "html", "body")]
    inner = frame[-1] if frame else path[-1]
    body = next((n for n in path if n.tag == "body"), path[-1])
    threshold = min(n.density for n in [*frame, body] if n.chars) if any(n.chars for n in [*frame, body]) else 0.0
    # other children of the body that are no menus belong to the article as well, links in them or not
    others = [c for c in body.children if isinstance(c, Node) and not c.drop and c is not inner and c.chars and not is_menu(c, threshold)]
    loose = any(isinstance(c, str) and SPACE.sub("", c) for c in body.children)
    return (body if others or loose or not frame else inner), threshold


def blocks(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks in page order; a block whose text is mostly links and which is less dense than
    the threshold is a menu."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(part))).strip(" ")
        part.clear()
        if text:
            out.append(text)

    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            part.append(x)
        elif x is None:
            flush()
        elif x.drop:
            part.append(" ")
        elif x.tag == "br":
            part.append(" ")
        elif x.tag in INLINE:
            todo += reversed(x.children)
        else:
            flush()
            if x is not top and is_menu(x, threshold):
                continue
            todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top, threshold = choose(parse(page))
    return "\n\n".join(blocks(top, threshold))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Composite text density: characters per tag of every node of the page's tree, link-adjusted, and the sum of
    the children's densities. The subtree of the greatest sum, raised along its body path, is the article;
    the path's smallest density is the threshold under which link-dominated blocks go. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments are taken off before: by element, and
    by class, id or role where the place of the named element is not around the article (``take_off``). Character
    references are decoded, white space in a block becomes one space,
    blocks are trimmed and joined by an empty line in page order; nothing else is dropped or cut.

    Pages are parsed one by one inside Arrow batches bounded by bytes; no shuffle. A null or empty page, or one
    without text, gives an empty text. Null ids and urls stay null; repeated rows get a row each; other columns
    are ignored; broken or unclosed markup is read tolerantly; an empty table gives an empty table."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
                       F.col(f"`{html_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = [main_text(p) for p in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
