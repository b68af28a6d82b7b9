"""Main-text extraction by consensus host paths (operator 5).

1. Each page's containers are scored by the text of their blocks (text in links counts
   against them); the best container's generalised path - tags and classes from the root,
   digits folded - is the page's vote.
2. Spark sums the votes per host; the path with the most votes is the host's path.
3. Each page is extracted again: the blocks inside its elements on the host's path, or inside
   its own best container where it has none there.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are
left out by element and by words of class, id and role.  Such a word does not count on an
element that holds most of the page's text with its article, main or h1 in it, nor as an id made
from a heading of the article, nor where it would leave nothing of the page.  Inside an article a
class of ``TOPICS`` does not count within a line of running text, nor on a section of plain text
whose class also says what it is about ("alert-systems").  A form is a container, not a form, if
it holds most of the page's text with its article, main or h1, or nine tenths of it and a
paragraph.  White space inside a block is one space, character references are decoded, blocks are
joined in page order.

Tags are read by HTML's attribute rules: a quote counts only where a value begins, an unclosed one
does not swallow the page.  The time is linear in the page (times the bounded depth).

The votes of a host are partial sums per (host, path), so a host of a third of all pages is
no hot spot.  Host paths are broadcast if they are few, else joined by shuffle (Spark splits
a skewed host).

Edge cases: null or empty html has no text; truncated pages end where they end, a tag without
its ``>`` is the end of the page; a path of over ``LONGEST`` characters is its digest; a page
without blocks has no text; a null URL or one without ``://`` belongs to host ''; equal votes
go to the path that sorts first; repeated rows are extracted alike; an empty table gives an
empty result; elements nested deeper than 400 count to the one around them; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import cut, small_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul br option".split())
DROPPED = frozenset(
    "nav footer aside script style noscript template iframe object embed svg math button select textarea input dialog "
    "menu head title canvas audio video map datalist search xmp noembed noframes".split())
CLOSES_P = BLOCK - {"br", "option", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "p": ("p",)}
SCOPE = frozenset("table ul ol dl article section div main body html td th blockquote".split())
# Words of class, id or role that mark what is not the article ...
NOISE = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment "
    "comments commentlist respond reply replies disqus cookie cookies consent gdpr privacy disclaimer notice notices alert alerts "
    "popup popups modal overlay newsletter subscribe subscription promo promos promoted sponsor sponsors sponsored sidebar "
    "sidebars side sidenav widget widgets related recommended share sharing social menu menus nav navbar navigation topnav subnav "
    "leftnav pagination pager footer masthead toolbar topbar siteheader skip search login signup complementary contentinfo "
    "dialog tag tags hidden".split())
# ... those among them that no section of an article is about ...
DISCUSSION = frozenset(
    "comment comments commentlist respond reply replies disqus newsletter subscribe subscription promo promos promoted sponsored "
    "share signup breadcrumb breadcrumbs pagination pager".split())
# ... those that a section or a word of an article may be about ...
TOPICS = frozenset(
    "alert alerts notice notices privacy cookie cookies consent gdpr disclaimer login search menu menus navigation widget widgets "
    "tag tags dialog side sharing social toolbar overlay".split())
# ... words beside them that do not say what it is about ...
PLACES = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards center column container content entry field "
    "form global group header heading icon info inline inner item items left line link links list main message module outer page "
    "panel policy post posts primary region right row secondary section site slot small text title top user view wrap wrapper".split())
# ... and of a page's header, outside the article.
HEADERS = frozenset("header site-header page-header top-header global-header main-header".split())
# Words that turn the meaning of a mark round ("with-sidebar").
ABOUT = frozenset("has with no without".split())
VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+"""      # quotes count where a value begins
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)" + VALUE)
TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*+)|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[\s/\x00]++|[^\s/>][^\s/>=]*+"
    + VALUE.replace("([^", "(?:[^") + r")*+)>|</?[a-zA-Z].*+|<[!?/][^>]*+>?", re.S)
NAMED = frozenset(("class", "id", "role", "hidden", "style"))
DIGITS = re.compile(r"\d+")
MARK_WORDS = re.compile(r"[-_:]+")
NOT_SLUG = re.compile(r"[\W_]+")
SPACES = re.compile(r"\s+")
DEEPEST = 400            # elements nested deeper are taken as part of the one they are in
LONGEST = 2_000          # characters of a path; beyond them it goes on from its digest
PARAGRAPH = 80           # characters of one run of text that make it more than a label


class Node:
    __slots__ = ("tag", "path", "noise", "parent", "score", "link", "depth", "article", "mark")

    def __init__(self, tag: str, path: str, noise: bool, parent: "Node | None", link: bool):
        self.tag, self.path, self.noise, self.parent, self.link, self.score = tag, path, noise, parent, link, 0.0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.mark: Mark | None = parent.mark if parent is not None else None     # of the nearest marked element


class Mark:
    """A form, or an element that a class, id or role names as something else than the article."""
    __slots__ = ("outer", "header", "id", "kind", "chars", "linked", "longest", "titled", "heading", "ignored", "gone")

    def __init__(self, outer: "Mark | None", header: bool, id: str, kind: str):
        self.outer, self.header, self.id = outer, header, id      # id: if that alone is the mark, inside an article
        self.kind = kind                                          # "form", "section" or "word" (of a topic), or ""
        self.chars = self.linked = self.longest = 0
        self.titled, self.heading, self.ignored, self.gone = False, None, False, True


def marked_noise(marks: str, outside: bool) -> str:
    """The first class, id or role that names something that is not the article; '' if none does."""
    for mark in marks.lower().split():
        words = MARK_WORDS.split(mark)
        if not ABOUT.intersection(words) and (not NOISE.isdisjoint(words) or outside and mark in HEADERS):
            return mark
    return ""


def topic(mark: str, tag: str) -> str:
    """How a mark inside an article may be about a topic: a "word" of a line, a "section", '' if it may not."""
    words = {w for w in MARK_WORDS.split(mark.lower()) if w}
    if not words & NOISE <= TOPICS:
        return ""
    return "word" if tag not in BLOCK else "section" if words - NOISE - PLACES else ""


def longer(path: str, step: str) -> str:
    """A path and one step more."""
    path = f"{path}>{step}"
    return path if len(path) <= LONGEST else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()


def open_node(tag: str, attributes: str, parent: Node) -> Node:
    classes, marks, ids, off = "", "", "", False
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name not in NAMED:
                continue
            if name == "class":
                classes = ".".join(sorted(set(DIGITS.sub("0", value).lower().split())))
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                off = True
            elif name == "id":
                ids += " " + value
            elif name != "style":
                marks += " " + value
    outside = not parent.article
    noise = parent.noise or off or tag in DROPPED or tag == "header" and outside
    path = parent.path if noise else longer(parent.path, f"{tag}.{classes}" if classes else tag)
    node = Node(tag, path, noise, parent, parent.link or tag == "a")
    if noise or tag in ("body", "html"):
        return node
    mark = marked_noise(marks, outside) if marks else ""
    by_id = marked_noise(ids, outside) if ids and not mark and (outside or tag not in HEADINGS) else ""
    if tag in ("article", "main"):
        if node.mark is not None and not mark and not by_id:
            node.mark.titled = True
    elif mark or by_id:
        node.mark = Mark(parent.mark, (mark or by_id) in HEADERS, "" if outside else by_id,
                         topic(mark, tag) if mark and not outside else "")
    elif tag == "form":
        node.mark = Mark(parent.mark, False, "", "form")
    elif tag == "h1" and node.mark is not None and not node.mark.header:
        node.mark.titled = True
    return node


Block = tuple[Node, str, int, bool]
Piece = tuple[str, bool, "Mark | None"]      # text, whether it is in a link, mark of the nearest marked element
RawBlock = tuple[Node, bool, int, int]       # container, whether it is a heading, first piece, end


def about_heading(mark: Mark) -> bool:
    """Whether a mark is an id made from the heading that its element begins with, over plain text."""
    slug = lambda x: NOT_SLUG.sub("-", x.lower()).strip("-")
    return bool(mark.id and mark.heading and 2 * mark.linked < mark.chars and DISCUSSION.isdisjoint(MARK_WORDS.split(mark.id))
                and slug(re.sub(r"[-_]\d+$", "", mark.id)) == slug(html.unescape(mark.heading)))


def about_topic(mark: Mark) -> bool:
    """Whether a marked section of an article is plain text about a topic."""
    return mark.kind == "section" and 4 * mark.linked < mark.chars and (bool(mark.heading) or mark.longest >= PARAGRAPH)


def in_running_text(raw: list[RawBlock], pieces: list[Piece]) -> Iterator[Mark]:
    """The marks of words that have other text of the element around them in their line."""
    for _, _, lo, hi in raw:
        of_words = [p[2] for p in pieces[lo:hi] if p[2] is not None and p[2].kind == "word"]
        if of_words:
            around = {id(mark) for part, link, mark in pieces[lo:hi] if not link and part.strip()}
            yield from (m for m in of_words if id(m.outer) in around)


def weigh_marks(marks: list[Mark], pieces: list[Piece], raw: list[RawBlock]) -> None:
    """Sets which marked elements are gone; ``marks`` has outer elements before inner ones."""
    total = left = 0
    for part, link, mark in pieces:
        n = len(part.strip())
        total += n
        if mark is None:
            left += n
        else:
            mark.chars += n
            mark.linked += n * link
            mark.longest = max(mark.longest, n)
    words = {id(m) for m in in_running_text(raw, pieces)}
    for mark in reversed(marks):
        most = 2 * mark.chars > total
        mark.ignored = (most and mark.titled or about_heading(mark) or about_topic(mark) or id(mark) in words
                        or mark.kind == "form" and 10 * mark.chars >= 9 * total and mark.longest >= PARAGRAPH)
        if mark.outer is not None:
            mark.outer.chars += mark.chars
            mark.outer.linked += mark.linked
            mark.outer.longest = max(mark.outer.longest, mark.longest)
            mark.outer.titled = mark.outer.titled or most and mark.titled
    while True:
        for mark in marks:
            mark.gone = not mark.ignored or mark.outer is not None and mark.outer.gone
        if left or any(part.strip() for part, _, mark in pieces if mark is not None and not mark.gone):
            return
        outermost = [m for m in marks if m.chars and not m.ignored and (m.outer is None or not m.outer.gone)]
        if not outermost:
            return
        max(outermost, key=lambda m: m.chars).ignored = True


def blocks_of(page: str) -> list[Block]:
    """(container, text, characters in links, is a heading) of each block of a page, boilerplate left out."""
    raw, pieces, marks = raw_blocks(page)
    if marks:
        weigh_marks(marks, pieces, raw)
    out = []
    for node, heading, lo, hi in raw:
        kept = [p for p in pieces[lo:hi] if p[2] is None or not p[2].gone]
        joined = SPACES.sub(" ", html.unescape("".join(p[0] for p in kept))).strip()
        if joined:
            out.append((node, joined, sum(len(p[0]) for p in kept if p[1]), heading))
    return out


class Unopened:
    """Tags of the open elements that are nested too deep, and where each tag stands among them."""
    __slots__ = ("tags", "at")

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, tag: str) -> None:
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)

    def cut(self, length: int) -> None:
        while len(self.tags) > length:
            self.at[self.tags.pop()].pop()

    def nearest(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if t in self.at and self.at[t]), default=-1)

    def forget(self, tags: tuple[str, ...]) -> bool:
        """Closes the nearest element of ``tags``, if it is in scope; whether the search ends here."""
        found, scope = self.nearest(tags), self.nearest(SCOPE)
        if found >= 0 and found >= scope:
            self.cut(found)
        return found >= 0 or scope >= 0


def raw_blocks(page: str) -> tuple[list[RawBlock], list[Piece], list[Mark]]:
    """(container, is a heading, first piece, end) of each block, marked elements included; pieces; marks."""
    node, raw, pieces, marks, begun = Node("", "", False, None, False), [], [], [], 0
    unopened = Unopened()

    def end_block() -> None:
        nonlocal begun
        if begun < len(pieces):
            around, heading = container(node)
            raw.append((around, heading, begun, len(pieces)))
            if node.mark is not None and node.mark.heading is None:
                joined = "".join(p[0] for p in pieces[begun:]).strip()
                if joined:
                    node.mark.heading = joined if heading else ""
            begun = len(pieces)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not node.noise:
            pieces.append((page[at:stop], node.link, node.mark))
        if not m:
            break
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if unopened.tags and tag in BLOCK:
                end_block()
                if unopened.nearest((tag,)) >= 0:
                    unopened.cut(unopened.nearest((tag,)))
                    continue
            elif unopened.tags and unopened.forget((tag,)):
                continue
            top = node
            while top is not None and top.tag != tag:
                if top.tag in SCOPE and tag not in BLOCK:
                    top = None
                    break
                top = top.parent
            if tag in BLOCK:
                end_block()
            if top is not None and top.parent is not None:
                node = top.parent
                unopened.cut(0)
            continue
        if tag in BLOCK:
            end_block()
        for tags in (("p",) if tag in CLOSES_P else (), SAME.get(tag, ())):
            if tags and not (unopened.tags and unopened.forget(tags)):
                before, node = node, closed(node, tags)
                if node is not before:
                    unopened.cut(0)
        if tag in VOID:
            continue
        if tag not in BLOCK and tag not in DROPPED and tag not in RAW and tag != "a" and not m.group(3):
            continue                                   # plain inline mark-up changes nothing
        opened = open_node(tag, m.group(3), node)
        if opened.mark is not node.mark:
            marks.append(opened.mark)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if opened.depth <= DEEPEST * (4 if opened.noise or opened.mark is not None else 1):
            node = opened
        else:
            unopened.push(tag)
    end_block()
    return raw, pieces, marks


def closed(node: Node, tags: tuple[str, ...]) -> Node:
    """The node after closing the nearest open element of ``tags``, if it is in scope."""
    top = node
    while top is not None and top.parent is not None:
        if top.tag in tags:
            return top.parent
        if top.tag in SCOPE:
            return node
        top = top.parent
    return node


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre b i em strong span a u font small sub sup code mark "
                  "figure figcaption table tbody thead tr td th caption label".split())


def container(node: Node) -> tuple[Node, bool]:
    """The nearest element around a block that is no text part itself; whether a heading is passed."""
    heading = False
    while node.tag in PARTS and node.parent is not None:
        heading = heading or node.tag in HEADINGS
        node = node.parent
    return node, heading


def best_container(blocks: list[Block]) -> str:
    """Path of the container with the best score; '' if there is none.

    It is widened to the article element around it (else the main element), or to parents that
    add nothing but headings."""
    scored: dict[int, Node] = {}
    plain: Counter[str] = Counter()              # blocks inside a path that are no headings
    for node, text, linked, heading in blocks:
        linked = min(linked, len(text))
        worth = len(text) - 2.0 * linked + 20.0 * (1.0 - linked / len(text))
        share = 1.0
        while node is not None and node.parent is not None:
            if id(node) not in scored:
                scored[id(node)] = node
                node.score = 200.0 if node.tag in ("article", "main") else 0.0
            node.score += worth * share
            share *= 0.6
            if not heading:
                plain[node.path] += 1
            node = node.parent
    best = max(scored.values(), key=lambda v: (v.score, v.path), default=None)
    if best is None:
        return ""
    for tag in ("article", "main"):
        node = best
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None:
            return node.path
    while best.parent is not None and best.parent.parent is not None and best.parent.tag not in ("body", "html"):
        if plain[best.parent.path] != plain[best.path]:
            break
        best = best.parent
    return best.path


def inside(node: Node | None, path: str) -> bool:
    while node is not None:
        if node.path == path:
            return True
        node = node.parent
    return False


def main_text(page: str | None, host_path: str | None) -> str:
    blocks = blocks_of(page or "")
    for path in (host_path, best_container(blocks) if blocks else ""):
        if path:
            found = [text for node, text, _, _ in blocks if inside(node, path)]
            if found:
                return " ".join(found)
    return " ".join(text for _, text, _, _ in blocks)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many pages of a host have their best container on a path."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_container(blocks_of(p)) if p else "" for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])
    return (pages.select("host", "html").mapInArrow(vote, "host string, path string").where("path <> ''")
            .groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))


MAX_HOSTS = 100_000      # hosts whose paths are broadcast (a path has at most LONGEST characters)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most votes."""
    best = Window.partitionBy("host").orderBy(F.desc("n"), "path")
    return votes(pages).withColumn("k", F.row_number().over(best)).where("k = 1").select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, host, path (the host's), text, n_chars for each page."""
    from roadlens.llm.url_filter import address
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        address(F.col(url_col))[0].alias("host"))
    paths = cut(host_paths(rows))
    paths = F.broadcast(paths) if paths.count() <= MAX_HOSTS else paths

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "host", "path", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return (rows.join(paths, "host", "left").select("id", "url", "host", "path", "html")
            .mapInArrow(read, f"id {kind}, url string, host string, path string, text string, n_chars long")
            .withColumnRenamed("id", id_col))
