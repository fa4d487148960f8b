"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, fewer with each level, and in full to the article
that they are in; a container's points are discounted by the share of its text in links. The best container is kept with
all that stands beside it and isn't mostly links, and with what has points enough beside the containers around it. A form
that holds most of the page's text is its wrapper. Parsing and scoring take time in proportion to the page, however it is
nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mo mn mtext mrow mstyle msup msub msubsup mfrac msqrt mroot munder mover mfenced semantics".split())
#: Elements that never hold the article's text.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas annotation audio video dialog menu".split())
#: Words of which a class or id is made that marks menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related replies share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Of those the words that alone, in an article, may as well name a part of it: an editor's comment, a notice that it quotes.
UNSURE = frozenset("banner comment header menu notice notices promotion related social".split())
#: Words that may stand beside those in such a name. With any other word the name is that of something else: ad-hoc, menu-prices.
BESIDE = frozenset("area articles bar block bottom box buttons center container content form icons inner item items js left links list main mobile outer page posts primary right section secondary site slot sticky thread to top unit wrap wrapper".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table article section div body main blockquote".split())


class Node:
    __slots__ = ("children", "commas", "home", "links", "loose", "marks", "own", "own_links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, marks: str = ""):
        self.tag, self.parent, self.marks = tag, parent, marks
        self.home = self if tag in ("article", "main") else parent.home if parent else None  # the article or main part that it is in
        self.children: list[Node | str] = []
        self.score, self.size, self.links, self.own, self.own_links, self.commas, self.loose = 0.0, 0, 0, 0, 0, 0, False


class Builder(HTMLParser):
    """A forgiving tree: unknown end tags are ignored, open paragraphs end where a block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("root", None)]
        self.places: dict[str, list[int]] = {}  # of open elements, by tag

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag not in VOID:
            self._end({"p"}, HOLDS - {"blockquote"} | {"li", "td"})
            if tag in ENDS:
                self._end(ENDS[tag], {"ul", "ol", "dl", "table"})
        node = Node(tag, self.open[-1], " ".join(v for k, v in attrs if k in ("class", "id", "role") and v))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._end({tag}, HOLDS if tag in INLINE or tag == "p" else frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _end(self, tags, walls) -> None:
        """Closes the innermost open element of `tags`, unless one of `walls` is open within it."""
        at = self._last(tags)
        if at and at >= self._last(walls):
            self._close(at)

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()


def _to_the_end(parse):
    """A tag, comment or declaration that never ends takes the rest of the page, as in browsers; else each of many would search it."""

    def method(self, i, *args):
        k = parse(self, i, *args)
        return len(self.rawdata) if k < 0 else k

    return method


for _name in ("parse_starttag", "parse_endtag", "parse_comment", "parse_pi", "parse_html_declaration"):
    setattr(Builder, _name, _to_the_end(getattr(HTMLParser, _name)))


def marked(names: str, within: bool = False) -> bool:
    """Whether a class, id or role of these, as a whole, names a menu, notice, advert or the like; `within` an article not by an unsure word alone."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if within and len(words) == 1 and words[0] in UNSURE:
            continue
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


def _dropped(node: Node, wrappers: set[int]) -> bool:
    if node.tag in DROPPED and id(node) not in wrappers:
        return True
    if node.tag == "header":
        return node.home is None
    return node.tag not in ("body", "html", "root", "main") and bool(node.marks) and marked(node.marks, node.parent is not None and node.parent.home is not None)


def _text(nodes: list[Node | str]) -> str:
    """The nodes' text: blocks and line breaks part words, white space becomes one space."""
    out, todo = [], list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag not in INLINE:
            out.append(" ")
            todo.append(" ")
        todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


def _wrappers(root: Node) -> set[int]:
    """The forms that hold more than half of the text outside of other dropped elements."""
    seen, todo, sizes = [], [root], {}
    while todo:
        x = todo.pop()
        seen.append(x)
        todo.extend(c for c in x.children if not isinstance(c, str) and (c.tag == "form" or c.tag not in DROPPED))
    for x in reversed(seen):  # children come before parents
        sizes[id(x)] = sum(len(c.strip()) if isinstance(c, str) else sizes.get(id(c), 0) for c in x.children)
    return {id(x) for x in seen if x.tag == "form" and 2 * sizes[id(x)] > sizes[id(root)]}


def _prune(root: Node) -> list[Node]:
    """Takes out dropped elements; the rest in page order."""
    wrappers = _wrappers(root)
    seen, todo = [], [root]
    while todo:
        x = todo.pop()
        seen.append(x)
        x.children = [c for c in x.children if isinstance(c, str) or not _dropped(c, wrappers)]
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return seen


def measure(nodes: list[Node]) -> None:
    """Sizes, links and commas of all nodes (in page order) from their children, then scores from those of text blocks.

    A block's own text is that of its strings and inline elements; blocks within it are text blocks of their own.
    """
    for x in reversed(nodes):  # children come before parents
        for c in x.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                x.size, x.own, x.commas, x.loose = x.size + n, x.own + n, x.commas + c.count(","), x.loose or n > 0
            else:
                x.size, x.links = x.size + c.size, x.links + c.links
                if c.tag in INLINE:
                    x.own, x.own_links, x.commas, x.loose = x.own + c.own, x.own_links + c.own_links, x.commas + c.commas, x.loose or c.loose
        if x.tag == "a":
            x.links, x.own_links = x.size, x.own
    for x in nodes:
        if not x.loose or x.tag in INLINE:
            continue
        points = (1 + x.commas + min(x.own / 100, 3)) * (1 - x.own_links / x.own)
        if x.home:
            x.home.score += points
        up, share = (x if x.tag in HOLDS else x.parent), 1.0
        while up is not None and share > 0.05:
            if up is not x.home:
                up.score += points * share
            up, share = up.parent, share / 2


def main_text(html: str | None) -> str:
    """The main text of one page; empty for null, empty and text-free pages. Nesting of any depth and unclosed tags are fine."""
    if not html:
        return ""
    b = Builder()
    b.feed(html)
    b.close()
    nodes = _prune(root := b.open[0])
    measure(nodes)
    found = [x for x in nodes if x.score > 0 and x.tag not in INLINE]
    if not found:
        return _text([root]) if root.links < root.size else ""
    best = max(found, key=lambda x: x.score * (1 - x.links / max(1, x.size)))  # of equal ones the outermost
    kept: list[Node | str] = [best]
    least, at = max(4.0, 0.2 * best.score), best
    while at.parent is not None and at.tag not in ("body", "main"):
        top = at.parent.tag in ("body", "html", "root")
        if at is best and not top and (best.tag != "article" or best.parent.home is not None):
            reads = _beside
        elif at.tag == "article":  # several of a page
            reads = lambda x: not isinstance(x, str) and x.tag == "article" and _reads(x, 0.2 * best.score)
        else:
            reads = lambda x: not isinstance(x, str) and (_reads(x, least) or at is best and x.tag in ("article", "section") and _beside(x))  # noqa: B023, E731
        place = next(i for i, c in enumerate(at.parent.children) if c is at)
        before, after = at.parent.children[:place], at.parent.children[place + 1 :]
        kept = [*filter(reads, before), *kept, *filter(reads, after)]
        at = at.parent
    return _text(kept)


def _beside(x: Node | str) -> bool:
    """Whether what stands beside the best container in one that isn't the page itself belongs to the text: all but what is mostly links."""
    return isinstance(x, str) or 2 * x.links < x.size


def _reads(x: Node | str, least: float) -> bool:
    """Whether what stands beside a container around the text belongs to it, by its own points."""
    if isinstance(x, str):
        return False
    density = x.links / max(1, x.size)
    if x.tag in ("p", "h1", "h2", "h3", "pre", "blockquote"):
        return density < 0.25 and x.size > 0
    return x.score * (1 - density) >= least


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; ids and urls are kept as they are, null or repeated, and other columns left out.

    Null and empty pages have empty text. n_chars counts code points. Pages of any length are read whole, in time in
    proportion to it. An empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")


def op4_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all `pages`."""
    return extract(read(spark, sf_dir, "pages"))
