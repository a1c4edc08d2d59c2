"""Main-text extraction from HTML by tree scoring.

Each paragraph earns points for its length and commas and passes them to its
ancestors (the parent all of them, the grandparent half, later ones less).  A
container's score is discounted by its link density.  The best container, or
the outermost article around it, and those of its siblings that score well or
read like prose are the article.  Names of classes weigh: they cut a block
unless it carries much of the text, or is a paragraph that reads like prose.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text, not markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Never part of an article.
DROPPED = frozenset("head script style noscript iframe template nav footer aside button select option input textarea svg canvas object dialog menu math audio video title label datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
#: A start tag of the key ends an open element of the value, up to the barrier.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 figcaption dt".split())
CONTAINER = frozenset("article main section div body td blockquote center html".split())
#: Parts of class, id and role names that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side comment comments disqus respond replies reply menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login social share sharing related recommended recommendations widget pager pagination tags legal disclaimer copyright search skip toolbar alert contentinfo complementary".split()
)
#: Of these, names that say little inside an article: a block that reads like prose stays.
WEAK = frozenset("copyright disclaimer foot footer header legal masthead page pager respond search side skip tags toolbar widget".split())
#: Of these, names of what readers write.
READERS = frozenset("comment comments disqus respond replies reply".split())
#: Elements that are one paragraph: inside an article a name alone does not cut one that reads like prose.
ONE_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre span b i em strong a".split())
#: A block of this share of the article's text, or of the page's where it has no article, is no notice.
SHARE_OF_ARTICLE, SHARE_OF_PAGE = 1 / 3, 1 / 2
#: A form around so many characters of prose, and half of the page's, is a page in a form.
FORM_PROSE, LONG_TEXT = 200, 80
#: A block that reads like prose: so many characters, and at most this share of them in links.
PROSE_CHARS, PROSE_LINKS = 40, 0.33
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?=$|[\s_-])", re.I)
TAG = re.compile(r"<(?:!--(?:.*?(?:--!?>|\Z)|>)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WHITE = re.compile(r"\s+")


class Node:
    """An element; ``kids`` holds nodes and decoded strings in page order."""

    __slots__ = ("tag", "hint", "hidden", "parent", "depth", "kids", "score", "chars", "linked", "prose", "holds", "readers")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.hint, self.hidden, self.score, self.chars, self.linked, self.prose, self.holds, self.readers = "", False, 0.0, 0, 0, 0, False, False


class Tree:
    """The open elements while a page is read, by tag as well, so that no tag makes for a walk up all of them."""

    def __init__(self) -> None:
        self.here = Node("#root", None)
        self.open: dict[str, list[Node]] = {}
        self.blocks: list[Node] = []

    def enter(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(node)
        if node.tag in BLOCK:
            self.blocks.append(node)
        self.here = node

    def leave(self, upto: Node) -> None:
        """Close all elements inside ``upto``, and that too."""
        while True:
            node = self.here
            self.open[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.here = node.parent
            if node is upto:
                return

    def deepest(self, tags) -> int:
        return max((self.open[t][-1].depth for t in tags if self.open.get(t)), default=0)

    def make_way(self, tag: str) -> None:
        """Leave the elements that a start tag ends."""
        if tag in ENDS_P and self.blocks and self.blocks[-1].tag == "p":
            self.leave(self.blocks[-1])
        if tag in SIBLINGS:
            ends, barrier = SIBLINGS[tag]
            floor, last = self.deepest(barrier), None
            for t in ends:
                for node in reversed(self.open.get(t, ())):
                    if node.depth <= floor:
                        break
                    last = node if last is None or node.depth < last.depth else last
            if last is not None:
                self.leave(last)

    def close(self, tag: str) -> None:
        """Leave the nearest open element of an end tag's name, if there is one; a stray one does not leave a table's cell."""
        if not self.open.get(tag):
            return
        node = self.open[tag][-1]
        inside_cell = self.deepest(("td", "th")) > node.depth
        if not (inside_cell and tag in BLOCK and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html")):
            self.leave(node)


def parse(source: str) -> Node:
    """A tree of the page, lenient as browsers are: unclosed paragraphs, list items and cells end where the next begins."""
    tree = Tree()
    root, at, n = tree.here, 0, len(source)
    while at < n:
        found = TAG.search(source, at)
        stop = found.start() if found else n
        if stop > at:
            tree.here.kids.append(html.unescape(source[at:stop]))
        if not found:
            break
        at = found.end()
        if found[1]:
            tree.close(found[1].lower())
        elif found[2]:
            tag, attrs = found[2].lower(), found[3] or ""
            if not found[0].endswith(">"):
                break  # the page ends inside a tag
            tree.make_way(tag)
            node = Node(tag, tree.here)
            tree.here.kids.append(node)
            if attrs:
                _describe(node, attrs)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
                tree.enter(node)
    return root


def _describe(node: Node, attrs: str) -> None:
    hint = []
    for found in ATTR.finditer(attrs):
        name, value = found[1].lower(), (found[2] or "").strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            hint.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.hidden = True
    node.hint = " ".join(hint)


def _dropped(node: Node, article: Node | None, page: Node) -> bool:
    """Menus, notices, adverts and the like, by element, or by names where place, text and links do not speak for it.

    ``article`` is the outermost one around the node, if there is one.
    """
    if node.tag in DROPPED or node.hidden:
        return True
    if node.tag == "form":
        return not (node.holds or node.prose >= FORM_PROSE and 2 * node.prose >= page.prose)
    if node.tag == "header":
        return article is None  # the page's header, not an article's own headline
    if node.readers:
        return not node.holds
    found = set().union(*map(_unlikely, node.hint.split())) if node.hint and not node.holds and node.tag not in ("html", "body", "article", "main") else set()
    if not found:
        return False
    if node.chars and node.linked > PROSE_LINKS * node.chars:
        return True
    if node.tag in ONE_PARAGRAPH or article is not None and found <= WEAK:
        return article is None or node.chars < PROSE_CHARS
    if article is not None:
        return node.chars < SHARE_OF_ARTICLE * article.chars
    return page.holds or node.prose < max(FORM_PROSE, SHARE_OF_PAGE * page.prose)


def _unlikely(name: str) -> set[str]:
    """What in a name is not the article's: ``post-comments`` and ``adBox`` have something, ``with-sidebar`` and ``article-header`` describe something else."""
    parts = _parts(name)
    if _plain(name):
        return set()
    found = UNLIKELY.intersection(parts)
    return set() if found == {"header"} and {"article", "entry", "post", "story"}.intersection(parts) else set(found)


def _parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def _plain(name: str) -> bool:
    """Does a name only say what a block has or lacks?"""
    parts = _parts(name)
    return not parts or parts[0] in ("has", "with", "no", "without")


def measure(nodes: list[Node]) -> None:
    """Characters, those in links and those of long paragraphs, of every node; nodes in page order."""
    for node in reversed(nodes):
        node.chars = node.linked = node.prose = own = 0
        for kid in node.kids:
            if isinstance(kid, str):
                own += len(kid.strip())
            else:
                node.chars += kid.chars
                node.linked += kid.chars if kid.tag == "a" else kid.linked
                node.prose += kid.prose
        node.chars += own
        if node.tag == "p" and node.chars - node.linked >= LONG_TEXT or node.tag in CONTAINER and own >= LONG_TEXT:
            node.prose = max(node.prose, node.chars - node.linked if node.tag == "p" else node.prose + own)


def mark(root: Node, nodes: list[Node]) -> None:
    """Which nodes are what readers write, and which hold the page's article.

    Articles named as comments, and those below a block of that name, are
    readers' if there is an article besides; so is a discussion that has such
    names inside.  Articles inside an article are parts of it.
    """
    named: dict[Node, bool] = {}
    below: dict[Node | None, bool] = {None: False}
    talk: dict[Node | None, Node | None] = {None: None}
    for node in nodes:
        names = {p for name in node.hint.split() if not _plain(name) for p in _parts(name)} if node.hint else set()
        named[node] = bool(names & READERS)
        below[node] = named[node] or below[node.parent]
        if named[node] and (around := talk[node.parent]) is not None:
            around.readers = True
        talk[node] = node if "discussion" in names else talk[node.parent]
        node.readers |= named[node] and node.tag not in ONE_PARAGRAPH and node.tag not in ("html", "body")
    articles = [n for n in nodes if n.tag in ("article", "main")]
    for node in [n for n in articles if not below[n]] or articles:
        above: Node | None = node
        while above is not None and not above.holds:
            above.holds = True
            above = above.parent


def prune(root: Node) -> None:
    """Cut what is never part of an article, without recursion: pages may nest deeply."""
    nodes = _order(root)
    measure(nodes)
    mark(root, nodes)
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, article = todo.pop()
        article = article or (node if node.tag in ("article", "main") else None)
        node.kids = [k for k in node.kids if isinstance(k, str) or not _dropped(k, article, root)]
        todo += [(k, article) for k in node.kids if not isinstance(k, str)]


def _order(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def score(root: Node) -> list[Node]:
    """Set chars, linked and score of every node; gives the nodes in page order."""
    nodes = _order(root)
    measure(nodes)
    for node in nodes:
        block = node.tag in PARAGRAPH or node.tag in CONTAINER and any(isinstance(k, str) and k.strip() for k in node.kids)
        if not block or not node.chars:
            continue
        own = "".join(k if isinstance(k, str) else _flat(k) for k in node.kids if isinstance(k, str) or k.tag not in BLOCK)
        if not own.strip():
            continue
        points = (1 + own.count(",") + min(len(own) / 100, 30)) * (1 - node.linked / node.chars)
        above, depth = (node if node.tag in CONTAINER and node.tag not in PARAGRAPH else node.parent), 0
        while above is not None and depth < 5:
            above.score += points / (1, 2, 6, 9, 12)[depth]
            above, depth = above.parent, depth + 1
    for node in nodes:
        if node.score:
            bonus = 25 if LIKELY.search(node.hint) or node.tag in ("article", "main") else 0
            node.score = (node.score + bonus) * (1 - node.linked / max(1, node.chars))
    return nodes


def _flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo += reversed(item.kids)
    return "".join(out)


def choose(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container, with siblings that belong to it, in page order.

    The best one by score stands for the article around it, if there is one.
    Another article beside it is text of its own, unless it scores like the best
    and has hardly a link; other siblings belong if they score or read like it.
    """
    best = max((n for n in nodes if n.tag in CONTAINER and n.score > 0), key=lambda n: n.score, default=None)
    if best is None:
        return [root]
    above, node = [best], best.parent
    while node is not None:
        above.append(node)
        node = node.parent
    # The whole article, not its longest section; an article inside another is a part of it.
    best = next((n for n in reversed(above) if n.tag == "article"), next((n for n in reversed(above) if n.tag == "main"), best))
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    named, bar, out = best.tag == "article", best.score * 0.2, []
    for kid in best.parent.kids:
        if isinstance(kid, str):
            continue
        density = kid.linked / max(1, kid.chars)
        if kid is best:
            belongs = True
        elif named and kid.tag == "article":
            belongs = kid.score >= best.score * 0.6 and density < 0.05
        else:
            belongs = not named and kid.score >= bar or kid.tag in ("p", "h1", "h2") and kid.chars and density < 0.25 and (kid.tag != "p" or kid.chars > 80)
        if belongs:
            out.append(kid)
    return out


def blocks(chosen: list[Node]) -> list[str]:
    """Text by block: white space becomes one space; a block element, or two line breaks in a row, begins another."""
    out: list[str] = []
    line: list[str] = []
    pre = object()

    def end() -> None:
        if line:
            text = WHITE.sub(" ", "".join(line)).strip()
            if text:
                out.append(text)
            line.clear()

    todo: list = list(reversed(chosen))
    breaks = 0
    while todo:
        item = todo.pop()
        if item is pre:
            end()
        elif isinstance(item, str):
            if item.strip():
                breaks = 0
            line.append(item)
        elif item.tag == "br":
            breaks += 1
            if breaks > 1:
                end()
            line.append(" ")
        else:
            if item.tag in BLOCK:
                end()
                breaks = 0
                todo.append(pre)
            todo += reversed(item.kids)
    end()
    return out


def main_text(source: str | None) -> str:
    """The article's text, one block a line; empty for null, empty or text-free pages."""
    if not source:
        return ""
    root = parse(source.replace("\x00", ""))
    prune(root)
    return "\n".join(blocks(choose(root, score(root))))


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Defined cases: a null, empty or markup-only page has the empty text; a page
    cut off anywhere, even inside a tag or reference, keeps what came before;
    repeated rows give repeated results; further columns are ignored.
    """
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
