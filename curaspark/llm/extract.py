"""Main text of web pages by scoring the element tree.

Paragraphs pass points for length and commas to their ancestors, halved at each level up; a container's points are
discounted by its share of link text. All containers compete. If an article wins, it is kept with its like; another
container is kept with everything beside it that is not mostly links: headings, short paragraphs, sections and loose
text, however short, also at each level up to a main element that holds it. The text is written block by block.

What never counts as content: scripts, styles, forms, menus, page headers and footers, sidebars, adverts, notices and
reader comments, known by element, role or words in class and id. Open tags that authors leave unclosed are closed as
browsers do. Character references are decoded once.

Defined results: a null, empty or text-free page gives an empty text; a page cut off inside a tag, comment or script
ends there; rows that repeat give repeated rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
#: Only these may close themselves by a slash; browsers ignore it elsewhere.
_FOREIGN = frozenset("svg math".split())
_DROPPED = frozenset("script style noscript template iframe svg math form nav footer aside head title button select option input textarea label fieldset dialog menu object embed applet canvas audio video map xmp noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
#: What an opening tag closes, up to the element that holds it.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_JUNK = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|adslot|adbox|adunit|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-?bar|aside|widget|footer|foot|masthead|site-?header|page-?header|header|comments?|comment-?list|disqus|replies|respond|reply|related|recommend(?:ed|ations)?|share|sharing|social|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|paywall|pagination|pager|toolbar|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text|hentry)(?:$|[\s_-])", re.I)
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: An attribute as browsers read it: quotes count only where a value starts, an unquoted value runs to white space or >.
_NAME_VALUE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|$)|'([^']*+)(?:'|$)|([^\s>"'][^\s>]*+))?+)?+"""
_ATTRIBUTE = re.compile(_NAME_VALUE)
_ATTRIBUTES = rf"(?:[\s/]++|{re.sub(r'[(](?![?])', '(?:', _NAME_VALUE)})*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|$)", re.S)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "up", "items", "points", "size", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.items = tag, attrs, up, []
        self.points, self.size, self.linked = 0.0, 0, 0


def parse(page: str) -> Node:
    """The element tree; items of a node are nodes and decoded texts in page order."""
    root = Node("html", {}, None)
    node, at, end = root, 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            node.items.append(entities.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        if closed := found[1]:
            node = _close(node, closed.lower())
        elif opened := found[2]:
            tag = opened.lower()
            node = _open(node, tag)
            attrs = {a.lower(): entities.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(found[3])} if found[3] else {}
            new = Node(tag, attrs, node)
            node.items.append(new)
            if tag in _FOREIGN and _ATTRIBUTE.sub("", found[3]).endswith("/"):
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = close.end() if close else end
            elif tag not in _VOID:
                node = new
        elif found[0].startswith("<![CDATA["):
            node.items.append(found[0][9:].removesuffix("]]>"))
    return root


def _close(node: Node, tag: str) -> Node:
    up = node
    while up is not None and up.tag != tag:
        if up.tag in ("article", "main", "body", "table") and tag not in _BLOCKS:
            return node
        up = up.up
    return up.up if up is not None and up.up is not None else node


def _open(node: Node, tag: str) -> Node:
    closes, within = _IMPLIED.get(tag, (None, None)) if tag not in _CLOSES_P else ({"p"}, {"td", "th", "li", "div", "article", "section", "button", "table"})
    if not closes:
        return node
    up, to = node, node
    while up is not None and up.tag not in within:
        if up.tag in closes and up.up is not None:
            to = up.up
        up = up.up
    return to


def _junk(node: Node, inside: bool) -> bool:
    """inside: within an article or main element, whose own header holds its title."""
    if node.tag in _DROPPED or (node.tag == "header" and not inside):
        return True
    attrs = node.attrs
    if not attrs:
        return False
    if attrs.get("role", "").lower() in _JUNK_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    name = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return bool(node.tag not in ("body", "html", "article", "main") and name.strip() and _JUNK.search(name))


def _measure(root: Node) -> list[Node]:
    """Drops what is never content, sums text and link sizes, passes points up; returns the containers with points."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, inside, linked = stack.pop()
        order.append(node)
        inside |= node.tag in ("article", "main")
        node.items = [x for x in node.items if isinstance(x, str) or not _junk(x, inside)]
        linked |= node.tag == "a" and "href" in node.attrs
        node.size = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.linked = node.size if linked else 0
        stack += [(x, inside, linked) for x in node.items if not isinstance(x, str)]
    commas: dict[int, int] = {}
    scored: dict[int, Node] = {}
    for node in reversed(order):
        commas[id(node)] = sum(x.count(",") if isinstance(x, str) else commas.get(id(x), 0) for x in node.items)
        if (up := node.up) is not None:
            up.size += node.size
            up.linked += node.linked
        loose = node.tag not in _PARAGRAPHS and any(isinstance(x, str) and x.strip() for x in node.items) and node.tag in _BLOCKS
        if (node.tag in _PARAGRAPHS or loose) and node.size:
            points = (1 + commas[id(node)] + min(node.size / 100, 3)) * (1 - node.linked / node.size)
            share, to = 1.0, node if loose else up
            while to is not None and share > 0.1:
                if to.tag in _BLOCKS:
                    to.points += points * share
                    scored[id(to)] = to
                    share /= 2
                to = to.up
    return list(scored.values())


def _score(node: Node) -> float:
    weight = {"article": 1.6, "main": 1.3, "body": 0.7, "html": 0.5, "ul": 0.6, "ol": 0.8, "table": 0.8}.get(node.tag, 1.0)
    if _GOOD.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"):
        weight *= 1.25
    return node.points * weight * (1 - node.linked / max(1, node.size))


def _chosen(root: Node) -> list[Node]:
    containers = _measure(root)
    if not containers:
        articles, stack = [], [root]
        while stack:
            node = stack.pop()
            articles += [node] if node.tag in ("article", "main") else []
            stack += [x for x in node.items if isinstance(x, Node)]
        return articles[:1] or [root]
    best = max(containers, key=_score)
    least = 0.2 * _score(best)
    if best.tag != "article":
        return [_with_siblings(best, least)]
    kept = []
    for item in best.up.items if best.up is not None else [best]:
        alike = isinstance(item, Node) and item.tag == "article" and item.attrs.get("class") == best.attrs.get("class") and _score(item) > 0.1 * least
        if item is best or alike or (isinstance(item, Node) and item.tag == "article" and _score(item) >= least):
            kept.append(item)
    return kept


def _with_siblings(best: Node, least: float) -> Node:
    """The content parent of `best` without what is mostly links: its main element's parent, or its own.

    Parents that hold no other text are passed over.
    """
    top, node = best, best
    while node is not None:
        top = node if node.tag == "main" or node.attrs.get("role", "").lower() == "main" else top
        node = node.up
    node, beyond = best, best is top
    while node.up is not None:
        alone = node.up.size == node.size
        _prune(node.up, node, least)
        node = node.up
        if beyond and not alone:
            break
        beyond |= node is top
    return node


def _prune(parent: Node, best: Node, least: float) -> None:
    """Keeps of the items of `parent` `best` and what is not mostly links; texts and inline elements are judged by the line."""
    kept, line = [], []

    def end() -> None:
        size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in line)
        linked = sum(0 if isinstance(x, str) else x.linked for x in line)
        if 2 * linked <= size:
            kept.extend(line)
        line.clear()

    for item in parent.items:
        if isinstance(item, str) or item.tag not in _BLOCKS:
            line.append(item)
            continue
        end()
        if item is best or 2 * item.linked <= item.size or _score(item) >= least:
            kept.append(item)
    end()
    parent.items = kept


def _blocks(nodes: list[Node]) -> str:
    out, line = [], []

    def end() -> None:
        if text := _SPACE.sub(" ", "".join(line)).strip():
            out.append(text)
        line.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                line.append(item)
            elif item.tag == "br":
                line.append(" ")
            elif item.tag in _BLOCKS:
                end()
                stack.append(None)
                stack += reversed(item.items)
            else:
                stack += reversed(item.items)
        end()
    return "\n".join(out)


def main_text(page: str | None) -> str:
    return _blocks(_chosen(parse(page))) if page else ""


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text (empty if none), n_chars."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
