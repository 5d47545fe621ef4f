"""Main text of web pages by composite text density (operator 3).

A page becomes a tree of elements, in one pass whose time is linear in the page.
Elements that are never article text (scripts, menus, footers, forms, hidden
parts and the like, known by element or role) are taken out.  Names of classes
and ids are evidence only: an element named like an advert, a notice, a sidebar
or reader comments goes, unless it holds the title, or most of the text of a page whose title is nowhere else.  For
every other node the density is its characters per tag, raised or lowered by how
much of it is links; a node's density sum adds up its children's.  The node with
the largest sum is the main subtree.  It is widened on the way up to the body by
the neighbours that are not mostly links and at least as dense as the threshold,
the least density on that way, or stand between such; headings belong to what
follows them, and within one article or main element of the page a neighbour
need not be dense.

The text of the chosen nodes is cut into blocks at block elements; within a
block runs of white space (``br`` included) are one space; blocks are joined by
an empty line, in page order.  Nothing else is dropped or shortened.

Defined results: a null, empty or textless page has the text ""; markup that
does not nest is repaired; repeated rows are each reported; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard and of common page templates.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FORMATTING = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
_ENDS_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend".split())
#: Element: the open elements it closes, and those that shield from it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()), "a": ({"a"}, {"td", "th", "li", "div", "p", "table"}),
}
_NEVER_TEXT = frozenset("script style noscript template textarea title head nav footer aside form button select option datalist input iframe object embed canvas svg video audio map dialog menu noembed noframes xmp search".split())
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NEVER_NAME = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|sidenav|widgets?"
    r"|related|recommended|recommendations|shar(?:e|ing)|social|comments?|commentlist|disqus|replies|reply|respond|breadcrumbs?|menus?|nav|navbar|navigation|footer|header|masthead|topbar|pagination|pager|toolbar|skip|disclaimer)(?:$|[-_]|\d)",
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, or the end of a tag; a quote opens a value only right after the sign.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*|(?=>))))?)")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``inside`` has its child nodes and texts in order."""

    __slots__ = ("tag", "attributes", "parent", "inside", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "titles", "headed")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.inside = tag, attributes, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0
        self.titles, self.headed = int(tag in ("h1", "main")), tag in ("h1", "h2")

    def get(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes) if self.attributes else ():
            if m[2]:
                found.setdefault(m[2].lower(), _html.unescape(m[3] or m[4] or m[5] or ""))
        return found


class _Scanner:
    """Where tags end. A page is never looked through twice for what it lacks."""

    def __init__(self, page: str):
        self.page, self.last, self.loose = page, page.rfind(">"), False
        self.quotes = {q: page.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if self.last < at:
            return -1
        if not self.loose:
            here = at
            while m := _ATTRIBUTE.match(self.page, here):
                if m[1]:
                    return m.start(1)
                here = m.end()
            self.loose = True  # a quote that nothing closes
        return self.page.find(">", at)


def parse(page: str) -> Node:
    """The tree of a page, with end tags implied and stray ones passed over."""
    root = Node("#root", "", None)
    here, at, n = root, 0, len(page)
    scanner = _Scanner(page)
    open_: Counter[str] = Counter()
    stray: dict[str, Node] = {}  # where an end tag last closed nothing
    raw_ends: dict[str, list[int]] = {}

    def leave(to: Node) -> Node:
        """Close all up to and with the child of ``to``."""
        node = here
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent
        return to

    text_from = 0

    def text_to(end: int) -> None:
        if end > text_from:
            here.inside.append(_html.unescape(page[text_from:end]))

    while (at := page.find("<", at)) >= 0:
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?"):
            text_to(at)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", at) if scanner.last > at else -1
                at = n if end < 0 else end + 1
            text_from = at
            continue
        ends = follows == "/"
        m = _NAME.match(page, at + 1 + ends)
        stop = scanner.tag_end(m.end()) if m else -1
        if stop < 0:
            at += 1
            continue
        text_to(at)
        attributes, tag = page[m.end() : stop], m[0].lower()
        at = text_from = stop + 1
        if ends:
            if tag in _VOID:
                if tag == "br":
                    here.inside.append(" ")
                continue
            if not open_[tag] or stray.get(tag) is here:
                continue
            up = here
            while up is not root and up.tag != tag:
                if tag in _FORMATTING and up.tag in _BLOCK:  # a formatting end tag closes no block
                    up = root
                    break
                if up.tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = leave(up.parent)
            else:
                stray[tag] = here
            continue
        if tag in _ENDS_P and open_["p"]:
            up = here
            while up is not root and up.tag != "p" and (up.tag not in _BLOCK):
                up = up.parent
            if up.tag == "p":
                here = leave(up.parent)
        if tag in _CLOSES:
            closed, shields = _CLOSES[tag]
            up, last = here, None
            if any(open_[x] for x in closed):
                while up is not root and up.tag not in shields:
                    if up.tag in closed:
                        last = up
                    up = up.parent
            if last is not None:
                here = leave(last.parent)
        node = Node(tag, attributes, here)
        here.inside.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK and tag not in _FORMATTING:
            continue
        if tag in _RAW:
            if tag not in raw_ends:  # all of them at once, the last first
                raw_ends[tag] = [x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)][::-1]
            while raw_ends[tag] and raw_ends[tag][-1] < at:
                raw_ends[tag].pop()
            end = raw_ends[tag][-1] if raw_ends[tag] else n
            node.inside.append(page[at:end])
            behind = page.find(">", end) if scanner.last >= end else -1
            at = text_from = n if end == n or behind < 0 else behind + 1
            continue
        here = node
        open_[tag] += 1
    text_to(n)
    return root


def _walk(node: Node) -> Iterator[Node]:
    work = [node]
    while work:
        one = work.pop()
        yield one
        work.extend(x for x in reversed(one.inside) if isinstance(x, Node))


def _never(node: Node) -> bool:
    """Whether an element cannot be article text, whatever it holds."""
    if node.tag in _NEVER_TEXT:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    have = node.get()
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", have.get("style", ""), re.I):
        return True
    return have.get("role", "").lower() in _NEVER_ROLE


def _suspect(node: Node) -> bool:
    """Whether an element is named like something beside the article."""
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    have = node.get()
    return any(_NEVER_NAME.search(x.lower()) for x in (have.get("class", "") + " " + have.get("id", "")).split())


def _prune(root: Node) -> None:
    """Take out what is not the article's."""
    work = [root]
    while work:
        node = work.pop()
        node.inside = [x for x in node.inside if not isinstance(x, Node) or not _never(x)]
        work.extend(x for x in node.inside if isinstance(x, Node))
    order = list(_walk(root))
    weight = {}
    for node in reversed(order):
        own = sum(len(_SPACE.sub("", x)) if isinstance(x, str) else weight[id(x)] for x in node.inside)
        weight[id(node)] = own
        for x in node.inside:
            if isinstance(x, Node):
                node.titles += x.titles
                node.headed |= x.headed
    articles = {}
    for node in reversed(order):
        articles[id(node)] = node.tag == "article" or any(articles[id(x)] for x in node.inside if isinstance(x, Node))
    most, within = weight[id(root)], {id(root): False}  # whether a node stands in an article
    work = [root]
    while work:
        node = work.pop()
        kept = []
        for x in node.inside:
            if isinstance(x, Node):
                within[id(x)] = within[id(node)] or node.tag in ("article", "main")
                holds = x.titles or 2 * weight[id(x)] > most and not root.titles and articles[id(x)] == articles[id(root)]
                # the site's header goes; an article's own, with its title, stays
                if x.tag == "header" and not (within[id(x)] and x.headed) or not holds and _suspect(x):
                    continue
                work.append(x)
            kept.append(x)
        node.inside = kept


def _measure(body: Node) -> None:
    """Characters, tags and densities of every node below and with ``body``."""
    order = list(_walk(body))
    for node in reversed(order):
        for x in node.inside:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len(_SPACE.sub("", x))
        if node.tag == "a":
            node.link_chars = node.chars
    all_linked = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        tags = max(node.tags, 1)
        node.density = node.chars / tags
        base = math.log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + all_linked * node.chars + math.e)
        if base > 1 and node.chars:
            ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
            node.density *= max(math.log(ratio) / math.log(base), 0.0) if ratio > 0 else 0.0
        node.density_sum = sum(x.density for x in node.inside if isinstance(x, Node))


def main_nodes(root: Node) -> list[Node | str]:
    """The nodes, and texts between them, that hold the main text, in page order; they do not overlap."""
    _prune(root)
    body = next((x for x in _walk(root) if x.tag == "body"), root)
    _measure(body)
    if not body.chars:
        return []
    best = max(_walk(body), key=lambda x: x.density_sum)
    path, up = [best], best
    while up is not body:
        up = up.parent
        path.append(up)
    threshold = min(x.density for x in path)
    around = max((k for k, x in enumerate(path) if x.tag in ("article", "main") or x.attributes and x.get().get("role") == "main"), default=0)
    chosen = [best]
    for k, (below, parent) in enumerate(zip(path, path[1:], strict=False)):
        nodes = [x for x in parent.inside if isinstance(x, Node) and x.chars or isinstance(x, str) and x.strip()]
        take = []
        for x in nodes:
            if isinstance(x, str):
                take.append(k < around or parent is not body)
            else:
                take.append(x is below or 2 * x.link_chars < x.chars and (k < around or x.density >= threshold))
        for i in range(len(nodes) - 2, -1, -1):  # a heading goes with what follows it
            if isinstance(nodes[i], Node) and nodes[i].tag in _HEADINGS and take[i + 1]:
                take[i] = True
        known = [i for i, t in enumerate(take) if t]
        for i in range(known[0], known[-1]):
            x = nodes[i]
            take[i] |= isinstance(x, str) or 2 * x.link_chars < x.chars
        if all(take):
            chosen = [parent]
        else:
            chosen = [y for i, x in enumerate(nodes) for y in (chosen if x is below else [x] if take[i] else [])]
    return chosen


def _blocks(node: Node | str) -> Iterator[str]:
    """The texts of a node's blocks."""
    parts: list[str] = []
    work: list[tuple[object, bool]] = [(node, False)]
    while work:
        one, leaving = work.pop()
        if isinstance(one, str):
            parts.append(one)
        elif one.tag == "br":
            parts.append(" ")
        else:
            if one.tag in _BLOCK or one is node:
                if text := _SPACE.sub(" ", "".join(parts)).strip():
                    yield text
                parts = []
            if not leaving:
                work.append((one, True))
                work.extend((x, False) for x in reversed(one.inside))
    if text := _SPACE.sub(" ", "".join(parts)).strip():
        yield text


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(block for node in main_nodes(parse(page)) for block in _blocks(node))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The key columns, text and n_chars (code points) of each page. Row by row, without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(x.as_py()) for x in part.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string, n_chars long"
    return pages.select(*keys, pages[html_col].cast("string").alias("__html")).mapInArrow(run, schema)
