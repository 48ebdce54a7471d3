"""Main text of web pages by tree scoring.

A page is read into a tree of block elements, without markup that is never text. Every paragraph has
points (one, one a comma, up to three for length), discounted by the share of its text that is link
text. A container that names itself as furniture has its points halved (those of readers' comments are
nearly worthless); it goes unless it holds most of the page's points even so. Paragraphs pass their
points to their parent, and half of them to its grandparent. The article is the smallest container that
holds the one with most points and all others whose own paragraphs score well beside it, but an article
or main element that holds the best bounds it; all its blocks are kept, with the headings, paragraphs,
lists and tables next to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
#: A name, and its value if it has one: what stands in values is never taken for a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Elements of the HTML standard by their part here (fixed values).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROP = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "noscript", "template", "svg", "canvas", "object", "audio", "video", "menu", "dialog", "fieldset", "label", "annotation", "annotation-xml", *RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "center",
}
PROSE = {"p", "pre", "blockquote", "td", "dd", "li"}
#: Of these a part is never the whole article.
PARTS = {"ul", "ol", "dir", "dl", "li", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "p", "pre", "blockquote", "figure", "figcaption", "caption"}
#: Containers of anything: next to the article they need a title, or paragraphs where no element says what the article is.
GENERIC = {"div", "section", "article", "main", "center", "details", "dialog", "search", "td", "th"}
#: What furniture calls itself in the words of a class, id or role (fixed values).
FURNITURE = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|disclaimer|footer|gdpr|header|masthead|menu\w*|modal|nav\w*|newsletter|notice|notices|notification|pagination|pager|popup|promo\w*|recommend\w*|related|replies|respond|search|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|tags?|toolbar|tooltip|widgets?|alert|complementary|contentinfo|navigation)",
    re.I,
)
#: What the article calls itself, what only says where it stands, and what only says that it has furniture beside it.
CONTENT = {"article", "content", "main", "post", "entry", "hentry", "story", "body", "text"}
PLACES, BESIDE = {"sidebar", "side", "header"}, {"has", "with", "no", "without", "is", "show", "hide"}
#: With more words behind them these say what the article is about, or of which kind it is.
KINDS = {"category", "tag", "topic", "type", "status", "format"}
#: Furniture that may hold more prose than the article does.
READERS = re.compile(r"comments?|commentlist|disqus|replies|respond|discussions?", re.I)
#: What a name leaves of a container's points.
FURNITURE_WEIGHT, READERS_WEIGHT = 0.5, 0.02
SCORED = {"div", "article", "section", "main", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class _Node:
    """A block element. heads: inside an article's header, of which only headings count."""

    __slots__ = ("name", "up", "dropped", "heads", "score", "own", "chars", "linked", "title", "prose", "held", "weight", "points")

    def __init__(self, name: str, up: _Node | None, dropped: bool, heads: bool = False, weight: float = 1.0) -> None:
        self.name, self.up, self.dropped, self.heads, self.weight, self.points = name, up, dropped, heads, weight, 0.0
        self.score, self.own, self.chars, self.linked, self.held = 0.0, 0.0, 0, 0, 0
        self.title = self.prose = False  # holds an h1, a paragraph or the like


def _weight(value: str) -> float:
    """What class, id or role names leave of a container's points. A name that the article's own name stands in
    (entry-header) or beside (content sidebar-left) only tells a place, and what follows "with" or "has" is beside
    it; comment-body and main-menu are furniture."""
    found, kinds, content = set(), set(), False
    for name in value.lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        words = words[: next((k for k, w in enumerate(words) if w in BESIDE), len(words))]
        if not words:
            continue
        hits = {w for w in words if FURNITURE.fullmatch(w) or READERS.fullmatch(w)}
        own = not CONTENT.isdisjoint(words)
        if own and hits <= {"header"}:
            hits = set()
        content |= own and not hits
        if words[0] in KINDS and len(words) > 1:
            kinds |= hits
        else:
            found |= hits
    found = found if content else found | kinds
    if not found or content and found <= PLACES:
        return 1.0
    return READERS_WEIGHT if any(READERS.fullmatch(w) for w in found) else FURNITURE_WEIGHT


def _named(name: str, attributes: str) -> tuple[bool, float]:
    """(whether the element is hidden, the weight that its names give it). Of equal attributes the first counts."""
    if not attributes or name in ("html", "body"):
        return False, 1.0
    weight, seen = 1.0, set()
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, 1.0
        if key in ("class", "id", "role"):
            weight = min(weight, _weight(value))
    # an article is halved by no name, only by being a reader's
    return False, 1.0 if name in ("article", "main") and weight == FURNITURE_WEIGHT else weight


def blocks_of(page: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """(element, text, characters in links) of each block of text, in page order, and all block elements,
    parents before children. Blocks whose names speak of furniture are here still. Time grows with the page only: open elements are found by name."""
    root = _Node("html", None, False)
    nodes, open_, places = [root], [root], {"html": [0]}  # open blocks, and where those of a name are
    inline: list[list[tuple[str, bool]]] = [[]]  # of each open block its open inline elements: name, dropped
    counts: list[dict[str, int]] = [{}]
    hidden: dict[str, list[int]] = {}  # blocks in which dropped inline elements are open
    found: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    links, linked, unseen = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((open_[-1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close_inline() -> str:
        nonlocal links, unseen
        name, dropped = inline[-1].pop()
        counts[-1][name] -= 1
        links -= name == "a"
        if dropped:
            unseen -= 1
            hidden[name].pop()
        return name

    def close_block() -> None:
        flush()
        while inline[-1]:
            close_inline()
        inline.pop()
        counts.pop()
        places[open_.pop().name].pop()

    def nearest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen and not open_[-1].dropped:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text.strip())

    at, raw = 0, None
    while True:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            at, raw = (end.start(), None) if end else (len(page), None)
        token = TOKEN.search(page, at)
        add(page[at : token.start()] if token else page[at:])
        if not token:
            break
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["close"]:
            if name == "br":
                pieces.append(" ")
            elif name in BLOCK or places.get(name):
                if len(places.get(name, ())) and places[name][-1]:
                    depth = places[name][-1]
                    while len(open_) > depth:
                        close_block()
            else:
                # what is dropped ends across blocks, other inline elements only inside theirs
                if hidden.get(name):
                    while len(open_) > hidden[name][-1] + 1:
                        close_block()
                if counts[-1].get(name):
                    while close_inline() != name:
                        pass
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append(" ")
            continue
        if name in ("html", "body"):
            continue
        attributes = token["attributes"]
        gone, weight = _named(name, attributes)
        # an element of the page's own kind may hold blocks: with such a name it is judged as one
        if name not in BLOCK and not ("-" in name and weight < 1 and not gone):
            if attributes.endswith("/") and name in ("svg", "path"):
                continue
            if name in ("a", "option") and counts[-1].get(name):  # neither holds itself
                while close_inline() != name:
                    pass
            dropped = name in DROP or gone or weight < 1
            inline[-1].append((name, dropped))
            counts[-1][name] = counts[-1].get(name, 0) + 1
            links += name == "a"
            if dropped:
                unseen += 1
                hidden.setdefault(name, []).append(len(open_) - 1)
            if name in RAW:
                raw = name
            continue
        if open_[-1].name == "p":
            close_block()
        else:
            flush()
        if name in SAME:
            same = nearest(SAME[name])
            if same > max(0, nearest(SCOPE[name])):
                while len(open_) > same:
                    close_block()
        up = open_[-1]
        own = gone or weight < 1
        inside = name == "header" and bool(places.get("article") or places.get("main"))
        heads = not own and (up.heads or inside and not up.dropped) and (name not in DROP or inside)
        dropped = gone or name in DROP or bool(unseen) or up.dropped
        if dropped and up.heads and name in HEADINGS and not own and not unseen:
            dropped = False
        node = _Node(name, up, dropped, heads, weight)
        places.setdefault(name, []).append(len(open_))
        nodes.append(node)
        open_.append(node)
        inline.append([])
        counts.append({})
        if name in RAW:
            raw = name
    while len(open_) > 1:
        close_block()
    flush()
    return found, nodes


def _points(node: _Node, text: str, linked: int) -> float:
    if node.name in PROSE or node.name in SCORED or "-" in node.name:
        return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    return 0.0


def _without_furniture(found: list[tuple[_Node, str, int]], nodes: list[_Node]) -> list[tuple[_Node, str, int]]:
    """Blocks outside containers whose names speak of furniture. A container that holds more than half of the
    page's points after its name has lowered them stays, unless an article or main element that it neither holds
    nor stands in has prose. If none is left outside such containers, all blocks stay."""
    for node, text, linked in found:
        node.points += _points(node, text, linked)
    for node in reversed(nodes[1:]):
        node.up.points += node.weight * node.points
    total = nodes[0].points
    named = set()  # what holds an article or main element with prose, or stands in one
    plain = {id(nodes[0])}  # outside containers with such names
    for node in nodes[1:]:
        if node.weight == 1 and id(node.up) in plain:
            plain.add(id(node))
        if id(node.up) in named or node.name in ("article", "main") and node.points > 0 and id(node) in plain:
            named.add(id(node))
    marked = bool(named)
    for node in reversed(nodes[1:]):
        if id(node) in named or node.name in ("article", "main") and node.weight == 1 and node.points > 0:
            named.add(id(node.up))
    gone: set[int] = set()
    for node in nodes[1:]:
        if id(node.up) in gone:
            gone.add(id(node))
        elif node.weight < 1:
            left = node.weight * node.points
            if 2 * left > total and not (marked and id(node) not in named):
                total += node.points - left
            else:
                gone.add(id(node))
    out = [x for x in found if id(x[0]) not in gone]
    return out if any(_points(*x) > 0 for x in out) or not any(_points(*x) > 0 for x in found) else found


def _bound(best: _Node) -> _Node | None:
    """The outermost article around the best container, or the outermost main where there is none."""
    bound, up = None, best
    while up is not None:
        if up.name == "article" or up.name == "main" and (bound is None or bound.name == "main"):
            bound = up
        up = up.up
    return bound


def _inside(node: _Node, known: dict[int, bool]) -> bool:
    """Whether one of the known elements, which are marked as such, holds the node."""
    path = []
    while id(node) not in known:
        path.append(node)
        node = node.up
    known.update((id(n), known[id(node)]) for n in path)
    return known[id(node)]


def main_text(page: str | None) -> str:
    """The article's blocks joined by two \\n; empty for null, empty or textless pages.

    A page with no prose block at all gives its other blocks outside furniture. An article's neighbours that are
    articles too belong to it where they score well, other containers outside it don't. Very long pages are
    read whole, in time that grows with their length; unclosed and misnested elements are closed as
    browsers do, roughly. Of containers with equal points the first on the page is the best.
    """
    found, nodes = blocks_of(page or "")
    found = _without_furniture(found, nodes)
    if not found:
        return ""
    scored: dict[int, _Node] = {}
    for node, text, linked in found:
        node.chars += len(text)
        node.linked += linked
        node.title |= node.name == "h1"
        node.prose |= node.name in PROSE
    for node in reversed(nodes[1:]):  # children come after their parents
        up = node.up
        up.chars, up.linked, up.title, up.prose = up.chars + node.chars, up.linked + node.linked, up.title | node.title, up.prose | node.prose
    for node, text, linked in found:
        if node.name in PROSE or node.name in SCORED or "-" in node.name:
            points = _points(node, text, linked)
            near = node.up if node.name in PROSE else node
            if near is not None:
                near.own += points
            for share in (1.0, 0.5):
                if near is not None:
                    near.score += points * share
                    scored[id(near)] = near
                    near = near.up
    plain = lambda n: 1 - n.linked / max(1, n.chars)
    if not scored:
        return "\n\n".join(text for _, text, _ in found)
    best = max(scored.values(), key=lambda n: n.score * plain(n))
    cut = 0.2 * best.score * plain(best)
    good = [n for n in scored.values() if n is best or n.own * plain(n) > max(cut, 0)]
    bound = _bound(best)
    if bound is not None:
        alike = {id(nodes[0]): False} | {id(n): True for n in nodes if n is bound or bound.name == n.name == "article" and n.up is bound.up}
        good = [n for n in good if _inside(n, alike)]
    for n in good:
        n.held = 1
    for n in reversed(nodes[1:]):
        n.up.held += n.held
    top = best
    while top.held < len(good):
        top = top.up
    while top.name in PARTS and top.up is not None and top.up.name in PARTS:
        top = top.up
    up = top
    while up is not None and up.name not in ("article", "main"):
        up = up.up
    named = up is not None
    whole = named or top is best
    top = up or top
    around = top.up
    verdict: dict[int, bool] = {id(top): True}

    def kept(node: _Node, text: str, linked: int) -> bool:
        if node is around:  # text of its own, between its containers
            return linked < 0.25 * len(text)
        path = []
        while id(node) not in verdict:
            path.append(node)
            up = node.up
            if up is top:
                # beside well-scored containers, one of links alone is navigation
                verdict[id(node)] = whole or node.name in PROSE or node.held or plain(node) >= 0.5
            elif up is around or up is None:
                verdict[id(node)] = up is not None and plain(node) > 0.75 and (node.name not in GENERIC or node.title or node.prose and not named)
            else:
                node = up
        good = verdict[id(node)]
        verdict.update((id(n), good) for n in path)
        return good

    return "\n\n".join(text for node, text, linked in found if kept(node, text, linked))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, ``text``, ``n_chars`` in code points) of each row; null pages are empty. No shuffle."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))
    out = rows.mapInArrow(run, f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
