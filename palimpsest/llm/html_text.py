"""Main text of HTML pages by tree scoring.

The page is read into a tree with the implied end tags of HTML. Parts that never hold the article (scripts, forms,
navigation, footers, and containers whose class, id or role says advert, menu, notice, comments and the like) are
cut. Each block of text passes points for its length and commas to its parent, half to the next ancestor and a third
to the one above; a container's points are discounted by its share of link text. The best container is kept, with
those of its siblings that score well themselves or are running text without links. If the best container lies in an
article or main element, that whole element is kept instead (all that is not cut).

Inside an article, main element or container named as one, a name alone cuts only if it says nothing else: each of its
parts names what is not the article or is a plain word for a box ("related-links", not "related-work"). Other names that
hold such a part cut there only where more than half of the text is in links.

Blocks are the text between block-level tags. White space in a block, line breaks included, is one space. Cases: null
and empty pages have the empty text; broken and cut-off mark-up is read as far as it goes; a page with no container
of positive score gives what is left of its body. Nesting is followed to any depth without recursion, in
time linear in the page: open tags are counted, and sums over subtrees are made once, from the leaves up.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vec
from .store import refuse

#: What is never shown or never article text.
CUT = frozenset("script style noscript template svg math iframe object embed canvas audio video head title nav footer aside form button select textarea input label fieldset menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINER = frozenset("article body blockquote center dd details div dl figure html li main ol section table tbody td tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element, and the elements beyond which they don't look.
IMPLIED = {
    **dict.fromkeys(BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dd dt".split()), (frozenset(["p"]), frozenset("button td th caption table object".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu table td".split())),
    "dd": (frozenset(["dd", "dt", "p"]), frozenset(["dl", "table"])),
    "dt": (frozenset(["dd", "dt", "p"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])),
}
# Words in a class, id or role that mark what is not the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comment|comments|commentlist|comment-list|disqus|respond|replies|reply|reader-comments|discussion|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|topbar|"
    r"masthead|site-header|page-header|header|footer|foot|copyright|legal|social|share|sharing|related|recommend\w*|widget|toolbar|search|form|hidden|skip|contentinfo|complementary|search|dialog)(?=$|[\s_-])",
    re.I,
)
# Whole names of the article's own containers, and parts of names that only say what else the layout has.
LIKELY = frozenset("article content main entry story post main-content article-body article-content post-content post-body entry-content story-body".split())
BOXES = frozenset("area bar block bottom box button buttons container content group inner item items left links list outer panel posts articles stories section top right wrap wrapper main site page".split())
LAYOUT = re.compile(r"(?:^|[_-])(?:with|has|no|without)(?=[_-])", re.I)

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_name = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element. block: the nearest block element, itself included; open: of a block, how many of each inline tag are open in it."""

    __slots__ = ("tag", "up", "parts", "cut", "weak", "inside", "block", "open", "points", "chars", "linked", "kept")

    def __init__(self, tag: str, up: Node | None, attributes: str = ""):
        self.tag, self.up = tag, up
        self.parts: list[Node | str] = []
        self.points, self.chars, self.linked, self.kept = 0.0, 0, 0, False
        self.block = self if up is None or tag in BLOCK else up.block
        self.open: dict[str, int] = {}
        self.cut, self.weak = False, False
        self.inside = up is not None and up.inside
        if up is not None:
            self._judge(attributes)
        self.inside |= tag in ("article", "main")

    def _judge(self, attributes: str) -> None:
        """cut, if it is no part of the article for sure; weak, if its links must tell."""
        tag = self.tag
        if tag in CUT:
            self.cut = True
        elif tag == "header":
            self.cut = not self.inside
        if self.cut or tag in ("body", "html", "main") or not attributes or tag not in BLOCK | {"span", "a"}:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _name.finditer(attributes)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            self.cut = True
            return
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split()
        if LIKELY.intersection(names):
            self.inside = True
            return
        unlikely = [n for n in names if UNLIKELY.search(n) and not LAYOUT.search(n)]
        if unlikely and self.inside:
            sure = any(all(x in BOXES or UNLIKELY.fullmatch(x) for x in re.split(r"[_-]+", n) if x) for n in unlikely)
            self.cut, self.weak = sure, not sure
        else:
            self.cut = bool(unlikely)


def tree(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements, each after the one that holds it."""
    root = Node("html", None)
    nodes = [root]
    opened: dict[str, int] = {}  # open block elements by tag
    at, place, end = root, 0, len(page)

    def leave(to: Node) -> Node:
        """Close elements up to ``to``, which stays open."""
        node = at
        while node is not to:
            held = opened if node.tag in BLOCK else node.block.open
            held[node.tag] -= 1
            node = node.up
        return to

    def enter(node: Node) -> Node:
        held = opened if node.tag in BLOCK else node.block.open
        held[node.tag] = held.get(node.tag, 0) + 1
        return node

    while place < end:
        found = _token.search(page, place)
        if not found:
            at.parts.append(page[place:])
            break
        if found.start() > place:
            at.parts.append(page[place : found.start()])
        place = max(found.end(), found.start() + 1)
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            # An inline end tag doesn't look beyond its block.
            if (opened if tag in BLOCK else at.block.open).get(tag, 0) > 0:
                node = at
                while node.tag != tag:
                    node = node.up
                if node.up:
                    at = leave(node.up)
            continue
        if tag in ("html", "body"):
            if tag == "body" and at is root:
                node = Node("body", root)
                nodes.append(node)
                root.parts.append(node)
                at = enter(node)
            continue
        if tag in IMPLIED:
            ends, beyond = IMPLIED[tag]
            node, last = at.block, None
            while node.up and node.tag in ends and node.tag not in beyond:
                last, node = node, node.up.block
            if last:
                at = leave(last.up)
        node = Node(tag, at, found[3])
        nodes.append(node)
        at.parts.append(node)
        if tag in VOID or found[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, place)
            node.parts.append(page[place : closing.start() if closing else end])
            place = closing.end() if closing else end
            continue
        at = enter(node)
    return root, nodes


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(element that holds it, text, characters in links) of each block under ``top``, in page order."""
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0

    def flush(holder: Node) -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append((holder, whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(top, 0, top, False)]
    while stack:
        node, i, holder, in_link = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush(stack[-1][2] if stack else holder)
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                text.append(part)
                if in_link:
                    linked += len(" ".join(part.split()))
            elif part.cut:
                if part.tag in BLOCK:
                    flush(holder)
            elif part.tag == "br":
                text.append(" ")
            else:
                stack.append((node, i, holder, in_link))
                stack.append((part, 0, part if part.tag in BLOCK else holder, in_link or part.tag == "a"))
                break
        else:
            if node.tag in BLOCK:
                flush(holder)
    return out


def _sums(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """chars and linked of each element: of the blocks in it."""
    for node in nodes:
        node.chars = node.linked = 0
    for holder, text, linked in found:
        holder.chars += len(text)
        holder.linked += linked
    for node in reversed(nodes):
        if node.up:
            node.up.chars += node.chars
            node.up.linked += node.linked


def extract(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = tree(page)
    found = blocks(root)
    _sums(nodes, found)
    weak = [node for node in nodes if node.weak and 2 * node.linked > node.chars]
    if weak:
        for node in weak:
            node.cut = True
        found = blocks(root)
        _sums(nodes, found)
    seen: list[Node] = []
    for holder, text, _ in found:
        # Commas of the text, and a point for each hundred characters up to three; a short block still counts a little.
        points = min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3) if holder.tag not in HEADING else 0.1
        at: Node | None = holder if holder.tag in CONTAINER else holder.up
        for share in (1, 2, 3):
            if not at:
                break
            if not at.points:
                seen.append(at)
            at.points += points / share
            at = at.up
    best, most = None, 0.0
    for node in seen:
        score = node.points * (1 - node.linked / max(1, node.chars))
        if score > most:
            best, most = node, score
    if best is None:
        return "\n".join(t for _, t, linked in found if linked < len(t))
    whole = best
    for tag in ("article", "main"):
        at = best
        while at and at.tag != tag:
            at = at.up
        if at:
            whole = at
            break
    whole.kept = True
    if whole is best and best.up and best.tag not in ("article", "main"):
        for other in best.up.parts:
            if isinstance(other, Node) and other is not best and not other.cut and other.tag in BLOCK:
                if other.tag in CONTAINER:
                    other.kept = other.points * (1 - other.linked / max(1, other.chars)) >= max(10, 0.2 * most)
                else:
                    other.kept = other.tag in HEADING or bool(other.chars) and other.linked < 0.25 * other.chars
    for node in nodes:  # each after the one that holds it
        if node.up and node.up.kept:
            node.kept = True
    return "\n".join(text for holder, text, _ in found if holder.kept)


def extract_text(pages: DataFrame, source: str = "html", column: str = "text") -> DataFrame:
    """pages with ``column``, the main text of each page; other columns as they are."""
    refuse(pages, column)
    at = pages.columns.index(source)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = pa.array([extract(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, column])

    return pages.mapInArrow(vec.tidy(run), T.StructType([*pages.schema.fields, T.StructField(column, T.StringType())]))
