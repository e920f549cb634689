"""Main text of HTML pages by composite text density.

Every DOM node has a density: its characters per tag, weighted down by how much
of it is links. A node's density sum adds up its children's densities. The node
of the largest sum is the article's container; on the way from the body to it
the least density is the threshold that what stands beside the way must reach.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML format.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: Open elements that a start tag ends, looked for up to the nearest element of the second set.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# What no article consists of: elements, roles, and words of class and id names.
OUT_TAGS = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "label", "button", "input", "select", "textarea",
    "iframe", "svg", "math", "object", "embed", "canvas", "dialog", "menu", "audio", "video", "datalist",
}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "comment", "comments", "disqus",
    "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "social", "share", "sharing", "related", "recommended", "recommendations", "widget", "widgets", "toolbar", "pagination",
    "pager", "login", "signup", "skip",
}
#: Words that name the page's head, unless they are inside the article.
HEAD_WORDS = {"header", "head"}
#: Words before a hyphen that tell what a node has or lacks, not what it is.
STATES = {"has", "with", "no", "without"}
#: Names that hold even where most of the page's text is below them.
REPLY_WORDS = {"comment", "comments", "disqus", "replies"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_OUT = {"html", "body", "main", "article"}
#: A tag that the page breaks off in.
UNFINISHED = re.compile(r"<[A-Za-z/][^<>]*\Z")


def _words(names: str) -> set[str]:
    """Each class or id name, and what stands before its first and behind its last hyphen or underscore.

    A name such as has-sidebar or no-banner is of something else than its node.
    """
    found = set()
    for name in names.lower().split():
        parts = name.replace("_", "-").split("-")
        found |= {name} if len(parts) > 1 and parts[0] in STATES else {name, parts[0], parts[-1]}
    return found


class _Tree(HTMLParser):
    """Nodes as parallel lists in page order, so that children follow their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.out, self.link, self.items = ["#root"], [-1], [False], [False], [[]]
        #: The listed words a node is called by; they count only where ``settle`` finds no article below.
        self.called: list[set[str]] = [set()]
        self.open = [0]
        #: Depths in ``open`` of each tag and of all blocks, so that no tag is looked for step by step.
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def _inside_article(self) -> bool:
        return bool(self.depths.get("article") or self.depths.get("main"))

    def _is_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER_OUT:
            return False
        if tag in OUT_TAGS or (tag == "header" and not self._inside_article()):
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "role" and value and value.lower() in OUT_ROLES:
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _called(self, attrs: list[tuple[str, str | None]]) -> set[str]:
        words = set().union(*(_words(value) for name, value in attrs if name in ("class", "id") and value))
        if words & HEAD_WORDS and not self._inside_article():
            return words & (OUT_WORDS | HEAD_WORDS)
        return words & OUT_WORDS

    def settle(self) -> list[int]:
        """Put out what is called by a listed word, except what holds the article; every node's own characters.

        That is a node with the page's main in it, without one a node with all
        its articles, or one with most of the body's characters that are no links.
        """
        n = len(self.tag)
        own, plain, mains, articles = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.out[i]:
                continue
            own[i] = sum(len(" ".join(x.split())) for x in self.items[i] if isinstance(x, str))
            if not self.link[i]:
                plain[i] += own[i]
            if not self.called[i]:
                mains[i] += self.tag[i] == "main"
                articles[i] += self.tag[i] == "article"
            p = self.parent[i]
            if p >= 0:
                plain[p] += plain[i]
                mains[p] += mains[i]
                articles[p] += articles[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        for i in range(1, n):
            if self.out[self.parent[i]]:
                self.out[i] = True
            elif self.called[i] and self.tag[i] not in NEVER_OUT:
                most = 2 * plain[i] > plain[body] and not self.called[i] & REPLY_WORDS
                self.out[i] = self.out[i] or not (most or mains[i] or (not mains[0] and 0 < articles[i] == articles[0]))
        return own

    def _close_to(self, depth: int) -> None:
        for node in reversed(self.open[depth:]):
            self.depths[self.tag[node]].pop()
        del self.open[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and self.blocks and self.tag[self.open[self.blocks[-1]]] == "p":
            self._close_to(self.blocks[-1])
        if tag in ENDED_BY:
            ended, until = ENDED_BY[tag]
            bound = max((d[-1] for d in map(self.depths.get, until) if d), default=0)
            found = [d[at] for d in map(self.depths.get, ended) if d and (at := bisect_right(d, bound)) < len(d)]
            if found:
                self._close_to(min(found))
        parent = self.open[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(self.out[parent] or self._is_out(tag, attrs))
        self.called.append(self._called(attrs))
        self.link.append(self.link[parent] or tag == "a")
        self.items.append([])
        self.items[parent].append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depths = self.depths.get(tag)
        # An end tag of no block ends nothing outside the innermost open block.
        if depths and (tag in BLOCK or not self.blocks or self.blocks[-1] <= depths[-1]):
            self._close_to(depths[-1])

    def handle_data(self, data: str) -> None:
        if not self.out[self.open[-1]]:
            self.items[self.open[-1]].append(data)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density. ``ratio`` is the share of link characters in the whole body."""
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + ratio * chars + math.e)
    inner = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(inner, 1.0) if inner > 0 else 1.0) / base if inner > 1 else 0.0


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the main text in page order, white space in each made single spaces; none without text.

    What is out (menus, page heads and feet, asides, notices, adverts, controls of
    forms, scripts, styles, comments, hidden parts) neither counts nor shows; a
    class or id name puts nothing out that holds the article. Containers are nodes
    that hold blocks, or the body; right below the body, blocks of links alone are
    no text unless they are headings, which count as if they had no link. Of equal sums the first node in page
    order is taken. A page without a body is one from its root.
    """
    tree = _Tree()
    tree.feed(UNFINISHED.sub("", html or ""))
    tree.close()
    own = tree.settle()
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    holds = [False] * n
    for i in range(n - 1, -1, -1):
        if tree.out[i]:
            continue
        chars[i] += own[i]
        if tree.link[i]:
            link_chars[i] += own[i]
        p = tree.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
            holds[p] = holds[p] or tree.tag[i] in BLOCK
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    ratio = link_chars[body] / max(chars[body], 1)
    density = [0.0 if tree.out[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[tree.parent[i]] += density[i]
    inside = [i == body for i in range(n)]
    for i in range(body + 1, n):
        inside[i] = inside[tree.parent[i]]
    best = max((i for i in range(n) if inside[i] and not tree.out[i] and (holds[i] or i == body)), key=lambda i: (sums[i], -i), default=body)
    way, at = {best}, best
    while at != body:
        at = tree.parent[at]
        way.add(at)
    least = min(density[i] for i in way)

    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    # (node, whether its whole content is taken, position in its items)
    stack = [(body, body == best, iter(tree.items[body]))]
    while stack:
        node, whole, items = stack[-1]
        for item in items:
            if isinstance(item, str):
                if whole:
                    now.append(item)
                continue
            if tree.out[item]:
                continue
            if tree.tag[item] in ("br", "hr"):
                now.append(" ")
                continue
            reached = density[item]
            if node == body and tree.tag[item] in BLOCK and 0 < chars[item] == link_chars[item]:
                if tree.tag[item] not in HEADINGS:
                    continue  # a list of links beside the text
                reached = _density(chars[item], tags[item] - link_tags[item], 0, 0, ratio)
            taken = whole or item == best or (item not in way and reached >= least > 0)
            if not taken and item not in way:
                continue
            if tree.tag[item] in BLOCK:
                flush()
            stack.append((item, taken, iter(tree.items[item])))
            break
        else:
            stack.pop()
            if tree.tag[node] in BLOCK:
                flush()
    flush()
    return blocks


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page: its main blocks joined by an empty line.

    Null html is an empty page; a page without main text has an empty text. Each
    row stands for itself, repeated ones too, and other columns are ignored. A
    page is one task's work, in memory in proportion to its own length.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = ["\n\n".join(main_blocks(h.as_py())) for h in batch.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return base.mapInArrow(run, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT")
