"""HTML main-text extraction by consensus host paths.

Every page is read into a light tree.  Its containers are scored by the running text
that they hold, less links and boilerplate, and the page votes for the generalised
path of its best container, widened until no container with running text is left out
beside it (an article is left only for a main element around it that holds no other article): tag names with their classes, digits
and ids dropped.  Votes are added up by host and path in Spark; a host's winning path is the one most of
its pages voted for.  In a second pass each page's text is taken from the containers at
the winning path; a page that lacks it, or finds nothing there, uses its own best one.

What is boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) is decided so.
Scripts, styles and hidden elements never show text.  Elements made for boilerplate, and those whose class, id or role names it, are
only suspects, and go unless the page would lose its text: a suspect that wraps the page's only article, main or first heading is cleared (unless its name
says comments, footer, notice or advert), and if no running text at all is left outside of suspects, the largest one is.  Clearing one leaves the
suspects inside it suspects.  However long a thread of comments is, it never outweighs an article.  Nothing else is dropped.

Character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined in page order by a blank line.

Defined results: null or empty html gives the empty text; a page without a container
counts its whole body as one; null urls share the empty host; ties between paths go to
the longer path, then to the smaller string; ties between suspects and between containers go to the one that comes first; repeated rows give
repeated results and a vote each; a tag whose quoted value never ends is taken to end at the next ``>``, as are all later ones of that page; a very long or
deeply nested page is read in time linear in its length; an empty table gives an empty result; only the named columns are read, further columns of any name are left alone.
"""

from __future__ import annotations

import functools
import heapq
import html as references
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import save, small_join
from .url_filter import url_host

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is not shown as text of the page.
UNSEEN = frozenset("script style noscript template head textarea iframe object embed svg canvas audio video map title noembed noframes xmp select datalist".split())
#: Elements made for what surrounds an article.
SUSPECTS = frozenset("nav footer aside form button dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div body td center".split())
#: Open elements that a start tag closes, and those that hide them from it.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
HIDES = {"li": {"ul", "ol", "menu", "table", "td", "th"}, "dt": {"dl", "table", "td", "th"}, "dd": {"dl", "table", "td", "th"}, "option": {"select", "datalist"}} | dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), {"table"})
P_SCOPE = frozenset(("p", "td", "th", "table", "button", "caption"))
LISTED = frozenset().union(*CLOSES.values(), *HIDES.values())
#: Elements that show where an article is, and names that no wrapper of one has.
HEADS = frozenset("article main h1".split())
NEVER_WRAP = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion footer cookie cookies consent gdpr notice notices "
    "newsletter subscribe comment comments replies disqus discussion respond recommended recommendations pagination pager copyright".split())
#: Names in a class, id or role that make a suspect.  A name counts as a whole or as a part between hyphens and the like, but not beside
#: a part of ``MODIFIERS``, which says something of the element that has it (has-sidebar, comments-open, entry-header).
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup popups modal "
    "overlay newsletter subscribe signup login search comment comments replies disqus discussion respond related recommended recommendations share sharing "
    "social widget widgets pagination pager skip hidden complementary contentinfo dialog copyright legal disclaimer tags".split())
MODIFIERS = frozenset("has no with without is not open closed enabled disabled entry post article story content main page body".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|[^<]++|<", re.S)
#: The rest of a tag; a quote opens a value only behind an equals sign.
REST = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)[^>=]*+)*+>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
GLUE = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^a-z]+")


@functools.lru_cache(4096)
def suspicious(marks: str) -> bool:
    """Whether a class, id or role names boilerplate."""
    return bool(named(marks))


@functools.lru_cache(4096)
def named(marks: str) -> frozenset[str]:
    """The names of boilerplate in a class, id or role."""
    found: set[str] = set()
    for name in GLUE.sub("-", marks).lower().split():
        parts = set(PARTS.split(name))
        if not parts & MODIFIERS:
            found |= parts & NAMES
    return frozenset(found)


@functools.lru_cache(4096)
def step_of(tag: str, marks: str) -> str:
    """Tag and classes without digits; what separates steps of a path is escaped."""
    classes = ".".join(sorted({DIGITS.sub("", x) for x in marks.split()} - {""})[:3])
    return (f"{tag}.{classes}" if classes else tag).replace("%", "%25").replace("/", "%2F")


@functools.lru_cache(64)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


class Node:
    """An element; ``suspect`` and ``skip`` are settled by :func:`judge`."""

    __slots__ = ("tag", "marks", "parent", "children", "skip", "suspect", "in_article", "text", "links")

    def __init__(self, tag: str, marks: str, unseen: bool, parent: Node | None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.skip = unseen or tag in UNSEEN
        self.suspect = tag in SUSPECTS or tag == "header" and not self.in_article or (
            bool(marks) and tag not in ("html", "body", "article", "main") and suspicious(marks))


def parse(page: str) -> Node:
    """A light tree of ``page``, already judged; text children are strings with references decoded."""
    root = Node("html", "", False, None)
    stack, paragraphs, open_ = [root], [], {}
    depths: dict[str, list[int]] = {tag: [] for tag in LISTED}  # of the open elements of these tags in the stack
    at, n, broken, unclosed = 0, len(page), False, set()

    def close(node: Node) -> None:
        """Close open elements up to ``node``."""
        while stack[-1] is not node:
            closed(stack.pop())
        closed(stack.pop())

    def closed(x: Node) -> None:
        open_[x.tag] -= 1
        if paragraphs and paragraphs[-1] is x:
            paragraphs.pop()
        if x.tag in LISTED:
            depths[x.tag].pop()

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag, here = m.group(2), stack[-1]
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or len(piece) == 1:
                here.children.append(references.unescape(piece) if "&" in piece else piece)
            elif piece.startswith("<![CDATA["):
                here.children.append(piece[9:].removesuffix("]]>"))
            continue
        end = None if broken else REST.match(page, at)
        broken = broken or end is None
        start, at = at, end.end() if end else page.find(">", at) + 1 or n
        tag, rest = tag.lower(), page[start:at - 1] if page[at - 1] == ">" else page[start:at]
        if m.group(1):
            if open_.get(tag):
                while stack[-1].tag != tag:
                    closed(stack.pop())
                closed(stack.pop())
            elif tag == "p":
                here.children.append(Node("p", "", False, here))
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and paragraphs and paragraphs[-1].tag == "p":
            close(paragraphs[-1])
        if tag in CLOSES:
            hidden = max((depths[x][-1] for x in HIDES[tag] if depths[x]), default=-1)
            behind = [depths[x][i] for x in CLOSES[tag] for i in (bisect_right(depths[x], hidden),) if i < len(depths[x])]
            if behind:
                close(stack[min(behind)])
        if tag == "body" and stack[-1].tag == "head":
            close(stack[-1])
        here = stack[-1]
        marks, unseen = [], False
        if rest and rest.strip(" /"):
            for a in ATTRIBUTE.finditer(rest):
                name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if name in ("class", "id", "role"):
                    marks.append(value)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    unseen = True
        node = Node(tag, " ".join(marks), unseen, here)
        here.children.append(node)
        if tag in RAW:
            end = None if tag in unclosed else raw_end(tag).search(page, at)
            if end is None:
                unclosed.add(tag)
            at = n if end is None else page.find(">", end.start()) + 1 or n
        elif tag not in VOID and (tag in BLOCKS or not rest.endswith("/")):
            open_[tag] = open_.get(tag, 0) + 1
            if tag in P_SCOPE:
                paragraphs.append(node)
            if tag in LISTED:
                depths[tag].append(len(stack))
            stack.append(node)
    judge(root)
    return root


def judge(root: Node) -> None:
    """Count each element's running text (less twice its links, without suspects in it) and settle which suspects are left out."""
    order, stack = [], [(root, False)]
    while stack:
        x, link = stack.pop()
        order.append(x)
        x.text = x.links = 0
        link = link or x.tag == "a"
        for c in x.children:
            if isinstance(c, str):
                size = len(c.strip())
                x.text += size
                x.links += size * link
            elif not c.skip:
                stack.append((c, link))
    for x in reversed(order):
        if x.parent is not None and not x.suspect:
            x.parent.text += x.text
            x.parent.links += x.links
    outside, heap = max(0, root.text - 2 * root.links), []
    around: dict[int, Node] = {id(root): root}  # the nearest suspect, or the root, that holds an element or is it
    inner: dict[int, list[Node]] = {}
    number: dict[int, int] = {}
    heads: dict[int, bool] = {}  # whether a suspect, or the root, holds a head that no suspect in it hides
    for i, x in enumerate(order[1:]):
        up = around[id(x.parent)]
        around[id(x)] = x if x.suspect else up
        if x.suspect:
            number[id(x)] = i
            inner.setdefault(id(up), []).append(x)
        if x.tag in HEADS and x.text > 0:
            heads[id(around[id(x)])] = True
    whole: dict[int, int] = {}
    wraps: dict[int, bool] = {}
    for x in reversed(order):  # a suspect's text with that of suspects in it
        if x.suspect:
            whole[id(x)] = max(0, x.text - 2 * x.links) + sum(whole[id(y)] for y in inner.get(id(x), ()))
            may = x.tag not in ("footer", "nav") and not named(x.marks) & NEVER_WRAP
            wraps[id(x)] = may and (heads.get(id(x), False) or any(wraps[id(y)] for y in inner.get(id(x), ())))
    headed = heads.get(id(root), False)

    def found(x: Node) -> None:
        for y in inner.get(id(x), ()):
            heapq.heappush(heap, (not wraps[id(y)], -whole[id(y)], number[id(y)], y))

    found(root)
    while heap:
        _, size, _, x = heapq.heappop(heap)
        if not (wraps[id(x)] and not headed or outside == 0 and size < 0):
            x.skip = True
            continue
        x.suspect = False
        outside += max(0, x.text - 2 * x.links)
        headed = headed or heads.get(id(x), False)
        found(x)


def path_of(node: Node) -> str:
    steps = []
    while node is not None:
        if node.tag not in ("html", "body"):
            steps.append(step_of(node.tag, node.marks))
        node = node.parent
    return "/".join(reversed(steps))


def walk(node: Node):
    """Nodes in page order, not into boilerplate; without recursion, as pages may nest deeply."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.skip]


def blocks(container: Node) -> list[str]:
    """The cleaned text blocks of a container in page order."""
    out, run, open_ = [], [], [container]

    def close():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [iter(container.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if open_.pop().tag in BLOCKS:
                close()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif not child.skip:
            if child.tag in BLOCKS:
                close()
            stack.append(iter(child.children))
            open_.append(child)
    close()
    return out


def own_text(node: Node) -> tuple[int, int]:
    """Characters of running text below ``node`` outside of its child containers, and of links in it."""
    total = links = 0
    inside = [(node, False)]
    while inside:
        x, link = inside.pop()
        for c in x.children:
            if isinstance(c, str):
                size = len(c.strip())
                total += size
                links += size * link
            elif not c.skip and c.tag not in CONTAINERS:
                inside.append((c, link or c.tag == "a"))
    return total, links


def best_container(root: Node) -> Node:
    """The container with the highest score: its own text less twice its links, half of what its child
    containers score, and a bonus for the tags meant for articles; then :func:`widened`."""
    order = [x for x in walk(root) if x is root or x.tag in CONTAINERS]
    score, outer = {}, {}
    for x in order:
        total, links = own_text(x)
        score[id(x)] = max(0.0, total - 2.0 * links)
    own, around = dict(score), [(root, None)]
    while around:  # each container's next container above
        x, up = around.pop()
        if id(x) in score:
            outer[id(x)], up = up, x
        around += [(c, up) for c in x.children if isinstance(c, Node) and not c.skip]
    for x in reversed(order):
        if outer[id(x)] is not None:
            score[id(outer[id(x)])] += 0.5 * score[id(x)]
    weight = {"article": 4.0, "main": 3.0}
    best = max(order, key=lambda x: score[id(x)] * weight.get(x.tag, 1.0))
    return widened(best, [x for x in order if own[id(x)] > 0]) if score[id(best)] > 0 else root


def widened(best: Node, texts: list[Node]) -> Node:
    """The lowest container, up to the next article or main element, that holds ``best`` and all running text there."""
    line = [best, *above(best)]
    end = next((i for i, x in enumerate(line) if x.tag in ("article", "main")), len(line) - 1)
    if line[end].tag == "article":
        outer = next((i for i in range(end + 1, len(line)) if line[i].tag == "main"), end)
        if sum(x.tag == "article" for x in walk(line[outer])) == 1:
            end = outer
    place, most = {id(x): i for i, x in enumerate(line)}, 0
    for x in texts:
        passed = []
        while id(x) not in place:
            passed.append(x)
            x = x.parent
        at = place[id(x)]
        place.update((id(y), at) for y in passed)
        if at <= end:
            most = max(most, at)
    while line[most].tag not in CONTAINERS and line[most].parent is not None:
        most += 1
    return line[most]


def vote(page: str | None) -> str | None:
    """The generalised path of the page's best container; none for a page without text."""
    best = best_container(parse(page or ""))
    return path_of(best) if blocks(best) else None


def at_path(root: Node, path: str) -> list[Node]:
    """The outermost containers at a generalised path, found by following its steps."""
    steps = path.split("/") if path else []
    out, stack = [], [(root, 0)]
    while stack:
        x, depth = stack.pop()
        if x.tag not in ("html", "body"):
            if depth >= len(steps) or step_of(x.tag, x.marks) != steps[depth]:
                continue
            depth += 1
        if depth == len(steps) and (x.tag in CONTAINERS or x is root):
            out.append(x)
        else:
            stack += [(c, depth) for c in reversed(x.children) if isinstance(c, Node) and not c.skip]
    return out


def extract(page: str | None, winning: str | None) -> tuple[str, str | None]:
    """(text, path used) of a page, from the containers at the winning path."""
    root = parse(page or "")
    found, path = [b for x in at_path(root, winning) for b in blocks(x)] if winning is not None else [], winning
    if not found:
        best = best_container(root)
        found, path = blocks(best), path_of(best)
    return "\n\n".join(found), path


def above(node: Node):
    node = node.parent
    while node is not None:
        yield node
        node = node.parent


def ballots(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host and path (voted for) of every page that has text."""
    poll = F.pandas_udf(lambda pages: pd.Series([vote(p) for p in pages], dtype=object), "string")
    return pages.select(url_host(F.col(url_col)).alias("host"), poll(html_col).alias("path")).where("path is not null")


def host_paths(cast: DataFrame) -> DataFrame:
    """The vote: host, path and votes of every path that a page of the host chose."""
    return cast.groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(votes: DataFrame) -> DataFrame:
    """One path a host: most votes, then the longer path, then the smaller string."""
    best = F.min(F.struct(-F.col("votes"), -F.length("path"), F.col("path").alias("path"), F.col("votes").alias("votes")))
    return votes.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("winning"), F.col("best.votes").alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, path (the container used)."""
    won = save(winners(host_paths(ballots(pages))).select(F.col("host").alias("_host"), "winning"), "host-paths")
    asked = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("_host"))
    joined = small_join(asked, won, ["_host"], "left", won.count())

    def run(text: pd.Series, winning: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t, None if pd.isna(w) else w) for t, w in zip(text, winning, strict=True)], columns=["text", "path"])

    got = joined.select("page_id", "url", F.pandas_udf(run, "text string, path string")("html", "winning").alias("got"))
    return got.select("page_id", "url", "got.text", F.length("got.text").cast("long").alias("n_chars"), "got.path")
