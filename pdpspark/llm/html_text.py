"""Main text of pages by consensus: containers are scored per page, their generalised paths voted on per host, the winners extracted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdpspark.llm.common import written
from pdpspark.llm.url_filter import host_of

#: Paths that a page votes for, and that a host keeps: its ranked winners.
VOTES, WINNERS = 3, 4

#: Fixed sets: elements that break a block, that can contain others, that never hold main text, and whose content is no markup.
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BREAKS - frozenset("br hr p h1 h2 h3 h4 h5 h6 html head".split())
DROPPED = frozenset("nav footer aside form button select dialog menu search template svg math canvas object video audio map noscript head".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Fixed words: parts of a class or id that mark what isn't main text; those that count outside an article only; those that hint at it.
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail footer masthead topbar toolbar pagination pager "
    "cookie cookies consent gdpr notice notices alert popup modal overlay lightbox disclaimer newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus discussion share sharing social follow related recommended recommendations "
    "widget widgets skip tags tagcloud feedback paywall".split()
)
BAD_OUTSIDE = frozenset(["header", "top"])
#: Words that leave a name with a bad word bad; words by which a name tells of a state of its content; bad words of texts that can outweigh the main text.
BESIDE = frozenset("site page main global left right top bottom upper lower box area block list item wrapper wrap container inner outer section col column".split())
STATE = frozenset("has have with without no not is show hide open opened closed layout".split())
LONG = frozenset("comment comments commentlist respond reply replies disqus discussion feedback cookie cookies consent gdpr disclaimer notice notices".split())
GOOD = frozenset("article content post entry story body text main page prose".split())

TOKEN = re.compile(
    r"<!--(?:[\s\S]*?--!?>|[\s\S]*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>?"
    r"|<[!?/][^>]*+>?"
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?![\w-])", re.I)
DIGITS = re.compile(r"\d+")
#: Containers that hold text of the main text itself; those that a page's frame has beside the main text; letters from which a block is a paragraph.
TEXTUAL = frozenset("section blockquote ul ol dl table pre figure details".split())
FRAME = frozenset("nav footer header".split())
PARAGRAPH = 40
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OPEN_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    bad: bool
    article: bool
    wraps: bool = False  # could be bad and yet hold the page
    dropped: bool = False
    score: float = 0.0


@dataclass
class Page:
    """Containers in page order (0 is the page itself) and all blocks (container, text, letters in links); dropped containers are marked."""

    nodes: list[Node] = field(default_factory=lambda: [Node("", "", -1, False, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def _name_parts(value: str) -> list[str]:
    return [p.lower() for p in NAME_PART.findall(value)]


def _marks(name: str, marks: frozenset[str]) -> bool:
    """Whether a class or id says what its element is by one of the words: as its last word, or beside words of place. Not "has-sidebar"."""
    parts = _name_parts(name)
    return bool(parts) and STATE.isdisjoint(parts) and (parts[-1] in marks or not marks.isdisjoint(parts) and all(p in marks or p in BESIDE for p in parts))


def _node(tag: str, raw: str, parent: int, above: Node) -> Node:
    own = _attributes(raw)
    names = [*own.get("class", "").split(), *own.get("id", "").split()]
    named = {p for n in names for p in _name_parts(n)}
    article, holds = above.article or tag in ("article", "main"), tag in ("body", "article", "main")
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    by_name = not holds and any(_marks(n, BAD) for n in names)
    role = own.get("role", "").lower() in ROLES
    outside = not above.article and (tag == "header" or not holds and any(_marks(n, BAD_OUTSIDE) for n in names) and not named & GOOD)
    bad = tag in DROPPED or by_name or hidden or role or outside
    label = ".".join([tag, *sorted(own.get("class", "").split())])
    wraps = bad and (tag == "form" or tag not in DROPPED) and named.isdisjoint(LONG)
    return Node(tag, f"{above.path}>{DIGITS.sub('#', label)}", parent, bad, article, wraps)


def _plain(block: str, linked: int) -> float:
    return max(0.0, len(block) - 2.0 * linked)


def _drop(page: Page) -> None:
    """Marks what bad containers hold as dropped, but for bad containers that hold the main text itself.

    Where no article or main with text is outside bad containers, those around the one with most text are spared. Where none outside
    has a tenth of the page's text, wrappers (forms, names, hidden ones) with more than half of it are spared, and all others if no text
    were left otherwise.
    """
    nodes, plain, covered = page.nodes, [0.0] * len(page.nodes), [False] * len(page.nodes)
    for k, block, linked in page.blocks:
        plain[k] += _plain(block, linked)
    for i in range(len(nodes) - 1, 0, -1):
        plain[nodes[i].parent] += plain[i]
    for i, n in enumerate(nodes):
        covered[i] = n.bad or n.parent >= 0 and covered[n.parent]
    holders = [i for i, n in enumerate(nodes) if n.tag in ("article", "main")]
    open_text = max((plain[i] for i in holders if not covered[i]), default=0.0)
    spared: set[int] = set()
    if open_text <= PARAGRAPH and any(plain[i] > open_text for i in holders):
        at = max(holders, key=lambda i: (plain[i], -i))
        while at >= 0:
            spared.add(at)
            open_text, at = max(open_text, plain[at] if nodes[at].tag in ("article", "main") else 0.0), nodes[at].parent
    most = [i for i, n in enumerate(nodes) if n.bad and 2 * plain[i] > plain[0]]
    if 10 * open_text < plain[0]:
        spared.update(i for i in most if nodes[i].wraps)

    def mark() -> None:
        for i, n in enumerate(nodes):
            n.dropped = n.bad and i not in spared or n.parent >= 0 and nodes[n.parent].dropped

    mark()
    if plain[0] and not any(_plain(b, linked) and not nodes[k].dropped for k, b, linked in page.blocks):
        spared.update(most)
        mark()


def _score(page: Page) -> None:
    for at, block, linked in page.blocks:
        if page.nodes[at].dropped:
            continue
        worth = _plain(block, linked) * (1.0 if len(block) > PARAGRAPH else 0.3)
        share, k = 1.0, at
        while k >= 0 and share > 0.01:  # ancestors share in it, less and less
            page.nodes[k].score += worth * share
            share *= 0.6
            k = page.nodes[k].parent


def parse(html: str | None) -> Page:
    """One pass over the whole page. Unclosed and misnested tags end with what encloses them."""
    page = Page()
    html = html or ""
    stack, text, linked, link_depth, at = [0], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            page.blocks.append((stack[-1], block, linked))
        linked = 0

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        upto = m.start() if m else size
        if upto > at:
            piece = html[at:upto]
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            linked += len(piece) if link_depth else 0
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, raw = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
            continue
        if tag in BREAKS:
            flush()
            if tag not in ("p", "br", "hr"):
                link_depth = 0
        if tag in CONTAINERS or tag in DROPPED and tag != "head":
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if page.nodes[stack[i]].tag == tag:
                        flush()
                        del stack[i:]
                        break
                continue
            closes = OPEN_CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if page.nodes[stack[i]].tag in SCOPE[tag]:
                        break
                    if page.nodes[stack[i]].tag in closes:
                        del stack[i:]
                        break
            if raw.endswith("/") and tag in ("svg", "math", "canvas", "object", "template"):
                continue
            flush()
            page.nodes.append(_node(tag, raw, stack[-1], page.nodes[stack[-1]]))
            stack.append(len(page.nodes) - 1)
    flush()
    _drop(page)
    _score(page)
    return page


def risers(page: Page) -> dict[int, int]:
    """For each container the one around it that its text belongs to: the outermost that adds text which is no link list, an article or main at most.

    A frame (the page, body, or what has nav, header or footer in it) holds other things too: it counts if it has paragraphs of its own, or
    lists, quotes, sections or equal containers with paragraphs beside, or beside a quarter of the text as much.
    """
    nodes = page.nodes
    plain, paragraphs, own, own_paragraphs = ([0.0] * len(nodes) for _ in range(4))
    for k, block, linked in page.blocks:
        if not nodes[k].dropped and 2 * linked < len(block):
            plain[k] += _plain(block, linked)
            paragraphs[k] += len(block) > PARAGRAPH
            own[k] += 1
    own_paragraphs = list(paragraphs)
    inside, frame, textual = [[] for _ in nodes], [n.tag in ("", "body") for n in nodes], [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.dropped:
            frame[n.parent] |= n.tag in FRAME and nodes[n.parent].tag not in ("article", "main")
            continue
        inside[n.parent].append(i)
        plain[n.parent] += plain[i]
        paragraphs[n.parent] += paragraphs[i]
        textual[n.parent] += paragraphs[i] if n.tag in TEXTUAL else 0
    equal: dict[tuple[int, str], float] = {}
    for p, among in enumerate(inside):
        for i in among:
            if nodes[i].tag not in TEXTUAL:
                equal[p, nodes[i].path] = equal.get((p, nodes[i].path), 0.0) + paragraphs[i]

    def belongs(p: int, child: int) -> bool:
        beside = paragraphs[p] - paragraphs[child]
        if not frame[p]:
            return own[p] > 0 or beside > 0
        alike = textual[p] - paragraphs[child] if nodes[child].tag in TEXTUAL else textual[p] + equal[p, nodes[child].path] - paragraphs[child]
        return own_paragraphs[p] > 0 or alike > 0 or 4 * (plain[p] - plain[child]) >= plain[child] and beside > 0

    top: dict[int, int] = {0: 0}
    up: list[int] = [-1] * len(nodes)  # the outermost container above that counts
    for i, n in enumerate(nodes):
        if i and not n.dropped:
            p = n.parent
            ends = n.tag in ("article", "main")
            up[i] = -1 if ends else up[p] if up[p] >= 0 else p if belongs(p, i) else -1
            top[i] = up[i] if up[i] >= 0 else i
    return top


def votes(page: Page) -> list[tuple[str, float]]:
    """The best containers' paths with their share of the best score."""
    best: dict[str, tuple[float, int]] = {}
    for i, n in enumerate(page.nodes[1:], 1):
        if n.dropped or not n.score:
            continue
        last = n.path.rpartition(">")[2]
        hint = 2.0 if n.tag in ("article", "main") else 1.3 if not GOOD.isdisjoint(_name_parts(last.partition(".")[2])) else 0.9 if n.tag == "body" else 1.0
        best[n.path] = max(best.get(n.path, (0.0, 0)), (n.score * hint, -i))
    above, risen = risers(page) if best else {}, {}
    for score, i in sorted(best.values(), key=lambda x: (-x[0], len(page.nodes[-x[1]].path), page.nodes[-x[1]].path))[:VOTES]:
        path = page.nodes[above[-i]].path
        risen[path] = max(risen.get(path, 0.0), score)
    top = sorted(risen.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
    return [(path, score / top[0][1]) for path, score in top]


def extract(page: Page, winners: list[str]) -> str:
    """Blocks of the containers with the first of the winning paths that has text here; else with the page's own best path."""
    for path in [*winners, *[p for p, _ in votes(page)], ""]:
        inside = [False] * len(page.nodes)
        for i, n in enumerate(page.nodes):
            inside[i] = n.path == path or n.parent >= 0 and inside[n.parent]
        found = [t for k, t, _ in page.blocks if inside[k] and not page.nodes[k].dropped]
        if found:
            return " ".join(found)
    return ""


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the WINNERS paths with the most votes of each host's pages, best first. Votes are summed before the shuffle."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, path, share) for h, html in zip(pdf["host"], pdf["html"], strict=True) for path, share in votes(parse(html))]
            yield pd.DataFrame(rows, columns=["host", "path", "share"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(vote, "host string, path string, share double")
    total = cast.groupBy("host", "path").agg(F.sum("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc(F.round("share", 6)), F.length("path"), "path"))
    ranked = total.withColumn("place", place).where(F.col("place") <= WINNERS)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars (code points): the main text of each page by its host's winning paths.

    pages needs url and html. Both passes read the whole html. The winners are one short row per host; they are written first, so the
    join broadcasts them only below the session's threshold. A null or empty html gives an empty text, a null url belongs to the host "".
    Repeated rows stay; columns named text and n_chars are replaced.
    """
    winners = written(host_paths(pages), "host-paths")
    kept = [f for f in pages.schema if f.name not in ("html", "text", "n_chars")]
    names = [f.name for f in kept]
    joined = pages.select(*names, "html", host_of(F.col("url")).alias("__host")).join(winners.select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "__host", "left")
    ints = [f.name for f in kept if f.dataType.typeName() in ("long", "integer", "short", "byte")]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract(parse(h), [] if p is None else list(p)) for h, p in zip(pdf["html"], pdf["__paths"], strict=True)]
            yield pdf[names].astype({c: "Int64" for c in ints if pdf[c].dtype.kind == "f"}).assign(text=found, n_chars=[len(t) for t in found])

    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string", "n_chars long"]
    return joined.select(*names, "html", "__paths").mapInPandas(take, ", ".join(out))
