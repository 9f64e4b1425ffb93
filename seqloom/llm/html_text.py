"""Main text of web pages by composite text density.

A page is tokenised into a light DOM that forgives unclosed and misnested tags. Each node outside
scripts, menus, comment sections and the like gets its link-adjusted characters per tag; a node's
density sum adds its children's densities. The node of the largest sum is the heart of the page, and the
least density on its path up to the body is the threshold. Of the subtrees beside that path those stay that are mostly unlinked and reach the
threshold, or hold a sentence, or are a headline; beside the heart itself also any other paragraph, list or table. A heart inside an
article element stands for the outermost such element, and other articles with a fourth of its text or more stay with it; failing
those it stands for the main element around it. A form, or
an element whose class or id names a side part, is left out before that only if it holds no article or main
element of the page and less than half of its link-adjusted text; an article that is named a comment is left out unless it is all there is. Pages
are independent rows, so the plan is scan -> map with no shuffle.

Defined results: null or empty html, and pages without any text, give the empty text; markup that the
end of the page cuts off is dropped; repeated rows are extracted each; null keys stay null; an empty table gives an empty result;
columns other than the kept ones are ignored, so input columns named text or n_chars clash with nothing unless they are asked to
be kept (then the result takes their place); very deep nesting is walked without recursion, in time that grows with the page's length.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, column

#: A quoted value may hold ">"; quotes elsewhere in a tag are plain characters. No part can match in two ways, so time is linear.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-z][^>]*+\Z",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")

#: Elements without content, elements whose content is no markup, elements that start a block, and elements that never
#: hold article text.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside button select option label input dialog menu object audio video canvas svg math template noscript".split())
FOREIGN = frozenset("svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p ul ol dl table blockquote pre figure".split())
INLINE = frozenset("a abbr b big cite code em font i kbd mark s samp small span strike strong sub sup tt u var".split())
BAD_NAMES = frozenset(
    "reply replies "
    "nav navbar navigation menu sidebar footer header masthead ad ads adbox adslot adunit advert adverts advertisement adsense banner promo sponsor sponsored cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus breadcrumb breadcrumbs pagination pager widget toolbar".split()
)
#: Last parts that make a longer name a side part's, parts that say nothing, and parts that make it a state.
ENDINGS = frozenset(
    "nav navbar navigation sidebar footer masthead ads advert adverts advertisement adsense banner consent gdpr popup modal "
    "newsletter comments disqus breadcrumb breadcrumbs pagination pager toolbar widget".split()
)
FRAMES = frozenset("area bar block body box button buttons container form frame google group icons iframe inner item items label left link links list panel post posts right section slot thread threads top bottom unit wrap wrapper zone".split())
#: Parts of a name that make an article a reader's comment, the end of a sentence, and what marks a line of rights.
COMMENTS = frozenset("comment comments disqus reply replies".split())
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u2019\u201d\u00bb]*(?:\s|\Z)")
RIGHTS = re.compile(r"\u00a9|&copy;|\bcopyright\b|all rights reserved", re.I)
STATES = frozenset("has have no not with without is hide show open closed before after".split())
HEADERS = frozenset("header site global top bar inner wrap wrapper container".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A start tag of the key closes an open element of the value, as far as the nearest of the barriers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case, values decoded; of two with one name the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), references.unescape("".join(values)))
    return found


class Page:
    """Nodes in document order, and the page's texts and block breaks in order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.linked = ["html"], [-1], [False], [False]
        self.doubtful, self.inside, self.foreign = [False], [False], [False]
        self.items: list[tuple[int, str] | None] = []
        self.stack, at = [0], 0
        #: Depths in the stack of the open elements of each name, and of those that start a block.
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        while token := TOKEN.search(source, at):
            if token.start() > at:
                self.items.append((self.stack[-1], source[at : token.start()]))
            at = token.end()
            name = (token["name"] or "").lower()
            if name and token["end"]:
                self.close(name)
            elif name in RAW and not (self.foreign[self.stack[-1]] and SELF_CLOSED.search(token["rest"])):
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            elif name:
                self.open(name, token["rest"])
        if at < len(source):
            self.items.append((self.stack[-1], source[at:]))
        self.settle()

    def open(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self.items.append(None)
            self.pop({"p"}, {"button", "table", "td", "th", "div", "section", "article", "li"})
        if name in CLOSES:
            self.pop(CLOSES[name], BARRIERS[name])
        if name == "br":
            self.items.append((self.stack[-1], " "))
        parent = self.stack[-1]
        if name in VOID and not self.foreign[parent]:
            return
        self.tags.append(name)
        self.parents.append(parent)
        self.linked.append(self.linked[parent] or name == "a")
        self.inside.append(self.inside[parent] or name in ("article", "main"))
        self.foreign.append(self.foreign[parent] or name in FOREIGN)
        known = attributes(rest) if rest else {}
        self.dropped.append(self.dropped[parent] or name in DROPPED or name == "header" and not self.inside[parent] or unwanted(name, known))
        self.doubtful.append(name == "form" or side_part(name, known, self.inside[parent]) or name == "article" and comment(known))
        if name in BLOCK or not SELF_CLOSED.search(rest):
            self.depths.setdefault(name, []).append(len(self.stack))
            if name in BLOCK:
                self.blocks.append(len(self.stack))
            self.stack.append(len(self.tags) - 1)

    def cut(self, depth: int) -> None:
        """Close the element at this depth of the stack and all above it."""
        for i in self.stack[depth:]:
            self.depths[self.tags[i]].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        del self.stack[depth:]

    def nearest(self, names: set[str]) -> int:
        return max((self.depths[x][-1] for x in names if self.depths.get(x)), default=0)

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.items.append(None)
        depth = self.nearest({name})
        if depth and not (name in INLINE and self.blocks and self.blocks[-1] > depth):
            self.cut(depth)

    def pop(self, names: set[str], barriers: set[str]) -> None:
        depth = self.nearest(names)
        if depth > self.nearest(barriers):
            self.cut(depth)

    def settle(self) -> None:
        """Drop the doubtful nodes that hold neither the page's articles nor most of its link-adjusted text."""
        if not any(self.doubtful):
            return
        n = len(self.tags)
        plain, depth, holds = [0] * n, [0] * n, [False] * n
        for item in self.items:
            if item and not self.dropped[item[0]] and not self.linked[item[0]]:
                plain[item[0]] += len(item[1]) - sum(map(item[1].count, " \n\t\r"))
        for i in range(1, n):
            depth[i] = depth[self.parents[i]] + self.doubtful[i]
        for i in range(n - 1, 0, -1):
            plain[self.parents[i]] += plain[i]
        articles = [i for i in range(n) if self.tags[i] in ("article", "main") and plain[i] and not self.doubtful[i]]
        # articles inside comments and the like do not count where there are others
        least = min((depth[i] for i in articles), default=0)
        articles = [i for i in articles if depth[i] == least]
        for i in articles:
            holds[i] = True
        most = max((plain[i] for i in articles), default=0)
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
        for i in range(1, n):
            small = not plain[i] or 2 * plain[i] < plain[0] or 4 * most >= plain[i] or self.tags[i] == "article" and plain[i] < plain[0]
            self.dropped[i] = self.dropped[i] or self.dropped[self.parents[i]] or self.doubtful[i] and not holds[i] and small

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and the sum over its children."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [0] * n
        for item in self.items:
            if item and not self.dropped[item[0]]:
                size = len(item[1]) - item[1].count(" ")
                chars[item[0]] += size
                if self.linked[item[0]]:
                    links[item[0]] += size
        for i in range(n - 1, 0, -1):
            if self.dropped[i]:
                continue
            p = self.parents[i]
            link_tags[i] += self.tags[i] == "a"
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
        ratio = links[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc = chars[i], links[i]
            if c and not self.dropped[i]:
                base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
                density[i] = max(c / tags[i] * math.log(max(c / max(lc, 1) * tags[i] / max(link_tags[i], 1), 1 + 1e-9)) / base, 0.0)
            if i:
                sums[self.parents[i]] += density[i]
        for i in range(n):
            if not sums[i]:
                sums[i] = density[i]
        return density, sums

    def content(self) -> list[bool]:
        """Whose own text belongs to the main text."""
        n = len(self.tags)
        density, sums = self.densities()
        alive = [i for i in range(n) if not self.dropped[i]]
        heart = max(alive, key=lambda i: (sums[i], -i))
        path = [heart]
        while path[-1] > 0:
            path.append(self.parents[path[-1]])
        kept, own = {heart}, set()
        articles = [i for i in path if self.tags[i] == "article"]
        mains = [i for i in path if self.tags[i] == "main"]
        if articles:
            kept = {articles[-1], *self.other_articles(articles[-1])}
        elif mains:
            kept = {mains[-1]}
        else:
            body = next((i for i in path if self.tags[i] == "body"), 0)
            facts = Facts(self, density, min(density[i] for i in path[: path.index(body) + 1]))
            for child, parent in zip(path, path[1:], strict=False):
                kept.update(i for i in facts.children[parent] if i != child and not self.dropped[i] and facts.stays(i, parent == path[1] and parent != body, i < child))
                if facts.says[parent] and (parent != body or facts.ends[parent]):
                    own.add(parent)
                if parent == body:
                    break
        inside = [i in kept for i in range(n)]
        for i in range(1, n):
            inside[i] = (inside[i] or inside[self.parents[i]]) and not self.dropped[i]
        for i in own:
            inside[i] = not self.dropped[i]
        return inside

    def other_articles(self, first: int) -> list[int]:
        """Articles in no other article, not dropped, with a fourth of the first one's unlinked text or more."""
        n = len(self.tags)
        plain, nested = [0] * n, [False] * n
        for item in self.items:
            if item and not self.dropped[item[0]] and not self.linked[item[0]]:
                plain[item[0]] += len("".join(item[1].split()))
        for i in range(n - 1, 0, -1):
            plain[self.parents[i]] += plain[i]
        for i in range(1, n):
            nested[i] = nested[self.parents[i]] or self.tags[self.parents[i]] == "article"
        return [i for i in range(1, n) if self.tags[i] == "article" and not self.dropped[i] and not nested[i] and plain[i] and 4 * plain[i] >= plain[first]]


class Facts:
    """What the choice beside the path looks at, of each node and all below it: unlinked and linked characters, whether it holds a sentence,
    a headline, a line of rights; and of its own text alone, whether it says something unlinked and ends a sentence."""

    def __init__(self, page: Page, density: list[float], least: float):
        n = len(page.tags)
        self.tags, self.density, self.least = page.tags, density, least
        self.plain, self.links, self.sentence, self.headline, self.rights = [0] * n, [0] * n, [False] * n, [x in ("h1", "h2") for x in page.tags], [False] * n
        self.says, self.ends, self.children = [False] * n, [False] * n, [[] for _ in range(n)]
        for item in page.items:
            if item and not page.dropped[item[0]]:
                node, text = item
                size = len("".join(text.split()))
                if page.linked[node]:
                    self.links[node] += size
                elif size:
                    self.plain[node] += size
                    self.says[node] = True
                    self.ends[node] |= bool(SENTENCE.search(text))
                    self.rights[node] |= bool(RIGHTS.search(text))
        self.sentence = list(self.ends)
        for i in range(n - 1, 0, -1):
            above = page.parents[i]
            self.children[above].append(i)
            if not page.dropped[i]:
                self.plain[above] += self.plain[i]
                self.links[above] += self.links[i]
                for flags in (self.sentence, self.headline, self.rights):
                    flags[above] |= flags[i]

    def stays(self, i: int, beside_heart: bool, before: bool) -> bool:
        if not self.plain[i] or self.links[i] > self.plain[i] or self.rights[i] and self.plain[i] < 200:
            return False
        textual = self.tags[i] in TEXTUAL or self.tags[i] in INLINE
        return self.density[i] >= self.least or self.sentence[i] or self.tags[i] in HEADINGS or before and self.headline[i] or beside_heart and textual


def unwanted(name: str, known: dict[str, str]) -> bool:
    if not known or name in ("html", "body"):
        return False
    hides = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", known.get("style", ""), re.I)
    if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or hides is not None:
        return True
    return name not in ("article", "main") and known.get("role", "").lower() in BAD_ROLES


def comment(known: dict[str, str]) -> bool:
    """Whether the class or id names a reader's comment."""
    return any(not COMMENTS.isdisjoint(re.split(r"[^a-z0-9]+", x)) and bad_name(x, True) for a in ("class", "id") for x in known.get(a, "").lower().split())


def side_part(name: str, known: dict[str, str], inside: bool) -> bool:
    """Whether the class, id or role names a side part of a page; ``inside`` is true in an article or main element."""
    if not known or name in ("html", "body", "article", "main"):
        return False
    return known.get("role", "").lower() == "form" or any(bad_name(x, inside) for a in ("class", "id") for x in known.get(a, "").lower().split())


def bad_name(value: str, inside: bool) -> bool:
    """A whole name, a clear ending, or bad parts among parts that say nothing; has-sidebar or share-price are none."""
    parts = [x for x in re.split(r"[^a-z0-9]+", value) if x]
    bad = BAD_NAMES.intersection(parts)
    if not bad or not STATES.isdisjoint(parts):
        return False
    if bad == {"header"}:
        return not inside and HEADERS.issuperset(parts)
    return parts[-1] in ENDINGS or all(x in BAD_NAMES or x in FRAMES or x.isdigit() for x in parts)


def main_text(source: str | None) -> str:
    """Blocks of the main text, joined by newlines."""
    if not source:
        return ""
    page = Page(source)
    inside = page.content()
    blocks, now = [], []
    for item in [*page.items, None]:
        if item is None:
            block = " ".join("".join(map(references.unescape, now)).split())
            if block:
                blocks.append(block)
            now = []
        elif inside[item[0]]:
            now.append(item[1])
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns plus ``text`` and ``n_chars``."""
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_html", 8 << 20):
                texts = [main_text(x) for x in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*map(column, keep)).schema)
    return pages.select(*map(column, keep), column(html).alias("_html")).mapInArrow(run, f"{kept}, text string, n_chars long")


def op10_html_text(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
