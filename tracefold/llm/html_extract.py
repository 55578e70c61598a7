"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to all their ancestors, discounted by link
density; the best container is kept, and of its siblings and those of its ancestors what scores well or is of the same
kind. Elements that
their tag, role or class name as a menu, header, footer, sidebar, notice, advert, form or comment
neither score nor are kept, but a name alone never empties a page: an element that holds most of
the points is spared where little would be left without it.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags that open a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that are no part of an article: blocks, and what stands inside a line.
OUTSIDE = frozenset("aside dialog footer head header menu nav option".split())
INSERTS = frozenset("audio button canvas datalist map object select svg video".split())
#: Elements whose content is no markup.
RAW = frozenset("iframe noscript script style template textarea title".split())
#: Words of a class, id or role that name what surrounds an article. A choice, like the lists below.
AROUND = frozenset(
    "ad ads adslot adsense adunit advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline captcha "
    "comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus footer gdpr header hidden login masthead menu menubar "
    "modal nav navbar navigation navi newsletter notice notices notification overlay pager paginate pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharebar sharing sidebar sidenav signup skip skyscraper social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar topbar alert widget dialog".split()
)
#: Words that say where or of what kind such an element is.
BESIDE = frozenset(
    "area article bar block body bottom box button buttons col column container content entry feed footer form global header holder icons inner item items left link "
    "links list main mobile module outer page panel post posts primary region right row secondary section site slot small story sub text thread title top unit "
    "user view wrap wrapper".split()
)
#: Beside one of OWN these name a part of the article; a class that begins with one of SAYS tells of the page.
PARTS = frozenset("header alert banner byline tags".split())
OWN = frozenset("article entry post story content".split())
SAYS = frozenset("has with no without is not show hide category tag topic type format status js".split())
#: Void tags, and the tags that close an open one of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = frozenset("ul ol dl table body html article main section div".split())
#: What opens inside an insert (a button) that somebody forgot to close, and what is itself a container.
LEAVES_INSERT = frozenset("p h1 h2 h3 h4 h5 h6 article main section ul ol table blockquote footer".split())
CONTAINERS = frozenset("div section article main td body form fieldset".split())

ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-z][a-z0-9:-]*)({ATTRS})>|</?[a-z][^>]*>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
KEPT, WEAK, NAMED, GONE = range(4)
#: Characters that make a paragraph long, and points that a container of some text has.
LONG, SOME = 80, 2.5


def naming(attrs: str) -> int:
    """What the attributes say: GONE (hidden), NAMED (only words of AROUND and BESIDE), WEAK (other words too) or KEPT."""
    verdict = KEPT
    for name, value in NAMES.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value.lower()):
            return GONE
        if name in ("class", "id", "role"):
            for token in value.split():
                said = [w.lower() for w in WORD.findall(token)]
                around = AROUND.intersection(said)
                if not around or said[0] in SAYS or around <= PARTS and OWN.intersection(said):
                    continue
                verdict = max(verdict, NAMED if all(w in AROUND or w in BESIDE or len(w) == 1 for w in said) else WEAK)
    return verdict


class Page:
    """Elements (0 is the root) with what their names say, and the text blocks with the element that holds them."""

    def __init__(self, html: str):
        self.parent, self.tag, self.said, self.kind = [-1], ["#root"], [KEPT], [""]  # kind: the class as written
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.parse(html)

    def parse(self, html: str) -> None:
        stack, off = [0], 0  # off: how many open elements are GONE
        open_tags: Counter = Counter()
        unclosed: set[str] = set()  # raw tags without an end further on
        pieces: list[str] = []
        links = linked = at = 0

        def close_block() -> None:
            nonlocal linked
            if pieces:
                if text := " ".join(unescape("".join(pieces)).split()):
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def pop() -> None:
            nonlocal off
            element = stack.pop()
            off -= self.said[element] == GONE
            open_tags[self.tag[element]] -= 1

        def push(tag: str, said: int, kind: str = "") -> None:
            nonlocal off
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.said.append(said)
            self.kind.append(kind)
            stack.append(len(self.tag) - 1)
            off += said == GONE
            open_tags[tag] += 1

        while m := TOKEN.search(html, at):
            if not off and m.start() > at:
                piece = html[at : m.start()]
                pieces.append(piece)
                linked += len(piece) if links else 0
            at = m.end()
            tag, attrs = (m[2] or "").lower(), m[3] or ""
            ending, empty = m[1] == "/", attrs.endswith("/")
            if tag in RAW:
                if not ending and not empty and tag not in unclosed:
                    if end := re.compile(rf"</{tag}\s*>", re.I).search(html, at):
                        at = end.end()
                    else:
                        unclosed.add(tag)
                        at = len(html) if tag in ("script", "style") else at
            elif tag in INSERTS:
                if ending and open_tags[tag]:
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                elif not ending and not empty:
                    push(tag, GONE)
            elif tag in BLOCKS:
                if tag in LEAVES_INSERT or ending:  # an insert does not reach over these
                    while self.tag[stack[-1]] in INSERTS:
                        pop()
                if not off:
                    close_block()
                if ending:
                    if open_tags[tag]:
                        while self.tag[stack[-1]] != tag:
                            pop()
                        pop()
                        links = 0
                    continue
                if self.tag[stack[-1]] == "p" or self.tag[stack[-1]] == tag and tag[0] == "h" and tag[1:].isdigit():
                    pop()
                for kind in CLOSES.get(tag, ()):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == kind:
                            while len(stack) > k:
                                pop()
                            break
                        if self.tag[stack[k]] in BARRIERS:
                            break
                if tag == "hr" or empty and tag != "p":
                    continue
                if tag == "body":  # an unclosed head
                    while open_tags["head"]:
                        pop()
                outside = tag in OUTSIDE and not (tag == "header" and open_tags["article"] + open_tags["main"])
                said = GONE if outside else naming(attrs) if attrs else KEPT
                if tag in ("html", "body", "main"):
                    said = KEPT
                elif tag in ("form", "fieldset") and said < NAMED:
                    said = NAMED
                push(tag, said, next((v.strip("\"'") for n, v in NAMES.findall(attrs) if n.lower() == "class"), "") if attrs else "")
            elif tag == "a":
                links = 0 if ending else 1
            elif tag == "br":
                pieces.append(" ")
        if not off and at < len(html):
            pieces.append(html[at:])
        close_block()

    def up(self, values: list[float]) -> list[float]:
        """Sums over subtrees (an element stands after its parent)."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def under(self, cut: list[bool]) -> list[bool]:
        """Which elements are cut or stand inside one that is."""
        out = list(cut)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def main_text(self) -> str:
        """The text blocks of the best container and its good siblings, in page order."""
        if not self.blocks:
            return ""
        n = len(self.tag)
        own, chars, linked = ([0.0] * n for _ in range(3))
        points = []
        for element, text, in_links in self.blocks:
            points.append((1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text)))
            own[element] += points[-1]
            chars[element] += len(text)
            linked[element] += in_links
        held, chars, linked = self.up(own), self.up(chars), self.up(linked)
        dense = [c > 0 and l > 0.3 * c for c, l in zip(chars, linked)]
        of = Counter(e for e, _, _ in self.blocks)
        n_blocks = self.up([of[i] for i in range(n)])
        within = self.under([t in ("article", "main") for t in self.tag])
        enough = lambda gone: any((len(t) >= LONG or within[e]) and not gone[e] for e, t, _ in self.blocks)
        # a weak name cuts what has little text or many links; any name cuts, but may not empty the page
        cut = [s == NAMED or s == WEAK and (dense[i] or held[i] < SOME) for i, s in enumerate(self.said)]
        gone = self.under(cut)
        if not enough(gone):
            self.spare(cut, held, n_blocks, within)
            gone = self.under(cut)
        if all(gone[e] for e, _, _ in self.blocks) and enough([False] * n):
            gone = [False] * n
        return self.pick([b for b in zip(self.blocks, points) if not gone[b[0][0]]], gone)

    def spare(self, cut: list[bool], held: list[float], n_blocks: list[float], within: list[bool]) -> None:
        """Cut no longer the outermost cut element that holds most, and so on inside it, until enough text is left."""
        above = [0] * len(cut)  # the nearest cut element around each, itself included
        inner: dict[int, list[int]] = {}
        for i in range(1, len(cut)):
            around = above[self.parent[i]]
            above[i] = i if cut[i] else around
            if cut[i] and n_blocks[i] > 1:
                inner.setdefault(around, []).append(i)
        frees = {above[e] for e, text, _ in self.blocks if len(text) >= LONG or within[e]}
        outer = [(-held[i], i) for i in inner.get(0, [])]
        heapq.heapify(outer)
        while outer:
            _, i = heapq.heappop(outer)
            cut[i] = False
            if i in frees:
                break
            for j in inner.get(i, []):
                heapq.heappush(outer, (-held[j], j))

    def pick(self, scored_blocks: list, gone: list[bool]) -> str:
        if not scored_blocks:
            return ""
        n = len(self.tag)
        points, own, chars, linked = ([0.0] * n for _ in range(4))
        for (element, text, in_links), p in scored_blocks:
            at = element if self.tag[element] in CONTAINERS else self.parent[element]
            points[at] += p
            own[element] += p
            chars[element] += len(text)
            linked[element] += in_links
        held, chars, linked = self.up(own), self.up(chars), self.up(linked)
        for i in range(n - 1, 0, -1):  # half of it goes to the element around, half of that to the next, and so on
            points[self.parent[i]] += points[i] / 2
        scored = [p * (1 - l / c) if c else 0.0 for p, c, l in zip(points, chars, linked)]
        best = max(range(n), key=scored.__getitem__)  # of equal ones the first on the page
        up = best
        while up >= 0:  # an article that holds the best container is the container
            if self.tag[up] in ("article", "main"):
                best = up
                break
            up = self.parent[up]
        kept = {best}
        whole = self.tag[best] == "article"
        plain = ("h1", "h2", "h3") if whole else ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol")
        beside: dict[int, list[int]] = {}
        for i in range(1, n):
            if chars[i] and linked[i] < chars[i] / 3 and not gone[i]:
                beside.setdefault(self.parent[i], []).append(i)
        at, least = best, max(2.0, held[best] / 5)
        while self.tag[at] not in ("main", "body", "#root"):
            # siblings of the best container and of what it stands in: by what they hold, or alike in tag and class
            top = self.tag[self.parent[at]] in ("body", "html", "#root")
            for i in beside.get(self.parent[at], []):
                alike = self.tag[i] == self.tag[at] and self.kind[i] == self.kind[at] and (self.tag[i] == "section" or bool(self.kind[i]) or not top)
                if held[i] >= least or alike or self.tag[i] in (plain if at == best else ("h1",)):
                    kept.add(i)
            if whole:
                break
            at = self.parent[at]
        inside = self.under([i in kept for i in range(n)])
        return "\n".join(text for (element, text, _), _ in scored_blocks if inside[element])


def main_text(html: str) -> str:
    return Page(html).main_text() if html else ""


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text (main text, "" if none) and n_chars (its code points).

    Cases: a null or empty html gives an empty text. Unclosed, stray and cut-off tags are
    taken as browsers do in the main. Of containers with equal points the first on the page is the
    best. A very long or deep page is handled whole, in time that grows with its length. Repeated
    rows give a row each; an empty table gives no rows. Other columns are ignored, but the kept
    ones may not be named text or n_chars (ValueError).
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are made here: keep them under other names")
    rows = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_html"], T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.array([main_text(x.as_py()) for x in part.column("_html")], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], names=[*keep, "text"])

    return rows.mapInArrow(work, schema).withColumn("n_chars", F.length("text").cast("long"))
