"""Main text of web pages by the container paths that the pages of a host agree on.

1. Every page is read into blocks of text and the containers they stand in. What is not article
   by its element, role, class or id (menus, headers, footers, side columns, notices,
   adverts, forms, comments, scripts) is left out with all it holds. A container scores the
   characters outside links of its blocks, less for blocks deeper down.
2. The path of a container is its chain of elements and classes, digits and hash-like parts made
   alike. Pages vote in Spark: per host, shares of the best score are summed by path, and
   the path with the most is the host's. It is then widened to the outermost ancestor that adds text:
   on a share ``VOTES`` of the host's pages it holds more beside its largest child than links, and below it no
   ancestor adds links on more pages than text. So headlines, leads and paragraphs around the deepest container
   stay; a list or a quotation is always widened.
3. Every page is read once more; its containers on the host's path give the text. A page without
   such a container, or with no text in it, takes its own best one, widened in the same way.

Votes are summed before they meet, so one host may hold most pages; the host's path comes back by a
join that adaptive execution can split. Pages are read whole.

Defined results: a null or empty page gives an empty text; a null url, or one without a host,
counts as the host ''; broken markup is read as far as it goes; repeated rows each get a row;
an empty table gives an empty table. Extra columns are not used.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.llm.common import add_columns, texts
from snapcount.session import cut, ship_package

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
# Elements by what they are.
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form header hgroup html main "
    "menu nav ol section table tbody td tfoot th thead tr ul".split()
)
LEAVES = frozenset("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog footer form header iframe input label menu nav noscript object select svg "
    "template textarea".split()
)
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_LEFT_OUT = frozenset("article body html main".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
BOILERPLATE = (
    "ad ads adsbygoogle advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice overlay pager pagination popup promo promotion recommended related replies respond share "
    "sharing sidebar sidenav signup skip social sponsor sponsored subnav subscribe toolbar topbar topnav widget"
).split()
NOT_ARTICLE = re.compile(rf"^(?:{'|'.join(BOILERPLATE)})(?:$|[-_\d])|[-_](?:{'|'.join(BOILERPLATE)})\d*$")
WHOLE = re.compile(r"(?:^|[-_])(?:has|with|no|without)[-_]")
EXACT = frozenset(BOILERPLATE)
# Containers that are a part of a text and never all of it.
PARTS = frozenset("blockquote dl figure ol ul".split())
SEMANTIC = 1.4
FADE = 0.75
# Share of a page's best score from which on a container gets a vote.
VOTES = 0.2


def attributes(text: str) -> dict[str, str]:
    return {(n or h).lower(): a or b or c or "" for n, a, b, c, h in ATTRIBUTE.findall(text)}


def left_out(tag: str, given: dict[str, str]) -> bool:
    """Whether an element is not article."""
    if tag in LEFT_OUT:
        return True
    if not given or tag in NEVER_LEFT_OUT:
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    classes = given.get("class", "").lower().split()
    if tag in LEAVES:
        return any(n in EXACT for n in classes)
    own = given.get("id", "").lower().split()
    # The id of a section is as a rule its heading's words.
    if tag == "section" or "section" in classes:
        if any(n in EXACT for n in own):
            return True
        own = []
    names = classes + own
    return any(NOT_ARTICLE.search(n) and not WHOLE.search(n) for n in names)


def step(tag: str, given: dict[str, str]) -> str:
    """An element of a path: the tag and its classes, without what tells single pages apart."""
    names = []
    for name in sorted(set(given.get("class", "").lower().split())):
        name = re.sub(r"\d+", "#", name)
        if len(re.findall("#", name)) < 3:
            names.append(name)
    return ".".join([tag, *names])


class Page:
    """Blocks of a page in order, and the containers they stand in."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int]] = []  # (text, characters in links, container)
        self.parent = [-1]
        self.path = [""]
        self.semantic = [False]
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # (tag, container, left out)
        parts: list[str] = []
        links = in_link = 0
        leaf_out = False
        inline_out: tuple[str, int] | None = None  # an inline element that is left out, and how deep
        lowered = None
        at = 0

        def say(text: str) -> None:
            nonlocal links
            if text and not (stack[-1][2] or leaf_out or inline_out):
                text = html.unescape(text)
                parts.append(text)
                if in_link:
                    links += len(text)

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, min(links, len(text)), stack[-1][1]))
                parts.clear()
            links = 0

        for token in TOKEN.finditer(source):
            if token.start() < at:
                continue
            if token.start() > at:
                say(source[at : token.start()])
            at = token.end()
            tag = token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                if inline_out and tag == inline_out[0]:
                    inline_out = (tag, inline_out[1] - 1) if inline_out[1] > 1 else None
                if tag == "a":
                    in_link = max(0, in_link - 1)
                elif tag in CONTAINERS:
                    flush()
                    inline_out, leaf_out = None, False
                    if any(tag == open_tag for open_tag, _, _ in stack[1:]):
                        while stack.pop()[0] != tag:
                            pass
                elif tag in LEAVES:
                    flush()
                    inline_out, leaf_out = None, False
                continue
            if tag in RAW:
                lowered = source.lower() if lowered is None else lowered
                if len(lowered) == len(source):
                    end = lowered.find(f"</{tag}", at)
                else:
                    closing = re.compile(f"</{tag}", re.I).search(source, at)
                    end = closing.start() if closing else -1
                at = len(source) if end < 0 else end
                continue
            if tag == "br":
                say(" ")
                continue
            given = attributes(token[3]) if token[3].strip(" /") else {}
            if tag in CONTAINERS:
                flush()
                inline_out, leaf_out, in_link = None, False, 0
                if tag in ("body", "html"):
                    continue
                parent = stack[-1][1]
                out = stack[-1][2] or left_out(tag, given)
                if not out:
                    self.parent.append(parent)
                    self.path.append(f"{self.path[parent]}>{step(tag, given)}")
                    self.semantic.append(tag in ("article", "main"))
                    parent = len(self.parent) - 1
                stack.append((tag, parent, out))
            elif tag in LEAVES:
                flush()
                inline_out, in_link = None, 0
                leaf_out = left_out(tag, given)
            elif tag == "a":
                in_link += 1
            elif inline_out:
                if tag == inline_out[0]:
                    inline_out = (tag, inline_out[1] + 1)
            elif tag not in VOID and left_out(tag, given):
                inline_out = (tag, 1)
        if at < len(source):
            say(source[at:])
        flush()

    def scores(self) -> list[float]:
        total = [0.0] * len(self.parent)
        for text, links, container in self.blocks:
            worth = float(len(text) - links)
            while container >= 0:
                total[container] += worth * (SEMANTIC if self.semantic[container] else 1)
                worth *= FADE
                container = self.parent[container]
        return total

    def best(self) -> int:
        total = self.scores()
        return max(range(len(total)), key=lambda i: (total[i], -i))

    def votes(self) -> dict[str, list[float]]:
        """Paths with their share of the best score (0 below ``VOTES``), and whether they add text, add links, and are there."""
        total = self.scores()
        top = max(total)
        out: dict[str, list[float]] = {}
        if top > 0:
            voted = set()
            for i, score in enumerate(total):
                while score >= VOTES * top and i >= 0 and i not in voted:
                    voted.add(i)
                    i = self.parent[i]
            added = self.added()
            for i in sorted(voted):
                share = total[i] / top if total[i] >= VOTES * top else 0.0
                before = out.get(self.path[i], [0.0, 0, 0, 1])
                out[self.path[i]] = [max(b, n) for b, n in zip(before, (share, *added[i], 1), strict=True)]
        return out

    def added(self) -> list[tuple[int, int]]:
        """Whether each container has more text than links, or links and no more text, beside its largest child."""
        free, linked = [0] * len(self.parent), [0] * len(self.parent)
        for text, links, container in self.blocks:
            free[container] += len(text) - links
            linked[container] += links
        largest = [(0, 0)] * len(self.parent)
        # A parent has a smaller number than its children.
        for i in range(len(self.parent) - 1, 0, -1):
            up = self.parent[i]
            free[up] += free[i]
            linked[up] += linked[i]
            largest[up] = max(largest[up], (free[i], linked[i]))
        beside = [(f - a, n - b) for f, n, (a, b) in zip(free, linked, largest, strict=True)]
        return [(int(more > links), int(0 < links >= more)) for more, links in beside]

    def widened(self, chosen: int) -> int:
        added = self.added()
        chain = [chosen]
        while self.parent[chain[-1]] >= 0:
            chain.append(self.parent[chain[-1]])
        return chain[widest([(self.path[i], *added[i], 1) for i in chain])]

    def text(self, chosen: set[int]) -> str:
        inside = [False] * len(self.parent)
        for i, parent in enumerate(self.parent):
            inside[i] = i in chosen or (parent >= 0 and inside[parent])
        return "\n".join(text for text, _, container in self.blocks if inside[container])


def widest(chain: list[tuple[str, int, int, int]]) -> int:
    """The place of the container to take, in a chain from the inside out of (path, pages on which it adds text,
    on which it adds links, all pages with it)."""
    at = 0
    for i in range(1, len(chain)):
        _, text, links, pages = chain[i]
        part = re.split(r"[>.]", chain[i - 1][0].rsplit(">", 1)[-1])[0] in PARTS
        if links > text and not part:
            break
        if part or text >= VOTES * pages:
            at = i
    return at


def main_text(source: str, path: str | None) -> str:
    """Text of the containers on ``path``, or of the page's own best container."""
    page = Page(source)
    if path is not None:
        found = page.text({i for i, p in enumerate(page.path) if p == path})
        if found:
            return found
    return page.text({page.widened(page.best())})


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def with_host(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumn("host", F.lower(F.regexp_extract(url, HOST, 1)))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host's pages, the least of equals, widened."""
    ship_package(pages.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, str], list[float]] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, votes in Page(source or "").votes().items():
                    before = held.get((host, path), (0.0, 0, 0, 0))
                    held[host, path] = [a + b for a, b in zip(before, votes, strict=True)]
            share, *counts = zip(*held.values(), strict=True) if held else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in held], type=pa.string()),
                    pa.array([p for _, p in held], type=pa.string()),
                    pa.array(share, type=pa.float64()),
                    *[pa.array(c, type=pa.int64()) for c in counts],
                ],
                names=["host", "path", "share", "adds", "links", "pages"],
            )

    schema = "host string, path string, share double, adds long, links long, pages long"
    votes = with_host(pages.select("url", "html")).select("host", "html").mapInArrow(each, schema)
    # Rounded, so that the order of sums cannot tip a tie.
    summed = cut(
        votes.groupBy("host", "path").agg(
            F.round(F.sum("share"), 6).alias("share"), *[F.sum(c).alias(c) for c in ("adds", "links", "pages")]
        )
    )
    won = summed.groupBy("host").agg(F.min(F.struct((-F.col("share")).alias("s"), "path")).alias("m")).select("host", "m.path")
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), ">"))
    chains = (
        won.select("host", F.explode(above).alias("path"))
        .join(summed, ["host", "path"])
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", "adds", "links", "pages")), False).alias("chain"))
    )

    def widen(batch: pa.RecordBatch) -> list:
        found = []
        for chain in batch.column(batch.schema.get_field_index("chain")).to_pylist():
            steps = [(c["path"], c["adds"], c["links"], c["pages"]) for c in chain]
            found.append(steps[widest(steps)][0])
        return [found]

    return add_columns(chains, [("path", T.StringType())], widen).select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every page; ``path`` is the host's, null if it has none."""
    read = with_host(pages.select("page_id", "url", "html"))
    joined = read.join(host_paths(pages), "host", "left").drop("host")

    def compute(batch: pa.RecordBatch) -> list:
        paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
        found = [main_text(t, p) for t, p in zip(texts(batch, "html"), paths, strict=True)]
        return [found, [len(t) for t in found], [None] * len(found)]

    # A new column ``html`` takes the place of the source, which so does not come back.
    fields = [("text", T.StringType()), ("n_chars", T.LongType()), ("html", T.StringType())]
    return add_columns(joined, fields, compute).select("page_id", "url", "text", "n_chars", "path")
