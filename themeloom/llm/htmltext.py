"""Main text of web pages by paths that a host's pages agree on.

1. Every page is read into blocks of text, each with the elements around it.
   Its containers are scored by the text they hold, less what stands in links,
   and the page votes for the path of its best container. A path is the tags
   and classes from the root down, with digits made equal.
2. Votes are counted per host and path, and the paths with most votes win:
   those with at least ``ENOUGH`` of the votes of the leading path.
3. Every page is read again, and the text of the containers at its host's
   winning paths is taken, the leading path first. A page without any falls
   back on its own best container.

Votes are added up in the tasks before they are shuffled, so a host with a
third of all pages is a few rows. The table of winners has one row per host;
Spark broadcasts it if it is small and joins it otherwise.

Left out are scripts, styles, menus, headers, footers, sidebars, notices,
adverts, forms and comments of readers, known by tag, role or class. Nothing
else is dropped: a block keeps its links and its inner markup's text.

Defined results: a null or empty html gives an empty text; a null url, or one
without a host, is the host of that name; repeated rows give repeated rows; an
empty table gives an empty table; other columns are not read.
"""

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.llm.rows import map_batches
from themeloom.plans.staging import staged

# A container holds the main text if it has this share of the page's text.
MOST_OF_TEXT = 0.8
# A path wins with this share of the leading path's votes; at most so many win.
ENOUGH = 0.2
WINNERS = 5
# Different paths that a task counts before it sends them.
MOST_HELD = 50_000

# Kinds of elements.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside form iframe svg canvas button select "
    "textarea input label dialog menu object embed audio video map math".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
SECTIONS = frozenset("article main".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form tablist".split()
)
JUNK_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promos promotion "
    "recommended related replies reply respond share sharing sidebar sidebars signup skyscraper "
    "social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>?",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?"
)
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# What ends an open element of the same kind, up to a parent of the other kind.
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
# The same from the other side: which open elements a new one may end.
MAY_CLOSE: dict[str, list[str]] = {}
for _open, _ends in CLOSED_BY.items():
    for _tag in _ends:
        MAY_CLOSE.setdefault(_tag, []).append(_open)


@dataclass(slots=True)
class Element:
    """An element, its parent's number, and its path's number in ``Paths``."""

    tag: str
    path: int
    parent: int
    junk: bool
    in_section: bool
    in_link: bool


@dataclass(slots=True)
class Block:
    """Text of one block, and the innermost element that was open at its end."""

    text: str
    linked: int
    inside: int


class Paths:
    """The different paths of a page, each as its last step below another path."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.numbers: dict[tuple[int, str], int] = {}

    def below(self, path: int, step: str) -> int:
        number = self.numbers.setdefault((path, step), len(self.steps))
        if number == len(self.steps):
            self.steps.append((path, step))
        return number

    def text(self, path: int) -> str:
        found = []
        while path:
            path, step = self.steps[path]
            found.append(f">{step}")
        return "".join(reversed(found))

    def find(self, text: str) -> int | None:
        """The number of a path that the page has."""
        path: int | None = 0
        for step in text.split(">")[1:]:
            path = self.numbers.get((path, step))
            if path is None:
                break
        return path


@dataclass(slots=True)
class Page:
    """All elements, parents before children, and the blocks that are not left out."""

    elements: list[Element]
    blocks: list[Block]
    paths: Paths


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def _is_junk(tag: str, attributes: dict[str, str], in_section: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_section):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES or HIDDEN.search(attributes.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(word.lower() in JUNK_WORDS for word in CLASS_WORD.findall(named))


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(set(attributes.get("class", "").split()))
    return DIGITS.sub("#", ".".join([tag, *classes])).replace(">", "#")


def parse(source: str) -> Page:
    """The page, in time and memory that grow with its length, however deep it is."""
    paths = Paths()
    elements = [Element("", 0, -1, False, False, False)]
    open_tags: dict[str, int] = defaultdict(int)
    blocks: list[Block] = []
    stack = [0]
    pieces: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack[-1]))
            pieces.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        top = elements[stack[-1]]
        if text and not top.junk:
            pieces.append(text)
            if top.in_link:
                linked += len(text.strip())

    def close(at: int) -> None:
        if any(elements[i].tag in BLOCKS for i in stack[at:]):
            end_block()
        for i in stack[at:]:
            open_tags[elements[i].tag] -= 1
        del stack[at:]

    at, n = 0, len(source)
    while at < n:
        found = TOKEN.search(source, at)
        if not found:
            put(source[at:])
            break
        put(source[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            if found[0].startswith("<![CDATA["):
                put(found[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if found[1]:
            places = range(len(stack) - 1, 0, -1) if open_tags[tag] else ()
            open_at = next((i for i in places if elements[stack[i]].tag == tag), 0)
            if open_at:
                close(open_at)
            elif tag == "p":
                end_block()
            elif tag == "br":
                put(" ")
            continue
        if tag == "br":
            put(" ")
            continue
        attributes = _attributes(found[3]) if found[3].strip(" /") else {}
        # Elements whose end tag may be left out.
        may_close = tag in MAY_CLOSE and any([open_tags[other] for other in MAY_CLOSE[tag]])
        for i in range(len(stack) - 1, 0, -1) if may_close else ():
            open_tag = elements[stack[i]].tag
            if tag in CLOSED_BY.get(open_tag, ()):
                close(i)
                break
            if open_tag in ("ul", "ol", "dl", "table", "select") or (
                open_tag in CONTAINERS and open_tag not in ("td", "tr", "tbody")
            ):
                break
        if tag in BLOCKS:
            end_block()
        if tag in VOID:
            continue
        parent = elements[stack[-1]]
        path = parent.path
        if tag in CONTAINERS or tag == "html":
            path = paths.below(path, _step(tag, attributes))
        elements.append(
            Element(
                tag,
                path,
                stack[-1],
                parent.junk or _is_junk(tag, attributes, parent.in_section),
                parent.in_section or tag in SECTIONS,
                parent.in_link or tag == "a",
            )
        )
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            if tag in ("script", "style", "noscript", "iframe"):
                elements.pop()
            else:
                stack.append(len(elements) - 1)
                put(source[at : end.start() if end else n])
                stack.pop()
            at = end.end() if end else n
            continue
        stack.append(len(elements) - 1)
        open_tags[tag] += 1
    end_block()
    return Page(elements, blocks, paths)


def best_container(page: Page) -> int:
    """The innermost container that holds most of the page's text outside links."""
    elements = page.elements
    held = [0] * len(elements)
    has_block = [False] * len(elements)
    for block in page.blocks:
        held[block.inside] += len(block.text) - block.linked
        has_block[block.inside] = True
    # Children come after their parents, so they are added up from the end.
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        has_block[elements[i].parent] |= has_block[i]
    containers = [i for i, e in enumerate(elements) if has_block[i] and e.tag in CONTAINERS]
    if not containers:
        return 0
    depth = [0] * len(elements)
    for i in range(1, len(elements)):
        depth[i] = depth[elements[i].parent] + 1
    whole = max(held[i] for i in containers)
    enough = [i for i in containers if held[i] >= MOST_OF_TEXT * whole]
    return max(enough, key=lambda i: (depth[i], held[i], -i))


def text_of(page: Page, containers: set[int]) -> str:
    """The blocks that stand in any of the containers."""
    within = [False] * len(page.elements)
    for i, element in enumerate(page.elements):
        within[i] = i in containers or (i > 0 and within[element.parent])
    return "\n".join(block.text for block in page.blocks if within[block.inside])


def extract(source: str | None, winners: list[str]) -> str:
    """The text at the first winning path that has any, else of the best container."""
    page = parse(source or "")
    for winner in winners:
        path = page.paths.find(winner)
        if path is None:
            continue
        at = {i for i, e in enumerate(page.elements) if e.path == path and e.tag in CONTAINERS}
        text = text_of(page, at)
        if text:
            return text
    return text_of(page, {best_container(page)})


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, n``: pages of the host whose best container is at the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            keys = list(held)
            made = {
                "host": pa.array([k[0] for k in keys], pa.string()),
                "path": pa.array([k[1] for k in keys], pa.string()),
                "n": pa.array([held[k] for k in keys], pa.int64()),
            }
            held.clear()
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = parse(source or "")
                if page.blocks:
                    best = page.elements[best_container(page)]
                    held[host, page.paths.text(best.path)] += 1
                if len(held) > MOST_HELD:
                    yield sent()
        yield sent()

    parts = pages.select("host", "html").mapInArrow(run, "host string, path string, n long")
    return parts.groupBy("host", "path").agg(F.sum("n").alias("n"))


def winning_paths(counted: DataFrame) -> DataFrame:
    """``host, winners``: at most WINNERS paths of each host, the leading one first."""
    of_host = W.partitionBy("host").orderBy(F.desc("n"), "path")
    ranked = counted.withColumn("at", F.row_number().over(of_host)).where(F.col("at") <= WINNERS)
    paths = F.array_sort(F.collect_list(F.struct("at", "n", "path")))
    lists = ranked.groupBy("host").agg(paths.alias("all"))
    enough = F.filter("all", lambda p: p["n"] >= F.col("all")[0]["n"] * ENOUGH)
    return lists.select("host", F.transform(enough, lambda p: p["path"]).alias("winners"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``page_id, url, html``."""
    hosted = _with_host(pages)
    winners = staged(winning_paths(votes(hosted)), "winning-paths")
    met = hosted.join(winners, "host", "left").select("page_id", "url", "html", "winners")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            texts = [extract(source, paths or []) for source, paths in rows]
            return {
                "page_id": batch.column(0),
                "url": batch.column(1),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(text) for text in texts], pa.int64()),
            }

        return work

    return map_batches(met, "page_id long, url string, text string, n_chars long", make)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
