"""Main text of web pages by two-pass block rules.

A tokeniser cuts the page into blocks at block-level tags and notes each block's element, its link characters, its
landmark (article or main) and whether it stands in a region that is never article text (menus, headers, footers,
sidebars, notices, adverts, forms, comments, by element, role or class name). Pass 1 decides blocks by link density,
length and stop-word density; pass 2 gives the short and the ambiguous ones the label of their nearest decided
neighbours. Where a page has a landmark, blocks outside of it are surroundings, and within it pass 1 finds nothing bad,
as a linked paragraph or a table of an article belongs to it; elsewhere the two passes decide alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load

#: Rules of pass 1: words of a long block, link densities, stop-word density.
LONG_WORDS = 12
LINK_BAD, LINK_LOW = 0.5, 0.2
STOP_GOOD = 0.1

#: Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you we were their been has there one all "
    "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también "
    "et les des une est pas dans qui au pour sur ce il du plus par je avec tout faire son mettre autre ne ou elle être nous vous ont cette "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum".split()
)
#: Elements whose text is never article text.
SKIPPED = frozenset("nav header footer aside form dialog menu head fieldset".split())
#: Elements within a line whose content is not text of the line.
SILENT = frozenset("script style noscript template iframe svg button select option textarea object canvas audio video title map label".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
#: Elements that part blocks, elements without content.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LANDMARKS = frozenset(("article", "main"))
#: Elements of running text, where a link alone is no menu.
PARAGRAPHS = frozenset("p blockquote pre figcaption dd h1 h2 h3 h4 h5 h6".split())
#: Parts of class and id names of regions around an article, and parts that go with them. A name with any
#: other part (has-sidebar, share-prices, entry-header) says something else.
REGION_NAMES = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted related rail register replies search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split())
NEUTRAL_NAMES = frozenset("area bar block bottom box btn button buttons column container element fixed floating form global group holder icons inner item items layer left link links list mobile module outer panel posts primary right row secondary section site slot sticky thread top unit wrap wrapper zone".split())
#: Of these, those that an article may have itself.
HEADER_NAMES = frozenset(("header", "masthead"))
REGION_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")


@dataclass
class Block:
    text: str
    link_chars: int
    landmark: int  # 0: none
    skipped: bool
    tag: str  # the innermost block element


@dataclass
class _Open:
    """An open element; the flags hold for all within it."""

    tag: str
    skip: bool
    landmark: int
    block: str
    silent: bool


@dataclass
class _Reader:
    """Collects the text of the block that is open."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def close(self, o: _Open) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.blocks.append(Block(text, self.linked, o.landmark, o.skip, o.block))
        self.parts, self.linked = [], 0


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def is_region_name(name: str, inside: bool) -> bool:
    """Whether a class or id name says that an element stands around the article; inside: within a landmark."""
    parts = {p.lower() for p in _PART.findall(name)}
    regions = parts & REGION_NAMES - (HEADER_NAMES if inside else frozenset())
    return bool(regions) and all(p in REGION_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts)


def is_region(raw: str, inside: bool = False) -> bool:
    """Whether the attributes of an element say that it stands around the article, or is hidden."""
    if not raw.strip(" /"):
        return False
    found = attributes_of(raw)
    if found.get("role", "").lower() in REGION_ROLES or "hidden" in found:
        return True
    return any(is_region_name(name, inside) for key in ("class", "id") for name in found.get(key, "").split())


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Broken markup is read as browsers do: what is left open ends with what holds it."""
    reader, at, landmarks = _Reader(), 0, 0
    end, stack = len(page), [_Open("", False, 0, "", False)]
    opened: Counter = Counter()
    link = 0  # the height of the stack at which a link is open; 0: none

    def push(tag: str, skip: bool = False, landmark: int = 0, silent: bool = False) -> None:
        above = stack[-1]
        stack.append(_Open(tag, skip or above.skip, landmark or above.landmark, tag if tag in BLOCKS else above.block, silent or above.silent))
        opened[tag] += 1

    def cut(k: int) -> None:
        nonlocal link
        for o in stack[k:]:
            opened[o.tag] -= 1
        del stack[k:]
        if len(stack) < link:
            link = 0

    def text(chunk: str) -> None:
        if not stack[-1].silent:
            chunk = html.unescape(chunk)
            reader.parts.append(chunk)
            if link:
                reader.linked += len(chunk.strip())

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        if not m.group(4):
            break  # the page ends within a tag
        tag = tag.lower()
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS or tag in SKIPPED:
            reader.close(stack[-1])
        if m.group(1):
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            if tag == "a":
                link = 0
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag == "a":
            link = len(stack) if "href" in attributes_of(m.group(3)) else 0
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        inside = bool(stack[-1].landmark)
        if tag in LANDMARKS and not inside:
            # an article that starts in a region which was left open ends it
            if stack[-1].skip:
                cut(next(k for k, o in enumerate(stack) if o.skip))
            landmarks += 1
            push(tag, False, landmarks)
        elif tag in BLOCKS or tag in SKIPPED:
            if tag == "p" and stack[-1].tag == "p":
                cut(len(stack) - 1)
            named = (tag not in ("html", "body", "main") and (tag != "article" or inside)) and is_region(m.group(3), inside)
            push(tag, tag in SKIPPED and not (tag == "header" and inside) or named)
        elif tag in SILENT:
            push(tag, silent=True)
        elif tag != "a" and is_region(m.group(3), inside):
            reader.close(stack[-1])
            push(tag, True)
    reader.close(stack[-1])
    return reader.blocks


def first_pass(block: Block) -> bool | None:
    """True: article text; False: not; None: ambiguous."""
    if block.skipped:
        return False
    density = min(1.0, block.link_chars / len(block.text))
    if density > LINK_BAD:
        return None if block.landmark or block.tag in PARAGRAPHS else False
    words = _WORD.findall(block.text.lower())
    if len(words) < LONG_WORDS:
        return None
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if density <= LINK_LOW and (stops >= STOP_GOOD or _SENTENCE.search(block.text)):
        return True
    return None


def _nearest(blocks: list[Block], first: list[bool | None], order: range) -> list[int | None]:
    """For each block the decided block of its landmark that comes last before it in this order."""
    out: list[int | None] = [None] * len(blocks)
    last: dict[int, int] = {}
    for i in order:
        out[i] = last.get(blocks[i].landmark)
        if first[i] is not None and not blocks[i].skipped:
            last[blocks[i].landmark] = i
    return out


def labels_of(blocks: list[Block]) -> list[bool]:
    """Both passes. Blocks of a landmark ask neighbours within it alone, and count as article text if none is decided.

    The nearer neighbour decides; of two equally near ones, and for a heading, the one behind if it is article text.
    Without any decided block on a page, all ambiguous ones count as its text.
    """
    first = [first_pass(b) for b in blocks]
    lefts, rights = _nearest(blocks, first, range(len(blocks))), _nearest(blocks, first, range(len(blocks) - 1, -1, -1))
    has_landmark = any(b.landmark and not b.skipped for b in blocks)
    out = []
    for i, (block, label) in enumerate(zip(blocks, first)):
        if has_landmark and not block.landmark:
            label = False
        if label is None:
            left, right = lefts[i], rights[i]
            if left is None and right is None:
                label = bool(block.landmark) or not any(first)
            elif left is None or right is None:
                label = first[right if left is None else left]
            elif i - left == right - i or block.tag in HEADINGS:
                label = first[right] or block.tag not in HEADINGS and first[left]
            else:
                label = first[left] if i - left < right - i else first[right]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The main text: decided blocks in page order, joined by an empty line; empty for null and empty pages."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, labels_of(blocks)) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keep columns, text and n_chars (code points), one row per input row in one narrow pass.

    Null and empty html give an empty text. Repeated rows each get theirs; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("__html"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLE_SQL: dict[str, str] = {}
