"""Main text of web pages by two passes of block rules.

Markup is cut into blocks at block-level tags. The first pass looks at each block's text: the share of its characters in
links, the share of stop words, and its length decide whether it is content or boilerplate or ambiguous (short or
middling). Tags and class names of navigation, headers, footers, sidebars, notices, adverts, forms and reader comments
only veto: what they hold is never content. An article or main element is a border: links in running text don't speak
against a block inside one, and ambiguous blocks inside it look for neighbours inside it only, its edges counting as content.

The second pass gives ambiguous blocks the label of the nearest decided neighbour, counted in blocks. Vetoed blocks are
no neighbours, as their text decided nothing, and neither is the page's edge. At equal distances to unlike neighbours, and
for headings before content, longer blocks and headings are content, short blocks boilerplate; a page on which no text decides has none outside its articles.

Stop words are known for four languages. On a page that hardly has any of them its language is taken for unknown, and
length and links decide alone.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Defined results: null, empty and text-free pages give an empty text; repeated rows give repeated results; nothing is
cut, however long the page, and reading takes time in proportion to it; the rest of a page behind an unclosed script, style, title, template or
the like belongs to that element, as in browsers, and is no text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import pieces

# Element and word lists.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br-block caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select button canvas audio video head title".split())
RAW = frozenset("script style textarea title template noscript iframe svg".split())
BAD_PLACES = frozenset("nav header footer aside form menu dialog".split())
GOOD_PLACES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsbygoogle|banner|sponsor\w*|promo\w*|sidebar|side-bar|nav\w*|menu\w*|footer|header|masthead|breadcrumb\w*"
    r"|cookie\w*|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|signup|comment\w*|replies|reply|disqus|respond"
    r"|share|sharing|social|related|recommend\w*|widget\w*|login|search|pagination|pager|toolbar|copyright|legal|skip)(?:$|[\s_-])",
    re.I,
)
STOP_WORDS = frozenset(
    # English
    "the of and to in a is was that for it as with be by on not he i this are or his from at which but have an had they you were their one all we"
    # German
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer"
    # French
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou elle aux"
    # Spanish
    " el los del las por con una su para es al lo como más o pero sus ha me si sin sobre este ya entre cuando todo esta".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.28
LINKS_HIGH = 0.25
STOP_UNKNOWN = 0.10

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"\w+")


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "links", "place", "tag", "label", "rule")

    def __init__(self, text: str, links: int, place: int, tag: str):
        self.text, self.links, self.place, self.tag, self.label, self.rule = text, links, place, tag, "", ""


def _place_of(tag: str, attributes: str) -> int:
    """-1 boilerplate, 1 content, 0 unsaid."""
    if tag in BAD_PLACES:
        return -1
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return -1
            if name == "style":
                if re.search(r"display\s*:\s*none", value, re.I):
                    return -1
            elif name == "role":
                if value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
                    return -1
            elif tag not in ("body", "html", "article", "main") and BAD_NAMES.search(value):
                return -1
    return 1 if tag in GOOD_PLACES else 0


class _Open:
    """An open element, with what it and all around it amount to."""

    __slots__ = ("tag", "place", "skipped", "leaf", "blocks", "nearest")

    def __init__(self, tag: str, place: int, skipped: bool, around: _Open | None, depth: int):
        self.tag = tag
        before = around.place if around else 0
        self.place = -1 if before < 0 or place < 0 else max(before, place)
        self.skipped = skipped or bool(around and around.skipped)
        block = tag in BLOCK_TAGS
        self.leaf = tag if block else around.leaf if around else ""
        self.blocks = (around.blocks if around else 0) + block
        self.nearest = depth if block else around.nearest if around else -1  # the place of the innermost block element


class _Stack:
    """Open elements; finding an element by its tag takes the same time at any depth."""

    def __init__(self):
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> _Open | None:
        return self.open[-1] if self.open else None

    def push(self, tag: str, place: int, skipped: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(tag, place, skipped, self.top, len(self.open)))

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.open.pop().tag].pop()

    def close(self, tag: str, is_block: bool) -> None:
        """Closes up to the nearest such element; end tags of inline elements don't close block elements."""
        at = self.places.get(tag)
        if at and (is_block or self.open[-1].blocks == self.open[at[-1]].blocks):
            self.cut(at[-1])

    def close_implied(self, closes: tuple[str, ...]) -> None:
        """Closes the innermost block elements while they are of the tags that a start tag ends."""
        while self.open and self.open[-1].nearest >= 0 and self.open[self.open[-1].nearest].tag in closes:
            self.cut(self.open[-1].nearest)


INLINE = frozenset("b i span em strong a font small u".split())
IMPLIED = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class _Open:
    """An open element, with what it and all around it amount to."""

    __slots__ = ("tag", "place", "skipped", "leaf", "blocks", "nearest")

    def __init__(self, tag: str, place: int, skipped: bool, around: _Open | None, depth: int):
        self.tag = tag
        before = around.place if around else 0
        self.place = -1 if before < 0 or place < 0 else max(before, place)
        self.skipped = skipped or bool(around and around.skipped)
        block = tag in BLOCK_TAGS
        self.leaf = tag if block else around.leaf if around else ""
        self.blocks = (around.blocks if around else 0) + block
        self.nearest = depth if block else around.nearest if around else -1  # the place of the innermost block element


class _Stack:
    """Open elements; finding an element by its tag takes the same time at any depth."""

    def __init__(self):
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> _Open | None:
        return self.open[-1] if self.open else None

    def push(self, tag: str, place: int, skipped: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(tag, place, skipped, self.top, len(self.open)))

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.open.pop().tag].pop()

    def close(self, tag: str, is_block: bool) -> None:
        """Closes up to the nearest such element; end tags of inline elements don't close block elements."""
        at = self.places.get(tag)
        if at and (is_block or self.open[-1].blocks == self.open[at[-1]].blocks):
            self.cut(at[-1])

    def close_implied(self, closes: tuple[str, ...]) -> None:
        """Closes the innermost block elements while they are of the tags that a start tag ends."""
        while self.open and self.open[-1].nearest >= 0 and self.open[self.open[-1].nearest].tag in closes:
            self.cut(self.open[-1].nearest)


INLINE = frozenset("b i span em strong a font small u".split())
IMPLIED = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def split_blocks(page: str) -> list[Block]:
    """Blocks in page order. Unclosed and stray tags are tolerated: an end tag closes up to its nearest open match."""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    links = anchor = at = 0

    def flush() -> None:
        nonlocal links, parts
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = stack.top
                blocks.append(Block(text, links, top.place if top else 0, top.leaf if top else ""))
        parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not (stack.open and stack.open[-1].skipped):
            parts.append(raw)
            if anchor:
                links += len(" ".join(entities.unescape(raw).split()))

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        is_block = tag in BLOCK_TAGS or tag in SKIPPED
        if is_block:
            flush()
        if m[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            stack.close(tag, is_block)
        elif tag == "br":
            add(" ")
        elif tag in VOID or m[3].endswith("/"):
            continue
        elif tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        else:
            if tag == "a":
                anchor += 1
            if tag in IMPLIED:
                stack.close_implied(IMPLIED[tag])
            if is_block or tag in INLINE:
                stack.push(tag, _place_of(tag, m[3]), tag in SKIPPED)
    add(page[at:])
    flush()
    return blocks


def _stop_share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(b: Block, stops: float | None) -> tuple[str, str]:
    """(label, the rule that gave it) from the block's own text; `stops` is None where the language is unknown."""
    n, inside = len(b.text), b.place > 0
    links = b.links / n
    if links > LINKS_HIGH and not inside:
        return "bad", "many links"
    if b.place < 0:
        return "bad", "veto"
    if links > LINKS_HIGH:
        return "short", ""
    if n < LENGTH_LOW:
        return ("bad", "short with links") if links > 0 and not inside else ("short", "")
    if stops is None or stops >= STOP_HIGH:
        return ("good", "long text" if stops is None else "long, stop words") if n > LENGTH_HIGH else ("near", "")
    return ("near", "") if stops >= STOP_LOW or inside else ("bad", "few stop words")


def _sections(blocks: list[Block]) -> list[tuple[int, int, bool]]:
    """(start, end, inside an article) of runs of blocks, cut at the borders of articles; vetoed blocks cut nothing."""
    out, start, inside = [], 0, False
    for i, b in enumerate(blocks):
        if b.place >= 0 and (b.place > 0) != inside:
            if i > start:
                out.append((start, i, inside))
            start, inside = i, b.place > 0
    return [*out, (start, len(blocks), inside)]


def label_blocks(blocks: list[Block]) -> None:
    """Set every label to good or bad, and the rule that decided."""
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    open_words = [w for b, own in zip(blocks, words, strict=True) if b.place >= 0 for w in own]
    known = _stop_share(open_words) >= STOP_UNKNOWN
    first = [_first_pass(b, _stop_share(w) if known else None) for b, w in zip(blocks, words, strict=True)]
    for start, end, inside in _sections(blocks):
        speaks = lambda i: first[i][0] in ("good", "bad") and blocks[i].place >= 0
        edge = "good" if inside else ""
        follows = [(edge, end)] * (end - start + 1)  # the nearest decided label from a block on, and its place
        for i in range(end - 1, start - 1, -1):
            follows[i - start] = (first[i][0], i) if speaks(i) else follows[i - start + 1]
        before, last = edge, start - 1
        for i in range(start, end):
            b, (kind, rule), (after, then) = blocks[i], first[i], follows[i - start + 1]
            if rule:
                b.label, b.rule = kind, rule
                if b.place >= 0:
                    before, last = kind, i
            elif before == after or not before or not after:
                b.label, b.rule = before or after or "bad", f"{kind}: neighbours"
            elif kind == "near" or after == "good" and re.fullmatch("h[1-6]", b.tag):
                b.label, b.rule = "good", f"{kind}: content on one side"
            else:
                b.label = before if i - last < then - i else after if then - i < i - last else "bad"
                b.rule = f"{kind}: nearer side"


def main_text(page: str | None) -> str:
    blocks = split_blocks(page or "")
    label_blocks(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns with text (string) and n_chars (long), row by row without a shuffle."""
    rows = df.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")

    def run(batches):
        for b in pieces(batches):
            texts = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            columns = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
