"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# HTML element names by role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video button select "
    "option textarea input label fieldset nav menu aside footer dialog".split()
)
CONTENT = frozenset("article main".split())
INLINE_CLOSED_BY_BLOCK = frozenset("p".split())

# Words in class, id and role attributes that name what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar "
    "topbar widget widgets".split()
)
# Of these, the words for what is written in whole sentences beside an article.
BESIDE = frozenset(
    "comment comments consent cookie cookies disclaimer disqus gdpr recommended related replies reply respond teaser".split()
)
# Class names that begin or end so tell how a page is laid out, not what an element holds.
LAYOUT_FIRST = frozenset("has with without no".split())
LAYOUT_LAST = frozenset("open closed enabled disabled".split())
ROLES = frozenset("banner navigation complementary contentinfo search form alert dialog menu menubar".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

SIGMA = 1.0


@dataclass
class Block:
    """A line of the page: the text between two block boundaries, and what surrounds it.

    ``named`` is the innermost open element that only its class, id or being a form calls
    noise, as a number in the parser's tree of such elements; 0 for none.
    """

    section: int
    noise: bool
    content: bool
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    text: str = ""
    named: int = 0
    linked: int = 0


class BlockParser(HTMLParser):
    """Turns parser events into blocks, keeping a stack of open elements.

    Unclosed and misplaced tags are tolerated: an end tag closes the nearest open
    element of its name or nothing, a block element ends an open paragraph. A declaration or
    marked section of an unknown kind is a comment up to the next ``>``; a comment, declaration or instruction
    that never ends goes to the end of the page. Every event takes time independent of how many elements are open,
    but for those it closes.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int, int]] = []
        self.open: dict[str, int] = {}
        self.block_at: list[int] = []  # places of block elements in the stack
        self.sections = 0
        self.ending = False
        # of every element that only a name calls noise: its parent in this tree, and whether BESIDE holds the name
        self.named: list[tuple[int, bool]] = [(0, False)]
        self.blocks = [Block(0, False, False)]

    def read(self, html: str) -> list[Block]:
        self.feed(html)
        self.ending = True
        self.close()
        return self.blocks

    def _or_rest(self, end: int) -> int:
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._or_rest(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._or_rest(super().parse_pi(i))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self._or_rest(self.rawdata.find(">", i) + 1 or -1)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.parse_marked_section(i)

    def _state(self) -> tuple[bool, bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, False, 0, 0)

    def _break(self) -> None:
        noise, content, section, named = self._state()
        last = self.blocks[-1]
        if last.parts:
            self.blocks.append(Block(section, noise, content, named=named))
        else:
            last.section, last.noise, last.content, last.named = section, noise, content, named

    def _close_from(self, place: int) -> None:
        for name, *_ in self.stack[place:]:
            self.open[name] -= 1
        del self.stack[place:]
        while self.block_at and self.block_at[-1] >= place:
            self.block_at.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.blocks[-1].tags += 1
        if tag == "br" or tag == "wbr":
            self.blocks[-1].parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCK and self.block_at:
            # the innermost block element, if it ends where the next begins
            inner = self.stack[self.block_at[-1]][0]
            if inner in INLINE_CLOSED_BY_BLOCK or inner == tag == "li":
                self._close_from(self.block_at[-1])
        if tag in VOID:
            if tag in BLOCK:
                self._break()
            return
        noise, content, section, named = self._state()
        never = is_noise(tag, attrs, content)
        article = tag in CONTENT or any(k == "role" and v == "main" for k, v in attrs)
        words = frozenset() if never or article or tag in ("html", "body") else noise_words(attrs)
        beside = bool(words & BESIDE) or (tag == "form" and not never)
        if (never or words or beside or article) and not noise:
            self.sections += 1
            section = self.sections
        if words or beside:
            self.named.append((named, beside))
            named = len(self.named) - 1
        if tag in BLOCK:
            self.block_at.append(len(self.stack))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, noise or never, content or (article and not never), section, named))
        if tag in BLOCK or never != noise or words or beside:
            self._break()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.blocks[-1].tags += 1
        if not self.open.get(tag):
            if tag in BLOCK:
                self._break()
            return
        place = len(self.stack) - 1
        while self.stack[place][0] != tag:
            place -= 1
        left = self.stack[place][1], self.stack[place][4]
        self._close_from(place)
        if tag in BLOCK or left != (self._state()[0], self._state()[3]):
            self._break()

    def handle_data(self, data: str) -> None:
        self.blocks[-1].parts.append(data)
        if self.open.get("a"):
            self.blocks[-1].linked += len(data)


def is_noise(tag: str, attrs: list, in_content: bool) -> bool:
    """Whether an element by its name, role or being hidden holds menus, forms, adverts and the like."""
    if tag in NEVER or (tag == "header" and not in_content):
        return True
    if tag in ("html", "body"):
        return False
    for key, value in attrs:
        if not value:
            continue
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "aria-hidden" and value == "true":
            return True
    return any(key == "hidden" for key, _ in attrs)


def noise_words(attrs: list) -> frozenset[str]:
    """The words of NOISE in an element's class names and id, without names of a layout."""
    found = set()
    for key, value in attrs:
        for name in value.split() if key in ("class", "id") and value else ():
            words = [t.lower() for t in _TOKEN.findall(name)]
            if words and not (len(words) > 1 and (words[0] in LAYOUT_FIRST or words[-1] in LAYOUT_LAST)):
                found.update(words)
    return NOISE & found


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; weights outside the page are left out."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, mode="full")[reach:reach + len(values)]
    return np.convolve(values, kernel, mode="full")[reach:reach + len(values)] / weight


def split_threshold(values: np.ndarray, rounds: int = 50) -> float:
    """Middle between the centres of two clusters on a line (two-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all() or not upper.any():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def page_blocks(html: str | None) -> tuple[list[Block], list[tuple[int, bool]]]:
    """(blocks with text, tree of the elements that only a name calls noise)."""
    parser = BlockParser()
    blocks = parser.read(html or "")
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text], parser.named


def named_noise(
    blocks: list[Block], tree: list[tuple[int, bool]], ratio: np.ndarray, never: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(noise, upper) of each block, elements that only a class or id calls noise judged by their text.

    The ratios of such an element are smoothed for themselves and clustered with the
    others of the page. It is content if over half of its text is in the upper cluster. One
    that a word of BESIDE names, or a form, must hold most text of the page too, and all of the upper
    cluster, as comments may be long. Noise within content is judged by itself.
    """
    length = np.array([len(b.text) for b in blocks])
    own = np.zeros(len(blocks))
    groups: dict[int, list[int]] = {}
    for i in np.flatnonzero(~never):
        groups.setdefault(blocks[i].named, []).append(i)
    for at in groups.values():
        own[at] = np.log1p(smooth(ratio[at]))
    upper = ~never & (own >= split_threshold(own[~never]))
    # text, upper text and upper blocks of every element with all inside it; children have greater numbers
    sums = np.zeros((len(tree), 3), np.int64)
    for e, at in groups.items():
        sums[e] = length[at].sum(), length[at][upper[at]].sum(), upper[at].sum()
    for e in range(len(tree) - 1, 0, -1):
        sums[tree[e][0]] += sums[e]
    shut = [False] * len(tree)
    for e in range(1, len(tree)):
        parent, beside = tree[e]
        text, high, count = sums[e]
        content = 2 * high > text
        if beside:
            content &= 2 * text > sums[0][0] and count == sums[0][2]
        shut[e] = shut[parent] or not content
    noise = never.copy()
    for e, at in groups.items():
        noise[at] = shut[e]
    return noise, upper


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks, kept blocks) of a page.

    Every block has a ratio of text to tags; noise has none. What only a class or id calls
    noise is judged by these ratios first. The ratios are smoothed
    and split in two clusters. A section (an article, or what lies between noise) is
    content if any of its blocks is in the upper cluster, and then stays whole, so
    that short paragraphs between long ones are kept. Where the page marks an
    article or a main part, only blocks inside it are candidates; one inside an element
    named as noise counts as such if it holds most of the upper cluster's text. Of several marked
    articles a short one stays too, unless it is mostly links.
    """
    blocks, tree = page_blocks(html)
    never = np.array([b.noise for b in blocks], bool)
    if never.all():
        return "", len(blocks), 0
    ratio = np.array([len(b.text) / max(1, b.tags) for b in blocks])
    noise, upper = named_noise(blocks, tree, ratio, never)
    content = np.array([b.content for b in blocks], bool) & ~noise
    length = np.array([len(b.text) for b in blocks]) * (upper & ~noise)
    marked = any(c and not b.named for b, c in zip(blocks, content)) or 2 * length[content].sum() > length.sum()
    candidate = content if marked else ~noise
    if not candidate.any():
        return "", len(blocks), 0
    ratio = ratio * candidate
    smoothed = np.log1p(smooth(ratio)) * candidate
    high = candidate & (smoothed >= split_threshold(smoothed))
    section = np.array([b.section for b in blocks]) if marked else np.cumsum(noise)
    chosen = np.isin(section, section[high])
    if marked:
        chosen |= np.isin(section, prose_sections(blocks, section, candidate))
    kept = [b.text for b, c in zip(blocks, candidate & chosen) if c]
    return " ".join(kept), len(blocks), len(kept)


def prose_sections(blocks: list[Block], section: np.ndarray, candidate: np.ndarray) -> list[int]:
    """Marked sections with more text outside of links than inside."""
    text, linked = {}, {}
    for b, at, c in zip(blocks, section.tolist(), candidate):
        if c:
            text[at] = text.get(at, 0) + len(b.text)
            linked[at] = linked.get(at, 0) + b.linked
    return [at for at, n in text.items() if 2 * linked[at] < n]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row: (page_id, url, text, n_chars, n_blocks, n_kept).

    Whole pages are read, whatever their length, in time that grows with it. Malformed markup never fails: see
    ``BlockParser``. A null or empty page, or one without
    content, has an empty text; null ids and URLs stay; repeated rows each get their row;
    an empty table gives an empty result; further columns are not read.
    """
    @F.arrow_udf("struct<text: string, blocks: int, kept: int>")
    def extract(html: pa.Array) -> pa.Array:
        rows = [main_text(h.as_py()) for h in html]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int32())],
            ["text", "blocks", "kept"],
        )

    found = pages.select("page_id", "url", extract("html").alias("main"))
    return found.select(
        "page_id", "url", "main.text", F.length("main.text").cast("long").alias("n_chars"),
        F.col("main.blocks").alias("n_blocks"), F.col("main.kept").alias("n_kept"),
    )
