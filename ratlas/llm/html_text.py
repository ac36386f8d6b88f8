"""Main text of web pages by two passes over blocks.

The first pass decides a block by its stop-word density, length and link density. The page's structure is a feature beside
them: what stands in menus, footers, forms, adverts, notices or comments is out whatever its densities say, and so is what
stands outside of the article where a page has one. Blocks that are left open (short ones, headings, articles in other
languages, paragraphs that are one link) take the label of their nearest decided neighbours in the second pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ratlas.llm.common import slices

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all
    were when we there can an your which their said if do will each about how up out them then she many some so these
    der die das und ist nicht ein eine zu den von mit sich auf für dem des im auch als an es werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    le la les de des et un une du en que est pour qui dans ce il pas au sur ne se par plus son avec tout mais nous sa on
    aux cette ou elle leur lui sont ses
    el los las y del por con no una su para es lo como más pero sus este ya entre cuando muy sin sobre también me hasta hay
    donde quien desde todo durante""".split()
)
#: Elements by their role.
RAW = frozenset("script style title textarea iframe noframes xmp".split())
DROPPED = frozenset("noscript template svg object select option button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head fieldset datalist".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words in class, id or role that name what isn't the article, and those that also name parts of articles.
MARKS = frozenset(
    """ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar nav navbar navigation menu footer foot
    topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist
    disqus related recommended recommendations newsletter subscribe subscription signup login
    contentinfo complementary toolbar widget masthead pagination pager skip""".split()
)
WEAK = frozenset("side share sharing social reply replies respond search".split())
#: Words of structure, which a mark may be made with; and those of a page's frame, which make header a mark.
NEUTRAL = frozenset(
    """list lists item items section sections box boxes slot slots wrapper wrap area areas block blocks user users site page main article
    articles post posts container inner outer content body group row panel bar links link button buttons form top bottom left right
    global primary secondary thread text title""".split()
)
FRAME = frozenset("site page main global top primary wrapper wrap container inner outer area bar box block row section".split())

#: Share of stop words from which short blocks, taken together, are running text.
STOPS_OF_TEXT = 0.1

_STOP = re.compile(r">|=\s*[\"']")
_NAME = re.compile(r"[a-z][a-z0-9:-]*", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ENDS = {x: re.compile(rf"</{x}(?![\w:-])", re.I) for x in RAW}
_LETTERS = re.compile(r"[^\W\d_]+")
Token = tuple[str, str, bool, str]  # text, tag, whether it ends an element, attributes


@dataclass
class Rules:
    """Limits of the first pass. Lengths are in code points, densities are shares of a block."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.25
    link_high: float = 0.5


@dataclass
class Block:
    text: str
    link_chars: int
    #: 0 outside of any article, else the number of the article that holds the block
    section: int
    #: in a menu, footer, form, advert, notice, comment ...; weak_place: in something whose name may also be an article's
    bad_place: bool
    weak_place: bool
    heading: bool
    label: str = "open"
    #: what decided: links, stop words, length, place, outside, neighbours
    rule: str = ""


def _words(names: str) -> list[set[str]]:
    return [words for w in names.lower().split() if (words := set(re.split(r"[^a-z]+", w)) - {""})]


def _place(rest: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes hide it or mark it as no part of the article, whether they may, and whether they make
    it a page's header. A class, id or role is a mark if it is made of marks and words of structure, with one mark at
    least: user-comments and ad-slot are marks; has-sidebar, with-footer, no-menu and main-content aren't."""
    bad = weak = header = False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id", "role"):
            for words in _words(value):
                bad |= words <= MARKS | NEUTRAL and not words.isdisjoint(MARKS)
                weak |= words <= MARKS | WEAK | NEUTRAL and not words.isdisjoint(MARKS | WEAK)
                header |= words <= FRAME | {"header"} and "header" in words
            bad |= name == "role" and value.lower() == "search"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            bad = True
    return bad, weak, header


class _Scanner:
    """Texts and tags of a page in one forward pass: nothing is read twice, whatever is left open or broken."""

    def __init__(self, page: str):
        self.page, self.quotes = page, {'"': True, "'": True}

    def _close(self, i: int) -> int:
        """The place of the > that ends a tag, behind quoted values; a quote without end is a character like others."""
        while m := _STOP.search(self.page, i):
            if m[0] == ">":
                return m.start()
            quote, i = m[0][-1], m.end()
            if self.quotes[quote]:
                end = self.page.find(quote, i)
                if end < 0:
                    self.quotes[quote] = False
                else:
                    i = end + 1
        return -1

    def tokens(self) -> list[Token]:
        """Raw elements are left out; a script or style without end goes on to the end of the page, any other is a tag like
        all others."""
        page, out, at, low, endless = self.page, [], 0, 0, set()
        while (low := page.find("<", low)) >= 0:
            ahead, end = page[low + 1 : low + 2], page.startswith("/", low + 1)
            name = _NAME.match(page, low + 1 + end)
            if name:
                stop = self._close(name.end())
            elif page.startswith("<!--", low):
                stop = page.find("-->", low + 2)
                stop = stop + 2 if stop >= 0 else len(page)
            elif ahead in ("!", "?") or end:
                stop = page.find(">", low)
            else:  # a sign of its own
                low += 1
                continue
            if stop < 0:
                break  # no tag ends any more
            if low > at:
                out.append((page[at:low], "", False, ""))
            rest = page[name.end() : stop] if name else ""
            at = low = min(stop + 1, len(page))
            tag = name[0].lower() if name else ""
            if not tag:
                continue
            if tag in RAW and not end and tag not in endless and (tag in ("script", "style") or not rest.endswith("/")):
                if over := _ENDS[tag].search(page, at):
                    stop = page.find(">", over.end())
                    at = low = stop + 1 if stop >= 0 else len(page)
                    continue
                endless.add(tag)
                if tag in ("script", "style"):
                    return out
            out.append(("", tag, end, rest))
        if at < len(page):
            out.append((page[at:], "", False, ""))
        return out


class _Page:
    """Blocks from tokens. The open elements are counted by what they mean, so a block asks no ancestor."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, bad, weak, header, number of the article
        self.open_tags: dict[str, int] = {}
        self.bad = self.weak = self.headers = self.sections = 0
        self.weak_outside = {0: 0}  # weak elements around an article don't count in it
        self.link = False

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            section = self.stack[-1][-1] if self.stack else 0
            heading = any(self.open_tags.get(h) for h in HEADINGS)
            bad = self.bad > 0 or self.headers > 0 and not (section and heading)
            links = len(" ".join(html.unescape("".join(self.linked)).split()))
            self.blocks.append(Block(text, links, section, bad, self.weak > self.weak_outside[section], heading))
        self.parts.clear()
        self.linked.clear()

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.link:
            self.linked.append(text)

    def _pop(self) -> str:
        tag, bad, weak, header, _ = self.stack.pop()
        self.open_tags[tag] -= 1
        self.bad -= bad
        self.weak -= weak
        self.headers -= header
        return tag

    def open(self, tag: str, rest: str, spared: bool) -> None:
        self.flush()
        self.link = False
        if tag in VOID:
            return
        if tag == "body":
            while self.stack and self.stack[-1][0] != "html":
                self._pop()
        if tag in CONTENT:  # no menu holds an article: one that is still open was never closed
            while self.stack and self.stack[-1][0] in ("nav", "footer", "header", "menu", "ul", "ol", "li", "p", "head"):
                self._pop()
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
            self._pop()
        bad, weak, header = (False, False, False) if spared or tag in ("html", "body") else _place(rest)
        bad, header = bad or tag in BOILERPLATE, header or tag == "header"
        section = self.stack[-1][-1] if self.stack else 0
        if tag in CONTENT and not bad:
            self.sections += 1
            section = self.sections
            self.weak_outside[section] = self.weak + weak
        self.stack.append((tag, bad, weak, header, section))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.bad += bad
        self.weak += weak
        self.headers += header

    def close(self, tag: str) -> None:
        self.flush()
        self.link = False
        if self.open_tags.get(tag):
            while self._pop() != tag:
                pass


def _structure(tokens: list[Token]) -> tuple[dict[int, int], set[int], set[int]]:
    """The end of each dropped element that has one; and the elements that hold a main or an article without marks."""
    ends, mains, articles = {}, set(), set()
    stack: list[int] = []
    count: dict[str, int] = {}
    for i, (_, tag, end, rest) in enumerate(tokens):
        if not tag or tag in INLINE or tag in VOID:
            continue
        if end:
            while count.get(tag):
                k = stack.pop()
                count[tokens[k][1]] -= 1
                if tokens[k][1] == tag:
                    if tag in DROPPED:
                        ends[k] = i
                    break
        elif not (tag in DROPPED | RAW and rest.endswith("/")):
            if tag in CONTENT and not _place(rest)[0]:
                holders = mains if tag == "main" else articles
                for k in reversed(stack):
                    if k in holders:
                        break
                    holders.add(k)
            stack.append(i)
            count[tag] = count.get(tag, 0) + 1
    return ends, mains, articles


def _read(tokens: list[Token], ends: dict[int, int], spared: set[int]) -> list[Block]:
    state, i, silent = _Page(), -1, False
    while (i := i + 1) < len(tokens):
        text, tag, end, rest = tokens[i]
        if not tag:
            if not silent:
                state.say(text)
        elif tag == "a":
            state.link = not end and "href" in rest.lower()
        elif tag in DROPPED or tag in RAW:
            # one without end is over at the next tag of another block; so is a raw one
            silent = not end and i not in ends and not rest.endswith("/")
            i = ends.get(i, i)
        elif tag not in INLINE:
            silent = False
            if end:
                state.close(tag)
            else:
                state.open(tag, rest, i in spared)
    state.flush()
    return state.blocks


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in order. Works on any string, in time that grows with its length; unclosed elements
    end with their parent. Marks don't count on what holds the page's main, nor, where no article is left otherwise, on
    what holds an article."""
    tokens = _Scanner(page).tokens()
    ends, mains, articles = _structure(tokens)
    blocks = _read(tokens, ends, mains)
    if articles and not any(b.section and not b.bad_place for b in blocks):
        blocks = _read(tokens, ends, mains | articles)
    return blocks


def _density(b: Block, rules: Rules) -> tuple[str, str]:
    """Label and rule by links, stop words and length alone; an article leaves open what other places would lose."""
    n = len(b.text)
    if b.link_chars > rules.link_high * n:
        return ("open", "") if b.section else ("bad", "links")
    if n < rules.short or b.heading:
        return "open", ""
    words = _LETTERS.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= rules.stop_high:
        return "good", "stop words"
    if stop >= rules.stop_low:
        return ("good", "length") if n >= rules.long else ("open", "")
    return ("open", "") if b.section else ("bad", "stop words")


def first_pass(blocks: list[Block], rules: Rules) -> None:
    """Label blocks good, bad or open (to be decided by their neighbours).

    Where a page has no article and no block is good by stop words (another language), length and links decide alone.
    """
    sections = any(b.section and not b.bad_place for b in blocks)
    for b in blocks:
        b.label, b.rule = _density(b, rules)
        if b.label != "bad":
            if b.bad_place or b.weak_place and b.rule == "":
                b.label, b.rule = "bad", "place"
            elif sections and not b.section:
                b.label, b.rule = "bad", "outside"
    if not sections and not any(b.label == "good" for b in blocks):
        for b in blocks:
            if len(b.text) >= rules.long and b.rule == "stop words" and not b.bad_place:
                b.label, b.rule = "good", "length"


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block before and after them, inside their own article if they
    have one: both good or both bad decides; if they differ, the nearer one, at equal distance good. An article without
    any decided block is good as a whole. A page without articles on which no block is decided but by its place or links is
    a page of short blocks: those in no bad place are good if, taken together, they have the stop words of running text.
    Headings outside of articles go with what follows them."""
    if not any(b.section or b.label == "good" for b in blocks):
        short = [b for b in blocks if b.label == "open"]
        said = _LETTERS.findall(" ".join(b.text for b in short if not b.heading).lower())
        if sum(w in STOP_WORDS for w in said) > STOPS_OF_TEXT * len(said):
            for b in short:
                b.label, b.rule = "good", "stop words"
            return
    before: list[tuple[int, str] | None] = []
    after: list[tuple[int, str] | None] = [None] * len(blocks)

    def nearest(order, put) -> None:
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            b = blocks[i]
            put(i, last.get(b.section))
            if b.label != "open" and not (b.section and b.rule == "place"):
                last[b.section] = (i, b.label)

    nearest(range(len(blocks)), lambda i, x: before.append(x))
    nearest(range(len(blocks) - 1, -1, -1), lambda i, x: after.__setitem__(i, x))
    new = {}
    for i, b in enumerate(blocks):
        if b.label != "open":
            continue
        near = sorted((abs(x[0] - i), x[1] == "bad", x[1]) for x in (before[i], after[i]) if x)
        new[i] = near[0][2] if near else "good" if b.section else "bad"
        if b.heading and not b.section:  # a heading belongs to what follows it
            new[i] = after[i][1] if after[i] else new[i]
    for i, label in new.items():
        blocks[i].label, blocks[i].rule = label, "neighbours"


def labelled(page: str | None, rules: Rules | None = None) -> list[Block]:
    """The blocks of a page with their labels, and the rules that decided them."""
    blocks = blocks_of(page or "")
    first_pass(blocks, rules or Rules())
    second_pass(blocks)
    return blocks


def main_text(page: str | None, rules: Rules | None = None) -> str:
    """The article of a page as one line; null, empty or without an article: the empty string."""
    return " ".join(b.text for b in labelled(page, rules) if b.label == "good")


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text of every row of pages, from the whole html. Rows are independent: nothing is shuffled. Null and
    empty pages, and pages without an article, give an empty text; repeated rows stay; null ids and urls stay null;
    other columns are left out; an empty table gives no rows."""
    limits = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = pa.array([main_text(x, limits) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
