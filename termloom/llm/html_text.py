"""Main text of HTML pages by block rules in two passes.

Pass one cuts a page into blocks of text and measures each: words, share of stop words, share of text inside links, and
where it stands (menu, footer, notice, comments ...). Clear cases become good or bad. Pass two gives each short or
unclear block the label of its nearest decided neighbours, those in the same section first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of the languages in hand.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are with as be this by from at have or not when an but which they you his her were been has"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " de la le et les des en un du une que est pour qui dans par sur au pas avec ce il sont plus se ne"
    " el y los del las por con no su para es lo como más pero sus al".split()
)
# Elements of HTML by what they do to text.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "xmp", "svg", "annotation-xml", "annotation", "object", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog button label input fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
TEXT_LEVEL = HEADINGS | frozenset("p blockquote pre dd figcaption".split())
#: Elements that are no wrappers of an article, whatever they hold.
NEVER_WRAP = BOILERPLATE - {"form", "fieldset", "header"}
#: An element whose class, id or role has one of these as a word, or as the start of one, isn't part of the article.
BAD_NAMES = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|adsense|adsby\w*|adslot\w*|adunit\w*|banner\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|masthead|footer\w*|sidebar\w*|comments?(?:list|area|body|section|form|er|ers)?|disqus\w*|replies|respond|responses"
    r"|cookie\w*|consent\w*|gdpr\w*|popup\w*|modal\w*|newsletter\w*|share|sharing|social\w*|widget\w*"
    r"|pagination|pager|copyright|disclaimer|contentinfo|navigation|complementary)(?![a-z])"
)
#: These name such an element only where a name has no other parts than these and words for parts of a page; an article
#: may have a header, a form or a notice of its own.
WEAK_NAMES = frozenset("header head foot side aside notice notices alert alerts legal search searchbox form login signup overlay toolbar skip".split())
PAGE_NAMES = WEAK_NAMES | frozenset("site page top main global web blog user box wrap wrapper container inner outer bar block area section left right bottom contact mail email feedback row col column panel".split())
#: These name such an element only beside words for parts of a page and for lists of other texts; related work, a subscript or
#: someone promoted are what an article may be about.
LIST_NAMES = frozenset("related recommend recommended recommendation recommendations".split())
SOFT_NAMES = LIST_NAMES | frozenset("promo promos promotion promotions subscribe subscriber subscription subscriptions".split())
OTHER_TEXTS = frozenset("posts post articles article stories story links link content contents items item news list lists products product topics reading videos video more you your also slider carousel grid".split())
#: Names of text by others, or about other things: an element named so is no wrapper of an article either.
NEVER_NAMES = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|adsense|adsby\w*|sponsor\w*|comments?(?:list|area|body|section|form|er|ers)?|disqus\w*|replies|respond|responses|cookie\w*|consent\w*|gdpr\w*|newsletter\w*)(?![a-z])"
)
#: The only names that count on elements inside a line of text.
AD_NAMES = re.compile(r"(?:ad|ads|advert\w*|adsense|adsby\w*|sponsored)")
#: A name with one of these parts says what a page has or how it looks (has-sidebar, social-enabled), not what the element is.
STATES = re.compile(r"(?<![a-z])(?:has|no|non|not|with|without|enabled|disabled|open|closed|layout)(?![a-z])")
PARTS = re.compile(r"[a-z]+")
# The attributes of a tag: quotes count only where a value begins.
_ATTRS = r"(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+"
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRS + r"(?:>|\Z)(?:.*?(?=</(?P=raw)[\s/>])|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + _ATTRS + r")(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?<![^\s"'/])(?:hidden(?=[\s/=]|\Z)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SHORT, LONG = 8, 25
#: So many code points are a long block in any script; scripts without spaces count two of their characters as a word.
LONG_CHARS = 150
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Running text with a smaller share of stop words is in a language whose function words aren't in hand.
KNOWN_SHARE = 0.15
GOOD, BAD, SHORT_BLOCK, UNCLEAR = "good", "bad", "short", "unclear"


@dataclass
class Wrap:
    """An element whose place is bad unless it turns out to be a wrapper of the article."""

    outer: Wrap | None
    is_form: bool
    is_text: bool = False  # a paragraph and the like: its name is one sign beside what its text says
    free: bool = False  # a wrapper of the article
    words: int = 0  # running text inside
    blocks: int = 0
    marked: bool = False  # holds a heading, or the article
    open: bool = False  # it and all around it are free


@dataclass
class Block:
    text: str
    links: int  # words inside links
    bad_place: bool
    in_main: bool
    heading: bool
    section: int
    wrap: Wrap | None = None  # the innermost element that makes its place bad, if not as a wrapper of the article
    label: str = ""
    words: int = 0
    stops: int = 0  # words that are stop words


def size(text: str) -> int:
    """Words of a text, by length where a script doesn't part them."""
    return len(text.split()) + (0 if text.isascii() else len(UNSPACED.findall(text)) // 2)


def _is_soft_name(parts: list[str], names: frozenset[str]) -> bool:
    return not names.isdisjoint(parts) and all(p in SOFT_NAMES or p in PAGE_NAMES or p in OTHER_TEXTS for p in parts)


def _is_bad_name(name: str) -> bool:
    if STATES.search(name):
        return False
    parts = PARTS.findall(name)
    weak = not WEAK_NAMES.isdisjoint(parts) and PAGE_NAMES.issuperset(parts)
    return bool(BAD_NAMES.search(name)) or weak or _is_soft_name(parts, SOFT_NAMES)


def _attrs_bad(attrs: str, is_block: bool = True) -> tuple[bool, bool]:
    """Whether an element stands for no part of the article, by its names or as it is hidden, and whether that can't be undone.
    Inside a line of text only names of adverts count."""
    if not attrs:
        return False, False
    given = [x for v in ATTRIBUTE.findall(attrs) for x in v.strip("\"'").lower().split()]
    hidden = bool(HIDDEN.search(attrs))
    if not is_block:
        bad = hidden or any(map(AD_NAMES.fullmatch, given))
        return bad, bad
    names = [x for x in given if _is_bad_name(x)]
    never = any(NEVER_NAMES.search(x) or _is_soft_name(PARTS.findall(x), LIST_NAMES) for x in names)
    return hidden or bool(names), hidden or never


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order. Inline tags don't end a block; br counts as white space. Time is in proportion
    to the page's length, however its elements are nested."""
    out: list[Block] = []
    # open elements: tag, and what holds around them: bad for good, perhaps bad, in the article, headings, section
    stack: list[tuple[str, bool, Wrap | None, bool, int, int]] = []
    n_open: Counter[str] = Counter()
    bad, wrap, main, headings, section, sections = False, None, False, 0, 0, 0
    wraps: list[Wrap] = []
    parts: list[str] = []
    link_words, link_depth = 0, 0

    def close_block() -> None:
        nonlocal link_words
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        if text:
            stops = sum(w.lower().strip(".,;:!?") in STOP_WORDS for w in text.split())
            out.append(Block(text, link_words, bad or wrap is not None, main, headings > 0, section, None if bad else wrap, words=size(text), stops=stops))
        link_words = 0

    def add(text: str) -> None:
        nonlocal link_words
        if text:
            text = html.unescape(text)
            parts.append(text)
            if link_depth:
                link_words += size(text)

    def leave(k: int) -> None:
        nonlocal bad, wrap, main, headings, section
        _, bad, wrap, main, headings, section = stack[k]
        n_open.subtract(x[0] for x in stack[k:])
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if m["raw"]:
            if m["raw"].lower() in ("template", "iframe", "object", "select"):
                close_block()
            continue
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m["end"])
        if tag == "br":
            parts.append(" ")
        if tag in RAW:
            continue
        if tag == "a":
            link_depth = max(0, link_depth + (-1 if ends else 1))
        is_block = tag in BLOCK
        if not is_block and (tag in VOID or ends and not n_open[tag]):
            continue
        if is_block:
            close_block()
        if ends:
            for k in range(len(stack) - 1, -1, -1) if n_open[tag] else ():
                if stack[k][0] == tag:
                    if not is_block and (stack[k][1] != bad or stack[k][2] is not wrap):
                        close_block()
                    leave(k)
                    break
                if stack[k][0] in BLOCK and not is_block:
                    break
            if is_block:
                link_depth = 0 if tag != "li" else link_depth
            continue
        if tag in VOID:
            continue
        worse, for_good = (False, False) if tag in ("body", "html", "main") else _attrs_bad(m["attrs"], is_block)
        if tag == "article":  # named as someone's comment, an advert and the like; other names don't count
            worse = for_good
        if tag in BOILERPLATE and not (tag == "header" and main):
            worse, for_good = True, for_good or tag in NEVER_WRAP
        if not is_block:
            if not worse:
                continue
            close_block()
        if tag == "p" or tag in HEADINGS or tag in ("li", "dd", "dt", "tr", "td", "th"):  # these end one of their kind that was left open
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or tag in HEADINGS and stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] not in ("p", "b", "i", "span"):
                    break
        if tag in MAIN and not worse:  # forms around an article are its wrappers, and so is all around main
            w = wrap
            while w is not None and not (w.marked and (w.free or tag == "article")):
                w.free, w.marked, w = w.free or w.is_form or tag == "main", True, w.outer
        stack.append((tag, bad, wrap, main, headings, section))
        n_open[tag] += 1
        bad, main = bad or for_good, main or tag in MAIN and not worse
        if worse and not for_good:
            wrap = Wrap(wrap, tag in ("form", "fieldset"), tag in TEXT_LEVEL)
            wraps.append(wrap)
        headings += tag in HEADINGS
        if tag in MAIN or tag in BOILERPLATE or tag in ("section", "div", "body"):
            sections += 1
            section = sections
    add(page[at:])
    close_block()
    if wraps:
        unwrap(out, wraps)
    return out


def unwrap(found: list[Block], wraps: list[Wrap]) -> None:
    """Takes blocks out of bad places that are wrappers of the article: those known as such, and elements that hold most of
    the page's running text, in three blocks or more or with its article or first heading; paragraphs of long running text,
    whatever their names. wraps: outer ones first."""
    total = 0
    known = is_known([b for b in found if b.wrap or not b.bad_place])
    for b in found:
        if b.bad_place and not b.wrap:
            continue
        n = running_words(b, known)
        total += n
        if w := b.wrap:
            w.marked = w.marked or b.heading or b.in_main
            w.words, w.blocks = w.words + n, w.blocks + (n > 0)
    for w in reversed(wraps):
        if o := w.outer:
            o.words, o.blocks, o.marked = o.words + w.words, o.blocks + w.blocks, o.marked or w.marked
    for w in wraps:
        w.free = w.free or 2 * w.words > total and (w.blocks > 2 or w.marked) or w.is_text and w.words >= LONG
        w.open = w.free and (w.outer is None or w.outer.open)
    for b in found:
        if b.wrap and b.wrap.open:
            b.bad_place = False


def is_known(found: list[Block]) -> bool:
    """Whether blocks that aren't links have the stop words of a language in hand."""
    text = [b for b in found if 2 * b.links <= b.words]
    return sum(b.stops for b in text) >= KNOWN_SHARE * sum(b.words for b in text)


def running_words(b: Block, known: bool) -> int:
    """A block's words if it reads like running text, else 0."""
    if b.words < SHORT or b.links / b.words > 0.5:
        return 0
    return b.words if b.stops / b.words >= 0.1 or not known and is_long(b) else 0


def is_long(b: Block) -> bool:
    return b.words >= LONG or len(b.text) >= LONG_CHARS


def first_pass(b: Block, has_main: bool, known: bool = True) -> str:
    """good or bad where place, links, stop words or length decide; short or unclear else.

    Stop words speak for a block. That it has none says little, as no language's words may be in hand: where that is
    so of the page (not known), length and links decide.
    """
    n = b.words
    if b.bad_place:
        return BAD
    if b.links / n > 0.5 and not (b.in_main and n > SHORT):
        return BAD
    stops = b.stops / n
    good = is_long(b) and (n >= LONG and stops >= 0.15 or not known and b.links / n <= 0.25)
    if has_main and not b.in_main:
        return BAD if not is_long(b) or known and (n < LONG or stops < 0.1) else UNCLEAR
    if n < SHORT and not (good and not b.heading):
        return SHORT_BLOCK
    if b.in_main:
        return GOOD if stops >= 0.05 or good else UNCLEAR
    return GOOD if good else UNCLEAR


def second_pass(found: list[Block]) -> list[bool]:
    """Whether each block is kept: undecided ones take the label of the nearest decided block on either side.

    Neighbours in the same section count before those of others; of two at odds, the nearer wins, then good. Blocks that
    are bad only by their place (an advert, a share bar) say nothing about the text around them. Where no block is good,
    and in an article without any decided block, undecided ones are kept.
    """
    none_good = not any(b.label == GOOD for b in found)
    votes = [b.label in (GOOD, BAD) and not b.bad_place for b in found]
    before, after = [None] * len(found), [None] * len(found)  # the nearest block that votes, on either side
    for side, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last = None
        for k in order:
            side[k] = last
            last = k if votes[k] else last
    keep = []
    for k, b in enumerate(found):
        if b.label in (GOOD, BAD):
            keep.append(b.label == GOOD)
            continue
        same = lambda j: (found[j].section == b.section, found[j].in_main == b.in_main)  # noqa: B023, E731
        near = [j for j in (before[k], after[k]) if j is not None and (not b.in_main or found[j].in_main)]
        if none_good or not near:
            keep.append(none_good or b.in_main)
            continue
        best = max(near, key=lambda j: (same(j), -abs(j - k), found[j].label == GOOD))
        keep.append(found[best].label == GOOD)
    return keep


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; null, empty and markup-only pages have an empty text."""
    if not page:
        return ""
    found = blocks_of(page)
    placed = [b for b in found if not b.bad_place]
    known = is_known(placed)
    inside, outside = (sum(running_words(b, known) for b in placed if b.in_main == x) for x in (True, False))
    has_main = any(b.in_main for b in placed)
    article_only = has_main and 2 * inside >= outside
    if has_main and not article_only:  # the article's element holds little of the page's text, such as a teaser
        for b in found:
            b.in_main = False
    for b in found:
        b.label = BAD if article_only and not b.in_main else first_pass(b, article_only, known)
    if not any(b.label == GOOD for b in found):  # paragraphs are all short: what reads like running text is good
        for b in found:
            if b.label == UNCLEAR and (running_words(b, known) or not known and b.links / b.words <= 0.25):
                b.label = GOOD
    return "\n".join(b.text for b, kept in zip(found, second_pass(found), strict=True) if kept)


def extract(page: Column) -> Column:
    """Main text of each page; never null."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return extracted(page)
