"""A tolerant reader of HTML: text blocks with the elements around them."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

#: Elements without content, elements whose content is not markup or is not shown, formulas, inline elements, and elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object xmp".split())
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
ASIDE = frozenset("head nav footer aside form script style noscript template iframe textarea title svg object button select option dialog menu".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements without a meaning of their own: which of its kind one is among its siblings is part of its path.
BOXES = frozenset("div section td".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Names that mark, as a whole class, id or role, what is not main text.
MARKS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager comment comments reply replies respond disqus discussion form search login copyright legal widget complementary contentinfo".split()
)

#: Last parts of longer names that mark the same (post-comments), unless the first part says otherwise (no-sidebar).
MARKING_ENDS = frozenset("ad ads advert adverts comment comments cookies footer nav navbar newsletter replies sidebar".split())
DENYING_STARTS = frozenset("no not has with without hide show".split())

#: A quoted value may hold > if it ends as a value does; after a quote that is never closed the tag ends at the first >.
_PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<[A-Za-z/!?](?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*>|<[A-Za-z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9:-]*)")
_HINT = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: An open paragraph ends where one of these starts.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: These end an open element of the same kind, within the given bounds.
_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def path_key(parent: int, tag: str) -> int:
    """The path of an element as one number, from its parent's; so a path is as short at any depth."""
    return int.from_bytes(hashlib.blake2b(f"{parent}/{tag}".encode(), digest_size=8).digest(), "little", signed=True)


@dataclass(eq=False)
class Element:
    tag: str
    key: int
    parent: Element | None
    aside: bool
    inside: bool
    heading: bool = False
    #: Whether the element is the region that is asked for, or in it.
    chosen: bool = False
    linked: bool = False
    names: frozenset[str] = frozenset()
    #: This element and those around it that have names.
    named: tuple[Element, ...] = ()
    #: Words of text blocks, and headings, in it and below that are neither aside nor linked.
    words: int = 0
    heads: int = 0
    boxes: int = 0


@dataclass
class Block:
    text: str
    element: Element
    #: Words that are part of a link.
    linked: int
    #: Whether it follows the block before it without white space.
    tight: bool = False
    named: tuple[Element, ...] = field(default=(), repr=False)

    @property
    def aside(self) -> bool:
        return self.element.aside

    @property
    def inside(self) -> bool:
        return self.element.inside

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def marks(self) -> frozenset[str]:
        """Names of the elements around it that may mean that it is not main text."""
        return frozenset().union(*(e.names for e in self.named))


def is_mark(name: str) -> bool:
    """Whether a class, id or role marks what is not main text: it is in ``MARKS``, all its parts are, or its last part is a marking end."""
    parts = [p for p in re.split("[-_]+", name) if p]
    if len(parts) < 2:
        return name in MARKS
    return all(p in MARKS for p in parts) or (parts[-1] in MARKING_ENDS and parts[0] not in DENYING_STARTS)


def marks_of(tag: str) -> frozenset[str]:
    """Those of an element's classes, id and role that are marks."""
    return frozenset(n for found in _HINT.findall(tag) for n in "".join(found).lower().split() if is_mark(n))


def parse(page: str, region: int | None = None) -> tuple[list[Block], list[Element]]:
    """(text blocks in page order, opened elements that are not inline, in page order); elements at the path ``region`` are chosen.

    Character references are decoded and white space is single; a block ends
    where an element that is not inline starts or ends.  An article or main
    element and all around it have no marks; an article in another one may.
    """
    blocks: list[Block] = []
    opened: list[Element] = []
    stack = [Element("", 0, None, False, False)]
    held: list[str] = []
    linked = 0
    tight = False

    def flush(inline: bool = False) -> None:
        nonlocal tight, linked
        if held:
            raw = html.unescape("".join(held))
            text = " ".join(raw.split())
            held.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(text, top, linked, tight and not raw[0].isspace(), top.named))
                tight = not raw[-1].isspace()
            elif raw:
                tight = False
        linked = 0
        tight = tight and inline

    def close(tag: str, bounds: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                flush()
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    at = 0
    while match := _PIECES.match(page, at):
        at = match.end()
        piece = match[0]
        if piece[0] != "<" or piece == "<":
            held.append(piece)
            if stack[-1].linked:
                linked += len(piece.split())
            continue
        name = _NAME.match(piece)
        if not name:  # comment, doctype or instruction
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            if tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        _leave_inline(stack, k, flush)
                        break
                    if stack[k].tag not in INLINE:
                        break
            else:
                flush()
                close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s>/])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            if tag in _ENDS_P:
                close("p", ("article", "main", "section", "div", "td", "li", "blockquote", "table", "body"))
            if tag in _SIBLINGS:
                close(tag, _SIBLINGS[tag])
        if tag in VOID:
            continue
        top = stack[-1]
        contained = top.inside or tag in CONTAINERS
        aside = top.aside or tag in ASIDE or (tag == "header" and not top.inside)
        names = frozenset()
        if tag in CONTAINERS and not (tag == "article" and any(e.tag == "article" for e in stack)):
            for e in top.named:
                e.names = frozenset()
        elif tag not in ("html", "body"):
            names = marks_of(piece)
        if tag in INLINE and (names or (aside and not top.aside)):
            flush(inline=True)
        # inline elements are no part of a path
        if tag in BOXES:
            top.boxes += 1
        key = top.key if tag in INLINE else path_key(top.key, f"{tag}{top.boxes}" if tag in BOXES else tag)
        stack.append(Element(tag, key, top, aside, contained, top.heading or tag in HEADINGS, top.chosen or (region is not None and key == region), top.linked or tag == "a", names, top.named))
        if names:
            stack[-1].named = (*top.named, stack[-1])
        if tag not in INLINE:
            opened.append(stack[-1])
        if piece.endswith("/>") and tag in MATH:
            stack.pop()
    held.append(page[at:])
    flush()
    return blocks, opened


def weigh(blocks: list[Block], opened: list[Element]) -> None:
    """Fill in the words and headings of all opened elements."""

    def around(e: Element | None) -> Element | None:
        while e is not None and e.tag in INLINE:
            e = e.parent
        return e

    for b in blocks:
        if not b.aside and (e := around(b.element)) is not None:
            e.words += b.words - b.linked
            e.heads += b.element.heading
    for e in reversed(opened):
        if (up := around(e.parent)) is not None:
            up.words += e.words
            up.heads += e.heads


def _leave_inline(stack: list[Element], k: int, flush) -> None:
    if stack[k].named != stack[k - 1].named or (stack[k].aside and not stack[k - 1].aside):
        flush(inline=True)
    del stack[k:]
