"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are the paths of its elements and, with their path, the words
of its short text blocks and its long text blocks as wholes.  Tokens that occur equally often
on every page of a host have equal occurrence vectors and form a class; a
vector is kept as an order-free digest over (page, count), so Spark sums it.
Large classes on most pages of a host are the host's template.  On each page a
class counts only if its tokens stand in the template's order (outer classes
first, inner ones between two neighbours of an outer one).  What is left
are the slots.

The template's elements are nested, and each holds slots with so many words on the host's
pages, those of links and those that the template fixes left out.  From the root
down, the element that holds nearly all words of the one around it, and all its headings, is
followed: that is the host's main region.  Names of elements (article, main)
only break the tie where such an element is within it.  A page's main text is in
the slots of the region that are not menus, forms and the like.  Hosts without a template
and pages without the region are read by their markup alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybook.llm.html_text import CONTAINERS, Block, parse, weigh
from quarrybook.plans.skew import join_groups
from quarrybook.plans.staging import Staging

#: Blocks of up to so many words give their words as tokens; longer ones one token.
SHORT = 12
#: A template class has at least so many tokens, is on so many pages and on such a share of its host's pages.
CLASS_SIZE = 3
LEAST_PAGES = 3
SHARE = 0.6
#: An element is the region instead of the one around it if it holds such a share of its words, and but so many headings a page are outside of it.
REGION_SHARE = 0.85
HEADINGS_OUTSIDE = 0.3
#: An article or main element within the region is taken if it holds such a share of the region's words.
NAMED_SHARE = 0.2
#: Kinds of tokens.
TEXT, ELEMENT, NAMED = 0, 1, 2


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def block_tokens(block: Block) -> list[int]:
    path, words = str(block.element.key), block.text.split(" ")
    if len(words) > SHORT:
        return [_hash("block", path, block.text)]
    return [_hash("word", path, w) for w in words]


def mark_token(name: str) -> int:
    return _hash("mark", name)


def page_tokens(page: str) -> list[tuple[int, int, int, int, int]]:
    """(token, path around it, words, headings, kind) in page order; kind: text, element, or article or main element.

    First names that may mark text beside the main one, then the elements, by their path, with the free words and
    headings in them, then the text blocks' tokens with the words that they would fix.
    """
    blocks, opened = parse(page)
    weigh(blocks, opened)
    found = [(mark_token(n), 0, 0, 0, TEXT) for n in sorted(frozenset().union(*(b.marks for b in blocks)))]
    found.extend((e.key, e.parent.key, e.words, e.heads, NAMED if e.tag in CONTAINERS else ELEMENT) for e in opened)
    for block in blocks:
        tokens = block_tokens(block)
        free = 0 if block.aside or block.linked else block.words
        found.extend((t, block.element.key, free // len(tokens), 0, TEXT) for t in tokens)
    return found


_TOKENS = "host string, token long, vector long, place long, around long, words long, heads long, kind int"


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), *[pa.int64()] * 6, pa.int32()]
    names = ["host", "token", "vector", "place", "around", "words", "heads", "kind"]
    for batch in batches:
        out: list[tuple] = []
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
            once: dict[int, list] = {}
            for k, (t, around, words, heads, kind) in enumerate(page_tokens(page)):
                row = once.setdefault(t, [0, k, around, 0, 0, kind])
                row[0] += 1
                row[3] += words
                row[4] += heads
            out.extend((host, t, _hash(key, str(n)), *rest) for t, (n, *rest) in once.items())
        for at in range(0, len(out), 1 << 16):
            cols = list(zip(*out[at : at + (1 << 16)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col)
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    # a page is known by 128 bits of what it is; equal rows are one page twice and weigh so
    page = F.md5(F.concat_ws("\x01", F.col(id_col).cast("string"), url, F.col(html_col)))
    return pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), page.alias("page"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def region_of(tokens: list[int], often: list[dict], n_pages: int) -> int | None:
    """The path of the host's main region; ``often``: token, around, words, heads, kind of all tokens of most pages."""
    template = set(tokens)
    elements = {t["token"]: t for t in often if t["kind"] != TEXT}
    words = {t: e["words"] for t, e in elements.items()}
    for t in often:
        if t["kind"] == TEXT and t["token"] in template:  # words that the template fixes are no slot's
            up = t["around"]
            while up in elements:
                words[up] -= t["words"]
                up = elements[up]["around"]
    below: dict[int, list[int]] = defaultdict(list)
    for t, e in elements.items():
        if t in template:
            below[e["around"]].append(t)

    def largest(among: list[int]) -> int | None:
        return max(among, key=lambda t: (words[t], t), default=None)

    here = largest(below[0])
    while here is not None and elements[here]["kind"] != NAMED:
        inner = largest(below[here])
        if inner is None or words[inner] < REGION_SHARE * words[here] or elements[here]["heads"] - elements[inner]["heads"] > HEADINGS_OUTSIDE * n_pages:
            break
        here = inner
    if here is None or elements[here]["kind"] == NAMED:
        return here
    within, ahead = [], [here]
    while ahead:
        ahead = [c for t in ahead for c in below[t]]
        within += [t for t in ahead if elements[t]["kind"] == NAMED]
    named = largest(within)
    return named if named is not None and words[named] >= NAMED_SHARE * max(1, words[here]) else here


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tokens", "often", "n_pages")]
        regions = [region_of(tokens, often, n) if tokens else None for tokens, often, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "n_pages", "tokens", "classes")), pa.array(regions, pa.int64())], ["host", "n_pages", "tokens", "classes", "region"])


def templates(rows: DataFrame, staging: Staging) -> DataFrame:
    """(host, n_pages, tokens, classes, region): each host's template tokens and their class in template order, and its main region.

    Tokens of a template stand on most pages of a host, so their number is
    bounded by a page's length.
    """
    found = rows.mapInArrow(_token_rows, _TOKENS)
    counted = found.groupBy("host", "token").agg(
        F.count("*").alias("n"), F.bit_xor("vector").alias("vector"), F.avg("place").alias("place"), F.min("around").alias("around"),
        F.sum("words").alias("words"), F.sum("heads").alias("heads"), F.max("kind").alias("kind"),
    )
    hosts = staging.table(rows.groupBy("host").agg(F.count("*").alias("n_pages")), "hosts")
    tokens = staging.table(counted.where(F.col("n") >= LEAST_PAGES), "tokens")
    # heavy hosts have few rows here: a row for each token of at least LEAST_PAGES pages
    often = join_groups(tokens, hosts.withColumn("_n", F.col("n_pages")), ["host"], "_n", "inner").where(F.col("n") >= SHARE * F.col("n_pages"))
    often = staging.table(often.drop("_n"), "often")
    classes = often.groupBy("host", "n_pages", "n", "vector").agg(F.collect_list(F.struct("place", "token")).alias("members")).where(F.size("members") >= CLASS_SIZE)
    ordered = classes.select("host", F.explode("members").alias("m"), "n", F.xxhash64("vector", "n").alias("class"))
    listed = ordered.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "class", F.col("m.place").alias("place"), F.col("m.token").alias("token")))).alias("t"))
    named = listed.select("host", F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform("t", lambda x: x["class"]).alias("classes"))
    held = often.groupBy("host").agg(F.collect_list(F.struct("token", "around", "words", "heads", "kind")).alias("often"))
    known = hosts.join(named, "host", "left").join(held, "host", "left")
    schema = "host string, n_pages long, tokens array<long>, classes array<long>, region long"
    return staging.table(known.mapInArrow(_region_rows, schema), "templates")


def valid_tokens(present: list[int], tokens: list[int], classes: list[int]) -> set[int]:
    """Those template tokens whose class stands in order on this page; outer classes come first.

    An inner class must lie between two neighbouring tokens of the classes accepted before it.
    """
    place = {}
    for k, t in enumerate(present):
        place.setdefault(t, k)
    accepted: set[int] = set()
    marks = np.empty(0, np.int64)
    at = 0
    while at < len(tokens):
        to = at
        while to < len(tokens) and classes[to] == classes[at]:
            to += 1
        spots = [place.get(t, -1) for t in tokens[at:to]]
        in_order = min(spots) >= 0 and all(a < b for a, b in zip(spots, spots[1:], strict=False))
        if in_order:
            gaps = np.searchsorted(marks, spots)
            if not len(marks) or gaps[0] == gaps[-1]:
                accepted.update(tokens[at:to])
                marks = np.sort(np.append(marks, spots))
        at = to
    return accepted


def joined(blocks: list[Block], chosen: list[int]) -> str:
    """The chosen blocks' text; neighbours that no white space parts are run together."""
    found = []
    for at, k in enumerate(chosen):
        found.append("" if not at or (blocks[k].tight and chosen[at - 1] == k - 1) else " ")
        found.append(blocks[k].text)
    return "".join(found)


def _words_of(block: Block, tokens: list[int], fixed: set[int]) -> tuple[int, int]:
    """(words that the template fixes, all words) of a block."""
    share = sum(t in fixed for t in tokens)
    return (share if len(tokens) == block.words else share * block.words), block.words


def main_text(page: str, tokens: list[int], classes: list[int], region: int | None = None) -> str:
    """The main text of one page under its host's template.

    Text goes by an element's name only if the template has that name (without
    a template the name alone decides), and not if no text were left.  Blocks that the template does not fix are slots.
    Authors repeat lines, too, so in an article a block is fixed only with all its tokens; its headings are always slots, and
    so are all blocks of an article of which the template has half the words or more on this page.  Elsewhere a block is
    fixed with most of its tokens.
    """
    blocks, opened = parse(page, region)
    known = set(tokens)
    per_block = [block_tokens(b) for b in blocks]
    names = frozenset().union(*(b.marks for b in blocks))
    counted = {n for n in names if not known or mark_token(n) in known}
    present = [mark_token(n) for n in sorted(names)] + [e.key for e in opened] + [t for ts in per_block for t in ts]
    fixed = valid_tokens(present, tokens, classes)
    places = [k for k, b in enumerate(blocks) if not b.aside]
    places = [k for k in places if blocks[k].element.chosen] or [k for k in places if blocks[k].inside] or places
    places = [k for k in places if not blocks[k].marks & counted] or places
    if places and all(blocks[k].inside for k in places):
        slots = [k for k in places if not all(t in fixed for t in per_block[k]) or blocks[k].element.heading]
        fixed_words, words = (sum(n) for n in zip(*(_words_of(blocks[k], per_block[k], fixed) for k in places), strict=True))
        return joined(blocks, slots if 2 * fixed_words < words else places)
    slots = [k for k in places if 2 * sum(t in fixed for t in per_block[k]) <= len(per_block[k])]
    return joined(blocks, slots or places)  # pages that are all alike have no slots


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("html", "tokens", "classes", "region")]
        texts = [main_text(page, tokens or [], classes or [], region) for page, tokens, classes, region in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text.

    Null html counts as empty and gives the empty text.  Pages without a host
    share one template, as do pages of one host; a host of fewer than
    ``LEAST_PAGES`` pages has none, so only the markup decides.  Repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored.
    """
    staging = Staging(pages.sparkSession, "html")
    rows = _rows(pages, id_col, url_col, html_col)
    known = templates(rows, staging)
    beside = join_groups(rows.select("page_id", "url", "host", "html"), known, ["host"], "n_pages", "left", width=16 * F.coalesce(F.size("tokens"), F.lit(0)) + 300)
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string"
    return beside.select("page_id", "url", "html", "tokens", "classes", "region").mapInArrow(_text_rows, schema)
