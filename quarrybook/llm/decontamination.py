"""Benchmark decontamination with a positional inverted index.

The corpus is split into words once.  An item is a sequence of words; a window is
``WINDOW`` consecutive words of it.  For every window the two terms that are rarest in the
corpus are its anchors.  The index stores the postings (term, document, position)
of anchor terms.  A posting less the term's place in the item is a diagonal: the
place where the item would start in the document.  Where both anchors of a
window have a posting on one diagonal, the item's words are compared with the
document's along it.

Proximity: an item of at least ``WINDOW`` words is near in a document that has the share
``NEAR`` of its distinct terms in some stretch of as many words as the item has
and ``SLOP`` more.  If m of t terms must be there, at least two of the t - m + 2 rarest
are; so their postings find all candidates, whose words are then counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.llm.words import alnum_words
from quarrybook.plans.names import own_names
from quarrybook.plans.skew import small_or_shuffled, small_or_shuffled_by_size
from quarrybook.plans.staging import Staging

#: Consecutive words that count as a leak.
WINDOW = 10
#: Rarest terms of a window whose posting lists are intersected.
ANCHORS = 2
#: Share of an item's distinct terms, and words that may lie between them.
NEAR, SLOP = 0.8, 5


def _width(words: str) -> Column:
    return F.aggregate(words, F.lit(32).cast("long"), lambda acc, w: acc + 8 + F.octet_length(w))


class PhraseIndex:
    """Items, their anchors and the anchors' postings in a corpus; tables written once.

    ``words``: row, id, text_key, n_words, words; ``items``: item, item_id, item_words.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, near: float | None = NEAR, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        self.window, self.near, self.slop = window, near, slop
        self.staging = Staging(docs.sparkSession, "phrases")
        text = F.col(text_col)
        spread = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), alnum_words(text).alias("words"))
        self.words = self.staging.table(spread.select(F.monotonically_increasing_id().alias("row"), "id", "text_key", F.size("words").cast("long").alias("n_words"), "words"), "words")
        read = items.select(F.col(item_col).alias("item_id"), alnum_words(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") > 0).distinct()
        self.items = self.staging.table(read.withColumn("item", F.monotonically_increasing_id()), "items")
        self._anchor()
        terms = self.anchors.select("term")
        if near is not None:
            terms = terms.unionByName(self.near_anchors.select("term"))
        self.postings = self.staging.table(self._tokens(self.staging.table(terms.distinct(), "anchor-terms")), "postings")

    def _tokens(self, terms: DataFrame) -> DataFrame:
        """(row, pos, term) of the corpus for the given terms only."""
        words = self.words.select("row", F.posexplode("words").alias("pos", "term"))
        return words.join(small_or_shuffled(terms, terms.count()), "term")

    def _anchor(self) -> None:
        """``anchors`` (item, q, term), ``windows`` (item, each window's anchor places), ``near_anchors`` (item, term)."""
        places = self.items.select("item", F.posexplode("item_words").alias("q", "term"))
        terms = self.staging.table(places.select("term").distinct(), "terms")
        counts = self.staging.table(self._tokens(terms).groupBy("term").agg(F.count("*").alias("n")), "counts")
        weighed = places.join(counts, "term", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("places"))
        weighed = self.staging.table(weighed, "weighed")
        last = F.greatest(F.size("places") - self.window, F.lit(0))

        def rarest(start):
            span = F.slice("places", start + 1, self.window)
            return F.slice(F.array_sort(F.transform(span, lambda p: F.struct(p["n"], p["q"], p["term"]))), 1, ANCHORS)

        windows = weighed.select("item", F.transform(F.sequence(F.lit(0), last), rarest).alias("windows"))
        # a window with a term that the corpus lacks cannot occur
        possible = windows.select("item", F.filter("windows", lambda w: w[0]["n"] > 0).alias("windows")).where(F.size("windows") > 0)
        wanted = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.transform(w, lambda p: F.struct(p["q"], p["term"])))))
        self.windows = self.staging.table(possible.select("item", F.transform("windows", lambda w: F.transform(w, lambda p: p["q"])).alias("windows")), "windows")
        self.anchors = self.staging.table(possible.select("item", F.explode(wanted).alias("a")).select("item", "a.q", "a.term"), "anchors")
        if self.near is not None:
            by_rarity = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.struct(p["n"], p["term"]))))
            t = F.size("ordered")
            long_enough = weighed.where(F.size("places") >= self.window).select("item", by_rarity.alias("ordered"))
            needed = self._needed(t)
            some = F.slice("ordered", 1, t - needed + F.when(needed >= 2, 2).otherwise(1))
            self.near_anchors = self.staging.table(long_enough.select("item", F.explode(some).alias("a")).select("item", "a.term"), "near-anchors")

    def _needed(self, terms: Column) -> Column:
        return F.ceil(F.lit(self.near) * terms).cast("int")

    def phrase_matches(self) -> DataFrame:
        """(row, item, item_id, start, end): every occurrence of a window, in words of the document."""
        anchors = small_or_shuffled(self.anchors, self.anchors.count())
        shifted = self.postings.join(anchors, "term").select("row", "item", (F.col("pos") - F.col("q")).alias("d"), "q")
        lists = shifted.groupBy("row", "item", "d").agg(F.collect_set("q").alias("places"))
        known = small_or_shuffled_by_size(self.windows, 32 + 16 * F.size("windows"))
        both = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)
        found = lists.join(known, "item").where(both).groupBy("row", "item").agg(F.collect_list("d").alias("ds"))
        found = self.staging.table(found, "candidates")
        items = small_or_shuffled_by_size(self.items, _width("item_words"))
        beside = self.words.select("row", "words").join(small_or_shuffled(found, found.count()), "row").join(items, "item")
        width = F.least(F.lit(self.window), F.size("item_words"))

        def starts(d: Column) -> Column:
            first = F.greatest(F.lit(0), -d)
            last = F.least(F.size("item_words"), F.size("words") - d) - width
            same = F.filter(F.sequence(first, F.greatest(first, last)), lambda j: (j <= last) & (F.slice("words", d + j + 1, width) == F.slice("item_words", j + 1, width)))
            return F.transform(same, lambda j: d + j)

        hits = beside.select("row", "item", "item_id", width.alias("width"), F.explode(F.array_distinct(F.flatten(F.transform("ds", starts)))).alias("start"))
        return hits.select("row", "item", "item_id", "start", (F.col("start") + F.col("width")).alias("end"))

    def proximity_matches(self) -> DataFrame:
        """(row, item, item_id, n_terms): items that are near, and the most of their distinct terms in one stretch."""
        sized = self.items.select("item", (F.size("item_words") + self.slop).alias("reach"), self._needed(F.size(F.array_distinct("item_words"))).alias("needed"))
        anchors = self.near_anchors.join(sized, "item")
        anchors = small_or_shuffled(anchors, self.near_anchors.count())
        # two postings in one stretch have a block of its length in common, or lie in neighbouring ones
        met = self.postings.join(anchors, "term").select("row", "item", "needed", "term", F.floor(F.col("pos") / F.col("reach")).alias("b"))
        blocks = met.select("row", "item", "needed", "term", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("block"))
        several = blocks.groupBy("row", "item", "needed", "block").agg(F.min("term").alias("x"), F.max("term").alias("y")).where("x < y OR needed < 2")
        found = self.staging.table(several.select("row", "item").distinct(), "near-candidates")
        items = small_or_shuffled_by_size(self.items, _width("item_words"))
        beside = self.words.select("row", "words").join(small_or_shuffled(found, found.count()), "row").join(items, "item")
        # of the item's terms in the document, in order: where a stretch may begin
        own = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda x: F.array_contains("item_words", x["term"]))
        own = beside.select("row", "item", "item_id", own.alias("own"), (F.size("item_words") + self.slop).alias("reach"), self._needed(F.size(F.array_distinct("item_words"))).alias("needed"))
        own = self.staging.table(own.where(F.size("own") >= F.col("needed")), "near-words")  # written, so that the next expression does not make it anew for every place

        def within(p: Column, i: Column) -> Column:
            stretch = F.filter(F.slice("own", i + 1, F.col("reach")), lambda x: x["pos"] < p["pos"] + F.col("reach"))
            return F.size(F.array_distinct(F.transform(stretch, lambda x: x["term"])))

        most = F.array_max(F.transform("own", within))
        return own.select("row", "item", "item_id", most.cast("long").alias("n_terms"), "needed").where("n_terms >= needed").drop("needed")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near: float = NEAR, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated, near_ids.

    A word of the document inside any occurrence of an item's window is hit; an
    item of fewer words than ``window``, but not none, is one window.  Null
    texts have no words.  ``item_ids`` (of the items with occurring windows) and ``near_ids`` (of the items that
    are near) are sorted as strings; null ids are not
    listed.  Without items nothing is hit; an empty table gives an empty result; other columns are ignored.
    """
    index = PhraseIndex(docs, items, window, near, slop, id_col, text_col, item_col, item_text_col)
    matches = index.staging.table(index.phrase_matches(), "matches")
    spans = matches.select("row", "start", "end").distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    hit = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    listed = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    named = matches.groupBy("row").agg(listed.alias("item_ids"))
    close = index.proximity_matches().groupBy("row").agg(listed.alias("near_ids"))
    result = index.staging.table(hit.join(named, "row").join(close, "row", "full_outer"), "result")
    joined = index.words.select(F.col("id").alias("doc_id"), "row", "n_words").join(small_or_shuffled(result, result.count()), "row", "left")
    none = F.array().cast("array<string>")
    ids, n_hit = F.coalesce("item_ids", none), F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), F.coalesce("near_ids", none).alias("near_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any occurrence of a window, with all their columns."""
    index = PhraseIndex(docs, items, window, None, 0, id_col, text_col, item_col, item_text_col)
    leaked = index.phrase_matches().select("row").distinct()
    known = index.words.select("row", "id", "text_key").join(leaked, "row", "left_semi").select("id", "text_key").distinct()
    own_id, own_key = own_names(docs, "leaked_id", "leaked_key")
    known = index.staging.table(known.toDF(own_id, own_key), "leaked")
    same = docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col]) == F.col(own_key))
    return docs.join(small_or_shuffled(known, known.count()), same, "left_anti")
