"""Near-duplicates by bottom-k sketches of one hash function.

1. Every document's shingle set is sketched: its ``K`` least hashes.  Documents
   with equal sets are one class, and a class one node, from here on.
2. Inverted lists of the retained values give overlaps.  Two sketches of sets
   with a Jaccard similarity of 0.75 share at least ``SHARED`` of ``K`` values
   (all but about 1 in 10^7 such pairs; small sets are kept whole, so for
   them the bound is exact).  So, with each sketch in order of rarity, it is enough to
   index the first K - SHARED + 1 values: values that one document has alone
   come first and give no list, values of passages that many documents share
   come last and are mostly never indexed.
3. Links are sought in two rounds.  First each node is paired with the least
   node of each of its lists.  A pair inside a component needs no further
   link, so a group of many near copies costs a few pairs for each document.
   Then come the nodes of those lists that still hold several components, with their full sets: in the lists of each set's
   ``NEAR_K`` least values each is paired with some nodes before it, in orders by the least values, and with the list's centre, the node with the least share of values rarer than the list's own.  Variants of one text that are too unlike each other are linked
   through such a node alone.  While far more pairs than rows of lists are left and links are found, this is done again with twice as many centres, so that
   large groups are in one component before all other pairs across components are looked at.  They meet in the lists of all values, by the values' rarity among these nodes, and
   only if the places of the value in both sets leave enough values for the overlap that the two sizes need; this is exact.
   Documents that share a passage, but each have words of their own, do not meet at all, however long they are.  Long lists are
   joined in parts.  So no link between components is lost.
4. Pairs whose union sketch estimates too little are dropped (7 standard errors
   below the threshold); the others are confirmed on full sets.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrybook.llm.shingles import sketch_rows
from quarrybook.plans.components import counted_components
from quarrybook.plans.skew import group_sizes, join_groups, small_or_shuffled
from quarrybook.plans.staging import Staging

K, SHARED = 96, 46
#: Least values of a full set whose lists are searched for centres and neighbours; pairs across components are sought in all of them.
NEAR_K = 512
#: Per cent of the union that the intersection has at least.
PERCENT = 75
#: Nodes of one list that are joined in one task.
LIST_PART = 1000
#: Orders of a list's nodes, similar sets mostly having their least values in common, and nodes that each is paired with.
ORDERS = (("m0", "m1", "n", "node"), ("m1", "m0", "n", "node"), ("n", "m0", "node"))
BEFORE = 6
#: Ratio of the sizes of sets that meet under one key when pairs across components are sought.
SIZE_STEP = 1.05
#: Pairs across components for each row of a list beyond which the lists' next centres are tried before the pairs.
PAIRS_PER_ROW = 8


class NearDuplicates:
    """The tables of one search; see :func:`near_duplicates`."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT):
        self.staging = Staging(docs.sparkSession, "near-dedup")
        self.texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.k, self.percent = k, percent
        self.id_type = self.texts.schema["doc_id"].dataType

    def _sketched(self, texts: DataFrame, k: int | None) -> DataFrame:
        """The columns of ``texts`` but the text, then n, sig, sketch."""
        own = [f for f in texts.schema.fields if f.name != "text"]
        new = [T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
        return texts.mapInArrow(partial(sketch_rows, k=k), T.StructType([*own, *new]))

    def _ranked(self, postings: DataFrame, kept: Column, least: Column, name: str, *keep: str) -> DataFrame:
        """(value, node, *keep, place) for the first values of each node, in order of rarity; values of one node alone are passed over.

        A node has ``kept`` values, of which it shares ``least`` or more with any similar node.
        """
        lists = self.staging.table(postings.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), f"{name}-lists")
        found = postings.join(lists.hint("merge"), "value")  # lists grow with the input, so one plan serves all sizes
        own = Window.partitionBy("node")
        place = kept - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "value"))
        ranked = found.select("value", "node", *keep, place.alias("place"), (kept - least + 1).alias("last"))
        ranked = self.staging.table(ranked.where("place <= last").drop("last"), name)
        self.staging.drop(f"{name}-lists")
        return ranked

    def index(self, reps: DataFrame) -> DataFrame:
        """(value, node): the values under which each node is found."""
        postings = reps.select("node", "n", F.explode("sketch").alias("value"))
        least = F.when(F.col("n") <= self.k * self.percent // 100, F.ceil(F.col("n") * self.percent / 100)).otherwise(F.lit(SHARED * self.k // K))
        return self._ranked(postings, F.least(F.col("n"), F.lit(self.k)), least, "index").drop("place")

    def stars(self, index: DataFrame) -> DataFrame:
        """(a, b): each node with the least node of each of its lists."""
        hubs, sizes = self.staging.measured(index.groupBy("value").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs", **group_sizes("m"))
        pairs = join_groups(index, hubs, ["value"], "m", "inner", sizes=sizes).where("node <> hub")
        return self.staging.table(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    def _again(self, nodes: DataFrame, n_nodes: int, k: int | None) -> DataFrame:
        """The columns of ``nodes`` (node, doc_id, sig, ...) and n, sketch: their texts are read again."""
        ids = small_or_shuffled(nodes.select("doc_id").distinct(), n_nodes)
        sketched = self._sketched(self.texts.join(ids, "doc_id", "left_semi"), k)
        found = sketched.join(small_or_shuffled(nodes, n_nodes), ["doc_id", "sig"])
        return found.dropDuplicates(["node"]) if self.repeated else found  # rows that repeat id and set are one node

    def _last(self, n: Column, n_y: Column) -> Column:
        """The last place, in order of rarity, at which a set of ``n`` values can first meet a similar one of ``n_y``."""
        return n - F.ceil((n + n_y) * self.percent / (100 + self.percent)) + 1

    def open_lists(self, index: DataFrame, components: DataFrame) -> DataFrame:
        """(value, node, n, m0, m1, near, place, parts): lists of the full sets of the nodes whose lists hold several components; near: one of a set's ``NEAR_K`` least values."""
        labelled = self.staging.table(self._labelled(index, components), "labelled")
        mixed = labelled.groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("value")
        mixed, seen = self.staging.measured(mixed, "mixed", rows=F.count("*"))
        open_nodes = labelled.join(small_or_shuffled(mixed, seen["rows"]), "value", "left_semi").select("node").distinct()
        open_nodes, seen = self.staging.measured(open_nodes.join(self.nodes, "node"), "open", rows=F.count("*"))
        full = self.staging.table(self._again(open_nodes, seen["rows"], None).select("node", "n", F.col("sketch").alias("s")), "full")
        first = [F.coalesce(F.get("s", k), F.lit(0)).alias(f"m{k}") for k in (0, 1)]
        postings = full.select("node", "n", *first, F.posexplode("s").alias("pos", "value")).withColumn("near", F.col("pos") < NEAR_K).drop("pos")
        ranked = self._ranked(postings, F.col("n"), F.ceil(F.col("n") * self.percent / 100), "full-index", "n", "m0", "m1", "near")
        lists = ranked.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value", F.ceil(F.col("m") / LIST_PART).cast("int").alias("parts"))
        dealt = self.staging.table(ranked.join(lists, "value"), "dealt")
        self.staging.drop("labelled", "mixed", "open", "full", "full-index")
        return dealt

    def _components(self, links: DataFrame, name: str) -> DataFrame:
        """Components of ``links``, written once; ``n_components`` has the number of nodes in them."""
        found, self.n_components = counted_components(links, self.staging, "a", "b", f"cc-{name}")
        return found

    def _labelled(self, lists: DataFrame, components: DataFrame) -> DataFrame:
        """``lists`` with each node's component."""
        comps = small_or_shuffled(components.withColumnRenamed("node", "member"), self.n_components)
        return lists.join(comps, lists["node"] == comps["member"], "left").withColumn("comp", F.coalesce("component", "node")).drop("member", "component")

    def _hopeful(self, met: DataFrame, tested: DataFrame, name: str) -> tuple[DataFrame, int]:
        """(a, b), not yet tested, and their number, of pairs (node, n, place and the same with _y) whose sizes and places leave room for the overlap."""
        n, n_y = F.col("n"), F.col("n_y")
        room = (F.col("place") <= self._last(n, n_y)) & (F.col("place_y") <= self._last(n_y, n))
        close = F.least("n", "n_y") * 100 >= F.greatest("n", "n_y") * self.percent
        new = met.where(close & room).select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()
        found, seen = self.staging.measured(new.join(tested, ["a", "b"], "left_anti"), name, rows=F.count("*"))
        return found, seen["rows"]

    def neighbours(self, lists: DataFrame, components: DataFrame, tested: DataFrame, name: str, centres: int) -> DataFrame:
        """(a, b): each node of the lists with those of other components among the ``BEFORE`` before it, in orders that have similar sets together, and among the list's centres.

        What is before a node is looked at with the first centre only, as it is the same each time.
        """
        labelled = self.staging.table(self._labelled(lists.where("near"), components), f"{name}-labelled")
        shown, met = F.struct("node", "comp", "n", "place"), self._beside_centres(labelled, name, centres)
        for order in ORDERS if centres == 1 else ():
            part = F.pmod(F.xxhash64(order[0]), F.col("parts")).cast("int")
            before = Window.partitionBy("value", part).orderBy(*order).rowsBetween(-BEFORE, -1)
            listed = labelled.select("node", "comp", "n", "place", F.collect_list(shown).over(before).alias("others"))
            near = listed.select("node", "n", "place", F.explode(F.filter("others", lambda o: o["comp"] != F.col("comp"))).alias("o"))
            met = met.unionByName(near)
        met = met.select("node", "n", "place", *[F.col(f"o.{c}").alias(f"{c}_y") for c in ("node", "n", "place")])
        found, _ = self._hopeful(met, tested, name)
        self.staging.drop(f"{name}-labelled", f"{name}-centres")
        return found

    def _beside_centres(self, labelled: DataFrame, name: str, centres: int) -> DataFrame:
        """(node, n, place, o): each node with the centres of its lists that are of other components; a list is dealt into ``centres`` parts of one centre each."""
        rarer = F.col("place") / F.col("n")
        best = F.min(F.struct(rarer.alias("rarer"), "node", "comp", "n", "place")).alias("best")
        parts = labelled.groupBy("value", F.pmod(F.xxhash64("node"), F.lit(centres)).alias("part")).agg(best, F.count("*").alias("m"))
        hubs = parts.groupBy("value").agg(F.collect_list("best").alias("centres"), F.sum("m").alias("m"))
        hubs, sizes = self.staging.measured(hubs, f"{name}-centres", **group_sizes("m"))
        met = join_groups(labelled.select("value", "node", "comp", "n", "place"), hubs, ["value"], "m", "inner", sizes=sizes)
        others = F.transform(F.filter("centres", lambda o: o["comp"] != F.col("comp")), lambda o: F.struct(*[o[c].alias(c) for c in ("node", "comp", "n", "place")]))
        return met.select("node", "n", "place", F.explode(others).alias("o"))

    def left(self, lists: DataFrame, components: DataFrame, name: str) -> tuple[DataFrame, dict]:
        """The lists that hold several components, with each node's comp; their rows, and how many pairs across components they have."""
        labelled = self._labelled(lists.drop("comp"), components)
        counts = labelled.groupBy("value", "comp").agg(F.count("*").alias("c"))
        mixed = counts.groupBy("value").agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same")).where("comps > 1")
        mixed, seen = self.staging.measured(mixed, f"{name}-mixed", rows=F.sum("m"), pairs=F.sum(F.col("m") * F.col("m") - F.col("same")) / 2)
        dealt = self.staging.table(labelled.join(mixed.select("value"), "value"), f"{name}-lists")
        self.staging.drop(f"{name}-mixed")
        return dealt, {k: v or 0 for k, v in seen.items()}

    def across(self, dealt: DataFrame, tested: DataFrame) -> tuple[DataFrame, int]:
        """(a, b): all hopeful pairs across components that are not yet tested, and their number.

        Of a pair, the smaller set is on the left.  The places leave less room the nearer the sizes are, so a row on the
        right meets sets of those sizes only for which its place is early enough: few nodes meet in the lists of common values.
        """
        n, place = F.col("n"), F.col("place")
        step = lambda size: F.floor(F.log(size) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")
        left = dealt.where(place <= self._last(n, n)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("size", step(n))
        least, most = F.ceil(n * self.percent / 100), F.floor((n - place + 1) * (100 + self.percent) / self.percent) - n
        sizes = F.sequence(step(least), F.greatest(step(least), step(F.least(most, n))))
        right = dealt.select("value", *[F.col(c).alias(f"{c}_y") for c in ("node", "comp", "n", "place")], "parts", F.explode(sizes).alias("size"))
        right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
        met = left.join(right, ["value", "part", "size"]).where("comp <> comp_y AND (n < n_y OR (n = n_y AND node < node_y))")
        return self._hopeful(met, tested, "across")

    def _nodes_of(self, pairs: DataFrame) -> tuple[DataFrame, dict]:
        """(node, pairs_a, pairs_b): in how many pairs each node is on either side; and what to measure when they are written."""
        each = F.explode(F.array(*[F.struct(F.col(s).alias("node"), *[F.lit(int(s == t)).cast("long").alias(f"pairs_{t}") for t in "ab"]) for s in "ab"]))
        counted = pairs.select(each.alias("e")).groupBy("e.node").agg(*[F.sum(f"e.pairs_{s}").alias(f"pairs_{s}") for s in "ab"])
        return counted, {"rows": F.count("*")} | {f"{k}_{s}": c for s in "ab" for k, c in group_sizes(f"pairs_{s}").items()}

    def _beside(self, pairs: DataFrame, table: DataFrame, columns: list[str], sizes: dict, width: str | None = None) -> DataFrame:
        """Both nodes' columns beside each pair, suffixed _a and _b; ``table`` is staged and has pairs_a and pairs_b.

        The least node of a large group is in many pairs; it comes last, so that its columns are not shuffled with each of them.
        ``width`` is a column of unbounded arrays.
        """
        out = pairs
        for side in ("b", "a"):
            groups = table.where(F.col(f"pairs_{side}") > 0).select(F.col("node").alias(side), F.col(f"pairs_{side}").alias("pairs"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            measured = {k: sizes[f"{k}_{side}"] for k in ("total", "most")}
            out = join_groups(out, groups, [side], "pairs", "inner", width=width and 8 * F.size(f"{width}_{side}") + 50, sizes=measured).drop("pairs")
        return out

    def confirm(self, pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """Those pairs whose full sets are similar enough."""
        counted, measures = self._nodes_of(pairs)
        often, seen = self.staging.measured(counted, "often", **measures)
        sketches = self.staging.table(reps.select("node", "n", "sketch").join(small_or_shuffled(often, seen["rows"]), "node"), "sketches-of")
        beside = self._beside(pairs, sketches, ["n", "sketch"], seen)  # heavy nodes: fewer than HEAVY_KEYS, of K values each
        long_enough = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        hopeful = self.staging.table(beside.where(long_enough & (self._estimate() >= self._floor())).select("a", "b"), f"{name}-hopeful")
        counted, measures = self._nodes_of(hopeful)
        ids, seen = self.staging.measured(counted.join(self.nodes, "node"), "ids", **measures)
        sets = self.staging.table(self._again(ids, seen["rows"], None).select("node", "pairs_a", "pairs_b", F.col("sketch").alias("s")), "sets")
        out = self._beside(hopeful, sets, ["s"], seen, width="s")
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - common
        links, seen = self.staging.measured(out.where(common * 100 >= union * self.percent).select("a", "b").distinct(), f"{name}-links", rows=F.count("*"))
        self.n_links = seen["rows"]
        self.staging.drop("often", "sketches-of", "ids", "sets", f"{name}-hopeful")
        return links

    def _estimate(self) -> Column:
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, self.k)
        common = F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b"))
        return F.size(common) / F.size(union)

    def _floor(self) -> float:
        share = self.percent / 100
        return max(0.0, share - 7 * (share * (1 - share) / self.k) ** 0.5)

    def run(self) -> DataFrame:
        """doc_id, text_key, n_shingles, component_id, kept."""
        keyed = self.texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        sketched = self.staging.table(self._sketched(keyed, self.k).withColumn("node", F.monotonically_increasing_id()), "sketches")
        named = sketched.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
        first = F.min(F.struct("doc_id", "node"))
        classes, sizes = self.staging.measured(named.groupBy("sig").agg(first.alias("first"), F.count("*").alias("rows")).select("sig", F.col("first.node").alias("node"), F.col("first.doc_id").alias("doc_id"), "rows"), "classes", **group_sizes("rows"))
        self.nodes = classes.select("node", "doc_id", "sig")
        several = classes.where("rows > 1").select("sig", "rows", F.col("node").alias("rep"), F.col("doc_id").alias("rep_id"))
        copies = join_groups(named.select("node", "doc_id", "sig"), several, ["sig"], "rows", "inner", sizes=sizes).where("node <> rep").select("node", (F.col("doc_id") == F.col("rep_id")).alias("again"))
        copies, seen = self.staging.measured(copies, "copies", rows=F.count("*"), again=F.count_if("again"))
        self.repeated = seen["again"] > 0
        reps = named.join(small_or_shuffled(copies.select("node"), seen["rows"]), "node", "left_anti")
        index = self.index(reps)
        stars = self.stars(index)
        links = self.confirm(stars, reps, "stars")
        components = self._components(links, "stars")
        lists, tested, centres, more = self.open_lists(index, components), stars, 1, True
        while more:
            name = f"near-{centres}"
            near = self.neighbours(lists, components, tested, name, centres)
            links = self.staging.table(links.unionByName(self.confirm(near, reps, name)), f"{name}-all")
            found, tested = self.n_links, tested.unionByName(near)
            components = self._components(links, name)
            lists, left = self.left(lists, components, name)
            centres *= 2
            more = found > 0 and left["pairs"] > PAIRS_PER_ROW * centres * left["rows"]
        across, n_across = self.across(lists, tested)
        if n_across:
            links = self.staging.table(links.unionByName(self.confirm(across, reps, "across")), "links")
            components = self._components(links, "all")
        labels = self.staging.table(self._labels(classes, components), "labels")
        members = join_groups(sketched.select("doc_id", "text_key", "n", "sig"), labels, ["sig"], "rows", "left", sizes=sizes)
        rounds = [f"near-{2**k}{part}" for k in range(centres.bit_length() - 1) for part in ("", "-all", "-links", "-lists")]
        self.staging.drop("index", "hubs", "stars", "across", "dealt", "copies", "classes", "links", "stars-links", "across-links", *rounds)
        component = F.coalesce("component_id", "doc_id")
        return members.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

    def _labels(self, classes: DataFrame, components: DataFrame) -> DataFrame:
        """(sig, rows, component_id): the least doc_id of each class's component."""
        linked = self.staging.table(components.join(classes.select("node", "doc_id"), "node"), "linked")
        least, sizes = self.staging.measured(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")), "least", **group_sizes("m"))
        named = join_groups(linked, least, ["component"], "m", "inner", sizes=sizes).select("node", "component_id")
        return classes.join(small_or_shuffled(named, sizes["total"] or 0), "node", "left").select("sig", "rows", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of five-word shingles have 100 times
    the intersection at least ``percent`` times the union; ``component_id`` is
    the least doc_id reachable.  Null or blank texts have an empty set and are
    linked with nothing.  Every row is a document of its own: rows that share a doc_id
    are linked if their texts are, and not by the id.  A row without doc_id is linked with
    nothing and stays.  An empty table gives an empty result; other columns are ignored.
    """
    return NearDuplicates(docs, id_col, text_col, k, percent).run().drop("text_key")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat id and text stay as they are."""
    found = NearDuplicates(docs, id_col, text_col)
    dropped, seen = found.staging.measured(found.run().where(~F.col("kept")).select("doc_id", "text_key").distinct(), "dropped", rows=F.count("*"))
    side = small_or_shuffled(dropped, seen["rows"])
    same = (docs[id_col] == side["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == side["text_key"])
    return docs.join(side, same, "left_anti")
