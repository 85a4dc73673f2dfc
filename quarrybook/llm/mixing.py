"""Mixing sources to target weights by pivotal dependent rounding.

Every document's share of the mix is its source's target over its source's size.
The whole part is taken for certain; the fractional parts are rounded in pairs:
each step moves mass (fraction times size) between two documents until one of
them is whole, in a direction drawn so that expectations stay.  Blocks of about
``BLOCK`` documents of one source are rounded side by side and hand on the one
document that is still fractional, so the residuals of n documents meet in a
tree of log_BLOCK(n) levels.  A source's taken words then miss its target by at
most half of one document, which is a small one where there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.llm.words import BLANK, uniform
from quarrybook.plans.names import own_names
from quarrybook.plans.prefix import running_total
from quarrybook.plans.skew import join_groups, small_or_shuffled
from quarrybook.plans.staging import Staging

#: Weights of the sources in code point order, repeating; fixed values.
WEIGHTS = (5, 2, 1)
#: No target is above so many times its source's size.
MOST_REPEATS = 3
#: Documents that meet in one rounding block on average.
BLOCK = 64


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, staging: Staging, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets share the total by weight; what would be above ``most`` times a
    source's size is shared again among the others by weight, until none is
    above.  That is a water level: sources are capped in order of cap over
    weight, and the level comes from prefix sums in that order.
    """
    named = sizes.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(named, ["_last", "source"], {"_k": "_one"}, staging, "by-name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    capped = staging.table(capped.withColumn("_ratio", F.col("_cap") / F.col("_w")), "capped")
    total, all_weights = capped.agg(F.sum("source_size"), F.sum("_w")).first()
    up = running_total(capped, ["_ratio", "_k"], {"_caps": "_cap", "_weights": "_w"}, staging, "by-ratio")
    levelled = staging.table(up.withColumn("_level", (F.lit(total or 0) - F.col("_caps")) / (F.lit(all_weights or 1.0) - F.col("_weights"))), "levels")
    free = levelled.where("_level <= _ratio").agg(F.min(F.struct("_ratio", "_k", "_level")).alias("x")).select("x._level").first()[0]
    share = F.least(F.col("_w") * F.lit(free).cast("double"), F.col("_cap"))
    return levelled.select("source", "source_size", F.coalesce(F.when(F.col("_level") > F.col("_ratio"), F.col("_cap")).otherwise(share), F.lit(0.0)).alias("target"))


def _round_block(items: Column) -> Column:
    """Fold a block's items: all but one become whole; {done: [...], rest: item}."""
    def step(acc, x):
        rest = acc["rest"]
        room_a, room_b = rest["size"] - rest["mass"], x["size"] - x["mass"]
        up, down = F.least(room_a, x["mass"]), F.least(rest["mass"], room_b)
        raise_first = uniform(rest["h"], x["h"], F.lit(17)) * (up + down) < down
        mass_a = F.when(raise_first, F.when(room_a <= x["mass"], rest["size"].cast("double")).otherwise(rest["mass"] + x["mass"])).otherwise(F.when(rest["mass"] <= room_b, F.lit(0.0)).otherwise(rest["mass"] - room_b))
        mass_b = F.when(raise_first, F.when(room_a <= x["mass"], x["mass"] - room_a).otherwise(F.lit(0.0))).otherwise(F.when(rest["mass"] <= room_b, x["mass"] + rest["mass"]).otherwise(x["size"].cast("double")))
        a, b = rest.withField("mass", mass_a), x.withField("mass", mass_b)
        whole_a = (mass_a <= 0.0) | (mass_a >= rest["size"])
        return F.struct(F.concat(acc["done"], F.array(F.when(whole_a, a).otherwise(b))).alias("done"), F.when(whole_a, b).otherwise(a).alias("rest"))

    first = F.element_at(items, 1)
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(F.slice(items, 1, 0).alias("done"), first.alias("rest")), step)


def dependent_rounding(items: DataFrame, staging: Staging) -> DataFrame:
    """(doc_id, source, size, text_key, mass) with 0 < mass < size to the same rows with mass 0 or size.

    Each source's sum of masses changes by at most half of one size.  One block of
    each source waits until the last level, where larger documents are rounded
    before smaller ones: so the document that is left over is a small one.
    """
    level, done = 0, None
    current = staging.table(items.withColumn("h", F.xxhash64("doc_id", "size", "text_key")), "fraction-0")
    # rows that agree in all of these would share every block: they are dealt over as many as they fill
    crowds = staging.table(current.groupBy("h").agg(F.count("*").alias("_crowd")).where(F.col("_crowd") > BLOCK), "crowds")
    if not crowds.isEmpty():
        dealt = current.join(small_or_shuffled(crowds, crowds.count()), "h", "left").withColumn("_deal", F.monotonically_increasing_id())
        apart = F.when(F.col("_crowd").isNotNull(), F.xxhash64("h", "_deal")).otherwise(F.col("h"))
        current = staging.table(dealt.withColumn("h", apart).select(*current.columns), "fraction-dealt")
    while True:
        counts = staging.table(current.groupBy("source").agg(F.count("*").alias("_rows")), f"counts-{level}")
        most = counts.agg(F.max("_rows")).first()[0] or 0
        if most <= 1:
            break
        blocks = counts.select(F.col("source").alias("_s"), F.ceil(F.col("_rows") / BLOCK).alias("_blocks"))
        placed = current.join(small_or_shuffled(blocks, counts.count()), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("_blocks")))
        waiting = (F.col("_blocks") > 1) & (F.col("_block") == 0)
        item = F.struct((-F.col("size")).alias("_less"), "h", "doc_id", "size", "text_key", "mass")
        block = placed.where(~waiting).groupBy("source", "_block").agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded = staging.table(block.select("source", _round_block(F.col("items")).alias("r")), f"folded-{level}")
        whole = folded.select("source", F.explode("r.done").alias("x")).select("source", "x.*").select(*current.columns)
        rest = folded.select("source", "r.rest.*").select(*current.columns)
        is_whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
        level += 1
        whole = whole.unionByName(rest.where(is_whole))
        done = whole if done is None else done.unionByName(whole)
        current = staging.table(rest.where(~is_whole).unionByName(placed.where(waiting).select(*current.columns)), f"fraction-{level}")
    last = current.withColumn("mass", F.when(F.col("size") <= 2 * F.col("mass"), F.col("size").cast("double")).otherwise(F.lit(0.0)))
    return last if done is None else done.unionByName(last)


def mix_sizes(sized: DataFrame, staging: Staging, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, text_key) to the same with source_size, target, copies (one row per input row)."""
    sized = staging.table(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staging.table(source_targets(sizes, staging, weights, most), "targets").withColumnRenamed("source", "_s")
    few = small_or_shuffled(targets, targets.count())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shared = sized.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_base", F.floor(ratio)).withColumn("mass", (ratio - F.floor(ratio)) * F.col("size"))
    fractional = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    whole = shared.where(~fractional).select("doc_id", "source", "size", "text_key", "source_size", "target", F.col("_base").cast("long").alias("copies"))
    rounded = dependent_rounding(shared.where(fractional).select("doc_id", "source", "size", "text_key", "mass"), staging)
    back = rounded.select("doc_id", "source", "size", "text_key", "mass").join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    up = F.when(F.col("mass") >= F.col("size"), 1).otherwise(0)
    return whole.unionByName(back.select("doc_id", "source", "size", "text_key", "source_size", "target", (F.floor(ratio) + up).cast("long").alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, size, text_key, source_size, target, copies.

    Size is the number of words (null text: 0).  A document without words is
    never rounded up: it gets its source's whole part.  Null is a source of its own, last in
    order.  An empty table gives an empty result.  Rows that agree in id, source
    and text are interchangeable: each gets its own number of copies.  Other columns are ignored.
    """
    staging = Staging(docs.sparkSession, "mix")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_key"))
    return mix_sizes(sized, staging, weights, most)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of ``docs``.

    Repeated rows (same id, source and text) are taken alike: each as often as
    their mean, rounded up for the first ones; only they are shuffled.
    """
    staging = Staging(docs.sparkSession, "mixed")
    copies = mix(docs, id_col, text_col, source_col, weights, most)
    own = own_names(docs, "mix_id", "mix_source", "mix_key", "mix_copies", "mix_same", "mix_times", "mix_one", "mix_place")
    own_id, own_source, own_key, taken_col, same_col, times, one, place = own
    keys = [own_id, own_source, own_key]
    per_key = copies.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("text_key").alias(own_key)).agg(F.sum("copies").alias(taken_col), F.count("*").alias(same_col))
    per_key = staging.table(per_key.where(F.col(taken_col) > 0), "copies")
    match = F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).cast("string").eqNullSafe(F.col(own_source)) & (F.xxhash64(F.col(text_col)) == F.col(own_key))
    taken = docs.join(small_or_shuffled(per_key, per_key.count()), match)
    whole = F.floor(F.col(taken_col) / F.col(same_col))
    single = taken.where(F.col(same_col) == 1).withColumn(times, F.col(taken_col))
    repeated = taken.where(F.col(same_col) > 1).withColumn(one, F.lit(1).cast("long"))
    if per_key.where(F.col(same_col) > 1).isEmpty():
        every = single
    else:
        placed = staging.table(running_total(repeated, keys, {place: one}, staging, "repeated"), "placed")
        first, n, *names = own_names(placed, "mix_first", "mix_n", *(f"mix_{x}{j}" for x in "kz" for j in range(3)))
        null_free = [c.alias(name) for c, name in zip([*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), *(F.col(k).isNull() for k in keys)], names, strict=True)]
        start = placed.groupBy(*keys).agg(F.min(place).alias(first), F.count("*").alias(n)).select(*null_free, first, n)
        beside = join_groups(placed.select("*", *null_free), staging.table(start, "first"), names, n, "inner")
        more = F.when(F.col(place) - F.col(first) < F.pmod(F.col(taken_col), F.col(same_col)), 1).otherwise(0)
        every = single.unionByName(beside.withColumn(times, whole + more).select(*single.columns))
    again = every.where(F.col(times) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return again.select(*docs.columns)
