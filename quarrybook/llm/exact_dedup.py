"""Exact deduplication by two passes over a Bloom filter.

The first pass sets one bit for every row's hash and keeps those bits that were set
more than once: a number of eight bytes for each row is counted.  The second pass asks for every row whether its bit is
among them: only such possibly repeated rows are shuffled and grouped, all
others pass straight through as groups of one.

The filter is blocked (a block is 4 KB), so a probe is
one equi-join on the block number.  Up to ``FILTER_BYTES`` the filter is
broadcast; beyond it the same join shuffles the narrow digests by block.  (Bitmaps of
each task, merged, would not be smaller: every task would send a filter for all rows.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.llm.words import BLANK
from quarrybook.plans.names import own_names
from quarrybook.plans.skew import join_groups, small_or_shuffled
from quarrybook.plans.staging import Staging

#: Bits in a block: what one bitmap of Spark's bitmap functions holds.
BLOCK_BITS = 32768
#: Bits of the filter for each row; one of them is set by a row, so about 3 % of single rows are grouped in vain.
BITS_PER_ROW = 32
#: The largest filter that is broadcast.
FILTER_BYTES = 64 << 20


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_points, text_key) of the text without ASCII white space; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, f"[{BLANK}]+", "")
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("sha"), F.length(text).alias("n_points"), _text_key(text_col).alias("text_key"))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _bit_number(blocks: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(blocks * BLOCK_BITS))


def repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """The first pass: (block, bits) with the bits that more than one row set."""
    twice = digests.select(_bit_number(blocks).alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.floor(F.col("bit") / BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BLOCK_BITS))).alias("bits"))


def _is_set(position: Column) -> Column:
    octet = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", octet, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Staging]:
    """doc_id, keep_id, group_size, kept, sha, text_key."""
    staging = Staging(docs.sparkSession, "exact-dedup")
    digests = staging.table(digest(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "digests")
    blocks = max(1, -(-digests.count() * BITS_PER_ROW // BLOCK_BITS))
    bits = staging.table(repeated_bits(digests, blocks), "bits")
    probe = F.broadcast(bits) if blocks * BLOCK_BITS // 8 <= FILTER_BYTES else bits
    bit = digests.withColumn("bit", _bit_number(blocks)).withColumn("block", F.floor(F.col("bit") / BLOCK_BITS))
    marked = bit.join(probe, "block", "left").withColumn("maybe", F.coalesce(_is_set(F.pmod("bit", F.lit(BLOCK_BITS))), F.lit(False))).drop("block", "bits", "bit")
    single = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "text_key")
    maybe = staging.table(marked.where("maybe").drop("maybe"), "maybe")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("_row").alias("keep_row")))
    groups = staging.table(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")).select("sha", "group_size", "best.keep_id", "best.keep_row"), "groups")
    grouped = join_groups(maybe, groups, ["sha"], "group_size", "inner").select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "sha", "text_key")
    return single.unionByName(grouped), staging


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null counts
    as empty.  Of equal texts the longest original stays, then the smallest
    doc_id (null ids last); of rows that agree in both, one stays.  Rows that share a doc_id are rows of their own.  An empty
    table gives an empty result; other columns are ignored.
    """
    found, _ = _judged(docs, id_col, text_col)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of the documents that stay, with all their columns; rows that repeat both id and text stay once.

    Rows are known by id and text, so rows that share an id lose nothing; only rows that repeat both are shuffled.
    """
    found, staging = _judged(docs, id_col, text_col)
    per_key = found.where("group_size > 1").groupBy("doc_id", "text_key").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    own_id, own_key = own_names(docs, "repeated_id", "repeated_key")
    per_key = staging.table(per_key.withColumnsRenamed({"doc_id": own_id, "text_key": own_key}), "keys")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (_text_key(text_col) == F.col(own_key))
    leave = per_key.where("NOT stays OR n > 1").select(own_id, own_key)
    again = per_key.where("stays AND n > 1").select(own_id, own_key)
    alone = docs.join(small_or_shuffled(leave, leave.count()), same, "left_anti")
    once = docs.join(small_or_shuffled(again, again.count()), same, "left_semi").withColumn(own_key, _text_key(text_col)).dropDuplicates([id_col, own_key]).drop(own_key)
    return alone.unionByName(once)
