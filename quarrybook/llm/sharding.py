"""Contiguous shards of equal bytes by global prefix sums.

Documents are taken in order of id; prefix sums of their sizes come from
per-partition totals, and the order is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.plans.names import own_names
from quarrybook.plans.prefix import running_total
from quarrybook.plans.staging import Staging

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    octets = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(octets) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"))


def _cut(start: Column, size: Column, total: int, shards: int) -> Column:
    """The shard in whose span the middle of a document lies."""
    twice = F.lit(2) * start + size
    return F.least(F.floor(twice.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text (null: none) plus ``OVERHEAD``.  Shards
    are contiguous in the order (doc_id, text_crc32, size), null ids first; a
    shard's size misses the mean by less than one document.  ``slot`` counts
    from 0 within a shard.  Equal rows are interchangeable; an empty table gives
    an empty result.
    """
    staging = Staging(docs.sparkSession, "shard")
    sized = staging.table(_sized(docs, id_col, text_col), "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    summed = running_total(sized.withColumn("_one", F.lit(1).cast("long")), ["doc_id", "text_crc32", "size"], {"_start": "size", "_rank": "_one"}, staging)
    placed = staging.table(summed.withColumn("shard", _cut(F.col("_start"), F.col("size"), total, shards)).drop("_one"), "placed")
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their shard; a column ``shard`` of theirs is replaced.  Texts are not shuffled.

    A contiguous shard is an interval of the order, so its first key is enough to
    place a row: the ``shards`` first keys are compared with every row.  Rows that
    agree in the whole key (doc_id, text_crc32, size) stay together.
    """
    found = assign_shards(docs, shards, id_col, text_col)
    key = F.struct(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    own_col, cuts_col = own_names(docs, "own_key", "shard_cuts")
    cuts = found.groupBy("shard").agg(F.min(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("shard", "k"))).alias(cuts_col))
    octets = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = F.struct(F.col(id_col).alias("doc_id"), F.crc32(octets).alias("text_crc32"), (F.octet_length(octets) + F.lit(OVERHEAD)).cast("long").alias("size"))
    keyed = docs.withColumn(own_col, own).crossJoin(F.broadcast(cuts))  # one row of at most `shards` keys
    place = F.array_max(F.transform(F.filter(cuts_col, lambda c: c["k"] <= F.col(own_col)), lambda c: c["shard"]))
    return keyed.withColumn("shard", place).drop(own_col, cuts_col)
