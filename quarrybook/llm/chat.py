"""Chat formatting as prefix trees.

Conversations that share their first turns share those turns' tokens.  Every
distinct prefix of turns is a node; a tree's nodes are laid out depth-first,
each once, with the position its tokens have in a conversation and the
intervals of the layout that they may attend to: those of its ancestors.

A node's id is the digest of its path.  Distinct conversations are ranked by the
chain of their turns' digests; in that order each one adds just the turns that no
earlier one has, so the layout is their concatenation and offsets are global
prefix sums: no tree has to fit in one task, and one first turn may open a third
of all conversations.  What a node attends to is one interval for each
conversation that laid out a stretch of its path.

Texts are written once, beside their conversation.  All of the layout is worked out
on digests and numbers; texts are shuffled when turns are gathered, and those that
several conversations share once more when these are read back.

Template: ``### role: text</turn>`` and a line feed for each turn.  Inside roles and texts the control
characters are escaped (``\\`` as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``, and in roles ``:`` as
``\\c``), so no text can open or close a turn, and unescaping gives it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrybook.plans.prefix import running_total
from quarrybook.plans.skew import join_groups, small_or_shuffled
from quarrybook.plans.staging import Staging

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, escaped in escapes:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _token_rows(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = True
    for batch in batches:
        ids = [[e.ids for e in tokenizer.encode_batch([s["text"] for s in segments], add_special_tokens=False)] for segments in batch.column("segments").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.list_(pa.int32())))], [*batch.schema.names, "token_ids"])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


class ChatTrees:
    """The tables of formatted conversations.

    ``conversations``: conv_id, leaf (node of the last turn), n_turns.
    ``nodes``: path (id), tree, depth, text, loss_from, loss_length, n_tokens, start
    (offset in the tree's layout), position (of its first token), attends
    (intervals [from, to) of the ancestors in the layout; within a node
    attention is causal).

    Tokens are code points, or the ids of ``tokenizer_file`` (a file that every
    executor can open) in a column token_ids.  Turns are ordered by turn, role
    and text, nulls first; null roles and texts count as empty.  A row of a null
    conv_id belongs to no other: it is a conversation of one turn.  The loss mask covers the text of assistant
    turns, nothing else.  Equal conversations share all their nodes.  Other columns are ignored.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer_file: str | None = None):
        self.staging = Staging(rows.sparkSession, "chat")
        turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
        talks = rows.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), turn.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        talks = talks.select("conv_id", F.transform("turns", self._segment).alias("segments"))
        if tokenizer_file is None:
            talks = talks.withColumn("lengths", F.transform("segments", lambda s: F.length(s["text"]).cast("long")))
        else:
            schema = T.StructType([*talks.schema.fields, T.StructField("token_ids", T.ArrayType(T.ArrayType(T.IntegerType())))])
            talks = talks.mapInArrow(lambda b: _token_rows(b, tokenizer_file), schema).withColumn("lengths", F.transform("token_ids", lambda i: F.size(i).cast("long")))
        talks = talks.withColumn("digests", F.transform("segments", lambda s: _digest(s["text"]))).withColumn("talk", F.monotonically_increasing_id())
        nothing = F.array().cast("array<binary>")
        paths = F.aggregate("digests", nothing, lambda acc, d: F.concat(acc, F.array(_digest(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(b"")), d)))))
        self.talks = self.staging.table(talks.withColumn("paths", paths), "talks")
        leaves = self.talks.select("conv_id", "talk", F.element_at("paths", -1).alias("leaf"), F.size("paths").cast("long").alias("n_turns"))
        self.conversations = leaves.select("conv_id", "leaf", "n_turns")
        self.first = self.staging.table(leaves.groupBy("leaf").agg(F.min("talk").alias("talk"), F.count("*").alias("talks")), "first")
        self._lay_out()

    @staticmethod
    def _segment(turn: Column) -> Column:
        role, text = escape(turn["role"], ROLE_ESCAPES), escape(turn["text"])
        head = F.concat(F.lit(OPEN), role, F.lit(BETWEEN))
        is_loss = turn["role"] == "assistant"
        return F.struct(F.concat(head, text, F.lit(CLOSE)).alias("text"), F.when(is_loss, F.length(head)).otherwise(0).alias("loss_from"), F.when(is_loss, F.length(text)).otherwise(0).alias("loss_length"))

    def _lay_out(self) -> None:
        stage = self.staging.table
        narrow = self.talks.select("talk", "digests", "paths", "lengths").join(small_or_shuffled(self.first.select("talk"), self.first.count()), "talk", "left_semi")
        # eight bytes of each digest order the conversations; the nodes are told apart by whole digests
        order = F.aggregate("digests", F.lit(b""), lambda acc, d: F.concat(acc, F.substring(d, 1, 8)))
        ranks = running_total(narrow.select("talk", order.alias("order"), F.lit(1).cast("long").alias("one")), ["order"], {"rank": "one"}, self.staging, "by-digests")
        ranks = stage(ranks.select("talk", "rank"), "ranks")
        self.staging.drop("by-digests")
        steps = narrow.join(small_or_shuffled(ranks, ranks.count()), "talk").select("rank", "talk", F.element_at("paths", 1).alias("tree"), F.posexplode(F.arrays_zip("paths", "lengths")).alias("k", "z"))
        steps = steps.select("rank", "talk", "tree", (F.col("k") + 1).alias("depth"), F.col("z.paths").alias("path"), F.col("z.lengths").alias("n_tokens"))
        # one conversation's turns are few beside all; their running sum is its own window
        before = Window.partitionBy("rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        steps = stage(steps.withColumn("position", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "steps")
        uses = stage(steps.groupBy("path").agg(F.min("rank").alias("owner"), F.count("*").alias("uses")), "uses")
        owned_by = stage(join_groups(steps, uses, ["path"], "uses", "inner").drop("uses"), "owned")
        own = owned_by.where(F.col("rank") == F.col("owner"))
        fresh = own.groupBy("rank").agg(F.sum("n_tokens").alias("fresh"), F.min("position").alias("first"))
        bases = stage(running_total(fresh, ["rank"], {"offset": "fresh"}, self.staging, "by-rank").select("rank", (F.col("offset") - F.col("first")).alias("base")), "bases")
        self.stretches = stage(owned_by.groupBy("rank", "talk", "owner").agg(F.min("position").alias("from"), F.max(F.col("position") + F.col("n_tokens")).alias("to"), F.min("depth").alias("top"), F.max("depth").alias("bottom")), "stretches")
        met = stage(self.stretches.groupBy("owner").agg(F.count("*").alias("met")).join(bases.withColumnRenamed("rank", "owner"), "owner"), "met")
        spans = join_groups(self.stretches.select("rank", "owner", "from", "to"), met, ["owner"], "met", "inner").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("from", "to", "base"))).alias("spans"))
        placed = own.join(bases, "rank").join(spans, "rank").withColumn("at", F.col("base") + F.col("position"))
        placed = stage(placed.drop("owner", "base"), "placed")
        trees = stage(placed.groupBy("tree").agg(F.min("at").alias("root"), F.count("*").alias("n_nodes")), "trees")
        rooted = join_groups(placed, trees, ["tree"], "n_nodes", "inner")
        earlier = F.filter("spans", lambda x: x["from"] < F.col("position"))
        attends = F.transform(earlier, lambda x: F.struct((x["base"] + x["from"] - F.col("root")).alias("from"), (x["base"] + F.least(x["to"], F.col("position")) - F.col("root")).alias("to")))
        layout = stage(rooted.select("talk", "depth", "path", "tree", "n_tokens", "position", (F.col("at") - F.col("root")).alias("start"), attends.alias("attends")), "layout")
        more = [c for c in ("token_ids",) if c in self.talks.columns]
        texts = self.talks.select("talk", F.posexplode(F.arrays_zip("segments", *more)).alias("k", "z")).select("talk", (F.col("k") + 1).alias("depth"), "z.segments.*", *[f"z.{c}" for c in more])
        self.nodes = layout.join(texts, ["talk", "depth"]).drop("talk")
        self.staging.drop("steps", "owned", "by-rank", "met", "placed", "trees", "bases", "uses")

    def read_back(self) -> DataFrame:
        """conv_id, n_turns, formatted, turns (role, text), loss_text: from the laid-out turns alone, each of which only its owner has."""
        own = self.stretches.where(F.col("rank") == F.col("owner")).select("talk", "rank", "top", "bottom")
        laid = self.talks.select("talk", "conv_id", "segments").join(small_or_shuffled(own, own.count()), "talk").select("rank", "talk", "conv_id", "top", F.slice("segments", F.col("top"), F.col("bottom") - F.col("top") + 1).alias("part"))
        shared = self.stretches.where(F.col("rank") != F.col("owner")).select(F.col("rank").alias("reader"), F.col("owner").alias("rank"), F.col("top").alias("lo"), F.col("bottom").alias("hi"))
        asked = self.staging.table(shared.groupBy("rank").agg(F.count("*").alias("readers")), "asked")
        lent = self.staging.table(laid.join(small_or_shuffled(asked, asked.count()), "rank").select("rank", "top", "part", "readers"), "lent")
        bytes_of = F.aggregate("part", F.lit(64).cast("long"), lambda acc, x: acc + 24 + F.octet_length(x["text"]))
        pieces = join_groups(shared, lent, ["rank"], "readers", "inner", width=bytes_of)
        pieces = pieces.select(F.col("reader").alias("rank"), F.col("lo").alias("top"), F.slice("part", F.col("lo") - F.col("top") + 1, F.col("hi") - F.col("lo") + 1).alias("part"))
        whole = laid.where("top = 1")
        rest = laid.where("top > 1").select("rank", "top", "part").unionByName(pieces)
        joined = rest.groupBy("rank").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("top", "part"))), lambda x: x["part"])).alias("part"))
        # a conversation whose turns are all others' has no stretch of its own to tell its talk
        named = self.stretches.groupBy("rank").agg(F.first("talk").alias("talk")).join(self.first.select("talk", "leaf", "talks"), "talk")
        read = whole.select("rank", "part").unionByName(joined).join(small_or_shuffled(named, named.count()), "rank")
        members = self.talks.select("conv_id", "talk", F.element_at("paths", -1).alias("leaf"))
        read = self.staging.table(read.select("talk", "leaf", "talks", "part"), "read")
        one = read.where("talks = 1").join(small_or_shuffled(members.select("talk", "conv_id"), self.first.count()), "talk").select("conv_id", "part")
        several = read.where("talks > 1").select("leaf", "talks", "part")
        each = one.unionByName(join_groups(members.select("conv_id", "leaf"), several, ["leaf"], "talks", "inner", width=bytes_of).select("conv_id", "part"))
        formatted = F.array_join(F.transform("part", lambda p: p["text"]), "")
        masked = F.array_join(F.transform("part", lambda p: F.substr(p["text"], p["loss_from"] + 1, p["loss_length"])), "")
        found = each.select("conv_id", F.size("part").cast("long").alias("n_turns"), formatted.alias("formatted"), masked.alias("masked"))
        marked = F.split(F.col("formatted"), CLOSE)
        bodies = F.slice(marked, 1, F.size(marked) - 1)

        def parsed(body: Column) -> Column:
            rest = F.substr(body, F.lit(len(OPEN) + 1))
            role = F.substring_index(rest, BETWEEN, 1)
            return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.length(role) + len(BETWEEN) + 1)).alias("text"))

        return found.select("conv_id", "n_turns", "formatted", F.transform(bodies, parsed).alias("turns"), unescape(F.col("masked")).alias("loss_text"))
