"""Follow-up questions: what a conversation keeps, and how the next question is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.operators.reports import QUESTION_CHARS

#: Exchanges that a history keeps, items of each, and characters of a question and of an item.
MAX_EXCHANGES, MAX_ITEMS = 10, 10
KEPT_QUESTION_CHARS, KEPT_ITEM_CHARS = 1000, 150
#: Outcomes after which a conversation may go on.
OPEN_OUTCOMES = ("answered", "insufficient_evidence")


def kept_exchange(question: Column, items: Column) -> Column:
    return F.struct(F.substring(question, 1, KEPT_QUESTION_CHARS).alias("q"), F.transform(F.slice(items, 1, MAX_ITEMS), lambda i: F.substring(i, 1, KEPT_ITEM_CHARS)).alias("i"))


def history(exchanges: DataFrame) -> DataFrame:
    """(conv_id, history) of (conv_id, n, question, items): the last exchanges, oldest first.

    Only the last ``MAX_EXCHANGES`` rows of a conversation are gathered; Spark limits within map tasks before it shuffles.
    """
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("n").desc()))
    last = exchanges.select("conv_id", "n", kept_exchange(F.col("question"), F.col("items")).alias("x")).withColumn("back", back).where(F.col("back") <= MAX_EXCHANGES)
    ordered = F.sort_array(F.collect_list(F.struct("n", "x")))
    return last.groupBy("conv_id").agg(F.transform(ordered, lambda e: e["x"]).alias("history"))


def next_history(before: Column, question: Column, items: Column, outcome: Column) -> Column:
    """The history after an exchange; null where the conversation cannot go on."""
    grown = F.concat(F.coalesce(before, F.array().cast("array<struct<q:string,i:array<string>>>")), F.array(kept_exchange(question, items)))
    return F.when(outcome.isin(*OPEN_OUTCOMES), F.slice(grown, F.greatest(F.size(grown) - MAX_EXCHANGES, F.lit(0)) + 1, MAX_EXCHANGES))


def latest_token(turns: DataFrame) -> DataFrame:
    """(conv_id, token) of (conv_id, turn, token): the token of the last turn that has one."""
    return turns.groupBy("conv_id").agg(F.max_by("token", F.when(F.col("token").isNotNull(), F.col("turn"))).alias("token"))


def clarified(question: Column, clarification: Column) -> Column:
    return F.when(clarification.isNull(), question).otherwise(F.format_string("%s (clarification: %s)", question, clarification))


def rewritten(decision: Column, standalone: Column) -> Column:
    """struct<outcome, question>: a question out of scope is decided before its rewrite is looked at; an empty or over-long rewrite is malformed."""
    text = F.trim(standalone)
    bad = F.coalesce((text == "") | (F.length(text) > QUESTION_CHARS), F.lit(True))
    outcome = F.when(decision == "out_of_scope", "out_of_scope").when(bad, "malformed").otherwise("proceed")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "proceed", text).alias("question"))


def free_models(models: DataFrame) -> DataFrame:
    """Models (id, context, prompt_price, completion_price) that cost nothing, the longest context first."""
    return models.where("prompt_price = 0 AND completion_price = 0").orderBy(F.col("context").desc(), "id")
