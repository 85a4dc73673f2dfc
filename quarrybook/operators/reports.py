"""Checks and summaries after a run, and the small rules of the request path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.operators.metrics import placed_values

OUTCOMES = ("answered", "insufficient_evidence", "needs_clarification", "out_of_scope", "service_unavailable")
QUESTION_CHARS, CLARIFICATION_CHARS = 2000, 1000


def gate_checks(rows: DataFrame, expected: DataFrame, excerpts: DataFrame, papers: DataFrame) -> DataFrame:
    """(gate, violations) of a run.

    ``rows``: (id, outcome); ``expected``: (id); ``excerpts``: (id, pmid, field,
    start, end, text).  Every expected id has one row and no other has any,
    outcomes are known, excerpts are of known papers and equal the stored text at their offsets.
    """
    counted = rows.groupBy("id").agg(F.count("*").alias("n"))
    accounts = expected.select("id").distinct().withColumn("wanted", F.lit(True)).join(counted, "id", "full_outer")
    beside = excerpts.join(papers.select("pmid", "title", "abstract"), "pmid", "left")
    stored = F.when(F.col("field") == "title", F.col("title")).otherwise(F.col("abstract"))
    same = F.substr(stored, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text")
    gates = [
        accounts.select(F.lit("missing rows").alias("gate"), F.col("n").isNull().alias("bad")),
        accounts.select(F.lit("unexpected rows").alias("gate"), F.col("wanted").isNull().alias("bad")),
        accounts.select(F.lit("repeated rows").alias("gate"), (F.coalesce("n", F.lit(0)) > 1).alias("bad")),
        rows.select(F.lit("unknown outcomes").alias("gate"), (~F.coalesce("outcome", F.lit("")).isin(*OUTCOMES)).alias("bad")),
        beside.select(F.lit("unknown sources").alias("gate"), F.col("title").isNull().alias("bad")),
        beside.select(F.lit("excerpts that differ").alias("gate"), (F.col("title").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("bad")),
    ]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out.groupBy("gate").agg(F.count_if("bad").alias("violations"))


def highlight_spans(text: Column, spans: Column) -> Column:
    """Of array<struct<start, end, text>>, in order of start, those that equal the text at their place and do not overlap the one kept before."""
    exact = F.filter(spans, lambda s: F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")) == s["text"])
    none = F.slice(exact, 1, 0)
    return F.aggregate(F.array_sort(exact), none, lambda kept, s: F.when((F.size(kept) > 0) & (s["start"] < F.try_element_at(kept, F.lit(-1))["end"]), kept).otherwise(F.concat(kept, F.array(s))))


def check_text(value: Column, limit: int = QUESTION_CHARS) -> Column:
    """Why a text is refused, or null."""
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "empty").when(F.length(F.trim(value)) > limit, "too long")


def error_kind(status: Column, message: Column, raw: Column | None = None) -> Column:
    """A provider's error by its status, its message and the raw text in its metadata; a limit per day is a quota."""
    said = F.lower(F.concat_ws(" ", message, *([] if raw is None else [raw])))
    per_day = said.rlike("per[- ]day")
    return (
        F.when(status.isin(401, 402, 403), "rejected")
        .when((status == 429) & per_day, "quota")
        .when(status == 429, "unavailable")
        .when(status == 408, "timeout")
        .when(status >= 500, "unavailable")
        .otherwise("rejected")
    )


def http_status(outcome: Column, error: Column) -> Column:
    return F.when(outcome != "service_unavailable", 200).when(error == "timeout", 504).otherwise(503)


def origins(setting: Column) -> Column:
    """A comma-separated list without blanks and empty parts."""
    return F.filter(F.transform(F.split(setting, ","), lambda x: F.trim(x)), lambda x: x != "")


def attempt_ceiling(used: Column, remaining: Column, reserve: int) -> Column:
    return used + F.greatest(F.lit(0), remaining - reserve)


def config_mismatches(frozen: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, frozen, actual) where two (key, value) tables differ, nulls and missing keys included."""
    both = frozen.select("key", F.col("value").alias("frozen"), F.lit(1).alias("_f")).join(actual.select("key", F.col("value").alias("actual"), F.lit(1).alias("_a")), "key", "full_outer")
    return both.where(~F.col("frozen").eqNullSafe(F.col("actual")) | F.col("_f").isNull() | F.col("_a").isNull()).select("key", "frozen", "actual")


def fixture_failures(cases: DataFrame) -> DataFrame:
    """Cases whose outcome or items are not as expected.

    Columns: id, outcome, items, calls, and the expectations want_outcome (array, null: any), not_outcome, items_include, items_exclude, want_calls.
    """
    shown = F.transform("items", lambda i: F.lower(i))
    has = lambda part: F.exists(shown, lambda i: F.contains(i, F.lower(part)))
    fails = F.filter(F.array(
        F.when(F.col("want_outcome").isNotNull() & ~F.array_contains("want_outcome", F.col("outcome")), "outcome"),
        F.when(F.col("outcome") == F.col("not_outcome"), "forbidden outcome"),
        F.when(F.exists("items_include", lambda p: ~has(p)), "missing item"),
        F.when(F.exists("items_exclude", has), "forbidden item"),
        F.when(F.col("calls") != F.col("want_calls"), "calls"),
    ), lambda x: x.isNotNull())
    return cases.select("id", fails.alias("failures")).where(F.size("failures") > 0)


def source_list(excerpts: DataFrame) -> DataFrame:
    """(source_id, excerpts): each source's excerpts in first-seen order without repeats; sources without any stay."""
    first = excerpts.groupBy("source_id", "text").agg(F.min("pos").alias("pos"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"].isNotNull())
    return first.groupBy("source_id").agg(F.transform(kept, lambda x: x["text"]).alias("excerpts"))


def citation_numbers(source_ids: Column, shown: Column) -> Column:
    """Places of cited sources among those shown, from 1; unknown ids are dropped."""
    return F.filter(F.transform(source_ids, lambda s: F.array_position(shown, s)), lambda n: n > 0)


def answer_summary(attempts: DataFrame, *by: str) -> DataFrame:
    """attempted, answered, strict accuracy over all attempted and over the answered, mean f1 over all attempted (a missing score is 0)."""
    done = F.col("outcome") == "answered"
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempted"), F.count_if(done).alias("answered"), F.avg(F.when(done & F.col("strict"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.when(done, F.col("strict").cast("double"))).alias("accuracy_of_answered"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1"),
    )


def operations_summary(requests: DataFrame) -> DataFrame:
    """(error, attempts, median_ms, max_ms) of (request, attempts: variant), over the attempts of all requests.

    ``attempts`` is an open record: an array of objects of which ``error`` and ``ms`` are read; an attempt without
    error counts as ``none``, one without a number ``ms`` in no median.  What is no array, or null, has no attempts.
    """
    each = requests.select(F.explode(F.try_variant_get("attempts", "$", "array<variant>")).alias("a"))
    read = each.select(F.coalesce(F.try_variant_get("a", "$.error", "string"), F.lit("none")).alias("error"), F.try_variant_get("a", "$.ms", "double").alias("ms"))
    counted = read.groupBy("error").agg(F.count("*").alias("attempts"), F.max("ms").alias("max_ms"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    value_at = lambda place: F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("ms")))
    medians = placed_values(read, "ms", "error").groupBy("error").agg(((value_at(low) + value_at(high)) / 2).alias("median_ms"))
    return counted.join(medians, "error", "left").select("error", "attempts", "median_ms", "max_ms")


def question_profile(questions: DataFrame) -> DataFrame:
    """type, n, with_answer, with_snippets, mean_documents of raw questions (see curation.eligibility_reason)."""
    some = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return questions.groupBy("type").agg(F.count("*").alias("n"), some("exact_answer").alias("with_answer"), some("snippets").alias("with_snippets"), F.avg(F.size("documents")).alias("mean_documents"))


def question_gate(questions: DataFrame, least: int = 100) -> DataFrame:
    """One row of raw questions (exact_answer, documents, snippets): n, fully_eligible, distinct_papers, mean_documents of the eligible, and whether at least ``least`` are eligible.

    Eligible is what has an answer, documents and snippets.  Papers count by the last part of their addresses; an empty table has zeros.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    eligible = some("exact_answer") & some("documents") & some("snippets")
    counted = questions.agg(F.count("*").alias("n"), F.count_if(eligible).alias("fully_eligible"), F.avg(F.when(eligible, F.size("documents"))).alias("mean_documents"))
    address = questions.select(F.explode("documents").alias("d")).select(F.substring_index(F.regexp_replace("d", "/+$", ""), "/", -1).alias("paper"))
    distinct = address.agg(F.count_distinct("paper").alias("distinct_papers"))
    return counted.crossJoin(F.broadcast(distinct)).withColumn("enough", F.col("fully_eligible") >= least)  # one row each


def reference_states(reference: DataFrame, kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """``reference`` (..., pmid) with the state of each paper: in_collection, the reason of its exclusion, or not_requested."""
    state = F.when(F.col("_has"), "in_collection").otherwise(F.coalesce("_reason", F.lit("not_requested")))
    known = kept.select("pmid", F.lit(True).alias("_has")).distinct()
    why = dropped.groupBy("pmid").agg(F.min("reason").alias("_reason"))
    return reference.join(known, "pmid", "left").join(why, "pmid", "left").select(*reference.columns, state.alias("state"))


def coverage(states: DataFrame, *by: str) -> DataFrame:
    """(*by, reference, in_collection, missing)."""
    has = F.col("state") == "in_collection"
    return states.groupBy(*by).agg(F.count("*").alias("reference"), F.count_if(has).alias("in_collection"), F.count_if(~has).alias("missing"))


def collection_size(papers: DataFrame, limit: int) -> DataFrame:
    """One row of (title, abstract): papers, searchable_chars, over_limit (longer than ``limit``), and the tokens at four and at three characters each."""
    chars = F.length("title") + 1 + F.length("abstract")
    total = F.coalesce(F.sum(chars), F.lit(0))
    estimate = [F.bround(total / by).cast("long").alias(f"tokens_at_{by}") for by in (4, 3)]
    return papers.agg(F.count("*").alias("papers"), total.alias("searchable_chars"), F.count_if(chars > limit).alias("over_limit"), *estimate)


def shared_between(splits: DataFrame) -> DataFrame:
    """Papers that both splits cite, of (split, pmid)."""
    part = lambda s: splits.where(F.col("split") == s).select("pmid")
    return part("development").intersect(part("test"))
