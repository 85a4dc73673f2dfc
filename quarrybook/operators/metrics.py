"""Scores of rankings and of answers."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.plans.prefix import running_total
from quarrybook.plans.staging import Staging

SEED, RESAMPLES = 20260923, 10_000
#: Differences up to this count as ties.
TIE = 1e-12
#: The share of Poisson numbers of mean 1 that are at most 0, 1, ..., in units of 2**-32; beyond twelve less than one is left.
POISSON_BOUNDS = [round(c * 2**32) for c in accumulate(exp(-1) / factorial(k) for k in range(13))]


def score_rankings(hits: DataFrame, relevant: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, method, n_relevant, recall_at_5, recall_at_10, rr_at_10, first_rank.

    ``relevant``: (query_id, pmid).  Repeated papers of a ranking count at their
    first place.  A query without relevant papers has null scores, which means pass over;
    ``queries`` (query_id, method) adds queries without any hit.
    """
    first = hits.groupBy("query_id", "method", "pmid").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id", "method").orderBy("rank"))
    placed = first.withColumn("rank", place)
    wanted = relevant.select("query_id", "pmid").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    found = placed.join(wanted.withColumn("hit", F.lit(1)), ["query_id", "pmid"], "left")
    in_top = lambda k: F.count(F.when(F.col("rank") <= k, F.col("hit")))
    counted = found.groupBy("query_id", "method").agg(in_top(5).alias("top5"), in_top(10).alias("top10"), F.min(F.when((F.col("rank") <= 10) & F.col("hit").isNotNull(), F.col("rank"))).alias("first_rank"))
    if queries is not None:
        counted = queries.select("query_id", "method").distinct().join(counted, ["query_id", "method"], "left").fillna(0, ["top5", "top10"])
    scored = counted.join(sizes, "query_id", "left")
    rr = F.when(F.col("n_relevant").isNotNull(), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))
    return scored.select(
        "query_id", "method", F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"),
        (F.col("top5") / F.col("n_relevant")).alias("recall_at_5"), (F.col("top10") / F.col("n_relevant")).alias("recall_at_10"),
        rr.alias("rr_at_10"), F.col("first_rank").cast("long").alias("first_rank"),
    )


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """Means over the queries that have a score, and how many have a relevant paper in the top ten, for each method and, within it, each value of ``by``.

    With ``by`` there is a row over all of its values too, in which it is null (grouping sets).
    """
    scored = scores.where(F.col("recall_at_10").isNotNull())
    grouped = scored.groupingSets([["method"], ["method", *by]], "method", *by) if by else scored.groupBy("method")
    return grouped.agg(
        F.count("*").alias("questions_scored"), F.avg("recall_at_5").alias("recall_at_5"), F.avg("recall_at_10").alias("recall_at_10"),
        F.avg("rr_at_10").alias("mrr_at_10"), F.count("first_rank").alias("any_relevant_in_top_10"),
    )


def placed_values(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, value, first, last, n): the places that each distinct value takes in its group's order, from 1, and the group's size.

    Places are prefix sums of counts over range partitions, so a group of any size is spread over tasks.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    summed = running_total(counted, [*by, value], {"_before": "_c"}, Staging(rows.sparkSession, "places"))
    summed = Staging(rows.sparkSession, "placed").table(summed, "summed")
    groups = summed.groupBy(*by).agg(F.min("_before").alias("_start"), F.sum("_c").alias("n"))
    beside = summed.join(groups, list(by)) if by else summed.crossJoin(F.broadcast(groups))  # one row
    return beside.select(*by, value, (F.col("_before") - F.col("_start") + 1).alias("first"), (F.col("_before") - F.col("_start") + F.col("_c")).alias("last"), "n")


def nearest_rank(rows: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The value at place max(1, round(share * n)) of each group; halves round to even."""
    place = F.greatest(F.lit(1), F.bround(F.col("n") * share))
    return placed_values(rows, value, *by).where((F.col("first") <= place) & (place <= F.col("last"))).select(*by, value)


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """p50 (mean of the middle ones), p95 (nearest rank) and max of each group."""
    at = lambda place: (F.col("first") <= place) & (place <= F.col("last"))
    low, high, far = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.greatest(F.lit(1), F.bround(F.col("n") * 0.95))
    value_at = lambda place: F.max(F.when(at(place), F.col(value)))
    return placed_values(rows, value, *by).groupBy(*by).agg(((value_at(low) + value_at(high)) / 2).alias("p50"), value_at(far).alias("p95"), F.max(value).alias("max"))


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """min, p50, p95, max; inner quantiles by linear interpolation, rounded half to even."""
    spread = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*by).agg(F.min(value).alias("min"), F.bround(spread[0]).cast("long").alias("p50"), F.bround(spread[1]).cast("long").alias("p95"), F.max(value).alias("max"))


def paired(scores: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """(query_id, diff): method a less method b, for queries that both scored."""
    one, two = (scores.where((F.col("method") == m) & F.col(metric).isNotNull()).select("query_id", F.col(metric).alias(c)) for m, c in ((a, "_a"), (b, "_b")))
    return one.join(two, "query_id").select("query_id", (F.col("_a") - F.col("_b")).alias("diff"))


def wins(diffs: DataFrame, *by: str) -> DataFrame:
    return diffs.groupBy(*by).agg(F.avg("diff").alias("mean_difference"), F.count_if(F.col("diff") > TIE).alias("a_better"), F.count_if(F.col("diff") < -TIE).alias("b_better"), F.count_if(F.abs("diff") <= TIE).alias("ties"))


def bootstrap_ci(diffs: DataFrame) -> DataFrame:
    """(low, high): the middle 95 % of the mean difference over ``RESAMPLES`` resamples of the questions.

    Every question draws its own number of repeats in each resample (Poisson bootstrap) from a hash of the seed, its id and the resample's
    place: eight draws of 32 bits a hash.  So each task adds up the questions it has, and only one row for each task and resample is shuffled.  No rows without questions.
    """
    blocks = diffs.select(F.col("query_id").cast("string").alias("query_id"), "diff", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES // 8 - 1))).alias("block"))
    digest = F.sha2(F.concat_ws("|", F.lit(SEED), "query_id", "block"), 256)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substr(F.col("digest"), k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    drawn = blocks.withColumn("digest", digest).select("diff", "block", F.posexplode(numbers).alias("k", "u"))
    weight = sum(((F.col("u") >= bound).cast("int") for bound in POISSON_BOUNDS), F.lit(0))
    sums = drawn.select((F.col("block") * 8 + F.col("k")).alias("resample"), weight.alias("w"), "diff").groupBy("resample").agg(F.sum("w").alias("drawn"), F.sum(F.col("w") * F.col("diff")).alias("total"))
    means = sums.select(F.round(F.col("total") / F.nullif("drawn", F.lit(0)), 12).alias("mean")).where("mean IS NOT NULL")
    # a row for each resample, whatever the input
    ordered = means.agg(F.sort_array(F.collect_list("mean")).alias("m")).where(F.size("m") > 0)
    n = F.size("m")
    return ordered.select(F.get("m", F.floor(n * 0.025).cast("int")).alias("low"), F.get("m", F.greatest(F.floor(n * 0.975) - 1, F.lit(0)).cast("int")).alias("high"))


def recall_ceiling(scores: DataFrame, relevant: DataFrame) -> DataFrame:
    """method, recall_vs_ceiling, mean_ceiling, and of the questions' numbers of relevant papers the least, the upper median, the greatest and how many are above ten.

    A ranking of ten cannot find more than ten papers: the ceiling is the recall of a ranking that finds as many as it can.
    """
    cap = F.least(F.lit(10), F.col("n_relevant")) / F.col("n_relevant")
    placed = placed_values(relevant.groupBy("query_id").agg(F.count("*").alias("c")), "c")
    middle = F.floor(F.col("n") / 2) + 1
    spread = placed.agg(
        F.min("c").alias("least_relevant"), F.max(F.when((F.col("first") <= middle) & (middle <= F.col("last")), F.col("c"))).alias("upper_median"), F.max("c").alias("most_relevant"),
        F.coalesce(F.sum(F.when(F.col("c") > 10, F.col("last") - F.col("first") + 1)), F.lit(0)).alias("above_ten"),
    )
    means = scores.where("recall_at_10 is not null").groupBy("method").agg(F.avg(F.col("recall_at_10") / cap).alias("recall_vs_ceiling"), F.avg(cap).alias("mean_ceiling"))
    return means.crossJoin(F.broadcast(spread))  # one row


def with_latency(summary: DataFrame, times: DataFrame, value: str, *by: str) -> DataFrame:
    """``summary`` with p50, p95 and max of the group's ``times``, rounded to a tenth; null where nothing was timed."""
    tenth = [F.bround(c, 1).alias(f"{c}_{value}") for c in ("p50", "p95", "max")]
    return summary.join(latency_summary(times, value, *by).select(*by, *tenth), list(by), "left")


def check_targets(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``values`` (..., metric, value) with its target (metric, least, most) and whether it is met.

    A bound that is null does not bind; a null value meets no target; a target without any value is a row of its own; values without a target stay out.
    """
    met = F.col("value").isNotNull() & F.coalesce(F.col("value") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("most"), F.lit(True))
    return targets.join(values, "metric", "left").select(*values.columns, "least", "most", met.alias("met"))


def miss_depth(deep_hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """method, bucket, n: where the relevant papers outside the top ten are in a ranking of depth 50."""
    methods = deep_hits.select("method").distinct()
    wanted = relevant.select("query_id", "pmid").distinct().join(F.broadcast(methods))  # a row for each method
    ranked = wanted.join(deep_hits.select("query_id", "method", "pmid", "rank"), ["query_id", "method", "pmid"], "left")
    bucket = F.when(F.col("rank") <= 20, "11-20").when(F.col("rank") <= 50, "21-50").otherwise("not_in_top_50")
    return ranked.where(F.col("rank").isNull() | (F.col("rank") > 10)).groupBy("method", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def score_fact(items: Column, variants: Column) -> Column:
    """struct<strict, lenient> of normalised predictions against all normalised variants."""
    good = F.filter(variants, lambda v: v != "")
    return F.struct(F.coalesce(F.array_contains(good, F.try_element_at(items, F.lit(1))), F.lit(False)).alias("strict"), F.exists(items, lambda i: F.array_contains(good, i)).alias("lenient"))


def score_list(items: Column, reference: Column) -> Column:
    """struct<matched, precision, recall, f1>: predictions take the first unmatched reference item in turn.

    ``items``: normalised predictions; ``reference``: items, each an array of normalised variants.
    """
    predictions = F.array_distinct(F.filter(items, lambda i: i != ""))
    n_ref = F.size(reference)
    places = F.when(n_ref > 0, F.sequence(F.lit(1), F.greatest(n_ref, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def take(open_items: Column, p: Column) -> Column:
        fits = F.filter(open_items, lambda k: F.array_contains(F.element_at(reference, k), p))
        return F.array_except(open_items, F.slice(fits, 1, 1))

    matched = n_ref - F.size(F.aggregate(predictions, places, take))
    precision = F.when(F.size(predictions) > 0, matched / F.size(predictions)).otherwise(F.lit(0.0))
    recall = F.when(n_ref > 0, matched / n_ref).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.struct(matched.cast("long").alias("matched"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
