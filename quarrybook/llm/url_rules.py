"""Allow and block rules over urls, joined as intervals by a sorted sweep.

A rule's host, read backwards, and its path make a key; all urls that the rule
fits have keys that begin with it, so the rule is an interval of keys.  Two such
intervals are apart or nested.  The ends of all intervals are swept in order with
a stack of the rules that are open; urls are sorted between the ends, and the
last end before a url tells the innermost rule around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.llm.words import ascii_lower
from quarrybook.plans.names import own_names
from quarrybook.plans.staging import Staging

#: Neither a host nor a path has it, so a host's key is a prefix of no longer host's key.
BETWEEN = "?"
#: A byte that no UTF-8 text has, as hex: behind every key that begins with what is before it.
LAST = "FF"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Both are empty for null and for a text without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """Bytes whose order is that of hosts read from the top level down, then paths."""
    return F.concat(F.array_join(labels, "."), F.lit(BETWEEN), path).cast("binary")


def _backwards(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _ranged(rows: DataFrame, order: list[str], staging: Staging, name: str) -> DataFrame:
    """``rows`` in range partitions, written once with the partition in ``part``."""
    return staging.table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _open_rules(rules: DataFrame, staging: Staging) -> DataFrame:
    """(key, top): at each end of an interval the rule that is innermost behind it; a row of nulls where none is open.

    The depth of the stack is a running count of starts and ends.  What is on top at a depth is the rule that
    was started last at that depth, looked for in the own range partition, then in those before it.
    """
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"))
    named = rules.select(_key(_backwards(F.col("host")), F.col("path")).alias("key"), rule.alias("rule"))
    starts = named.select("key", F.lit(1).alias("step"), "rule")
    ends = named.select(F.concat("key", F.unhex(F.lit(LAST))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(named.schema["rule"].dataType).alias("rule"))
    ranged = _ranged(starts.unionByName(ends), ["key"], staging, "ends")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ranged.groupBy("part").agg(F.sum("step").alias("steps")).select("part", F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    deep = ranged.join(F.broadcast(offsets), "part").select("part", "key", "rule", (F.col("offset") + F.sum("step").over(within)).alias("depth"))
    deep = staging.table(deep, "depths")
    levels = deep.groupBy("part", "depth").agg(F.max_by("rule", F.when(F.col("rule").isNotNull(), F.col("key"))).alias("started"))
    earlier = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each partition
    carried = levels.select("part", "depth", F.last("started", ignorenulls=True).over(earlier).alias("carried"))
    same = Window.partitionBy("part", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    top = F.coalesce(F.last("rule", ignorenulls=True).over(same), F.col("carried"))
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in named.schema["rule"].dataType.fields])
    return deep.join(carried, ["part", "depth"]).select("key", F.when(F.col("depth") > 0, top).otherwise(nothing).alias("top"))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (host and path of the rule that decides, else null) and verdict (the rule's, else ``default``).

    A rule (host, path, verdict) fits its host and all subdomains where the url's path begins with the rule's; an empty
    path fits all.  The longest rule wins (host and path together, then host, then the greater text); of equal rules
    ``block`` wins, else the least verdict.  Hosts of rules are compared as they are, so give them in lower case.

    Null and malformed urls have an empty host and path and no rule.  Every row is judged, repeated ones alike; an
    empty table gives an empty one, and without rules all rows get ``default``.  Other columns are kept, but
    columns named like a result are replaced.

    A url is looked up once for each ending of its host that is as short as a rule's host; keys are cut to the
    longest rule's bytes, which changes no comparison.  Hot hosts and urls are split over range partitions.
    """
    staging = Staging(urls.sparkSession, "urls")
    row, host, path, found = own_names(urls, "_row", "_host", "_path", "_found")
    decided = F.coalesce(F.max(F.when(F.col("verdict") == "block", F.col("verdict"))), F.min("verdict"))
    rules = staging.table(rules.where("host <> '' and path is not null").groupBy("host", "path").agg(decided.alias("verdict")), "rules")
    longest = rules.agg(F.max(F.size(_backwards(F.col("host")))), F.max(F.octet_length(_key(_backwards(F.col("host")), F.col("path"))))).first()
    most_labels, most_bytes = longest[0] or 0, longest[1] or 0
    own_host, own_path = host_and_path(F.col(url))
    numbered = staging.table(urls.withColumns({row: F.monotonically_increasing_id(), host: own_host, path: own_path}), "rows")
    ends = _open_rules(rules, staging)
    asked = numbered.where(F.col(host) != "").select(F.col(row).alias("row"), F.substring(path, 1, most_bytes).alias("path"), F.slice(_backwards(F.col(host)), 1, max(most_labels, 1)).alias("labels"))
    endings = asked.select("row", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
    probes = endings.select(F.substring(_key(F.slice("labels", F.lit(1), F.col("k")), F.col("path")), 1, most_bytes).alias("key"), "row")
    merged = probes.select("key", "row", F.lit(None).cast(ends.schema["top"].dataType).alias("top")).unionByName(ends.select("key", F.lit(-1).cast("long").alias("row"), "top"))
    ranged = _ranged(merged, ["key", "row"], staging, "swept")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    lasts = ranged.groupBy("part").agg(F.max_by("top", F.when(F.col("top").isNotNull(), F.col("key"))).alias("top"))
    carried = lasts.select("part", F.last("top", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("part").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("last", F.last("top", ignorenulls=True).over(within)).where("row >= 0").join(F.broadcast(carried), "part")
    hits = swept.select("row", F.coalesce("last", "carried").alias("top")).where("top.rule is not null")
    best = hits.groupBy("row").agg(F.max(F.struct("top.n", "top.h", "top.rule", "top.verdict")).alias(found)).withColumnRenamed("row", row)
    kept = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return numbered.join(best, row, "left").select(
        *kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict")
    )
