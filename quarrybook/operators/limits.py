"""Request limits over tables of events; see streaming.limits for the same over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrybook.plans.asof import last_before
from quarrybook.plans.names import own_names
from quarrybook.plans.prefix import running_total
from quarrybook.plans.staging import Staging

CLIENT_LIMIT, DAILY_CEILING = 20, 300
LEASE_SECONDS = 600
TOKENS_PER_MINUTE = 200_000


def admit(events: DataFrame, limit: int = CLIENT_LIMIT, client: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``events`` with window_start, n_in_window and admitted: the first ``limit`` of each client and clock hour, refused ones counted."""
    hour = F.date_trunc("hour", ts)
    place = F.row_number().over(Window.partitionBy(client, hour).orderBy(ts, tie)).cast("long")
    return events.withColumn("window_start", hour).withColumn("n_in_window", place).withColumn("admitted", place <= limit)


def daily_ceiling(events: DataFrame, ceiling: int = DAILY_CEILING, ts: str = "ts") -> DataFrame:
    """day, attempts, charged, refused.  Only counts matter, so days are never gathered in one task."""
    counted = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("attempts"))
    return counted.select("day", "attempts", F.least("attempts", F.lit(ceiling).cast("long")).alias("charged"), F.greatest(F.col("attempts") - ceiling, F.lit(0).cast("long")).alias("refused"))


def trailing_tokens(events: DataFrame, tokens: str = "tokens", ts: str = "ts", by: str = "client", seconds: int = 60) -> DataFrame:
    """``events`` with the tokens of the trailing ``seconds``, this event included."""
    w = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-(seconds - 1), 0)
    return events.withColumn("trailing", F.sum(tokens).over(w))


def trailing_load(requests: DataFrame, tokens: str = "tokens", ts: str = "ts", seconds: int = 60, stretch: int = 3600) -> DataFrame:
    """(second, tokens, trailing): the tokens of each second with requests, and those of the trailing ``seconds``, over all clients.

    Requests are added up by second first.  Each ``stretch`` of time is one group, with the seconds just before
    it as a halo, so a group holds at most ``stretch + seconds`` rows and none sees the whole time.
    """
    at = F.col(ts).cast("timestamp").cast("long")
    by_second = requests.groupBy(at.alias("second")).agg(F.sum(tokens).alias("tokens"))
    own = F.floor(F.col("second") / stretch)
    spans = F.sequence(own, F.floor((F.col("second") + seconds - 1) / stretch))
    copies = by_second.select("second", "tokens", own.alias("own"), F.explode(spans).alias("stretch"))
    near = Window.partitionBy("stretch").orderBy("second").rangeBetween(-(seconds - 1), 0)
    return copies.withColumn("trailing", F.sum("tokens").over(near)).where("own = stretch").select("second", "tokens", "trailing")


def paced_starts(requests: DataFrame, per_window: int, seconds: int = 60, tokens: str = "tokens", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``requests`` with starts_at (seconds since the epoch, double): the earliest start of each, in order of ``ts`` and ``tie``,
    so that no ``seconds`` hold more than ``per_window`` tokens; null for a request that alone has more, which is passed over.

    A request waits for the last one before it with which, and all between, the window would overflow: it starts when it is sent or
    ``seconds`` after that one started, whichever is later (later requests never wait for less).  Whom it waits for follows from prefix sums
    alone; the chains of waiting are then followed by doubling, in as many rounds as the longest chain has binary digits.
    """
    staging = Staging(requests.sparkSession, "paced")
    row, sent, size, before = own_names(requests, "_row", "_sent", "_size", "_before")
    sized = requests.withColumns({sent: F.unix_micros(F.col(ts).cast("timestamp")), size: F.col(tokens).cast("long")})
    fits = staging.table(sized.where(F.col(size) <= per_window), "fits")
    placed = staging.table(running_total(fits.withColumn("_one", F.lit(1).cast("long")), [sent, tie], {before: size, row: "_one"}, staging).drop("_one"), "placed")
    asked = placed.select((F.col(before) + F.col(size) - per_window).alias("value"), F.col(row).alias("row"))
    points = placed.select(F.col(before).alias("value"), F.col(row).alias("waits"))
    step = seconds * 1_000_000
    chain = last_before(asked, points, "waits", staging).join(placed.select(F.col(row).alias("row"), F.col(sent).alias("at")), "row").select("row", "at", "waits")
    chain, k = staging.table(chain, "chain-0"), 0
    while not chain.where("waits is not null").isEmpty():
        ahead = chain.select(F.col("row").alias("waits"), F.col("at").alias("ahead"), F.col("waits").alias("next"))
        joined = chain.join(ahead, "waits", "left")
        chain = staging.table(joined.select("row", F.greatest("at", F.col("ahead") + step * (1 << k)).alias("at"), F.col("next").alias("waits")), f"chain-{k + 1}")
        staging.drop(f"chain-{k}")
        k += 1
    started = placed.join(chain.select(F.col("row").alias(row), (F.col("at") / 1e6).alias("starts_at")), row).select(*requests.columns, "starts_at")
    never = sized.where(F.col(size).isNull() | (F.col(size) > per_window)).select(*requests.columns, F.lit(None).cast("double").alias("starts_at"))
    return started.unionByName(never)


Held = tuple[str, str, float]  # fingerprint, status, until


def lease_step(held: Held | None, at: float, fingerprint: str, kind: str, lease: float) -> tuple[str, Held | None]:
    """What one step (begin, finish or release) of a request key is answered, and what is held from then on."""
    if held and at >= held[2]:
        held = None
    if kind == "finish":
        return "stored", (fingerprint, "done", at + lease)
    if kind == "release":
        return "released", None
    if held is None:
        return "run", (fingerprint, "running", at + lease)
    if held[0] != fingerprint:
        return "conflict: different question", held
    return "conflict: being answered" if held[1] == "running" else "replay", held


def _leased(frames: Iterator[pd.DataFrame], lease: float) -> Iterator[pd.DataFrame]:
    """Steps come by key and time; only the last key's lease is held, whatever the number of its steps."""
    last, held = None, None
    for frame in frames:
        out = []
        for key, event_id, at, fingerprint, kind in frame.itertuples(index=False):
            if key != last:
                last, held = key, None
            decision, held = lease_step(held, at, fingerprint, kind, lease)
            out.append((key, event_id, decision))
        yield pd.DataFrame(out, columns=["request_key", "event_id", "decision"])


def request_leases(requests: DataFrame, lease: int = LEASE_SECONDS) -> DataFrame:
    """(request_key, event_id, decision) of (request_key, event_id, ts, fingerprint, kind: begin, finish, release).

    A key is claimed for ``lease`` seconds, its result kept as long.  The steps of a key are taken in order
    as they stream through a task.
    """
    steps = requests.select("request_key", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), "fingerprint", "kind")
    schema = f"request_key {requests.schema['request_key'].dataType.simpleString()}, event_id {requests.schema['event_id'].dataType.simpleString()}, decision string"
    return steps.repartition("request_key").sortWithinPartitions("request_key", "at", "event_id").mapInPandas(lambda frames: _leased(frames, lease), schema)


def occurrences(prompts: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``prompts`` with their occurrence number: the cache key of the n-th time that a prompt is sent."""
    return prompts.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie)).cast("long"))


def cached_completions(prompts: DataFrame, cache: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``prompts`` with occurrence and completion: what is stored for the n-th sending of the same prompt, or null.

    ``cache``: (key, occurrence, completion); failures are never stored.
    """
    return occurrences(prompts, key, ts, tie).join(cache.select(key, "occurrence", "completion"), [key, "occurrence"], "left")


def attempt_budget(attempts: DataFrame, most: int = 4, retries: int = 2, deadline: float = 90.0, reserve: float = 5.0) -> DataFrame:
    """(request, n, seconds, failed) with allowed: whether the attempt may be made within the request's budget."""
    w = Window.partitionBy("request").orderBy("n")
    spent = F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    failed = F.coalesce(F.sum(F.col("failed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return attempts.withColumn("allowed", (F.row_number().over(w) <= most) & (failed <= retries) & ((failed == 0) | (deadline - spent > reserve)))


def spacing_violations(calls: DataFrame, least: float, by: str, ts: str = "ts") -> DataFrame:
    """Calls that follow the one before sooner than ``least`` seconds."""
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(Window.partitionBy(by).orderBy(ts))
    return calls.withColumn("gap", gap).where(F.col("gap") < least)
