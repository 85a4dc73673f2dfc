"""Request limits over streams.

``events.ts`` has no time zone, so it is cast before a watermark; sessions run in UTC.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrybook.operators.limits import CLIENT_LIMIT, DAILY_CEILING, LEASE_SECONDS, lease_step

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def admitted_by_hour(events: DataFrame, limit: int = CLIENT_LIMIT, client: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """window_start, client, requests, admitted for each client and clock hour."""
    counted = _timed(events, ts, late).groupBy(F.window(ts, "1 hour"), client).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("window_start"), client, "requests", F.least("requests", F.lit(limit).cast("long")).alias("admitted"))


def charged_by_day(events: DataFrame, ceiling: int = DAILY_CEILING, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    counted = _timed(events, ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("attempts"))
    return counted.select(F.col("window.start").alias("day"), "attempts", F.least("attempts", F.lit(ceiling).cast("long")).alias("charged"))


def _place(step: Row) -> tuple:
    """A step's place among those of its key, as in the batch form: by time, then by id, null first."""
    return step["at"], (step["event_id"] is not None, step["event_id"])


class _Lease(StatefulProcessor):
    """One request key: its fingerprint and status, forgotten when the watermark passes the end of the lease."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "fingerprint string, status string, until double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.held.get()
        before = held = tuple(found) if found else None
        for step in sorted(rows, key=_place):
            decision, held = lease_step(held, step["at"], step["fingerprint"], step["kind"], self.lease)
            yield Row(request_key=key[0], event_id=step["event_id"], decision=decision)
        # each call to the state is a message to the JVM: a key's one timer is known by the end of its lease
        if held != before:
            if before and (held is None or held[2] != before[2]):
                self.handle.deleteTimer(math.ceil(before[2] * 1000))
            if held is None:
                self.held.clear()
            else:
                self.held.update(held)
                if before is None or held[2] != before[2]:
                    self.handle.registerTimer(math.ceil(held[2] * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Leases(StatefulProcessor):
    """The request keys of one bucket, as :class:`_Lease`, in one state: what a key costs beside its steps is paid by buckets."""

    def __init__(self, lease: int, key_type: str):
        self.lease, self.key_type = lease, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"keys array<{self.key_type}>, fingerprints array<string>, statuses array<string>, untils array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._read()
        timer = self._first(held)
        for step in sorted(rows, key=_place):
            k = step["request_key"]
            decision, now = lease_step(held.get(k), step["at"], step["fingerprint"], step["kind"], self.lease)
            if now:
                held[k] = now
            else:
                held.pop(k, None)
            yield Row(request_key=k, event_id=step["event_id"], decision=decision)
        self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep({k: h for k, h in self._read().items() if math.ceil(h[2] * 1000) > watermark}, None)
        return iter(())

    def _read(self) -> dict:
        found = self.held.get()
        return {k: (f, s, u) for k, f, s, u in zip(*found, strict=True)} if found else {}

    def _keep(self, held: dict, timer: int | None) -> None:
        if held:
            self.held.update((list(held), *[[h[i] for h in held.values()] for i in range(3)]))
        else:
            self.held.clear()
        if (first := self._first(held)) != timer:  # the bucket's one timer: when the first of its leases ends
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)

    @staticmethod
    def _first(held: dict) -> int | None:
        return min((math.ceil(h[2] * 1000) for h in held.values()), default=None)

    def close(self) -> None:
        pass


def request_leases(requests: DataFrame, lease: int = LEASE_SECONDS, late: str = "1 minute", buckets: int | None = None) -> DataFrame:
    """The stream's form of operators.limits.request_leases, with the same steps; needs the RocksDB state store (:func:`rocksdb`).

    A key's state goes when the watermark passes the end of its lease, so the store holds the keys of one lease.
    Steps that are later than ``late`` are dropped.  With ``buckets`` keys are dealt over so many states by their hash, for streams of many
    keys of a few steps each.
    A stream keeps its number of buckets.
    """
    at = F.col("ts").cast("timestamp")
    # a stream's first watermark is 1970, and what is not after it would be late
    timed = requests.withColumns({"at": at.cast("double"), "seen": F.greatest(at, F.timestamp_millis(F.lit(1)))}).withWatermark("seen", late)
    steps = timed.select("request_key", "event_id", "seen", "at", "fingerprint", "kind")
    key_type = steps.schema["request_key"].dataType.simpleString()
    schema = f"request_key {key_type}, event_id {steps.schema['event_id'].dataType.simpleString()}, decision string"
    if buckets is None:
        return steps.groupBy("request_key").transformWithState(_Lease(lease), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    dealt = steps.withColumn("bucket", F.pmod(F.xxhash64("request_key"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithState(_Leases(lease, key_type), outputStructType=schema, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def time_slices(rows: DataFrame, n: int, ts: str = "ts") -> list[DataFrame]:
    """``rows`` in ``n`` stretches of equal time, in order."""
    first, last = rows.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))), F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    if first is None:
        return [rows]
    step = (last - first) // n + 1
    return [rows.where(F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - first) / step) == k) for k in range(n)]


class DayLedger:
    """A daily ceiling over a stream that charges each attempt once, however often a micro-batch is run.

    Each micro-batch has a folder of its own, which is overwritten when it is run again: ``charged`` holds the
    attempts that were admitted, ``days`` the attempts of each day up to and with the batch, written last.  A batch starts
    from the newest folder below its own number, so a repeated batch finds what it found before.
    """

    def __init__(self, spark: SparkSession, path: str, ceiling: int = DAILY_CEILING):
        self.spark, self.path, self.ceiling = spark, path.rstrip("/"), ceiling

    def _batches(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/days")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []
        return sorted(int(name.removeprefix("batch-")) for name in done)

    def _days(self, below: int | None = None) -> DataFrame:
        known = [b for b in self._batches() if below is None or b < below]
        if not known:
            return self.spark.createDataFrame([], "day date, attempts long")
        return self.spark.read.schema("day date, attempts long").parquet(f"{self.path}/days/batch-{known[-1]}")

    def charge(self, attempts: DataFrame, batch: int) -> None:
        """One micro-batch of (event_id, ts); the sink of ``foreachBatch``."""
        timed = attempts.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date(F.col("ts").cast("timestamp")).alias("day"))
        before = self._days(batch)
        place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
        first = timed.withColumn("place", place.cast("long")).where(F.col("place") <= self.ceiling)  # limited within map tasks, so a day of any size is never gathered
        admitted = first.join(before, "day", "left").where(F.col("place") + F.coalesce("attempts", F.lit(0)) <= self.ceiling)
        admitted.select("event_id", "ts", "day").write.mode("overwrite").parquet(f"{self.path}/charged/batch-{batch}")
        both = before.unionByName(timed.groupBy("day").agg(F.count("*").alias("attempts")))
        both.groupBy("day").agg(F.sum("attempts").alias("attempts")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/days/batch-{batch}")  # a row for each day

    def charged(self) -> DataFrame:
        """(event_id, ts, day) of all admitted attempts."""
        found = [f"{self.path}/charged/batch-{b}" for b in self._batches()]
        schema = "event_id long, ts timestamp, day date"
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def days(self) -> DataFrame:
        """(day, attempts, charged, refused), as operators.limits.daily_ceiling."""
        admitted = self.charged().groupBy("day").agg(F.count("*").alias("charged"))
        joined = self._days().join(admitted, "day", "left").withColumn("charged", F.coalesce("charged", F.lit(0).cast("long")))
        return joined.select("day", "attempts", "charged", (F.col("attempts") - F.col("charged")).alias("refused"))
