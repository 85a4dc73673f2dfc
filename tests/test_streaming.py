"""Streaming forms against their batch forms, and limits over time against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarrybook.operators import limits
from quarrybook.streaming import limits as streams


def requests(spark):
    steps = [(1, 0, "a", "begin"), (2, 5, "a", "begin"), (3, 6, "b", "begin"), (4, 7, "a", "finish"), (5, 8, "a", "begin"), (6, 900, "b", "begin"), (7, 901, "b", "release"), (8, 902, "a", "begin")]
    rows = [(key, i, t, f, k) for key in ("x", "y") for i, t, f, k in steps]
    return spark.createDataFrame(rows, "request_key string, event_id long, at long, fingerprint string, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def drained(df, tmp_path, mode):
    out = str(tmp_path / "out")
    run = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.parquet(out)


def test_leases(spark, tmp_path):
    batch = requests(spark)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = drained(streams.request_leases(stream), tmp_path, "append")
    key = lambda r: (r["request_key"], r["event_id"], r["decision"])
    assert sorted(map(key, got.collect())) == sorted(map(key, limits.request_leases(batch).collect()))


def test_days(spark, tmp_path):
    events = spark.range(700).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 300).cast("timestamp_ntz").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = sorted((str(r["day"])[:10], r["attempts"], r["charged"]) for r in drained(streams.charged_by_day(stream, ceiling=200), tmp_path, "complete").collect())
    want = sorted((str(r["day"]), r["attempts"], r["charged"]) for r in limits.daily_ceiling(events, 200).collect())
    assert got == want


def lease_run(spark, tmp_path, slices):
    """Decisions of a stream that is restarted for each slice, and the progress of its last run."""
    schema, out = slices[0].schema, str(tmp_path / "out")
    with streams.rocksdb(spark):
        for part in slices:
            part.write.mode("append").parquet(str(tmp_path / "in"))
            source = streams.request_leases(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lease=600)
            run = source.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/{k}")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out), run


def test_leases_over_restarts_forget_dead_keys(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randrange(8) + 8 * (at // 4000)}", i, at, rnd.choice("ab"), rnd.choice(["begin", "begin", "finish", "release"])) for i, at in enumerate(sorted(rnd.choices(range(12_000), k=300)))]
    rows.append(("end", 999, 20_000, "a", "begin"))
    table = spark.createDataFrame(rows, "request_key string, event_id long, at long, fingerprint string, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got, run = lease_run(spark, tmp_path, [*streams.time_slices(table.where("event_id < 999"), 3), table.where("event_id = 999")])
    key = lambda r: (r["request_key"], r["event_id"], r["decision"])
    assert sorted(map(key, got.collect())) == sorted(map(key, limits.request_leases(table, 600).collect()))
    state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "progress"))
    assert [r["key"][0] for r in state.select("key").collect()] == ["end"]  # all others were forgotten


def test_ledger_charges_a_replayed_batch_once(spark, tmp_path):
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 300 % 200_000).alias("ts"))
    slices = streams.time_slices(events, 4)
    ledger = streams.DayLedger(spark, str(tmp_path / "ledger"), ceiling=150)
    assert ledger.days().collect() == []
    for k, part in enumerate(slices):
        ledger.charge(part, k)
        ledger.charge(part, k)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ledger.days()) == rows(limits.daily_ceiling(events, 150))
    kept = ledger.charged()
    assert kept.count() == kept.select("event_id").distinct().count() == ledger.days().agg(F.sum("charged")).first()[0]
    first = defaultdict(list)
    for r in events.orderBy("ts", "event_id").collect():
        first[r["ts"].date()].append(r["event_id"])
    assert {r["event_id"] for r in kept.collect()} == {i for ids in first.values() for i in ids[:150]}
    again = streams.DayLedger(spark, str(tmp_path / "ledger"), ceiling=150)  # a write that broke off leaves no mark and is not seen
    spark.createDataFrame([], "day date, attempts long").write.parquet(str(tmp_path / "ledger/days/batch-9"))
    (tmp_path / "ledger/days/batch-9/_SUCCESS").unlink()
    assert rows(again.days()) == rows(ledger.days())


def paced(rows, budget, seconds):
    """One after the other, as a sender that sleeps."""
    starts, sent, clock = {}, [], 0.0
    for i, at, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        if tokens > budget:
            starts[i] = None
            continue
        clock = max(clock, at)
        while sum(t for s, t in sent if s > clock - seconds) + tokens > budget:
            clock = min(s for s, t in sent if s > clock - seconds) + seconds
        sent.append((clock, tokens))
        starts[i] = clock
    return starts


def test_pacer_equals_a_sleeping_sender(spark):
    rnd = random.Random(5)
    for gap in (1, 20):  # overloaded and idle
        rows = [(i, float(rnd.randrange(0, 300 * gap)), rnd.choice([0, 1, 5, 10, 40, 101])) for i in range(300)] + [(1000 + i, 77.0, 9) for i in range(100)]
        df = spark.createDataFrame(rows, "event_id long, at double, tokens long").withColumn("ts", F.timestamp_seconds("at")).withColumn("_row", F.lit(1))
        got = limits.paced_starts(df, 100, seconds=60)
        assert got.columns == [*df.columns, "starts_at"]
        want = paced(rows, 100, 60)
        assert {r["event_id"]: r["starts_at"] for r in got.collect()} == want and sum(v is not None and v > at for (i, at, _), v in zip(rows, (want[r[0]] for r in rows))) > 50
        load = limits.trailing_load(df, seconds=60, stretch=40)
        held = {r["second"]: (r["tokens"], r["trailing"]) for r in load.collect()}
        assert held == {s: (sum(t for _, a, t in rows if a == s), sum(t for _, a, t in rows if s - 60 < a <= s)) for s in {int(a) for _, a, _ in rows}}
    assert limits.paced_starts(df.limit(0), 100).collect() == []


def test_leases_by_buckets_over_restarts(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(40) + 40 * (at // 4000)}", i, at, rnd.choice("ab"), rnd.choice(["begin", "begin", "finish", "release"])) for i, at in enumerate(sorted(rnd.choices(range(12_000), k=600)))]
    rows += [(None, 700 + i, 11_000 + i, "a", "begin") for i in range(3)] + [("k0", 777, 11_500, None, "release")]
    rows += [("end", 999, 20_000, "a", "begin"), ("end", 1000, 20_000, "b", "begin")]
    table = spark.createDataFrame(rows, "request_key string, event_id long, at long, fingerprint string, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out, most = str(tmp_path / "out"), 0
    with streams.rocksdb(spark):
        for part in [*streams.time_slices(table.where("event_id < 999"), 3), table.where("event_id >= 999")]:
            part.write.mode("append").parquet(str(tmp_path / "in"))
            source = streams.request_leases(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), lease=600, buckets=4)
            run = source.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/{k}")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            run.awaitTermination()
            state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "progress")).select("value.keys").collect()
            most = max(most, len(state))
    key = lambda r: (r["request_key"] or "", r["event_id"], r["decision"])
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert sorted(map(key, got.collect())) == sorted(map(key, limits.request_leases(table, 600).collect()))
    assert 1 < most <= 4 and [list(r["keys"]) for r in state] == [["end"]]  # a state for each bucket; all other leases are forgotten
