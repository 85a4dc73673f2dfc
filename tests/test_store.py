"""Sinks under repeats, crashes and refusals; trees of hashes against plain hashing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarrybook.operators import papers, reports, retrieval
from quarrybook.plans.merkle import MerkleTree
from quarrybook.sources import store


def pairs(df):
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, value long")


def test_upsert_repeats_versions_and_crashes(spark, tmp_path):
    kept = store.KeyedStore(spark, str(tmp_path / "store"), "id", buckets=4)
    with pytest.raises(ValueError):
        kept.read()
    first = [(f"k{i}", i) for i in range(50)]
    assert kept.upsert(table(spark, first + first[:5])) == {"inserted": 50, "replaced": 0}
    assert kept.upsert(table(spark, first)) == {"inserted": 0, "replaced": 50} and pairs(kept.read()) == sorted(first)
    change = [("k1", 100), ("k1", 7), ("new", 1)]
    assert kept.upsert(table(spark, change), latest=F.col("value")) == {"inserted": 1, "replaced": 1}
    after = sorted({**dict(first), "k1": 100, "new": 1}.items())
    assert pairs(kept.read()) == after and pairs(kept.read(1)) == sorted(first) and kept.versions() == [1, 2, 3]
    kept.upsert(table(spark, [("k2", -1), ("lost", 0)]), commit=False)  # files without a commit
    assert pairs(kept.read()) == after and kept.upsert(table(spark, [("k2", -1)])) == {"inserted": 0, "replaced": 1}
    assert dict(pairs(kept.read()))["k2"] == -1 and kept.read().count() == 51
    assert kept.upsert(table(spark, [])) == {"inserted": 0, "replaced": 0} and kept.versions() == [1, 2, 3, 4]
    for bad in (table(spark, [(None, 1)]), spark.createDataFrame([("a",)], "id string")):
        with pytest.raises(ValueError):
            kept.upsert(bad)
    with pytest.raises(ValueError):
        kept.read(9)


def test_of_two_writers_the_second_fails(spark, tmp_path):
    kept = store.KeyedStore(spark, str(tmp_path / "store"), "id", buckets=2)
    kept.upsert(table(spark, [("a", 1)]))
    late = store.KeyedStore(spark, str(tmp_path / "store"), "id", buckets=2)
    late.versions = lambda: []  # it began before the first commit
    with pytest.raises(FileExistsError):
        late.upsert(table(spark, [("a", 2)]))
    assert pairs(kept.read()) == [("a", 1)]


def test_large_calls_go_by_groups_of_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", 20)
    kept = store.KeyedStore(spark, str(tmp_path / "store"), "id", buckets=8)
    kept.upsert(table(spark, [(f"k{i}", i) for i in range(100)]))
    assert kept.upsert(table(spark, [(f"k{i}", -i) for i in range(50, 150)])) == {"inserted": 50, "replaced": 50}
    assert pairs(kept.read()) == sorted((f"k{i}", i if i < 50 else -i) for i in range(150))


def small(spark):
    rows = [(str(i), f"title{i} of word{i}", f"abstract{i} text about word{i} and others.") for i in range(1, 30)]
    kept = papers.split_records(spark.createDataFrame(rows, "pmid string, title string, abstract string"))[0]
    return kept, papers.units(kept)


def test_an_index_is_published_whole_or_not_at_all(spark, tmp_path):
    kept, units = small(spark)
    path = str(tmp_path / "index")
    ranks = store.publish_index(units, kept, path, seed=3)
    assert sorted(r["rank"] for r in ranks.collect()) == [1] * 5
    assert spark.read.parquet(f"{path}/names").count() == units.count() and spark.read.parquet(f"{path}/postings").count() > 0
    with pytest.raises(FileExistsError):
        store.publish_index(units, kept, path, seed=3)
    refused = str(tmp_path / "refused")
    with pytest.raises(ValueError, match="units stored"):
        store.publish_index(units, kept, refused, seed=3, build=lambda u: retrieval.Bm25Index(u.limit(5)))
    with pytest.raises(ValueError, match="do not find"):
        store.publish_index(units, kept, refused, seed=3, build=lambda u: retrieval.Bm25Index(u.withColumn("text", F.lit("nothing of it"))))
    assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_a_stopped_run_goes_on_and_equals_an_unbroken_one(spark, tmp_path):
    rows, path = spark.range(200).select("id", (F.col("id") % 7).alias("v")), str(tmp_path / "run")
    worked = spark.sparkContext.accumulator(0)

    def work(part):
        worked.add(1)
        return part.select("id", (F.col("v") * 2).alias("w"))

    run = store.ResumableRun(rows, "id", work, path, parts=5)
    assert run.go_on(at_most=2) == 3 and run.finished() == [0, 1]
    assert 0 < run.details().count() < 200 and not (tmp_path / "run/result").exists()
    total = lambda d: d.agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    with pytest.raises(ValueError, match="3 parts"):
        run.result(total)

    def broken(part):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        store.ResumableRun(rows, "id", broken, path, parts=5).go_on()
    (tmp_path / "run/details/2").mkdir()  # what a part that broke off has left
    before = worked.value
    again = store.ResumableRun(rows, "id", work, path, parts=5)
    assert again.go_on() == 0 and worked.value == before + 3
    assert pairs(again.result(total)) == pairs(again.result(total)) == pairs(total(work(rows)))
    assert pairs(again.details()) == pairs(work(rows))


def plain_root(rows, fan):
    level = [f"{k}|{v}" for k, v in sorted(rows)]
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) <= 1:
            return level[0] if level else hashlib.sha256(b"").hexdigest()


def test_tree_of_hashes(spark):
    rows = [(f"{i:04d}", f"v{i % 9}") for i in range(300)] + [("0007", "v7")] * 3
    make = lambda r, fan=4: MerkleTree(spark.createDataFrame(r, "id string, value string").repartition(5), "id", "value", fan)
    tree = make(rows)
    assert tree.root() == plain_root(rows, 4) == make(rows[::-1]).root()
    changed = [*rows]
    changed[123] = ("0123", "other")
    other = make(changed)
    assert other.root() == plain_root(changed, 4) != tree.root()
    assert pairs(tree.differing(other).select("row", "other_row")) == [("0123|v6", "0123|other")] and tree.differing(tree).collect() == []
    longer = make([*rows, ("9999", "x")])
    assert pairs(tree.differing(longer).select("row", "other_row")) == [(None, "9999|x")]
    assert make([]).root() == plain_root([], 4) and make(rows[:1]).root() == plain_root(rows[:1], 4)


def test_operations_over_open_records(spark):
    texts = ['[{"ms": 4}, {"error": "timeout", "ms": 10, "more": {"a": 1}}]', '[{"ms": 2.5}, {"error": "timeout", "ms": "slow"}, {"error": "quota"}]', "[]", '{"ms": 1}', None]
    found = reports.operations_summary(spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("attempts")))
    assert sorted(map(tuple, found.collect())) == [("none", 2, 3.25, 4.0), ("quota", 1, None, None), ("timeout", 2, 10.0, 10.0)]
