"""Sinks that survive repeats and crashes: an upsert by key, a gate before publishing, runs that go on where they stopped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrybook.operators import retrieval
from quarrybook.plans.folders import Folder
from quarrybook.plans.names import own_names
from quarrybook.plans.skew import BROADCAST_ROWS
from quarrybook.plans.staging import Staging


class KeyedStore:
    """Rows by key in buckets of files, with numbered versions; a version is what its commit file names.

    An upsert writes the buckets it touches anew, into a folder of its own, and then creates the next commit file,
    which lists the folder of every bucket.  What a crash leaves before that is named by no commit and never read; of two
    writers that start from one version the second fails.  Old versions stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names("commits") if n.endswith(".json")]

    def _commit(self, version: int) -> dict:
        return json.loads(self.folder.read(f"commits/{version:08d}.json")) if version else {"schema": None, "buckets": {}}

    def _rows(self, commit: dict, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows of some buckets, with the bucket in a column of their files' folder."""
        folders = [f"{self.folder.path}/data/{folder}/bucket={b}" for b, folder in commit["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(commit["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], commit["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; of the newest if none is named."""
        known = self.versions()
        if version is None and not known:
            raise ValueError("nothing is stored yet")
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        return self._rows(self._commit(known[-1] if version is None else version))

    def upsert(self, rows: DataFrame, latest: Column | None = None, commit: bool = True) -> dict[str, int]:
        """Insert or replace by key; how many keys were inserted and replaced.  Repeating a call changes no row.

        Of rows with one key in a call the one with the greatest ``latest`` stays (without it, the greatest of all
        columns); rows of null key are an error.  The stored side is scanned once and never shuffled: the
        keys of a group of buckets, counted first, are broadcast to it.
        """
        known = self.versions()
        version = known[-1] if known else 0
        before = self._commit(version)
        staging = Staging(self.spark, "upsert")
        columns, (place, bucket, rank, here) = rows.columns, own_names(rows, "_place", "bucket", "_rank", "_new")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        if before["schema"] not in (None, schema):
            raise ValueError("the columns are other ones than those stored")
        order = F.struct(*([latest.alias(rank)] if latest is not None else []), *columns)
        one = rows.groupBy(self.key).agg(F.max(order).alias(place)).select(*[F.col(f"{place}.{c}").alias(c) for c in columns])
        one = one.withColumn(bucket, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        new = staging.table(one, "new")
        if not new.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError("a row has no key")
        sizes = dict(new.groupBy(bucket).count().collect())  # a row for each bucket
        groups, held = [[]], 0
        for b in sorted(sizes):
            if groups[-1] and held + sizes[b] > BROADCAST_ROWS:
                groups, held = [*groups, []], 0
            groups[-1].append(b)
            held += sizes[b]
        target, replaced = uuid.uuid4().hex, 0
        for group in filter(None, groups):
            fresh = new.where(F.col(bucket).isin(group))
            seen = Observation()
            if before["schema"]:
                kept = self._rows(before, group).join(F.broadcast(fresh.select(self.key, F.lit(True).alias(here))), self.key, "left")
                kept = kept.observe(seen, F.count(here).alias("replaced")).where(F.col(here).isNull()).select(*columns, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(bucket))
                fresh = kept.unionByName(fresh)
            fresh.withColumnRenamed(bucket, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder.path}/data/{target}")
            replaced += seen.get["replaced"] if before["schema"] else 0
        if sizes and commit:
            named = before["buckets"] | {str(b): target for b in sizes}
            self.folder.create(f"commits/{version + 1:08d}.json", json.dumps({"schema": schema, "buckets": named}))
        return {"inserted": sum(sizes.values()) - replaced, "replaced": replaced}


def title_ranks(index: retrieval.Bm25Index, papers: DataFrame, seed: int, n: int = 5, depth: int = 3) -> DataFrame:
    """(query_id, rank): the rank of each sampled paper for its own title within ``depth``, else null."""
    sample = retrieval.title_sample(papers, seed, n)
    return retrieval.own_ranks(index.search(sample, depth), sample)


def publish_index(units: DataFrame, papers: DataFrame, path: str, seed: int, n: int = 5, most_rank: int = 3, build: Callable[[DataFrame], retrieval.Bm25Index] = retrieval.Bm25Index) -> DataFrame:
    """Build an index, audit it, and only then let it appear at ``path``; the ranks of the sampled titles.

    Written beside the place it goes to, then checked: as many units are stored as there are, and every one of
    ``n`` sampled titles finds its own paper among the first ``most_rank``.  A refused index leaves nothing at ``path``,
    an index that is there already is an error.  ``path`` gets ``postings``, ``tiers``, ``names`` and ``stats``.
    """
    spark = units.sparkSession
    place = Folder(spark, path)
    if place.exists():
        raise FileExistsError(f"{path} is there already")
    beside = Folder(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.draft")
    try:
        index = build(units)
        for name, table in (("postings", index.postings), ("tiers", index.tiers), ("names", index.names), ("stats", index.stats)):
            table.write.parquet(f"{beside.path}/{name}")
        expected, stored = units.count(), spark.read.schema(index.names.schema).parquet(f"{beside.path}/names").count()
        if stored != expected:
            raise ValueError(f"{stored} units stored, not {expected}; not published")
        ranks = Staging(spark, "titles").table(title_ranks(index, papers, seed, n, most_rank), "ranks")
        if lost := ranks.where("rank is null").count():
            raise ValueError(f"{lost} sampled titles do not find their own paper; not published")
        parent, name = path.rstrip("/").rsplit("/", 1)
        Folder(spark, parent).rename(beside.path.rsplit("/", 1)[1], name)
        return ranks
    finally:
        if beside.exists():
            beside.delete()


class ResumableRun:
    """A run over parts of its rows that can stop anywhere and go on: finished parts are never worked on again.

    Rows are dealt to parts by the hash of their key.  A part's details are written into its own folder and then marked as
    finished; a part that broke off has no mark and is overwritten.  The aggregate is written once all parts are finished,
    so a stopped run leaves details and no result.  A run over other rows or settings has another name.
    """

    def __init__(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, parts: int = 16):
        self.rows, self.key, self.work, self.parts = rows, key, work, parts
        self.spark, self.folder = rows.sparkSession, Folder(rows.sparkSession, path)

    def finished(self) -> list[int]:
        return [int(n) for n in self.folder.names("finished") if n.isdigit()]

    def go_on(self, at_most: int | None = None) -> int:
        """Work on up to ``at_most`` parts that are not finished (a budget); how many are still open."""
        done = set(self.finished())
        todo = [p for p in range(self.parts) if p not in done]
        for part in todo[:at_most]:
            own = self.rows.where(F.pmod(F.xxhash64(self.key), F.lit(self.parts)) == part)
            self.work(own).write.mode("overwrite").parquet(f"{self.folder.path}/details/{part}")
            self.folder.create(f"finished/{part}", "")
        return max(0, len(todo) - (len(todo) if at_most is None else at_most))

    def details(self) -> DataFrame:
        """The rows of the finished parts."""
        schema = self.work(self.rows.limit(0)).schema
        found = [f"{self.folder.path}/details/{p}" for p in self.finished()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def result(self, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``aggregate`` over the details, written at the first call after the last part; an error before."""
        if open_parts := self.parts - len(self.finished()):
            raise ValueError(f"{open_parts} parts are not finished")
        if not self.folder.exists("result/_SUCCESS"):
            aggregate(self.details()).write.mode("overwrite").parquet(f"{self.folder.path}/result")
        return self.spark.read.parquet(f"{self.folder.path}/result")
