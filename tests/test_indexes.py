"""Indexes that read only a part: the inverted index in order of terms, and vectors by learnt cells."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrybook import queries
from quarrybook.functions import text as T
from quarrybook.operators import papers, retrieval

SF = "/root/testdata/sf0.1"


def hits(df):
    return sorted((r["query_id"], r["rank"], r["pmid"], r["unit_id"], r["score"]) for r in df.collect())


def made_units(spark):
    rnd = random.Random(3)
    words = [f"w{i}x" for i in range(60)]
    texts = [" ".join(rnd.choices(words[: 2 + i % 59], weights=[1 / (j + 1) for j in range(2 + i % 59)], k=rnd.randint(1, 60))) for i in range(600)]
    rows = [(f"{i // 2}#{i % 2}" if i % 2 else str(i // 2), str(i // 2), i % 2, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "unit_id string, pmid string, idx long, text string").repartition(5), words


def test_tiers_that_are_left_out_change_no_rank(spark, monkeypatch):
    units, words = made_units(spark)
    monkeypatch.setattr(retrieval, "RARE", 5)
    index = retrieval.Bm25Index(units)
    rnd = random.Random(7)
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(words[:20], k=1 + i % 4))) for i in range(24)] + [(90, "unheard of"), (91, ""), (92, None)], "query_id long, text string")
    monkeypatch.setattr(retrieval, "HOPE", 0.0)
    every = hits(index.search(asked, 5))
    monkeypatch.setattr(retrieval, "HOPE", 2.0)
    monkeypatch.setattr(retrieval, "SEEDS", 1)
    assert hits(index.search(asked, 5)) == every and {q for q, *_ in every} == set(range(24))
    fs = index.staging
    size = lambda name: max((spark.read.parquet(f"{fs.root}/{d}").agg(F.sum("n")).first()[0] for d in os.listdir(fs.root.removeprefix("file:")) if d.startswith(name)), default=0)
    assert 0 < size("kept") < size("met")  # some tiers could not reach the fifth score
    monkeypatch.setattr(retrieval, "LITERAL_TERMS", 2)
    assert hits(index.search(asked, 5)) == every
    assert index.search(asked.limit(0), 5).collect() == []


def test_a_short_question_reads_under_a_tenth_of_the_index(spark):
    # each page of each column is a read of 16 KB at least from checked local files, so long questions read more of this small index
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    index = queries._index(spark, SF)
    asked = spark.createDataFrame([(1, "Ertion haen")], "query_id long, text string")
    plain = spark.sparkContext._jsc.hadoopConfiguration()
    plain.set("parquet.hadoop.vectored.io.enabled", "false")  # whose reads are not counted
    count = lambda: spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead")
    try:
        before = count()
        wanted = "|".join(retrieval.Bm25Index._only(index.postings, ["ertion", "haen"]).agg(F.min("term"), F.max("term")).first())
        assert wanted == "ertion|haen" and (narrow := count() - before)
        before = count()
        found = index.search(asked, 10).collect()
        used = count() - before
    finally:
        plain.unset("parquet.hadoop.vectored.io.enabled")
    folder = index.staging.root.removeprefix("file:")
    whole = sum(os.path.getsize(os.path.join(d, f)) for name in ("postings", "tiers") for d, _, files in os.walk(f"{folder}/{name}") for f in files)
    assert len(found) == 10 and narrow < whole / 10 and used < whole / 6  # the search also reads the terms' tiers and the hits' names


def test_vector_cells_reach_their_recall(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    index, asked = queries._vector_index(spark, SF), queries._every_20th(spark, SF)
    exact = retrieval.vector_search(queries._vectors(spark, SF), asked, 10)
    assert hits(index.search(asked, 10)) == hits(exact)
    near = index.search(asked, 10, probes=index.probes_for(0.95))
    pairs = lambda df: {(r["query_id"], r["pmid"]) for r in df.collect()}
    assert len(pairs(near) & pairs(exact)) >= 0.9 * exact.count()
    assert index.probes_for(0.95) < index.cells


def test_cells_of_clustered_vectors_and_ties(spark):
    rnd = np.random.default_rng(2)
    middles = rnd.normal(size=(20, 16))
    rows = middles[np.arange(2000) % 20] + 0.05 * rnd.normal(size=(2000, 16))
    rows[:300] = rows[0]  # a large group of copies
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    base = spark.createDataFrame([(str(i), str(i), [float(x) for x in v]) for i, v in enumerate(rows)], "unit_id string, pmid string, vector array<float>").repartition(6)
    asked = base.where("cast(unit_id as int) % 50 = 0").select(F.col("unit_id").cast("long").alias("query_id"), "vector")
    index = retrieval.VectorIndex(base, cells=30)
    assert index.probes_for(0.95) <= 4
    exact = hits(retrieval.vector_search(base, asked, 5))
    near = hits(index.search(asked, 5, probes=index.probes_for(0.95)))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)
    assert [r[2] for r in exact if r[0] == 0] == ["0", "1", "10", "100", "101"]  # of equal scores the least ids
    few = retrieval.VectorIndex(base.limit(3))
    assert len(hits(few.search(asked.limit(2), 5, probes=1))) > 0
    assert retrieval.VectorIndex(base.limit(0)).search(asked, 5, probes=1).collect() == []


def test_vector_search_over_tasks_without_rows(spark, tmp_path):
    rows = [(str(i), str(i), [float(i % 7), float(i % 5)]) for i in range(2000)]
    base = spark.createDataFrame(rows, "unit_id string, pmid string, vector array<float>")
    path = str(tmp_path / "base")
    base.coalesce(1).write.parquet(path)  # one row group: one of the tasks that share the file gets all rows
    asked = base.where("unit_id in ('3', '9')").select(F.col("unit_id").cast("long").alias("query_id"), "vector")
    want = hits(retrieval.vector_search(base.coalesce(1), asked, 5))
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "64"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        split = spark.read.parquet(path)
        assert split.rdd.getNumPartitions() > 1
        assert hits(retrieval.vector_search(split, asked, 5)) == want and len(want) == 10
    finally:
        for name in names:
            spark.conf.unset(name)


def test_terms_are_counted_in_their_units(spark):
    texts = {"1": ("a title", "beta beta alpha gamma beta"), "2": ("x", "alpha"), "3": ("...", "...")}
    kept = spark.createDataFrame([(p, t, a) for p, (t, a) in texts.items()], "pmid string, title string, abstract string")
    rows = papers.units(kept)
    index = retrieval.Bm25Index(rows)
    want = {(p, term, terms.count(term), len(terms)) for p, terms in ((p, spark.range(1).select(T.tokenize(F.lit(f"{t}\n{a}"))).first()[0]) for p, (t, a) in texts.items()) for term in set(terms)}
    got = index.postings.join(index.names.select("unit", "pmid"), "unit").select("pmid", "term", "tf", "dl")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and ("1", "beta", 3) in {w[:3] for w in want}
    lengths = {r["unit_id"]: r["dl"] for r in retrieval.unit_lengths(rows).collect()}
    assert lengths == {r["unit_id"]: r["dl"] for r in index.names.collect()} and lengths["3"] == 0


def test_lengths_need_no_index(spark, monkeypatch):
    def no_index(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(queries, "_index", no_index)
    got = queries.doc_lengths(spark, "/root/testdata/sf0.001")
    assert got.columns == ["unit_id", "dl"] and got.count() > 0
