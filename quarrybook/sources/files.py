"""Sources and sinks of papers, questions and results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybook.functions.text import valid_pmid
from quarrybook.plans.merkle import MerkleTree

SCHEMA_VERSION = 1
PAPER = "pmid string, title string, abstract string, journal string, year int, source_status string, retrieved_on date, content_hash string"
STATUSES = ("current", "corrected", "expression_of_concern", "retracted")
SNIPPET = "struct<document:string,begin_section:string,end_section:string,begin:int,end:int,text:string>"


def _demand(df: DataFrame, good: Column, what: str) -> DataFrame:
    """Fail on the first row that breaks a rule, where the row is read."""
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of papers; a malformed line or an invalid value is an error."""
    rows = spark.read.schema(PAPER).option("mode", "FAILFAST").json(path)
    good = valid_pmid(F.col("pmid")) & (F.length("title") > 0) & (F.length("abstract") > 0) & F.col("source_status").isin(*STATUSES) & F.col("content_hash").rlike("^[0-9a-f]{64}$")
    return _demand(rows, good, "invalid paper")


def read_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with an array ``questions``."""
    return spark.read.option("multiLine", True).schema(f"questions array<struct<{schema}>>").json(path).select(F.explode("questions").alias("q")).select("q.*")


def read_split(spark: SparkSession, path: str, split: str, expected: int | None = None) -> DataFrame:
    """JSON lines of benchmark questions of one split, without the split column."""
    rows = spark.read.json(path).where(F.col("split") == split).drop("split")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} questions in split {split}, not {expected}")
    return rows


def read_pmids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from text lines; comments after # and blank lines are skipped, anything else is an error."""
    rows = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("pmid")).where("pmid <> ''")
    return _demand(rows, F.col("pmid").rlike("^[0-9]+$"), "not an id")


def manifest(papers: DataFrame, exclusions: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: counts, reasons, length quantiles and the hash of the ids and contents in order (see plans.merkle); no text."""
    root = MerkleTree(papers, "pmid", "content_hash").root()
    per_paper = papers.select(F.length("abstract").alias("a"))
    spread = F.percentile(F.col("a"), F.array(F.lit(0.5), F.lit(0.95)))
    counted = per_paper.agg(F.count("*").alias("papers"), F.min("a").alias("abstract_min"), F.bround(spread[0]).cast("long").alias("abstract_p50"), F.bround(spread[1]).cast("long").alias("abstract_p95"), F.max("a").alias("abstract_max"), F.lit(root).alias("collection_sha256"))
    reasons = exclusions.agg(F.count("*").alias("excluded"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("not_returned", "no_title", "no_abstract", "title_too_long", "retracted", "duplicate")])
    asked = requested.agg(F.count_distinct("pmid").alias("requested"))
    return asked.crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(reasons))  # one row each


def write_snapshot(papers: DataFrame, exclusions: DataFrame, requested: DataFrame, path: str) -> DataFrame:
    """papers, exclusions and manifest as JSON below ``path``, which must be new; returns the manifest."""
    papers.write.mode("errorifexists").json(f"{path}/papers")
    exclusions.write.mode("errorifexists").json(f"{path}/exclusions")
    found = manifest(papers, exclusions, requested)
    found.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return found


def append_missing(rows: DataFrame, path: str, key: str) -> int:
    """Store rows by key, those that are stored already anew; how many keys were new.  See sources.store.KeyedStore."""
    from quarrybook.sources.store import KeyedStore

    return KeyedStore(rows.sparkSession, path, key).upsert(rows)["inserted"]


def write_benchmark(questions: DataFrame, path: str) -> DataFrame:
    """Questions (id, type, split, body, ...) as JSON lines below a new ``path``, and a manifest without any text: numbers by split and type, the hash of all in order of id."""
    questions.write.mode("errorifexists").json(f"{path}/questions")
    content = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "type", "split", "body"), 256)
    root = MerkleTree(questions.select("id", content.alias("content")), "id", "content").root()
    found = questions.groupBy("split", "type").agg(F.count("*").alias("n")).withColumn("questions_sha256", F.lit(root))
    found.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return found


def write_results(details: DataFrame, aggregates: DataFrame, config: dict[str, str], path: str) -> DataFrame:
    """A run's rows and its aggregates with the hash of its settings, below a new ``path``."""
    named = sorted(config.items())
    digest = F.sha2(F.concat_ws("\n", *[F.lit(f"{k}={v}") for k, v in named]), 256)
    details.write.mode("errorifexists").json(f"{path}/details")
    found = aggregates.withColumn("config_sha256", digest)
    found.coalesce(1).write.mode("errorifexists").json(f"{path}/aggregates")
    return found
