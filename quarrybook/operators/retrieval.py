"""Ranking: BM25 over an inverted index, exact vectors, fusion, evidence."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarrybook.functions.text import tokenize
from quarrybook.plans.skew import BROADCAST_ROWS, group_sizes, join_groups, small_or_shuffled
from quarrybook.plans.staging import Staging

K1, B = 1.5, 0.75
MAX_DEPTH = 50
RRF_K = 60
#: Evidence: papers, and characters of abstract.
MAX_SOURCES, EVIDENCE_CHARS = 5, 16_000
#: Tiers of a term's postings by weight; units of a term with one tier; terms that a search may name one by one; what seeds hold, in multiples of k.
TIERS, RARE, LITERAL_TERMS, SEEDS = 16, 1000, 256, 20
#: A k-th score over this share of the greatest possible one is hoped for; a lower one is found by ranking all tiers at once.
HOPE = 0.7
#: What rounding may take from a bound.
SLACK = 1e-8
#: Files of postings: small pages, as a search reads whole pages; sorted terms as differences instead of a dictionary, which would be read whole.
LAYOUT = {"parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 2000, "parquet.writer.version": "v2", "parquet.enable.dictionary#term": "false"}
#: Queries of one block of a vector search; a block is held by every task.
QUERY_BLOCK = 8192
#: Vectors that cells are learnt from, and cells, at most.
VECTOR_SAMPLE, MOST_CELLS = 16_384, 4096


def check_depth(k: int) -> int:
    if not 1 <= k <= MAX_DEPTH:
        raise ValueError(f"k must be from 1 to {MAX_DEPTH}")
    return k


def top(hits: DataFrame, k: int, keys: list[str], score: Column, tie: str) -> DataFrame:
    """The k best rows of each key with their rank; Spark limits within map tasks before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), tie))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _counted(units: DataFrame) -> DataFrame:
    """``units`` with ``counts``, the distinct terms of the sorted ``terms`` and how often each comes; a unit's terms are counted in its row, without a shuffle."""
    at = F.when(F.size("terms") > 0, F.sequence(F.lit(1), F.size("terms"))).otherwise(F.array().cast("array<int>"))
    # where each run of equal terms begins
    runs = units.withColumn("runs", F.filter(at, lambda i: (i == 1) | (F.element_at("terms", i) != F.element_at("terms", F.greatest(i - 1, F.lit(1))))))
    end = lambda k: F.coalesce(F.get("runs", k + 1), F.size("terms") + 1)
    counts = F.transform("runs", lambda i, k: F.struct(F.element_at("terms", i).alias("term"), (end(k) - i).cast("long").alias("tf")))
    return runs.withColumn("counts", counts).drop("terms", "runs")


def unit_lengths(units: DataFrame) -> DataFrame:
    """(unit_id, dl): the terms of each unit, as the index counts them, without an index."""
    return units.select("unit_id", F.size(tokenize(F.col("text"))).cast("long").alias("dl"))


class Bm25Index:
    """An inverted index in order of its terms, written once, whose postings are read only where a search needs them.

    ``names`` (unit, unit_id, pmid, idx, dl) number the units in order of their papers' ids; a unit's number less its place
    in the paper is the paper's.  ``postings`` (term, tier, unit, idx, tf, dl) are range-partitioned and sorted by term
    and tier, in small pages with the least and the greatest term of each, so that a filter on terms skips
    the rest of the files.  A tier holds the postings of a term with about equal weight, the heaviest first; rare terms have one
    tier.  ``tiers`` (term, tier, idf, most, n) has the greatest weight of each.  ``stats`` are two numbers.
    A paper that comes twice is an error.
    """

    def __init__(self, units: DataFrame, k1: float = K1, b: float = B):
        spark = units.sparkSession
        self.staging, self.k1, self.b = Staging(spark, "bm25"), k1, b
        # a paper's units stay together, as partitions are ranges of papers; texts are read into terms behind the shuffle, once
        dealt = units.select("pmid", "idx", "unit_id", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "pmid")
        laid = dealt.sortWithinPartitions("pmid", "idx").withColumn("unit", F.monotonically_increasing_id())
        terms = laid.select("unit", "unit_id", "pmid", "idx", F.array_sort(tokenize(F.col("text"))).alias("terms")).withColumn("dl", F.size("terms").cast("long"))
        sized = self.staging.table(_counted(terms), "sized")
        self.names = self.staging.table(sized.select("unit", "unit_id", "pmid", "idx", "dl"), "names")
        repeated = self.names.groupBy("unit_id").agg(F.count("*").alias("n"), F.first("pmid").alias("pmid")).where("n > 1").select("pmid").limit(1).collect()
        if repeated:
            raise ValueError(f"paper {repeated[0]['pmid']} is indexed twice")
        self.stats = self.staging.table(self.names.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")), "stats")
        n, self.avgdl = self.stats.first()
        counted = sized.select("unit", "idx", "dl", F.explode("counts").alias("c")).select("c.term", "unit", "idx", "c.tf", "dl")
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        sizes = {"common": F.count_if(F.col("df") > RARE), **group_sizes("df")}
        dfs, seen = self.staging.measured(counted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf), "dfs", **sizes)
        # only common terms have tiers, and few terms are common, so postings are shuffled once, into their order
        common = dfs.where(F.col("df") > RARE).select("term", "df")
        marked = counted.join(F.broadcast(common), "term", "left") if seen["common"] <= BROADCAST_ROWS else join_groups(counted, common, ["term"], "df", sizes=seen)
        share = F.col("tf") / (F.col("tf") + self._norm())
        tier = F.when(F.col("df").isNull(), 0).otherwise(F.floor((1 - share) * TIERS)).cast("int")
        tiered = marked.select("term", tier.alias("tier"), "unit", "idx", "tf", "dl")
        order, path = ["term", "tier", "unit"], f"{self.staging.root}/postings"
        written = tiered.repartitionByRange(*order).sortWithinPartitions(*order)
        written.write.options(**LAYOUT).parquet(path)
        self.postings = spark.read.schema(tiered.schema).parquet(path)
        most = self.postings.groupBy("term", "tier").agg(F.max(self._saturation()).alias("most"), F.count("*").alias("n"))
        tiers = most.join(dfs.select("term", "idf"), "term").select("term", "tier", "idf", (F.col("idf") * F.col("most")).alias("most"), "n")
        path = f"{self.staging.root}/tiers"
        tiers.repartitionByRange("term").sortWithinPartitions("term").write.options(**LAYOUT).parquet(path)
        self.tiers = spark.read.schema(tiers.schema).parquet(path)
        self.staging.drop("sized", "dfs")

    def _norm(self) -> Column:
        return F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(self.avgdl or 1.0))

    def _saturation(self) -> Column:
        return F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + self._norm())

    def _weight(self) -> Column:
        """A posting's part of a score."""
        return F.col("idf") * F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + self._norm())

    @staticmethod
    def _only(table: DataFrame, terms: list[str] | None) -> DataFrame:
        """``table`` filtered by literal terms, which reach the scan one by one; by nothing where there are too many."""
        return table if terms is None else table.where(reduce(or_, [F.col("term") == t for t in terms], F.lit(False)))

    def search(self, queries: DataFrame, k: int = 10, method: str = "bm25") -> DataFrame:
        """query_id, method, rank, pmid, unit_id, score for (query_id, text); a query's terms count once.

        Scores are rounded to nine places before ranking, so that the order of summation cannot change a rank.  A paper's score
        is that of its best unit.  The heaviest tiers give a score that the k-th best paper has at least; a tier is left
        out if even a unit with the greatest weights of all other terms could not reach it through that tier.
        """
        check_depth(k)
        asked = self.staging.table(queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")), f"asked-{uuid.uuid4().hex[:8]}")
        some = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        terms = some if len(some) <= LITERAL_TERMS else None
        n_asked = asked.count()
        by_term, by_query = Window.partitionBy("query_id", "term"), Window.partitionBy("query_id")
        met = self._only(self.tiers, terms).join(small_or_shuffled(asked, n_asked), "term")
        met = met.withColumns({"above": F.coalesce(F.sum("n").over(by_term.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "greatest": F.max("most").over(by_term)})
        total = F.sum(F.when(F.col("above") == 0, F.col("greatest"))).over(by_query)
        met = self.staging.table(met.select("query_id", "term", "tier", "idf", "n", "above", "greatest", "most", total.alias("total")).withColumn("bound", F.col("total") - F.col("greatest") + F.col("most")), f"met-{uuid.uuid4().hex[:8]}")
        postings = self._only(self.postings, terms)

        def ranked(tiers: DataFrame) -> DataFrame:
            found = postings.join(small_or_shuffled(tiers.select("query_id", "term", "tier", "idf"), n_asked * TIERS), ["term", "tier"])
            units = found.groupBy("query_id", "unit", "idx").agg(F.round(F.sum(self._weight()), 9).alias("score"))
            best = units.groupBy("query_id", (F.col("unit") - F.col("idx")).alias("paper")).agg(F.max(F.struct("score", (-F.col("idx")).alias("first"), "unit")).alias("best"))
            return top(best, k, ["query_id"], F.col("best.score"), "paper")

        # seeds are ranked first only for queries of few terms, where a tier can fall short of the k-th score
        short = met.where((F.col("above") >= SEEDS * k) & (F.col("bound") < HOPE * F.col("total"))).select("query_id").distinct()
        kept = met
        if not short.isEmpty():
            seeds = met.where(F.col("above") < SEEDS * k).join(short, "query_id", "left_semi")
            least = self.staging.table(ranked(seeds).where(F.col("rank") == k).select("query_id", F.col("best.score").alias("least")), f"least-{uuid.uuid4().hex[:8]}")  # a row for each query
            kept = met.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).drop("least")
            kept = self.staging.table(kept, f"kept-{uuid.uuid4().hex[:8]}")
        hits = self.staging.table(ranked(kept).select("query_id", "rank", "best.unit", "best.score"), f"hits-{uuid.uuid4().hex[:8]}")
        named = self.names.select("unit", "pmid", "unit_id").join(small_or_shuffled(hits, n_asked * k), "unit")
        return named.select("query_id", F.lit(method).alias("method"), "rank", "pmid", "unit_id", "score")


class _Best:
    """The best ``keep`` rows of each query so far, by score, then unit_id; held over all batches of a task."""

    def __init__(self, n_queries: int, keep: int):
        self.keep, self.least = keep, np.full(n_queries, -np.inf)
        self.rows: list[pd.DataFrame] = []
        self.held, self.most = 0, 2 * n_queries * keep

    def add(self, units: np.ndarray, pmids: np.ndarray, scores: np.ndarray, queries: np.ndarray) -> None:
        """Scores of units, in order of unit_id, for some of the queries."""
        keep = self.keep
        cut = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep] if len(scores) > keep else np.full(len(queries), -np.inf)
        good = scores >= np.maximum(cut, self.least[queries])
        for column in np.nonzero(good.sum(axis=0) > keep)[0]:  # ties at the cut: the first units
            good[:, column] = False
            good[np.argsort(-scores[:, column], kind="stable")[:keep], column] = True
        row, column = np.nonzero(good)
        self.rows.append(pd.DataFrame({"query": queries[column], "unit_id": units[row], "pmid": pmids[row], "score": scores[row, column]}))
        self.held += len(row)
        if self.held > self.most:
            self.reduce()

    def reduce(self) -> pd.DataFrame:
        every = pd.concat(self.rows) if self.rows else pd.DataFrame({"query": [], "unit_id": [], "pmid": [], "score": []})
        best = every.sort_values(["query", "score", "unit_id"], ascending=[True, False, True]).groupby("query").head(self.keep)
        full = best.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.keep]
        self.least[full.index.to_numpy(np.int64)] = full["min"].to_numpy()
        self.rows, self.held = [best], len(best)
        return best


def _block_scores(frames: Iterator[pd.DataFrame], shared, keep: int) -> Iterator[pd.DataFrame]:
    ids, matrix, asking = shared.value  # asking: the queries of each cell; None: all queries ask all rows
    best = _Best(len(ids), keep)
    for frame in frames:
        for cell, rows in [(None, frame)] if asking is None else frame.groupby("cell"):
            queries = np.arange(len(ids)) if asking is None else asking.get(int(cell), ())
            if len(rows) and len(queries):
                rows = rows.sort_values("unit_id")
                scores = np.round(np.stack(rows["vector"].to_numpy()).astype(np.float64) @ matrix[queries].T, 9)
                best.add(rows["unit_id"].to_numpy(), rows["pmid"].to_numpy(), scores, np.asarray(queries))
    found = best.reduce()
    if len(found):  # a task without rows yields none: its columns would have no type
        yield pd.DataFrame({"query_id": ids[found["query"].to_numpy(np.int64)], "unit_id": found["unit_id"], "pmid": found["pmid"], "score": found["score"]})


def _searched(base: DataFrame, queries: DataFrame, k: int, method: str, ask: Callable[[np.ndarray], dict[int, np.ndarray] | None]) -> DataFrame:
    """Ranks of ``queries`` in ``base``, whose rows are scored for the queries that ``ask`` names for their cell."""
    check_depth(k)
    spark, depth = base.sparkSession, min(3 * k, 150)
    id_type = queries.schema["query_id"].dataType.simpleString()
    n_blocks = -(-queries.count() // QUERY_BLOCK)
    found = spark.createDataFrame([], f"query_id {id_type}, unit_id string, pmid string, score double")
    for block in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).select("query_id", "vector").toPandas()
        if not len(rows):
            continue
        matrix = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        asking = ask(matrix)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), matrix, asking))
        near = base if asking is None else base.where(F.col("cell").isin(sorted(asking)))
        part = near.mapInPandas(lambda frames, s=shared: _block_scores(frames, s, depth), found.schema)
        found = part if n_blocks == 1 else found.unionByName(part)
    near = top(found, depth, ["query_id"], F.col("score"), "unit_id").drop("rank")
    best = near.groupBy("query_id", "pmid").agg(F.max("score").alias("score"), F.max_by("unit_id", F.struct("score", "unit_id")).alias("unit_id"))
    return top(best, k, ["query_id"], F.col("score"), "pmid").select("query_id", F.lit(method).alias("method"), "rank", "pmid", "unit_id", "score")


def vector_search(base: DataFrame, queries: DataFrame, k: int = 10, method: str = "vector") -> DataFrame:
    """Exact search by dot product of (query_id, vector) in (unit_id, pmid, vector).

    The best min(3k, 150) units are found, then each paper's best; ranks go by
    score, then pmid.  Queries are taken in blocks of ``QUERY_BLOCK``: each block
    is one matrix that every task multiplies with its rows of the base, and
    a task hands on its own best rows alone.
    """
    return _searched(base.select("unit_id", "pmid", "vector"), queries, k, method, lambda matrix: None)


def learnt_cells(sample: np.ndarray, n_cells: int, rounds: int = 12) -> np.ndarray:
    """Unit vectors in the middle of ``n_cells`` cells of ``sample`` (k-means by angle); the first rows are the first middles, an empty cell keeps its own."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    middles = unit[:n_cells].copy()
    for _ in range(rounds):
        nearest = np.argmax(unit @ middles.T, axis=1)
        sums = np.zeros_like(middles)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        middles = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), middles)
    return middles


def neighbour_depths(sample: np.ndarray, middles: np.ndarray, asked: int = 500, k: int = 10) -> np.ndarray:
    """For the ``k`` nearest neighbours within ``sample`` of its last ``asked`` rows: how many cells are nearer to the row than the neighbour's."""
    cell, queries = np.argmax(sample @ middles.T, axis=1), np.arange(max(0, len(sample) - asked), len(sample))
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[queries] @ middles.T), axis=1), axis=1)
    return np.take_along_axis(place, cell[near], axis=1).ravel()


def _celled(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
            yield frame.assign(cell=np.argmax(vectors @ shared.value.T, axis=1).astype(np.int32))


class VectorIndex:
    """Vectors (unit_id, pmid, vector) of about unit length by learnt cells, so that a search reads the cells near a query.

    Middles of cells are learnt from the ``sample`` rows with the least hash of their id; every row is then put into
    the cell of its nearest middle.  Rows are range-partitioned by cell and unit_id, so a large cell is spread, and lie in order of cells
    in small pages: a filter on cells skips the rest.
    """

    def __init__(self, base: DataFrame, cells: int | None = None, sample: int = VECTOR_SAMPLE):
        spark, self.staging = base.sparkSession, Staging(base.sparkSession, "vectors")
        self.cells = cells or max(1, min(MOST_CELLS, round(base.count() ** 0.5)))
        drawn = base.orderBy(F.xxhash64("unit_id"), "unit_id").select("vector").limit(max(sample, self.cells)).toPandas()["vector"]
        if len(drawn):
            vectors = np.stack(drawn.to_numpy()).astype(np.float64)
            self.middles = learnt_cells(vectors, self.cells)
            self.depths = neighbour_depths(vectors, self.middles)
        else:
            self.middles, self.depths = None, np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast(self.middles)
        rows = base.select("unit_id", "pmid", "vector")
        schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
        put = self.staging.table(rows.mapInPandas(lambda frames: _celled(frames, shared), schema), "celled")
        path = f"{self.staging.root}/cells"
        put.repartitionByRange("cell", "unit_id").sortWithinPartitions("cell", "unit_id").write.options(**{"parquet.page.size": 64 << 10, "parquet.page.row.count.limit": 500}).parquet(path)
        self.staging.drop("celled")
        self.rows = spark.read.schema(schema).parquet(path)

    def probes_for(self, recall: float) -> int:
        """Cells to read so that, among the sampled rows, this share of the ten nearest neighbours lies in them."""
        return int(np.quantile(self.depths, recall, method="higher")) + 1 if len(self.depths) else 1

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, method: str = "vector") -> DataFrame:
        """As :func:`vector_search`, scored exactly within the ``probes`` cells nearest to each query; exact over all rows without ``probes``."""
        middles = self.middles

        def ask(matrix: np.ndarray) -> dict[int, np.ndarray]:
            if middles is None:
                return {}
            near = np.argsort(-(matrix @ middles.T), axis=1, kind="stable")[:, :probes]
            return {int(cell): np.nonzero((near == cell).any(axis=1))[0] for cell in np.unique(near)}

        return _searched(self.rows, queries, k, method, ask if probes else lambda matrix: None)


def fuse(rankings: list[DataFrame], k: int = 10, rrf_k: int = RRF_K, depth: int = MAX_DEPTH, method: str = "hybrid") -> DataFrame:
    """Reciprocal rank fusion; the unit is that of the better rank, of the earlier ranking in a tie."""
    if len(rankings) < 2:
        raise ValueError("fusion needs at least two rankings")
    both = None
    for order, hits in enumerate(rankings):
        part = hits.where(F.col("rank") <= depth).select("query_id", "pmid", "unit_id", "rank", F.lit(order).alias("order"))
        both = part if both is None else both.unionByName(part)
    score = F.round(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))), 9)
    fused = both.groupBy("query_id", "pmid").agg(score.alias("score"), F.min_by("unit_id", F.struct("rank", "order")).alias("unit_id"))
    return top(fused, k, ["query_id"], F.col("score"), "pmid").select("query_id", F.lit(method).alias("method"), "rank", "pmid", "unit_id", "score")


def select_evidence(hits: DataFrame, papers: DataFrame, units: DataFrame, most: int = MAX_SOURCES, budget: int = EVIDENCE_CHARS) -> DataFrame:
    """query_id, label, pmid, unit_id, n_chars: papers in rank order until one exceeds the budget.

    Hits without a paper are skipped.  The first paper always stays; the first
    overflow ends the list, even if a later paper would fit.
    """
    length = units.select("unit_id", (F.col("end") - F.col("start")).alias("n_chars"))
    known = hits.join(papers.select("pmid"), "pmid", "left_semi").join(length, "unit_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    counted = known.withColumn("place", F.row_number().over(w).cast("long")).withColumn("used", F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.when((F.col("place") > 1) & (F.col("used") > budget), F.col("place"))
    cut = counted.withColumn("stop", F.min(over).over(Window.partitionBy("query_id")))
    shown = cut.where((F.col("place") <= most) & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))))
    return shown.select("query_id", F.concat(F.lit("S"), F.col("place").cast("string")).alias("label"), "pmid", "unit_id", "n_chars")


def relevant_papers(papers: DataFrame, questions: DataFrame, run: int = 8) -> DataFrame:
    """(query_id, pmid): papers (pmid, terms) that have ``run`` terms in a row in common with a question (query_id, terms).

    Runs are compared by hash, then those few that agree by their terms.
    """
    def runs(df: DataFrame, key: str) -> DataFrame:
        hashed = F.transform(F.sequence(F.lit(1), F.size("terms") - run + 1), lambda i: F.xxhash64(F.slice("terms", i, run)))
        return df.where(F.size("terms") >= run).select(key, F.posexplode(hashed).alias("at", "h"))

    asked = runs(questions, "query_id").withColumnRenamed("at", "asked_at")
    met = runs(papers, "pmid").join(small_or_shuffled(asked, asked.count()), "h").groupBy("query_id", "pmid", "h").agg(F.first("at").alias("at"), F.first("asked_at").alias("asked_at"))
    beside = met.join(papers.select("pmid", F.col("terms").alias("p")), "pmid").join(questions.select("query_id", F.col("terms").alias("q")), "query_id")
    return beside.where(F.slice("p", F.col("at") + 1, run) == F.slice("q", F.col("asked_at") + 1, run)).select("query_id", "pmid").distinct()


def title_sample(papers: DataFrame, seed: int, n: int = 5) -> DataFrame:
    """(query_id, text): ``n`` papers in seeded order, asked for by their own titles; see ``sources.store.publish_index``."""
    return papers.select(F.col("pmid").alias("query_id"), F.col("title").alias("text")).orderBy(F.sha2(F.concat_ws("/", F.lit(str(seed)), "pmid"), 256)).limit(n)


def own_ranks(hits: DataFrame, sample: DataFrame) -> DataFrame:
    """(query_id, rank): where each sampled paper is in the hits for its own title; null if it is not."""
    own = hits.where(F.col("pmid") == F.col("query_id")).select("query_id", "rank")
    return sample.select("query_id").join(own, "query_id", "left")
