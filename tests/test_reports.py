"""Hand-computed cases of reports, targets and run files, and their registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_core import duck, rows, test_query_equals_sql as same_as_sql  # noqa: F401

from quarrybook import report_queries  # noqa: F401
from quarrybook.operators import ingest, metrics, papers, reports
from quarrybook.queries import ORACLES
from quarrybook.sources import files

QUERIES = "method_report quality_targets question_gate reference_states collection_summary attempt_ceilings fixture_cases citation_order question_documents id_lists snapshot_files benchmark_files result_files unit_records bootstrap_interval recall_ceiling paired_wins".split()


@pytest.mark.parametrize("name", QUERIES)
def test_report_equals_sql(spark, duck, name):  # noqa: F811
    same_as_sql(spark, duck, name)


def test_recall_ceiling(spark):
    relevant = spark.createDataFrame([(q, str(p)) for q, n in ((1, 1), (2, 4), (3, 20), (4, 12)) for p in range(n)], "query_id long, pmid string")
    scores = spark.createDataFrame([(1, "m", 1, 1.0), (2, "m", 4, 0.5), (3, "m", 20, 0.25), (4, "m", 0, None)], "query_id long, method string, n_relevant long, recall_at_10 double")
    # ceilings 1, 1 and a half; the upper median of 1, 4, 12, 20 is 12
    assert rows(metrics.recall_ceiling(scores, relevant)) == [("m", pytest.approx((1 + 0.5 + 0.5) / 3), pytest.approx(2.5 / 3), 1, 12, 20, 2)]


def test_latency_beside_a_summary(spark):
    times = spark.createDataFrame([("a", 1.26), ("a", 3.0), ("a", None)], "method string, ms double")
    got = metrics.with_latency(spark.createDataFrame([("a",), ("b",)], "method string"), times, "ms", "method").orderBy("method")
    assert rows(got) == [("a", 2.1, 3.0, 3.0), ("b", None, None, None)]


def test_targets(spark):
    values = spark.createDataFrame([("x", "f1", 0.3), ("y", "f1", 0.2), ("x", "late", 50.0), ("x", "rate", None), ("x", "free", 1.0)], "model string, metric string, value double")
    targets = spark.createDataFrame([("f1", 0.25, None), ("late", None, 45.0), ("rate", 0.1, None), ("absent", 0.1, 0.2)], "metric string, least double, most double")
    got = {(r["model"], r["metric"]): r["met"] for r in metrics.check_targets(values, targets).collect()}
    assert {(m, k): v for (m, k), v in got.items() if m} == {("x", "f1"): True, ("y", "f1"): False, ("x", "late"): False, ("x", "rate"): False}
    assert list(got.values()).count(False) == 4 and len(got) == 5


def test_targets_of_absent_metrics_keep_their_name(spark):
    values = spark.createDataFrame([], "model string, metric string, value double")
    targets = spark.createDataFrame([("f1", 0.25, None)], "metric string, least double, most double")
    assert rows(metrics.check_targets(values, targets)) == [(None, "f1", None, 0.25, None, False)]


def test_question_gate(spark):
    q = [(["a"], ["http://x/1/", "http://x/2"], ["s"]), (["a"], ["http://x/2/"], ["s"]), ([], ["http://x/3"], ["s"]), (None, None, None)]
    asked = spark.createDataFrame(q, "exact_answer array<string>, documents array<string>, snippets array<string>")
    assert reports.question_gate(asked, 2).first().asDict() == {"n": 4, "fully_eligible": 2, "mean_documents": 1.5, "distinct_papers": 3, "enough": True}
    assert reports.question_gate(asked.limit(0)).first().asDict() == {"n": 0, "fully_eligible": 0, "mean_documents": None, "distinct_papers": 0, "enough": False}


def test_coverage(spark):
    reference = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3"), (2, "1")], "query_id long, pmid string")
    kept = spark.createDataFrame([("1",), ("1",)], "pmid string")
    dropped = spark.createDataFrame([("2", "no_title"), ("2", "no_title")], "pmid string, reason string")
    states = reports.reference_states(reference, kept, dropped)
    assert sorted(rows(states)) == [(1, "1", "in_collection"), (1, "2", "no_title"), (1, "3", "not_requested"), (2, "1", "in_collection")]
    assert sorted(rows(reports.coverage(states, "query_id"))) == [(1, 3, 1, 2), (2, 1, 1, 0)]
    texts = spark.createDataFrame([("ab", "cdefg"), ("a", "bcd")], "title string, abstract string")
    assert reports.collection_size(texts, 7).first().asDict() == {"papers": 2, "searchable_chars": 13, "over_limit": 1, "tokens_at_4": 3, "tokens_at_3": 4}
    assert reports.collection_size(texts.limit(0), 7).first()["tokens_at_3"] == 0


def test_fixtures_citations_and_ceilings(spark):
    case = "id string, outcome string, items array<string>, calls int, want_outcome array<string>, not_outcome string, items_include array<string>, items_exclude array<string>, want_calls int"
    got = reports.fixture_failures(spark.createDataFrame([
        ("good", "answered", ["Zinc oxide"], 1, ["answered"], "refused", ["ZINC"], ["iron"], 1), ("any", "answered", [], 3, None, None, [], [], None),
        ("bad", "refused", ["iron ore"], 2, ["answered"], "refused", ["zinc"], ["Iron"], 1),
    ], case))
    assert rows(got) == [("bad", ["outcome", "forbidden outcome", "missing item", "forbidden item", "calls"])]
    r = spark.range(1).select(reports.citation_numbers(F.array(F.lit("c"), F.lit("x"), F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("n"), reports.attempt_ceiling(F.lit(7), F.lit(10), 4).alias("a"), reports.attempt_ceiling(F.lit(7), F.lit(2), 4).alias("b")).first()
    assert (list(r["n"]), r["a"], r["b"]) == ([3, 1], 13, 7)


def test_files_and_records(spark, tmp_path):
    units = spark.createDataFrame([("9#1", "9", "text")], "unit_id string, pmid string, text string")
    assert rows(papers.store_records(units, "c", 3)) == [("c.u3", "9#1", "9", "text")]
    stored = spark.createDataFrame([("b",)], "pmid string")
    left = ingest.to_fetch(spark.createDataFrame([(1, "a"), (2, "b")], "place int, pmid string"), stored)
    assert left.columns == ["place", "pmid"] and rows(left) == [(1, "a")]
    asked = spark.createDataFrame([("q1", "fact", "test", "What?"), ("q2", "list", "test", None)], "id string, type string, split string, body string")
    first, other = files.write_benchmark(asked, f"{tmp_path}/a").collect(), files.write_benchmark(asked.limit(1), f"{tmp_path}/b").collect()
    assert len(first) == 2 and len({r["questions_sha256"] for r in [*first, *other]}) == 2
    with pytest.raises(Exception, match="exist"):
        files.write_benchmark(asked, f"{tmp_path}/a")
    (tmp_path / "ids.txt").write_text("12 # one\n\n# remark\nx3\n")
    with pytest.raises(Exception, match="not an id"):
        files.read_pmids(spark, f"{tmp_path}/ids.txt").collect()


def test_fixture_items_keep_letters_without_one_capital(spark, tmp_path):
    turns = [(1, 0, "user", "Was heißt enßver?"), (1, 1, "assistant", "Enß heißt nichts, so lang der Satz auch wird."), (2, 0, "user", "Wer?"), (2, 1, "assistant", "Öde wer")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["fixture_cases"]).fetchall())
    assert rows(report_queries.fixture_cases(spark, str(tmp_path)).orderBy("conv_id")) == want
    assert want[0] == (1, 1, "forbidden item")
