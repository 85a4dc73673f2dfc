"""Hand-computed cases of the core operators, and the registered queries against DuckDB on the smallest tables."""

import hashlib
import hmac
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrybook import queries, record_queries
from quarrybook.functions import text as T
from quarrybook.functions import tokens as K
from quarrybook.operators import curation, ingest, limits, metrics, papers, retrieval, validation
from quarrybook.plans.components import connected_components
from quarrybook.plans.prefix import running_total
from quarrybook.plans.staging import Staging
from quarrybook.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "lineitem part events documents embeddings pages benchmark labels conversations".split()
#: Cheap queries that cover every module; the driver runs all of them.
SAMPLE = "tokenize_terms units_passages bm25_topk vector_knn rrf_hybrid evidence_select recall_mrr miss_depth list_f1 question_groups eligibility_reasons quota_split collection_expand schema_gate request_key_replay rolling_pacer snapshot_manifest batches_of_n stream_hourly_admission signed_tokens answer_normalize history_last latency_summary article_records article_exclusions article_links stored_responses paper_files summary_by_kind followup_turns request_checks cached_completions".split()


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_tokenizer(spark):
    got = one(spark, t=T.tokenize(F.lit("The IL-6 of TNF-α, and/or it_is X/ray a-an 3.5")))["t"]
    assert got == ["il6", "il", "6", "tnfα", "tnf", "α", "andor", "x", "ray", "xray"][:6] + ["andor", "xray", "x", "ray", "aan", "3", "5"]


def test_text_functions(spark):
    r = one(
        spark, a=T.squash(F.lit("  a \n b\x1c ")), b=T.normalize_answer(F.lit("The  TNF-α_(x)!")), c=T.normalize_answer(F.lit("Straße ﬁ")),
        d=T.pmid_from_url(F.lit("http://www.ncbi.nlm.nih.gov/pubmed/123/")), e=T.pmid_from_url(F.lit("https://pubmed.ncbi.nlm.nih.gov/123/x")),
        f=T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), g=T.display_text(F.lit("Kinases [S2; S3] act")), h=T.strip_fence(F.lit("```json\n{}\n```")), i=T.nfc(F.lit("é")),
    )
    assert tuple(r) == ("a b", "tnf alpha x", "strasse fi", "123", None, 0.0, "Kinases act", "{}", "é")


def test_tokens(spark):
    key = K.derived_key("s" * 40, "x")
    message = "ünï" * 50
    r = one(spark, a=K.hmac_sha256(F.lit(message), key), b=K.unb64url(K.b64url(F.lit("ab?>").cast("binary"))).cast("string"), c=K.client_key(F.lit("1.2.3.4"), F.lit("2024-01-02 23:59:59").cast("timestamp"), "salt"), d=K.fingerprint(F.lit('{"b":1,"a":"ü"}')), e=K.client_address(F.lit(" 9.9.9.9 , 8.8.8.8"), F.lit("x")))
    assert bytes(r["a"]) == hmac.new(key, message.encode(), hashlib.sha256).digest()
    assert r["b"] == "ab?>" and r["c"] == hashlib.sha256(b"salt|2024-01-02|1.2.3.4").hexdigest()[:24] and r["e"] == "9.9.9.9"
    assert r["d"] == hashlib.sha256(b'{"a": "\\u00fc", "b": 1}').hexdigest()
    t = K.sign_token(F.lit('{"v":"2","exp":100}'), key)
    check = lambda token, now: one(spark, v=K.verify_token(token, key, F.lit(now), "2"))["v"]["problem"]
    assert check(t, 99) is None and check(t, 100) == "expired" and check(F.lit("abc"), 1) == "malformed token" and check(F.concat(t, F.lit("A")), 1) == "bad signature"
    assert check(K.sign_token(F.lit('{"v":"1","exp":100}'), key), 1) == "issued under a different policy"


@pytest.mark.parametrize("text", ["A b. " * 800, "x" * 9000, "word " * 3000, "One. Two! Three? (Four) 5. " * 400])
def test_passages_lose_nothing(text):
    text = text.strip()
    spans = papers.passages(text, 1000)
    assert all(0 < e - s <= 1000 for s, e in spans)
    assert all(a[1] <= b[0] and not text[a[1] : b[0]].strip() for a, b in zip(spans, spans[1:], strict=False))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)


def small_papers(spark):
    data = [("1", "IL-6 signalling", "Interleukin IL-6 acts on cells."), ("2", "TNF", "TNF-α and IL-6 differ."), ("3", "Twin", "Same words here."), ("4", "Twin", "Same words here.")]
    return spark.createDataFrame(data, "pmid string, title string, abstract string")


def test_bm25(spark):
    index = retrieval.Bm25Index(papers.units(small_papers(spark)))
    ask = lambda q: [r["pmid"] for r in index.search(spark.createDataFrame([(1, q)], "query_id long, text string"), 3).orderBy("rank").collect()]
    assert ask("IL-6") == ["1", "2"] and ask("words") == ["3", "4"] and ask("nothing matches") == []
    with pytest.raises(ValueError):
        retrieval.check_depth(51)


def test_fusion(spark):
    hits = lambda ids: spark.createDataFrame([(1, k + 1, i, i) for k, i in enumerate(ids)], "query_id long, rank long, pmid string, unit_id string")
    fused = retrieval.fuse([hits("8756"), hits("5986")], 5)
    assert [r["pmid"] for r in fused.orderBy("rank").collect()] == ["5", "8", "6", "7", "9"]  # 7 and 9 are each second once, so the lesser id comes first
    with pytest.raises(ValueError):
        retrieval.fuse([hits("8")])


def test_ranking_scores(spark):
    hits = spark.createDataFrame([(1, "m", k + 1, p) for k, p in enumerate("604815")] + [(2, "m", 1, "6")], "query_id long, method string, rank long, pmid string")
    relevant = spark.createDataFrame([(1, p) for p in "45237"], "query_id long, pmid string")
    got = {r["query_id"]: r for r in metrics.score_rankings(hits, relevant).collect()}
    assert (got[1]["recall_at_5"], got[1]["recall_at_10"], got[1]["rr_at_10"]) == (0.2, 0.4, 1 / 3)
    assert got[2]["recall_at_10"] is None and got[2]["rr_at_10"] is None


def test_answer_scores(spark):
    norm = lambda a: F.transform(a, lambda x: T.normalize_folded(F.lower(x)))
    arr = lambda *x: F.array(*map(F.lit, x))
    reference = F.array(norm(arr("Zinc", "Zn")), norm(arr("vitamin B-12")), norm(arr("iron")), norm(arr("iodine")))
    s = one(spark, s=metrics.score_list(norm(arr("Vitamin B-12", "vitamin B 12", "zn", "zinc", "copper")), reference), f=metrics.score_fact(norm(arr("x", "ZN")), F.flatten(reference)))
    assert s["s"]["matched"] == 2 and all(s["s"][k] == 0.5 for k in ("precision", "recall", "f1"))  # two spellings of one answer count once
    assert (s["f"]["strict"], s["f"]["lenient"]) == (False, True)


def test_nearest_rank(spark):
    df = spark.range(1, 31).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    assert rows(metrics.nearest_rank(df, "v", 0.95, "g")) == [("a", 28)]
    assert rows(metrics.latency_summary(df.unionByName(spark.createDataFrame([("b", 7), ("b", 7), ("b", None)], "g string, v long")), "v", "g").orderBy("g")) == [("a", 15.5, 28, 30), ("b", 7.0, 7, 7)]


def test_bootstrap(spark):
    values = [0.1, -0.2, 0.3, 0.05, -0.1] * 8
    diffs = spark.createDataFrame(list(enumerate(values)), "query_id long, diff double")
    weights = []
    for q in range(40):
        blocks = [hashlib.sha256(f"{metrics.SEED}|{q}|{b}".encode()).hexdigest() for b in range(metrics.RESAMPLES // 8)]
        weights.append([sum(int(h[8 * k : 8 * k + 8], 16) >= bound for bound in metrics.POISSON_BOUNDS) for h in blocks for k in range(8)])
    assert abs(sum(map(sum, weights)) / 40 / metrics.RESAMPLES - 1) < 0.01
    means = sorted(round(sum(w[r] * v for w, v in zip(weights, values, strict=True)) / sum(w[r] for w in weights), 12) for r in range(metrics.RESAMPLES))
    got = rows(metrics.bootstrap_ci(diffs.repartition(3)))
    assert got == [(pytest.approx(means[250], abs=1e-9), pytest.approx(means[9749], abs=1e-9))]
    rng = random.Random(1)  # and the same as drawing with replacement, but for chance
    drawn = sorted(sum(rng.choice(values) for _ in values) / 40 for _ in range(10_000))
    assert abs(got[0][0] - drawn[250]) < 0.01 and abs(got[0][1] - drawn[9749]) < 0.01
    assert rows(metrics.bootstrap_ci(diffs.limit(0))) == []


def test_groups(spark):
    q = [("a", "what binds x", ["1", "2"]), ("b", "what binds x", []), ("c", "which binds x", ["1", "2", "3"]), ("d", "other text", ["9"]), ("e", "more", ["9"])]
    got = dict(rows(curation.group_questions(spark.createDataFrame(q, "id string, body string, pmids array<string>"))))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_quota_does_not_depend_on_order(spark):
    data = [(i, i // 3, "fact" if i % 2 else "list", i % 7 != 0) for i in range(300)]
    schema = "id long, group_id long, type string, ok boolean"
    a = sorted(rows(curation.select_quota(spark.createDataFrame(data, schema), 1, 10)))
    b = sorted(rows(curation.select_quota(spark.createDataFrame(data[::-1], schema).repartition(5), 1, 10)))
    assert a == b and len({i // 3 for i, _, _ in a}) == 20 and all(i % 7 for i, _, _ in a)
    assert sum(s == "test" for _, _, s in a) == 10
    with pytest.raises(ValueError):
        curation.select_quota(spark.createDataFrame(data[:30], schema), 1, 10)
    chosen, rejected = curation.walk_quota(spark.createDataFrame(data, schema), 1, 10)
    sha = lambda *p: hashlib.sha256("/".join(map(str, ("1", *p))).encode()).hexdigest()
    taken, failed, done = {"fact": [], "list": []}, [], set()
    for i, g, t, ok in sorted(data, key=lambda r: (sha(r[1]), sha(r[1], r[0]))):  # the walk itself
        if all(len(x) == 10 for x in taken.values()):
            break
        if g not in done and len(taken[t]) < 10:
            if ok:
                taken[t].append(i)
                done.add(g)
            else:
                failed.append(i)
    assert sorted(r["id"] for r in chosen.collect()) == sorted(taken["fact"] + taken["list"])
    assert sorted(r["id"] for r in rejected.collect()) == sorted(failed)


def test_answer_gate(spark):
    good = '{"outcome":"answered","items":[{"text":"x","source_ids":["S1"]}],"claims":[{"text":"c","source_ids":["S1"],"quotes":[{"source_id":"S1","text":"a quote  of enough words"}]}],"qualifications":[" ","q"]}'
    cases = {good: None, good[:-1]: "malformed", good.replace('"x"', '""'): "malformed", good.replace('"qualifications"', '"extra"'): "malformed", good.replace("of enough", "of other"): "claim:quote_missing:S1", good.replace('"source_id":"S1"', '"source_id":"S2"'): "claim:quote_uncited:S2", good.replace("answered", "insufficient_evidence"): "items_without_evidence"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("sources", F.create_map(F.lit("S1"), F.struct(F.lit("t").alias("title"), F.lit("here is a quote of enough words").alias("abstract"))))
    got = {r["raw"]: r for r in validation.validate_answers(df).collect()}
    assert {k: r["problem"] for k, r in got.items()} == cases and got[good]["qualifications"] == ["q"]


def test_limits(spark):
    steps = [(1, 0, "a", "begin"), (2, 5, "a", "begin"), (3, 6, "b", "begin"), (4, 7, "a", "finish"), (5, 8, "a", "begin"), (6, 900, "b", "begin"), (7, 901, "b", "release"), (8, 902, "a", "begin")]
    df = spark.createDataFrame([("k", i, t, f, k) for i, t, f, k in steps], "request_key string, event_id long, at long, fingerprint string, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    got = [d for _, d in sorted((r["event_id"], r["decision"]) for r in limits.request_leases(df).collect())]
    assert got == ["run", "conflict: being answered", "conflict: different question", "stored", "replay", "run", "released", "run"]
    budget = spark.createDataFrame([("r", n, 30.0, True) for n in range(1, 5)], "request string, n long, seconds double, failed boolean")
    assert [r["allowed"] for r in limits.attempt_budget(budget).orderBy("n").collect()] == [True, True, True, False]


XML = """<?xml version="1.0"?><!DOCTYPE PubmedArticleSet PUBLIC "x" "y"><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2003 Spring to 2004</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>On <i>in vivo</i> work</ArticleTitle>
<Abstract><AbstractText Label="SCOPE">One.</AbstractText><AbstractText Label="UNLABELLED">Two.</AbstractText></Abstract></Article><CommentsCorrectionsList><CommentsCorrections RefType="ErratumIn"><PMID>99</PMID></CommentsCorrections></CommentsCorrectionsList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>x</AbstractText></Abstract><PublicationTypeList><PublicationType>Retracted Publication</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>4</PMID><Book><BookTitle>B</BookTitle><PubDate><Year>2010</Year></PubDate></Book><Abstract><AbstractText>y</AbstractText></Abstract></BookDocument></PubmedBookArticle>
<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>again</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_article_xml(spark):
    requested = spark.createDataFrame([("4", 0), ("1", 1), ("2", 2), ("3", 3), ("5", 4)], "pmid string, pos long")
    kept, dropped = ingest.parse_articles(spark.createDataFrame([(0, XML)], "response long, xml string"), requested)
    got = {r["pmid"]: r for r in kept.collect()}
    assert set(got) == {"1", "4"} and got["1"]["title"] == "On in vivo work" and got["1"]["abstract"] == "SCOPE: One. Two." and got["1"]["year"] == 2003 and got["1"]["status"] == "corrected"
    assert (got["4"]["title"], got["4"]["year"], got["4"]["journal"]) == ("B", 2010, None)
    assert sorted(rows(dropped)) == [("1", "duplicate"), ("2", "no_abstract"), ("3", "retracted"), ("5", "not_returned")]
    with pytest.raises(ValueError):
        list(ingest.fields("<eFetchResult><ERROR>no</ERROR></eFetchResult>"))
    with pytest.raises(Exception, match="no link result"):
        ingest.parse_neighbours(spark.createDataFrame([("<eLinkResult><ERROR>no</ERROR></eLinkResult>",)], "xml string")).collect()
    stored = spark.createDataFrame([(1, ["1", "2"], hashlib.sha256(b"<a/>").hexdigest(), "<a/>"), (2, ["3"], hashlib.sha256(b"<a/>").hexdigest(), "<b/>"), (3, ["9"], hashlib.sha256(b"<a/>").hexdigest(), "<a/>")], "batch long, pmids array<string>, sha256 string, xml string")
    asked = spark.createDataFrame([(1, ["1", "2"]), (2, ["3"]), (3, ["4"]), (4, ["5"])], "batch long, pmids array<string>")
    assert [(r["state"], r["xml"]) for r in ingest.reuse_responses(asked, stored).orderBy("batch").collect()] == [("reuse", "<a/>"), ("mismatch", None), ("mismatch", None), ("fetch", None)]
    links = "<eLinkResult><LinkSet><IdList><Id>1</Id></IdList><LinkSetDb><LinkName>pubmed_pubmed</LinkName><Link><Id>1</Id><Score>9</Score></Link><Link><Id>3</Id><Score>5</Score></Link><Link><Id>2</Id><Score>5</Score></Link></LinkSetDb><LinkSetDb><LinkName>other</LinkName><Link><Id>7</Id><Score>8</Score></Link></LinkSetDb></LinkSet></eLinkResult>"
    assert sorted(rows(ingest.parse_neighbours(spark.createDataFrame([(links,)], "xml string")))) == [("1", "2", 5, 1), ("1", "3", 5, 2)]


def test_files(spark, tmp_path):
    kept, dropped = papers.split_records(spark.createDataFrame([("1", "t", "a"), ("2", "", "a"), ("3", "t", "")], "pmid string, title string, abstract string"))
    found = files.write_snapshot(kept, dropped, spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string"), str(tmp_path / "snapshot")).first()
    assert (found["papers"], found["excluded"], found["no_title"], found["no_abstract"], found["requested"]) == (1, 2, 1, 1, 3)
    (tmp_path / "ids.txt").write_text("# ids\n12 # one\n\n34\n")
    assert rows(files.read_pmids(spark, str(tmp_path / "ids.txt"))) == [("12",), ("34",)]
    (tmp_path / "bad.txt").write_text("x1\n")
    with pytest.raises(Exception, match="not an id"):
        files.read_pmids(spark, str(tmp_path / "bad.txt")).collect()
    target = str(tmp_path / "units")
    assert files.append_missing(kept, target, "pmid") == 1 and files.append_missing(kept, target, "pmid") == 0


def test_plans(spark):
    staging = Staging(spark, "test")
    edges = [(k, k + 1) for k in range(0, 60, 2)] + [(k + 1, k + 2) for k in range(0, 30, 2)] + [(100, k) for k in range(101, 160)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long"), staging)))
    assert got[31] == got[0] == 0 and got[33] == 32 and got[159] == 100 and len(got) == 120
    df = spark.range(1000).select((F.col("id") * 7 % 50).alias("k"), F.col("id").alias("v"))
    sums = sorted(rows(running_total(df, ["k", "v"], {"before": "v"}, staging)))
    total = 0
    for _, v, before in sums:
        assert before == total
        total += v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_without_the_pipeline_folder():
    import __spark_entry__ as entry

    assert record_queries.query is queries.query and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
