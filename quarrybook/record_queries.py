"""Registered queries of ingest, files, reports and follow-ups, on data derived from the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrybook import sql as S
from quarrybook.functions import text as T
from quarrybook.functions import tokens as K
from quarrybook.operators import curation, followup, ingest, limits, metrics, papers, reports, retrieval
from quarrybook.plans.staging import Staging
from quarrybook.queries import _ELIGIBLE, _exchanges, _index, _papers, _raw_questions, _records, _scores, query
from quarrybook.sources import files
from quarrybook.sources.files import read_table

#: What XML cannot hold.
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _escaped(text):
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def _article_xml(spark, sf_dir):
    """A response for each document: an article, or a book for every fifth, with notices on some; every tenth document's record comes twice."""
    rows = _records(spark, sf_dir).withColumn("d", F.col("pmid").cast("long") - 1)
    title, abstract = (_escaped(F.regexp_replace(c, _CONTROL, "")) for c in ("title", "abstract"))
    marked = F.concat(F.lit("<i>"), F.lit("On "), F.lit("</i>"), title)
    every = lambda n, yes, no="": F.when(F.col("d") % n == 0, F.lit(yes)).otherwise(F.lit(no))
    notes = F.concat(F.lit("<CommentsCorrectionsList>"), every(7, "<CommentsCorrections RefType='ErratumIn'><PMID>1</PMID></CommentsCorrections>"), every(11, "<CommentsCorrections RefType='RetractionIn'/>"), F.lit("</CommentsCorrectionsList>"))
    body = F.concat(F.lit("<Abstract><AbstractText Label='AIM'>"), abstract, F.lit("</AbstractText><AbstractText Label='UNLABELLED'>End.</AbstractText></Abstract>"))
    own = F.concat(F.lit("<PMID Version='1'>"), F.col("pmid"), F.lit("</PMID>"))
    date = F.concat(F.lit("<PubDate><MedlineDate>Winter "), (F.col("d") % 100 + 1900).cast("string"), F.lit("</MedlineDate></PubDate>"))
    article = F.concat(F.lit("<PubmedArticle><MedlineCitation>"), own, F.lit("<Article><Journal><JournalIssue>"), date, F.lit("</JournalIssue><Title>J</Title></Journal><ArticleTitle>"), marked, F.lit("</ArticleTitle>"), body, F.lit("</Article>"), notes, F.lit("</MedlineCitation></PubmedArticle>"))
    book = F.concat(F.lit("<PubmedBookArticle><BookDocument>"), own, F.lit("<Book>"), date, F.lit("<BookTitle>"), marked, F.lit("</BookTitle></Book>"), body, F.lit("</BookDocument></PubmedBookArticle>"))
    record = F.when(F.col("d") % 5 == 0, book).otherwise(article)
    again = F.when(F.col("d") % 10 == 0, record).otherwise(F.lit(""))
    return rows.select(F.col("d").alias("response"), F.concat(F.lit("<?xml version='1.0'?><PubmedArticleSet>"), record, again, F.lit("</PubmedArticleSet>")).alias("xml"))


def _bare(e: str) -> str:
    return S.squash(f"regexp_replace({e}, '{_CONTROL}', '', 'g')")


_ARTICLES = f"""{S.RECORDS}, b AS (SELECT pmid, CAST(pmid AS BIGINT) - 1 AS d, trim('On ' || {_bare("title")}) AS title, trim('AIM: ' || {_bare("abstract")}) || ' End.' AS abstract, {_bare("abstract")} = '' AS bare FROM recs),
x AS (SELECT pmid, d, {S.squash("title")} AS title, CASE WHEN bare THEN 'End.' ELSE {S.squash("abstract")} END AS abstract, CASE WHEN d % 5 = 0 THEN NULL ELSE 'J' END AS journal, 1900 + d % 100 AS year,
  CASE WHEN d % 5 = 0 THEN 'current' WHEN d % 11 = 0 THEN 'retracted' WHEN d % 7 = 0 THEN 'corrected' ELSE 'current' END AS status FROM b),
j AS (SELECT *, CASE WHEN length(title) + 1 + length(abstract) > 6000 AND length(title) > 5799 THEN 'title_too_long' WHEN status = 'retracted' THEN 'retracted' END AS reason FROM x)"""


@query(f"WITH {_ARTICLES} SELECT pmid, CAST(year AS INT) AS year, journal, status, sha256(title || chr(10) || abstract) AS content_hash FROM j WHERE reason IS NULL")
def article_records(spark, sf_dir):
    requested = _records(spark, sf_dir).select("pmid", F.col("pmid").cast("long").alias("pos"))
    kept, _ = ingest.parse_articles(_article_xml(spark, sf_dir), requested)
    return kept.select("pmid", "year", "journal", "status", "content_hash")


@query(f"""WITH {_ARTICLES} SELECT reason, count(*) AS n FROM (SELECT coalesce(reason, 'duplicate') AS reason FROM j WHERE d % 10 = 0 UNION ALL SELECT reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'not_returned' FROM recs) GROUP BY reason""")
def article_exclusions(spark, sf_dir):
    own = _records(spark, sf_dir).select("pmid", F.col("pmid").cast("long").alias("pos"))
    absent = own.select(F.concat(F.lit("9"), F.lpad("pmid", 9, "0")).alias("pmid"), "pos")
    _, dropped = ingest.parse_articles(_article_xml(spark, sf_dir), own.unionByName(absent))
    return dropped.groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT pmid, neighbour, score, row_number() OVER (PARTITION BY pmid ORDER BY score DESC, neighbour) AS rank FROM (
  SELECT CAST(doc_id + 1 AS VARCHAR) AS pmid, CAST(doc_id + 2 + unnest(range(0, 3)) AS VARCHAR) AS neighbour, n_chars % 50 + doc_id % 2 AS score FROM documents)""")
def article_links(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("p"), (F.col("n_chars") % 50 + F.col("doc_id") % 2).cast("string").alias("s"))
    link = lambda by: F.concat(F.lit("<Link><Id>"), (F.col("p") + by).cast("string"), F.lit("</Id><Score>"), F.col("s"), F.lit("</Score></Link>"))
    sets = F.concat(F.lit("<LinkSetDb><LinkName>pubmed_pubmed</LinkName>"), *[link(by) for by in range(4)], F.lit("</LinkSetDb><LinkSetDb><LinkName>other</LinkName>"), link(9), F.lit("</LinkSetDb>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><eLinkResult><LinkSet><IdList><Id>"), F.col("p").cast("string"), F.lit("</Id></IdList>"), sets, F.lit("</LinkSet></eLinkResult>"))
    return ingest.parse_neighbours(docs.select(xml.alias("xml")))


@query("""WITH b AS (SELECT doc_id // 50 AS batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1)
SELECT batch, CASE batch % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'reuse' ELSE 'mismatch' END AS state, CASE WHEN batch % 4 = 1 THEN sha256('<a>' || ids || '</a>') END AS xml_sha256 FROM b""")
def stored_responses(spark, sf_dir):
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string"))
    batches = read_table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(ids.alias("pmids"))
    xml = F.concat(F.lit("<a>"), F.array_join("pmids", ","), F.lit("</a>"))
    kind = F.col("batch") % 4
    stored = batches.where(kind > 0).select("batch", F.when(kind == 2, F.slice("pmids", 1, 1)).otherwise(F.col("pmids")).alias("pmids"), F.sha2(F.when(kind == 3, F.lit("x")).otherwise(xml), 256).alias("sha256"), xml.alias("xml"))
    return ingest.reuse_responses(batches, stored).select("batch", "state", F.sha2("xml", 256).alias("xml_sha256"))


@query(f"WITH {S.RECORDS} SELECT pmid, title, content_hash FROM papers")
def paper_files(spark, sf_dir):
    path = f"{Staging(spark, 'files').root}/papers"
    rows = _papers(spark, sf_dir).select("pmid", "title", "abstract", "journal", F.lit(2020).alias("year"), F.lit("current").alias("source_status"), F.lit("2024-01-01").alias("retrieved_on"), "content_hash")
    rows.write.json(path)
    return files.read_papers(spark, path).select("pmid", "title", "content_hash")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'development' ELSE 'test' END AS split, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id % 2 = 1 GROUP BY 1")
def split_files(spark, sf_dir):
    path = f"{Staging(spark, 'files').root}/questions"
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "development").otherwise("test").alias("split"))
    rows.write.json(path)
    return files.read_split(spark, path, "test").agg(F.count("*").alias("n"), F.min("id").alias("first")).select(F.lit("test").alias("split"), "n", "first")


@query(f"WITH {S.RECORDS} SELECT title AS text, pmid AS query_id FROM papers ORDER BY sha256('11/' || pmid) LIMIT 5")
def title_sample(spark, sf_dir):
    return retrieval.title_sample(_papers(spark, sf_dir), 11)


@query(f"""WITH RECURSIVE {S.RANKINGS}, k AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM scored WHERE recall_at_10 IS NOT NULL)
SELECT method, kind, count(*) AS questions_scored, round(avg(recall_at_5), 9) AS recall_at_5, round(avg(recall_at_10), 9) AS recall_at_10, round(avg(rr_at_10), 9) AS mrr_at_10, count(first_rank) AS any_relevant_in_top_10
FROM k GROUP BY GROUPING SETS ((method), (method, kind))""")
def summary_by_kind(spark, sf_dir):
    scored = _scores(spark, sf_dir)[0].withColumn("kind", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    rounded = [F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr_at_10")]
    return metrics.summarize(scored, "kind").select("method", "kind", "questions_scored", *rounded, "any_relevant_in_top_10")


@query("""WITH a AS (SELECT source, quality IS NOT NULL AS done, quality = 1 AS strict, CASE WHEN doc_id % 3 > 0 THEN n_chars % 7 / 7.0 END AS f1 FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS attempted, count(CASE WHEN done THEN 1 END) AS answered, round(avg(CASE WHEN done AND strict THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(CASE WHEN done THEN CAST(strict AS INT) END), 9) AS accuracy_of_answered, round(avg(coalesce(f1, 0)), 9) AS f1
FROM a GROUP BY source""")
def answer_outcomes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    attempts = rows.select("source", F.when(F.col("quality").isNotNull(), "answered").otherwise("insufficient_evidence").alias("outcome"), (F.col("quality") == 1).alias("strict"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 7 / 7.0).alias("f1"))
    found = reports.answer_summary(attempts, "source")
    return found.select("source", "attempted", "answered", *[F.round(c, 9).alias(c) for c in ("accuracy", "accuracy_of_answered", "f1")])


@query(f"""WITH {_ELIGIBLE} SELECT type, count(*) AS n, count(CASE WHEN id % 17 <> 0 THEN 1 END) AS with_answer, count(CASE WHEN id % 43 <> 0 THEN 1 END) AS with_snippets, round(avg(CASE WHEN id % 41 = 0 THEN 0 ELSE 2 END), 9) AS mean_documents FROM r GROUP BY type""")
def question_profile(spark, sf_dir):
    return reports.question_profile(_raw_questions(spark, sf_dir)).withColumn("mean_documents", F.round("mean_documents", 9))


@query("SELECT CAST(l_partkey AS VARCHAR) AS pmid FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 7")
def shared_papers(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 7)")
    return reports.shared_between(lines.select(F.when(F.col("l_linenumber") == 1, "development").otherwise("test").alias("split"), F.col("l_partkey").cast("string").alias("pmid")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'remote' END AS address, CASE WHEN trim(props) = '' THEN 'empty' WHEN length(trim(props)) > 30 THEN 'too long' END AS refused, [event_type, CAST(user_id AS VARCHAR)] AS origins FROM events""")
def request_checks(spark, sf_dir):
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" , 10.0.0.1"))).otherwise("")
    setting = F.concat(F.lit(" "), F.col("event_type"), F.lit(",, "), F.col("user_id").cast("string"), F.lit(" ,"))
    return read_table(spark, sf_dir, "events").select("event_id", K.client_address(forwarded, F.lit("remote")).alias("address"), reports.check_text(F.col("props"), 30).alias("refused"), reports.origins(setting).alias("origins"))


@query("""WITH f AS (SELECT doc_id, text, min(turn) AS pos FROM (SELECT conv_id AS doc_id, turn, text FROM conversations) GROUP BY doc_id, text)
SELECT doc_id AS conv_id, count(*) AS n, sha256(string_agg(text, chr(9) ORDER BY pos, text)) AS excerpts_sha256 FROM f GROUP BY doc_id""")
def source_excerpts(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "text")
    found = reports.source_list(turns.unionByName(turns))
    return found.select(F.col("source_id").alias("conv_id"), F.size("excerpts").cast("long").alias("n"), F.sha2(F.array_join("excerpts", "\t"), 256).alias("excerpts_sha256"))


@query(f"""WITH {S.PAIRS}, l AS (SELECT conv_id, max(n) AS last FROM exchanges GROUP BY conv_id), t AS (SELECT conv_id, max(n) AS token FROM exchanges WHERE n % 2 = 1 GROUP BY conv_id)
SELECT e.conv_id, n, CASE WHEN n % 5 = 0 THEN 'out_of_scope' WHEN trim(question) = '' OR length(trim(question)) > 2000 THEN 'malformed' ELSE 'proceed' END AS outcome,
  length(CASE WHEN n % 2 = 0 THEN question || ' (clarification: ' || answer || ')' ELSE question END) AS asked_chars, CASE WHEN length(answer) % 2 = 0 THEN 1 END AS kept, t.token AS latest
FROM exchanges e JOIN t ON t.conv_id = e.conv_id""")
def followup_turns(spark, sf_dir):
    pairs = _exchanges(spark, sf_dir)
    token = followup.latest_token(pairs.select("conv_id", F.col("n").alias("turn"), F.when(F.col("n") % 2 == 1, F.col("n")).alias("token")))
    outcome = F.when(F.length("answer") % 2 == 0, "answered").otherwise("needs_clarification")
    after = followup.next_history(F.lit(None).cast("array<struct<q:string,i:array<string>>>"), F.col("question"), F.array("answer"), outcome)
    read = followup.rewritten(F.when(F.col("n") % 5 == 0, "out_of_scope").otherwise("rewrite"), F.col("question"))
    rows = pairs.select("conv_id", "n", read["outcome"].alias("outcome"), F.length(followup.clarified(F.col("question"), F.when(F.col("n") % 2 == 0, F.col("answer")))).cast("long").alias("asked_chars"), F.when(after.isNotNull(), F.size(after)).alias("kept"))
    return rows.join(token.withColumnRenamed("token", "latest"), "conv_id")


@query("""SELECT event_id, row_number() OVER w AS occurrence, CASE WHEN row_number() OVER w <= 2 THEN event_type || row_number() OVER w END AS completion FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)""")
def cached_completions(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("prompt", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    cache = events.select("prompt", "event_type").distinct().select("prompt", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("occurrence"), "event_type")
    stored = cache.select("prompt", "occurrence", F.concat("event_type", F.col("occurrence").cast("string")).alias("completion"))
    return limits.cached_completions(events, stored, "prompt").select("event_id", "occurrence", "completion")


@query("SELECT part.p_partkey AS id, CAST(p_size AS INT) AS context FROM part WHERE p_size % 5 = 0")
def free_models(spark, sf_dir):
    models = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("context"), (F.col("p_size") % 5).alias("prompt_price"), F.lit(0).alias("completion_price"))
    return followup.free_models(models).select("id", "context")


@query("""SELECT l_orderkey AS key, CAST(a.l_quantity AS VARCHAR) AS frozen, CAST(b.l_quantity AS VARCHAR) AS actual FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)
WHERE a.l_quantity IS DISTINCT FROM b.l_quantity""")
def config_mismatches(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    side = lambda n: lines.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("key"), F.col("l_quantity").cast("string").alias("value"))
    return reports.config_mismatches(side(1), side(2))
