"""DuckDB SQL of the derived tables that several queries share.

Each constant is a list of common table expressions, joined by commas.
"""

from __future__ import annotations

from quarrybook.functions.text import GREEK, SPACE, STOPWORDS, WORD

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
GAP = r"([.?!])\s+([A-Z0-9(\[])"


def squash(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{SPACE}]+', ' ', 'g'))"


def tokens(e: str) -> str:
    parts = f"list_filter(string_split_regex(w, '[-/]'), lambda p: p NOT IN ({_STOP}))"
    joined = "CASE WHEN regexp_matches(w, '[-/]') THEN [regexp_replace(w, '[-/]', '', 'g')] ELSE [] END"
    return f"flatten(list_transform(regexp_extract_all(lower({e}), '{WORD}'), lambda w: list_concat({joined}, {parts})))"


def words(e: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({e}), '[a-z0-9]+')))"


def answer(e: str) -> str:
    e = f"replace(lower({e}), 'ß', 'ss')"
    for letter, name in GREEK.items():
        e = f"replace({e}, '{letter}', ' {name} ')"
    e = f"regexp_replace(regexp_replace({e}, '[-_/]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_{SPACE}]', ' ', 'g')"
    return f"regexp_replace({squash(e)}, '^(the|a|an) ', '')"


RECORDS = f"""recs AS (
  SELECT *, CASE WHEN title = '' THEN 'no_title' WHEN abstract = '' THEN 'no_abstract' WHEN length(title) + 1 + length(abstract) > 6000 AND length(title) > 5799 THEN 'title_too_long' END AS reason
  FROM (SELECT CAST(doc_id + 1 AS VARCHAR) AS pmid, {squash("nfc_normalize(split_part(text, chr(10), 1))")} AS title,
         {squash("nfc_normalize(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END)")} AS abstract, source AS journal
        FROM documents)
), papers AS MATERIALIZED (SELECT * EXCLUDE (reason), sha256(title || chr(10) || abstract) AS content_hash FROM recs WHERE reason IS NULL)"""

UNITS = f"""{RECORDS}, lengthy AS (
  SELECT pmid, title, abstract, 5999 - length(title) AS budget FROM papers WHERE length(title) + 1 + length(abstract) > 6000
), sentences AS (
  SELECT *, sum(length(x) + 1) OVER (PARTITION BY pmid ORDER BY i) - length(x) - 1 AS s, sum(length(x) + 1) OVER (PARTITION BY pmid ORDER BY i) - 1 AS e
  FROM (SELECT pmid, title, abstract, budget, unnest(l) AS x, generate_subscripts(l, 1) AS i
        FROM (SELECT *, string_split(regexp_replace(abstract, '{GAP}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM lengthy))
), cuts AS (
  SELECT pmid, abstract, budget, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM sentences
  UNION ALL
  SELECT pmid, abstract, budget, CASE WHEN blank > 0 THEN s + blank + 1 WHEN substr(abstract, CAST(s + budget + 1 AS BIGINT), 1) = ' ' THEN s + budget + 1 ELSE s + budget END, e
  FROM (SELECT *, CASE WHEN strpos(reverse(substr(abstract, s + 2, budget - 1)), ' ') > 0 THEN budget - strpos(reverse(substr(abstract, s + 2, budget - 1)), ' ') ELSE 0 END AS blank
        FROM cuts WHERE e - s > budget)
), pieces AS (
  SELECT pmid, budget, s, CASE WHEN e - s > budget THEN CASE WHEN strpos(reverse(substr(abstract, s + 2, budget - 1)), ' ') > 0 THEN s + budget - strpos(reverse(substr(abstract, s + 2, budget - 1)), ' ') ELSE s + budget END ELSE e END AS e
  FROM cuts WHERE e > s
), numbered AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY s) AS n FROM pieces),
packed AS (
  SELECT pmid, n, s AS first, e, 0 AS idx FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.pmid, x.n, CASE WHEN x.e - p.first <= x.budget THEN p.first ELSE x.s END, x.e, CASE WHEN x.e - p.first <= x.budget THEN p.idx ELSE p.idx + 1 END
  FROM packed p JOIN numbered x ON x.pmid = p.pmid AND x.n = p.n + 1
), spans AS (SELECT pmid, idx, min(first) AS s, max(e) AS e FROM packed GROUP BY pmid, idx),
units AS MATERIALIZED (
  SELECT pmid AS unit_id, pmid, CAST(0 AS BIGINT) AS idx, title || chr(10) || abstract AS text, CAST(0 AS BIGINT) AS s, length(abstract) AS e
  FROM papers WHERE length(title) + 1 + length(abstract) <= 6000
  UNION ALL
  SELECT pmid || '#' || idx, pmid, CAST(idx AS BIGINT), title || chr(10) || substr(abstract, s + 1, e - s), s, e FROM spans JOIN lengthy USING (pmid)
)"""

INDEX = f"""{UNITS}, sized AS MATERIALIZED (SELECT unit_id, pmid, idx, {tokens("text")} AS terms FROM units),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM sized),
postings AS MATERIALIZED (SELECT unit_id, pmid, idx, term, dl, count(*) AS tf FROM (SELECT unit_id, pmid, idx, len(terms) AS dl, unnest(terms) AS term FROM sized) GROUP BY unit_id, pmid, idx, term, dl),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

ASKED = f"""asked AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({tokens("text")}) AS term FROM benchmark)"""

def qrels(run: int) -> str:
    """Papers with ``run`` terms in a row in common with an item."""
    grams = f"array_to_string(l[i:i + {run - 1}], ' ') AS head"
    return f"""heads AS (SELECT DISTINCT query_id, {grams} FROM (SELECT query_id, l, unnest(range(1, len(l) - {run - 2})) AS i FROM (SELECT item_id AS query_id, {tokens("text")} AS l FROM benchmark) WHERE len(l) >= {run})),
grams AS (SELECT DISTINCT pmid, {grams} FROM (SELECT pmid, l, unnest(range(1, len(l) - {run - 2})) AS i FROM (SELECT pmid, {tokens("title || chr(10) || abstract")} AS l FROM papers WHERE true) WHERE len(l) >= {run})),
qrels AS MATERIALIZED (SELECT DISTINCT query_id, pmid FROM heads JOIN grams USING (head))"""


QRELS = qrels(8)


def bm25(name: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    """A ranking of the benchmark's items over the index."""
    return f"""{name} AS MATERIALIZED (
  SELECT query_id, rank, pmid, unit_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS rank FROM (
      SELECT query_id, pmid, unit_id, score, row_number() OVER (PARTITION BY query_id, pmid ORDER BY score DESC, idx) AS best FROM (
        SELECT query_id, pmid, unit_id, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 9) AS score
        FROM asked JOIN postings USING (term) JOIN dfs USING (term), stats GROUP BY query_id, pmid, unit_id, idx)) WHERE best = 1)
  WHERE rank <= {k})"""


def knn(name: str, k: int, where: str, keep: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT query_id, rank, pmid, pmid AS unit_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS rank FROM (
      SELECT q.vec_id AS query_id, CAST(b.vec_id + 1 AS VARCHAR) AS pmid, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
      FROM embeddings q, embeddings b WHERE {where} AND {keep})) WHERE rank <= {k})"""


def fused(name: str, k: int, *rankings: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, pmid, unit_id, rank, {i} AS o FROM {r} WHERE rank <= 50" for i, r in enumerate(rankings))
    return f"""{name} AS MATERIALIZED (
  SELECT query_id, rank, pmid, unit_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS rank FROM (
      SELECT query_id, pmid, arg_min(unit_id, rank * 10 + o) AS unit_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({union}) GROUP BY query_id, pmid))
  WHERE rank <= {k})"""


def scores(name: str, hits: str) -> str:
    """Scores of the rankings in ``hits`` (query_id, method, rank, pmid) against qrels."""
    return f"""{name} AS MATERIALIZED (
  SELECT query_id, method, coalesce(n_relevant, 0) AS n_relevant, top5 / n_relevant AS recall_at_5, top10 / n_relevant AS recall_at_10,
         CASE WHEN n_relevant IS NOT NULL THEN coalesce(1 / first_rank, 0) END AS rr_at_10, first_rank
  FROM (SELECT h.query_id, method, count(CASE WHEN rank <= 5 THEN r.pmid END) AS top5, count(CASE WHEN rank <= 10 THEN r.pmid END) AS top10, min(CASE WHEN rank <= 10 AND r.pmid IS NOT NULL THEN rank END) AS first_rank
        FROM {hits} h LEFT JOIN qrels r ON h.query_id = r.query_id AND h.pmid = r.pmid GROUP BY h.query_id, method)
  LEFT JOIN (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id) USING (query_id))"""


RANKINGS = f"""{INDEX}, {ASKED}, {QRELS}, {bm25("bm25", 50)}, {knn("vector", 50, "q.vec_id IN (SELECT item_id FROM benchmark)")}, {fused("hybrid", 50, "bm25", "vector")},
hits AS (SELECT query_id, 'bm25' AS method, rank, pmid FROM bm25 UNION ALL SELECT query_id, 'hybrid', rank, pmid FROM hybrid), {scores("scored", "(SELECT * FROM hits WHERE rank <= 10)")}"""



def merkle(rows: str) -> str:
    """Levels of a tree of hashes over ``rows`` (key, value), for up to 256**3 of them: level, node, sha256."""
    up = lambda k: f"l{k + 1} AS MATERIALIZED (SELECT node // 256 AS node, sha256(string_agg(h, chr(10) ORDER BY node)) AS h FROM l{k} GROUP BY 1)"
    return f"""l0 AS MATERIALIZED (SELECT node, sha256(string_agg(r, chr(10) ORDER BY i)) AS h FROM (SELECT (row_number() OVER w - 1) // 256 AS node, row_number() OVER w AS i, key || '|' || value AS r FROM ({rows}) WINDOW w AS (ORDER BY key, value)) GROUP BY 1),
{up(0)}, {up(1)},
tree AS (SELECT 0 AS level, node, h AS sha256 FROM l0 UNION ALL SELECT 1, node, h FROM l1 WHERE (SELECT count(*) FROM l0) > 1 UNION ALL SELECT 2, node, h FROM l2 WHERE (SELECT count(*) FROM l1) > 1)"""


PAIRS = f"""turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), exchanges AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text AS question, answer FROM turns WHERE role = 'user' AND next_role = 'assistant'
)"""
