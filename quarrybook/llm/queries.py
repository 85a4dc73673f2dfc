"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybook.llm import chat, conversation_repair, decontamination, exact_dedup, html_extraction, language, lexical_search, mixing, near_dedup, pii, quality, sharding, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(_read(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hashed = found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).withColumn("near_sha256", F.sha2(F.array_join("near_ids", ","), 256))
    return hashed.withColumn("n_near", F.size("near_ids").cast("long")).drop("item_ids", "near_ids")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key is a secret of whoever runs the library; a registered query needs a fixed one
    done = pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), secret="registered query")
    return done.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), F.array_join("kinds", ",").alias("kinds"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    read = chat.ChatTrees(rows.unionByName(extra)).read_back()
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(_read(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.LexicalSearch(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).results


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), items AS (
  SELECT DISTINCT item_id, width, list_aggregate(w[j:j + width - 1], 'string_agg', ' ') AS key
  FROM (SELECT item_id, w, least(10, len(w)) AS width, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS j FROM iw WHERE len(w) > 0)
), widths AS (SELECT DISTINCT width FROM items),
spans AS (
  SELECT doc_id, p, width, list_aggregate(w[p:p + width - 1], 'string_agg', ' ') AS key
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM dw, widths WHERE len(w) >= width)
), hits AS (SELECT doc_id, item_id, p, s.width FROM spans s JOIN items i ON s.width = i.width AND s.key = i.key),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS x FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id),
long AS (SELECT item_id, list_distinct(w) AS terms, len(w) + 5 AS reach, CAST(ceil(0.8 * len(list_distinct(w))) AS BIGINT) AS needed FROM iw WHERE len(w) >= 10),
pairs AS (SELECT doc_id, item_id, w, terms, reach, needed FROM dw JOIN long ON len(list_intersect(w, terms)) >= needed),
close AS (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM pairs)
  WHERE len(list_intersect(w[p:p + reach - 1], terms)) >= needed
), near AS (SELECT doc_id, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_ids FROM close GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP11_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, row_number() OVER () AS id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT id, h || p AS rule, v, row_number() OVER (PARTITION BY id ORDER BY length(h || p) DESC, length(h) DESC) AS k FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (id)
"""


# the CRC's table of 256 numbers comes from its rule; costs go backwards row by row, each state with its least audit and its text
OP12_SQL = r"""
WITH RECURSIVE steps(n, k, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 20 AS kind FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, role[1] AS ini FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN fault = 'blank' THEN 1 END) AS blank, count(CASE WHEN fault = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN fault = 'truncated' THEN 1 END) AS truncated,
  count(CASE WHEN i > 1 AND before || ini NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM f GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'r': ''} AS s0, {'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1, {'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'} AS s2, {'c': 0, 'a': '', 'r': ''} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, list_min([v0, {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': chr(10) || 'user:' || v2.r}, {'c': v3.c + 4, 'a': 'II' || v3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || v3.r}]),
    list_min([v1, {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': chr(10) || 'user:' || v2.r}, {'c': v3.c + 4, 'a': 'II' || v3.a, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || v3.r}]),
    list_min([v2, {'c': v3.c + 2, 'a': 'I' || v3.a, 'r': chr(10) || 'assistant:' || v3.r}]), list_min([v3, {'c': v2.c + 2, 'a': 'I' || v2.a, 'r': chr(10) || 'user:' || v2.r}])
  FROM (
    SELECT conv_id, i,
      list_min([{'c': s0.c + 3, 'a': 'D' || s0.a, 'r': s0.r}] || CASE WHEN must THEN [] ELSE [{'c': s2.c + 2 + t, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}] END || CASE WHEN NOT must AND ini = 's' THEN [{'c': s1.c + t, 'a': 'K' || s1.a, 'r': own || s1.r}] WHEN NOT must AND ini = 'u' THEN [{'c': s2.c + t, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS v0,
      list_min([{'c': s1.c + 3, 'a': 'D' || s1.a, 'r': s1.r}] || CASE WHEN must THEN [] ELSE [{'c': s2.c + 2 + t, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}] END || CASE WHEN NOT must AND ini = 'u' THEN [{'c': s2.c + t, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS v1,
      list_min([{'c': s2.c + 3, 'a': 'D' || s2.a, 'r': s2.r}] || CASE WHEN must THEN [] ELSE [{'c': s3.c + 2 + t, 'a': 'R' || s3.a, 'r': chr(10) || 'assistant:' || text || s3.r}] END || CASE WHEN NOT must AND ini = 'a' THEN [{'c': s3.c + t, 'a': 'K' || s3.a, 'r': own || s3.r}] ELSE [] END) AS v2,
      list_min([{'c': s3.c + 3, 'a': 'D' || s3.a, 'r': s3.r}] || CASE WHEN must THEN [] ELSE [{'c': s2.c + 2 + t, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r}] END || CASE WHEN NOT must AND ini = 'u' THEN [{'c': s2.c + t, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS v3
    FROM (SELECT f.conv_id, f.i, f.text, f.ini, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t, chr(10) || role || ':' || text AS own, s0, s1, s2, s3 FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)
  )
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id) LEFT JOIN (SELECT * FROM b WHERE i = 1) USING (conv_id)
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
a AS (SELECT item, item_id, unnest(w) AS term FROM i),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, big_n),
x AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // l))))) AS BIGINT) AS score FROM a JOIN t USING (term) JOIN f USING (term), s GROUP BY item, item_id, row, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_language, op3_source_mix, op4_near_dedup, op5_html_text, op6_decontamination, op7_pii, op8_chat, op9_quality, op10_sharding, op11_url_rules, op12_conversation_repair, op13_lexical_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_decontamination": OP6_SQL, "op8_chat": OP8_SQL, "op11_url_rules": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
