"""Queries of this subpackage and their SQL, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, chat, decontaminate, near_dedup, quality, sharding, suffix_dedup, toxicity, url_filter, warc
from lumenframe.llm.shared import prepare

#: Host, path and decision of the rules that the url query applies.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A conversation whose texts are full of control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("class")


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(turns.unionByName(own))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_warc_archives": op2_warc_archives,
    "op3_benchmark_passages": op3_benchmark_passages,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_kd_shards": op6_kd_shards,
    "op7_url_verdicts": op7_url_verdicts,
    "op8_chat_round_trip": op8_chat_round_trip,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base 32 takes 5 of the 160 bits at a time; 5 hexadecimal digits make 4 letters.
_OP2 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
n AS (SELECT *, list_transform(range(1, 41, 5), lambda k: list_reduce(list_transform(range(5), lambda j: CAST(strpos('0123456789abcdef', substr(hex, CAST(k + j AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)) AS parts FROM h),
d AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // s) % 32 + 1 AS INTEGER), 1)), '')), '') AS payload_digest FROM n),
m AS (SELECT hex, max(page_id) AS last FROM d GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM d JOIN m USING (hex)"""

_OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT node, b FROM r JOIN e ON reached = a),
c AS (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, CAST(i AS INTEGER) AS i, md5(substr(h, CAST(2 * i + 1 AS INTEGER), 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN m USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM p),
t AS (SELECT q.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * last + 1 AS INTEGER), CAST(2 * (a - last) AS INTEGER)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS INTEGER)) AS kept FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

#: The derived tables link no pages; aliases are held against brute force in the tests.
_OP7 = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(kind, h, p)),
b AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS kind FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)"""

_OP8 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(text) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|\[TURN |\[/TURN\]')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

#: Where SQL cannot express an operator the tests hold it against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": _OP2,
    "op4_near_duplicates": _OP4,
    "op5_repeated_strings": _OP5,
    "op7_url_verdicts": _OP7,
    "op8_chat_round_trip": _OP8,
}
