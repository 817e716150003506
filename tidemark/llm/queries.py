"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hmm, html_text, lang_id, line_dedup, mixing, secrets, sharding, simhash

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.encode("text", "utf-8"), 256)
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), listed.alias("dropped"), digest.alias("clean_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", lang_id.held_out(F.col("doc_id"), 4, 2))
    model = lang_id.train(docs.where("not held_out"))
    return lang_id.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), lang_id.held_out(F.col("doc_id"), 5, 1))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "items", "best_share")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_line_dedup, op2_exact_dedup, op3_mixing, op4_secret_scan, op5_language_id,
        op6_html_extraction, op7_lm_scoring, op8_decontamination, op9_sharding, op10_simhash,
    )
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
c AS (SELECT doc_id, n, pos, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
s AS (SELECT doc_id, pos AS a, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM c),
pairs AS (SELECT s.doc_id, s.a, c.pos + 1 AS b FROM s JOIN c ON s.doc_id = c.doc_id AND c.pos >= s.a AND c.upto - s.before >= 50),
runs AS (SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a UNION SELECT doc_id, max(a) AS a, b FROM pairs GROUP BY doc_id, b),
named AS (SELECT runs.doc_id, a, b, array_to_string(ls[a + 1:b], chr(10)) AS name FROM runs JOIN d ON d.doc_id = runs.doc_id),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, a) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS pos FROM later),
spans AS (SELECT doc_id, min(pos) AS first, max(pos) + 1 AS last FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM gone) GROUP BY doc_id, part),
cut AS (SELECT doc_id, CAST(sum(last - first) AS BIGINT) AS n_dropped, string_agg(first || ':' || last, ',' ORDER BY first) AS dropped FROM spans GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos WHERE gone.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, sha256(coalesce(kept.text, '')) AS clean_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Pages of the table label their content with one article element and use few character references.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br|ul|li|div)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS raw FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS raw FROM t),
x AS (SELECT page_id, url, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM x
"""

OP9_SQL = """
WITH tab AS (SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)),
b AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS text_crc32,
    CAST(substr(list_max(list_transform(range(0, 40), lambda k: md5(doc_id::VARCHAR || ':' || k::VARCHAR) || lpad(k::VARCHAR, 6, '0'))), 33) AS INTEGER) AS shard,
    CAST(substr(list_max(list_transform(range(0, 41), lambda k: md5(doc_id::VARCHAR || ':' || k::VARCHAR) || lpad(k::VARCHAR, 6, '0'))), 33) AS INTEGER) AS grown_shard FROM b, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_html_extraction": OP6_SQL, "op9_sharding": OP9_SQL}
