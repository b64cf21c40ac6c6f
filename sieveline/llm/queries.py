"""The queries of this package and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import mixing
from sieveline.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.simhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.quality import judge

    return judge(spark, table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.toxicity import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.mixing import mix_documents

    return mix_documents(spark, table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.pages import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.scoring import score_documents

    return score_documents(spark, table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.substrings import deduplicate

    return deduplicate(spark, table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.llm.topk import exact_topk

    return exact_topk(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_outliers, op3_secret_scan, op4_toxicity, op5_best_fit_packing, op6_source_mixing, op7_html_main_text, op8_attention_scores, op9_substring_dedup, op10_exact_topk)}

SQL = {
    "op6_source_mixing": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS sidx FROM d GROUP BY source),
s1 AS (SELECT *, CAST(list_extract({list(mixing.WEIGHTS)}, (sidx - 1) % {len(mixing.WEIGHTS)} + 1) AS DOUBLE) AS w, CAST(s AS DOUBLE) * {mixing.CAP} AS cap FROM s0),
s2 AS (
  SELECT *, cap / w AS ratio,
         (sum(CAST(s AS DOUBLE)) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s1 WINDOW before AS (ORDER BY cap / w, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT source, sidx, s, least(cap, coalesce(max(level) FILTER (ratio >= level) OVER (), 0) * w) AS target FROM s2),
b AS (SELECT greatest(1, CAST(ceil(sum(size) / {float(mixing.SLOTS)}) AS BIGINT)) AS block FROM d),
s4 AS (SELECT s3.*, block, CAST(round(target) AS BIGINT) AS goal, (s + block - 1) // block AS blocks FROM s3, b),
s5 AS (SELECT *, CASE WHEN s > 0 THEN goal // s * blocks + (goal % s + block - 1) // block ELSE 0 END AS need FROM s4),
s6 AS (SELECT *, sum(need) OVER (ORDER BY sidx) - need AS lo FROM s5),
n AS (SELECT CAST(sum(need) AS BIGINT) AS total FROM s6),
k AS (SELECT unnest(range(0, total)) AS slot, total FROM n),
x AS (SELECT slot, total, (slot + 0.5::DOUBLE) * {mixing.GOLDEN}::DOUBLE AS x FROM k),
p AS (SELECT slot, least(CAST(floor((x - floor(x)) * total) AS BIGINT), total - 1) AS place FROM x),
r AS (SELECT slot, sidx, blocks, row_number() OVER (PARTITION BY sidx ORDER BY slot) - 1 AS rank FROM p JOIN s6 ON place >= lo AND place < lo + need),
t AS (SELECT sidx, rank % blocks AS block_no, count(*) AS times, min(slot) AS slot FROM r WHERE rank < {mixing.CAP} * blocks GROUP BY ALL),
a AS (
  SELECT row, doc_id, size, s, target, sidx, block, sum(size) OVER (PARTITION BY sidx ORDER BY key, row) - size AS a
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), c AS (SELECT *, unnest(range(CAST(a // block AS BIGINT), CAST((a + size - 1) // block + 1 AS BIGINT))) AS block_no FROM a WHERE size > 0),
o AS (
  SELECT row, sum(times * (least(a + size, (c.block_no + 1) * block) - greatest(a, c.block_no * block))) AS taken, min(slot) AS first_slot
  FROM c JOIN t USING (sidx, block_no) GROUP BY row
)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(first_slot, -1) AS first_slot FROM a LEFT JOIN o USING (row)
""",
    "op9_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS win FROM d, unnest(range(1, len(ws) - 48)) AS t(i)
), f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, list(w.i) AS starts FROM w JOIN f USING (win) WHERE w.doc_id > f.first GROUP BY w.doc_id),
c AS (SELECT g.doc_id, list_distinct(flatten(list_transform(g.starts, lambda i: range(i, i + 50)))) AS gone FROM g),
k AS (
  SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS r,
         list_filter(ws, lambda w, i: NOT list_contains(coalesce(gone, []), i)) AS kept
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
}
