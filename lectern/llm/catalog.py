"""The registered queries of this subpackage and, where SQL can say it, the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import urls
from lectern.llm.ball_tree import search_embeddings
from lectern.llm.hard_negatives import NEGATIVES_SQL, mine
from lectern.llm.language import identify_held_out
from lectern.llm.licenses import scan
from lectern.llm.manifest import manifest_sql, prove_documents
from lectern.llm.merkle import fingerprint_documents
from lectern.llm.mixture import mix
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.packing import pack_documents
from lectern.llm.pii import pseudonymize
from lectern.llm.quality import judge_quality, quality_sql
from lectern.llm.shared import table
from lectern.llm.toxicity import rate_documents

Query = Callable[[SparkSession, str], DataFrame]

#: For the queries here; a deployment takes its own from its secret store.
PII_KEY = "lectern-demonstration-key"


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_held_out(table(spark, folder, "documents"))


def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search_embeddings(table(spark, folder, "embeddings"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    done = pseudonymize(table(spark, folder, "documents"), PII_KEY)
    return done.select("doc_id", "text", "private", "private_kinds")


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return rate_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return prove_documents(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mine(table(spark, folder, "embeddings"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS slot
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
c AS (SELECT level FROM l WHERE cap > w * level ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM c) = 0 OR cap <= w * (SELECT level FROM c) THEN cap ELSE w * (SELECT level FROM c) END AS target
  FROM o),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM g),
b AS (SELECT source, slot, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, slot),
p AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b),
q AS (
  SELECT r.source, p.slot AS cut, CAST(r.rest - p.before AS DOUBLE) / p.n AS part
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source WHERE p.before <= r.rest AND r.rest < p.before + p.n)
SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
       CAST(r.whole * d.size + CASE WHEN d.slot < coalesce(q.cut, 4096) THEN d.size
            WHEN d.slot = q.cut THEN floor(d.size * q.part + 0.5) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN q ON r.source IS NOT DISTINCT FROM q.source
"""

OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, CAST(vec_id AS BIGINT) AS vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op7_sql() -> str:
    """The automaton's counts by one regular expression a term, over text whose separators are doubled so that
    neighbouring terms do not share one."""
    def count(terms: tuple[str, ...], each: str) -> str:
        return " + ".join(each.format("[^a-z0-9]" + t.replace("-", "--") + "[^a-z0-9]") for t in terms)

    strict = count(urls.STRICT, "len(regexp_extract_all(s, '{}'))")
    soft = count(urls.SOFT, "CAST(regexp_matches(s, '{}') AS INTEGER)")
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in urls.RULES)
    return rf"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(' ' || translate(coalesce(url, ''), '{urls._UPPER}', '{urls._LOWER}') || ' ', '([^a-z0-9])', '\1\1', 'g') AS s
  FROM pages),
c AS (SELECT *, CAST({strict} AS INTEGER) AS strict_hits, CAST({soft} AS INTEGER) AS soft_terms FROM u),
r(h, p, v) AS (VALUES {rules}),
m AS (
  SELECT n, max_by(h || p, len(h || p)) AS rule, max_by(v, len(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN strict_hits > 0 OR soft_terms >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_terms
FROM c LEFT JOIN m USING (n)
"""


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_mixture": op4_mixture,
    "op5_topk": op5_topk,
    "op6_fingerprints": op6_fingerprints,
    "op7_urls": op7_urls,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_manifest": op11_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality": op13_quality,
}

ORACLE: dict[str, str] = {
    "op4_mixture": OP4_SQL, "op5_topk": OP5_SQL, "op7_urls": _op7_sql(), "op11_manifest": manifest_sql(), "op12_hard_negatives": NEGATIVES_SQL,
    "op13_quality": quality_sql(),
}
