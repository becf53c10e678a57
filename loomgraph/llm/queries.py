"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, fingerprints, fixity, linededup, maxent, mixing, neardup, pii, quality, spandedup
from loomgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_frequent_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


ORACLE_SQL["op2_line_dedup"] = linededup.ORACLE_SQL


@query
def op3_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


@query
def op4_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spandedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "sentences_removed")


@query
def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL["op5_merkle_fingerprints"] = fingerprints.ORACLE_SQL


@query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as two replicas: by the MD5 of their address some records are damaged or lost in the second, and some are lost in the first."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.md5("url"), 1, 1)
    damaged = pages.withColumn("html", F.when(mark.isin("0", "7"), F.overlay("html", F.lit("#"), F.lit(4))).otherwise(F.col("html")))
    primary = fixity.archive(pages).join(pages.filter(mark == "c").select("page_id"), "page_id", "left_anti")
    replica = fixity.archive(damaged).join(pages.filter(mark == "a").select("page_id"), "page_id", "left_anti")
    return fixity.audit(primary, replica)


def _levels(side: str) -> str:
    """The tree of one replica, up to six levels of ranges; ``depth`` is the level of the roots."""
    first = f"""{side}1 AS (SELECT file, pos // {fixity.RANGE} AS pos, sha256(string_agg(seal, '' ORDER BY pos)) AS seal FROM {side}0 GROUP BY 1, 2)"""
    return ", ".join([first, *(f"{side}{k} AS (SELECT file, pos // {fixity.FAN_OUT} AS pos, sha256(string_agg(seal, '' ORDER BY pos)) AS seal FROM {side}{k - 1} GROUP BY 1, 2)" for k in range(2, 7))])


def _root(side: str) -> str:
    return " UNION ALL ".join(f"SELECT file, seal FROM {side}{k}, depth WHERE pos = 0 AND d = {k}" for k in range(1, 7))


ORACLE_SQL["op6_warc_fixity"] = f"""
WITH rec AS (
  SELECT page_id, page_id // {fixity.RECORDS_A_FILE} AS file, left(md5(url), 1) AS mark, url, html AS whole,
    CASE WHEN left(md5(url), 1) IN ('0', '7') THEN left(html, 3) || '#' || substr(html, 5) ELSE html END AS spoilt
  FROM pages
), written AS (
  SELECT page_id, file, mark, own, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url
      || '\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(body) || '\r\n\r\n' || body || '\r\n\r\n' AS record
  FROM (SELECT *, true AS own, whole AS body FROM rec UNION ALL SELECT *, false, spoilt FROM rec)
), placed AS (
  SELECT page_id, file, mark, own, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file, own ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM written
), sealed AS (SELECT *, sha256(pos || '|' || length || '|' || digest) AS seal FROM placed),
a0 AS (SELECT * FROM sealed WHERE own AND mark <> 'c'), b0 AS (SELECT * FROM sealed WHERE NOT own AND mark <> 'a'),
{_levels("a")}, {_levels("b")},
depth AS (
  SELECT CASE {" ".join(f"WHEN top < {fixity.RANGE * fixity.FAN_OUT ** (k - 1)} THEN {k}" for k in range(1, 7))} END AS d
  FROM (SELECT max(pos) AS top FROM (SELECT pos FROM a0 UNION ALL SELECT pos FROM b0))
), roots_a AS ({_root("a")}), roots_b AS ({_root("b")}),
found AS (
  SELECT coalesce(a0.file, b0.file) AS file, coalesce(a0.pos, b0.pos) AS pos, coalesce(a0.length, b0.length) AS length,
    CASE WHEN b0.seal IS NULL THEN 'missing' WHEN a0.seal IS NULL THEN 'extra' ELSE 'corrupt' END AS kind, a0.digest AS mine, b0.digest AS theirs
  FROM a0 FULL JOIN b0 ON a0.file = b0.file AND a0.pos = b0.pos WHERE a0.seal IS DISTINCT FROM b0.seal
)
SELECT f.file, f.pos AS "offset", f.length, f.kind, f.mine AS primary_digest, f.theirs AS replica_digest, a.seal AS primary_root, b.seal AS replica_root
FROM found f LEFT JOIN roots_a a ON f.file = a.file LEFT JOIN roots_b b ON f.file = b.file
"""


@query
def op7_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


@query
def op8_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_order_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))
