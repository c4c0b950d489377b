"""Queries of the operators in this package and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.cooccurrence import together
from lodestrata.llm.encode import token_ids
from lodestrata.llm.garbled import garbled
from lodestrata.llm.handwritten import named_files, not_handwritten
from lodestrata.llm.mixing import domain_posteriors, mix
from lodestrata.llm.names import variant_pairs
from lodestrata.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return together(table(spark, d, "commit_parts")).select("item_kind", "item_a", "item_b").distinct()


def p1_lift(spark: SparkSession, d: str) -> DataFrame:
    return together(table(spark, d, "commit_parts")).drop("repo_cell")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(table(spark, d, "author_identities"), table(spark, d, "commit_parts"), table(spark, d, "raw_commits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "source_files")).select("path")


def p6_named(spark: SparkSession, d: str) -> DataFrame:
    return named_files(table(spark, d, "commit_parts"), table(spark, d, "snippets"), table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Where the documents without a source seem to come from."""
    return domain_posteriors(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_lift": p1_lift,
    "p2_found": p2_found,
    "p6_found": p6_found,
    "p6_named": p6_named,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_posteriors": p8_posteriors,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_PAIRS = """
inc AS (
  SELECT DISTINCT repo, commit_hash, kind, item FROM (
    SELECT repo, commit_hash, 'file' AS kind, file AS item FROM commit_parts
    UNION ALL
    SELECT repo, commit_hash, 'component', CASE WHEN component NOT IN ('', 'Unknown') THEN component END FROM commit_parts)
  WHERE item IS NOT NULL),
total AS (SELECT repo, COUNT(DISTINCT commit_hash) AS n FROM commit_parts GROUP BY 1),
single AS (SELECT repo, kind, item, COUNT(*) AS n FROM inc GROUP BY 1, 2, 3),
pair AS (
  SELECT a.repo, a.kind, a.item AS x, b.item AS y, COUNT(*) AS n FROM inc a
  JOIN inc b ON a.repo = b.repo AND a.kind = b.kind AND a.commit_hash = b.commit_hash AND a.item < b.item
  GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 5),
cases AS (
  SELECT p.kind AS item_kind, p.x AS item_a, p.y AS item_b, p.n AS n_ab, sa.n AS n_a, sb.n AS n_b, t.n AS n_commits,
    ROUND(p.n * t.n / (sa.n * sb.n)::DOUBLE, 6) AS lift
  FROM pair p
  JOIN single sa ON sa.repo = p.repo AND sa.kind = p.kind AND sa.item = p.x
  JOIN single sb ON sb.repo = p.repo AND sb.kind = p.kind AND sb.item = p.y
  JOIN total t ON t.repo = p.repo
  WHERE p.n * 2 >= sa.n AND p.n * 2 >= sb.n AND p.n * t.n >= 4 * sa.n * sb.n)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT DISTINCT item_kind, item_a, item_b FROM cases",
    "p1_lift": f"WITH {_PAIRS} SELECT * FROM cases",
}
