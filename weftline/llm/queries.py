"""Queries of the training-data problems, with the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import distinctive, encoding, fused_ranking, mixing, residue, same_product
from weftline.runtime import table


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every listing with its score against the whole catalogue."""
    items, meta = table(spark, sf_dir, "catalog_items"), table(spark, sf_dir, "catalog_meta")
    n = items.select("parent_asin").distinct().count()
    return distinctive.tf_idf(distinctive.listing_terms(items, meta), "parent_asin", "terms", n)


P1_SQL = r"""
WITH titles AS (SELECT parent_asin, max(title) AS title FROM catalog_items GROUP BY parent_asin),
vocab AS (SELECT parent_asin, max(vocab) AS vocab FROM catalog_meta GROUP BY parent_asin),
terms AS (
  SELECT parent_asin, list_concat(
    coalesce(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), []), coalesce(regexp_extract_all(lower(vocab), '\S+'), [])) AS terms
  FROM titles LEFT JOIN vocab USING (parent_asin)),
pairs AS (
  SELECT parent_asin, length, term, count(*) AS tf
  FROM (SELECT parent_asin, len(terms) AS length, unnest(terms) AS term FROM terms) GROUP BY ALL),
frequencies AS (SELECT term, count(*) AS df FROM pairs GROUP BY term),
size AS (SELECT count(*) AS n FROM titles)
SELECT parent_asin, term, tf, df, round(tf / length * ln((1.0 + n) / (1.0 + df)), 9) AS score
FROM pairs JOIN frequencies USING (term), size
"""


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every request in one ranking."""
    return fused_ranking.fuse(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "catalog_meta"))[0]


def p3_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each score weighs in the ranking, and which builds log it upside down."""
    learned = fused_ranking.fuse(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "catalog_meta"))[1]
    return spark.createDataFrame([(x["score"], x["direction"], round(x["loading"], 6), x["upside_down"]) for x in learned],
                                 "score string, direction int, loading double, upside_down array<string>")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of the same product."""
    return same_product.same_pairs(same_product.cluster(table(spark, sf_dir, "catalog_items")))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identified listing with the key of its product."""
    return same_product.cluster(table(spark, sf_dir, "catalog_items"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_column(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids and whether their raw bytes are those of the text (null counts as empty)."""
    encoded = encoding.encode_column(table(spark, sf_dir, "documents"), keep=("doc_id", "text"))
    same = encoding.decode_column("ids") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), same.alias("same"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixtures of all plans in training order."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached, per plan and source."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, or error and script pages."""
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with the kind of residue."""
    return residue.find_residue(table(spark, sf_dir, "documents"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    return residue.without_residue(table(spark, sf_dir, "documents"))


QUERIES = {"p1_scores": p1_scores, "p3_ranking": p3_ranking, "p3_loadings": p3_loadings, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_kinds": p8_kinds, "p8_clean": p8_clean}
SQL: dict[str, str] = {"p1_scores": P1_SQL}
