"""Queries over what sessions and requests say beyond single slots: free evidence, profiles, openings, and their effect on ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import extract, lexicon as lex, text
from weftline.operators import catalog
from weftline.operators.catalog import TAG_TRAITS
from weftline.plans import pool
from weftline.plans.messages import FIRST, MESSAGES_SQL, SIGNALS_SQL, T_SQL, _list, messages, products
from weftline.plans.search import PRODUCTS_SQL
from weftline.runtime import table

#: Words of a message that mark slots, corrections or the act of shopping, and carry no wish of their own.
FRAME = [*lex.MARKER_WORDS, *lex.CORRECTION_WORDS, *lex.FRAMING_WORDS]

def evidence_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each request that no slot and no framing accounts for; a non-answer leaves none."""
    m = F.col("user_message")
    named = text.strings(*lex.CATEGORY_OF, *catalog.COLOURS, *catalog.MATERIALS, *FRAME)
    left = F.filter(text.search_terms(m), lambda t: ~F.array_contains(named, t))
    return messages(spark, sf_dir).select("request_id", F.when(extract.is_non_answer(m), text.empty()).otherwise(F.array_distinct(left)).alias("residual"))


def grounding_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by whether their pool holds words for what they said: their own, mapped ones only, or none."""
    g = pool.ground_terms(spark, sf_dir).groupBy("request_id").agg(F.max((F.col("said") == F.col("term")).cast("int")).alias("own"))
    kind = F.when(F.col("own") == 1, "own words").when(F.col("own") == 0, "mapped only").otherwise("none")
    return messages(spark, sf_dir).join(g, "request_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("requests"))


def profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a session's mapped preference tags that each candidate's traits meet; sessions without mapped tags give no rows."""
    tags = table(spark, sf_dir, "sessions").groupBy("session_id").agg(F.min_by(F.struct("user_profile.preference_tags"), "sample_id").alias("p"))
    rows = list(TAG_TRAITS.items())
    traits = spark.createDataFrame(rows, "tag string, wanted array<string>")  # five rows
    wanted = tags.select("session_id", F.explode(F.array_distinct(F.col("p.preference_tags"))).alias("tag")).join(F.broadcast(traits), "tag")
    per_session = wanted.groupBy("session_id").agg(F.collect_list("wanted").alias("wanted"))  # five at most
    pools = table(spark, sf_dir, "candidates").select("request_id", "session_id", "parent_asin").distinct()
    meta = table(spark, sf_dir, "catalog_meta").select("parent_asin", "traits")
    met = F.size(F.filter("wanted", lambda w: F.arrays_overlap(w, F.coalesce("traits", text.empty())))) / F.size("wanted")
    return pools.join(per_session, "session_id").join(meta, "parent_asin", "left").select("request_id", "parent_asin", F.round(met, 6).alias("share"))


def rank_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request how constraints change the fused ranking: items moved, and how many of the first ten are new.

    An item without a fused place can't move, but is new among the first ten.
    """
    a = pool.rrf_fusion(spark, sf_dir).select("request_id", "parent_asin", "pool_pos")
    b = pool.constraint_rank(spark, sf_dir).select("request_id", "parent_asin", "rank")
    both = b.join(a, ["request_id", "parent_asin"], "left")
    return both.groupBy("request_id").agg(F.count_if(F.col("pool_pos") != F.col("rank")).alias("moved"), F.count_if((F.col("rank") <= 10) & (F.coalesce("pool_pos", F.lit(11)) > 10)).alias("entered"))


def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in whose constraint ranking an item without any match stands above one with a match."""
    r = pool.constraint_rank(spark, sf_dir).groupBy("request_id").agg(
        F.min(F.when(F.col("matched") == 0, F.col("rank"))).alias("best_without"), F.max(F.when(F.col("matched") > 0, F.col("rank"))).alias("worst_with"))
    return r.select("request_id", F.coalesce(F.col("best_without") < F.col("worst_with"), F.lit(False)).alias("inverted"))


def popularity_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity of every product: ``log1p`` of its rating count, null (not 0) where the count is missing or negative."""
    return products(spark, sf_dir).select("parent_asin", F.round(catalog.popularity("rating_number"), 9).alias("popularity"))


QUERIES = {f.__name__: f for f in (
    evidence_residual, grounding_shares, profile_match, rank_sensitivity, inversions, popularity_feature)}

NAMED = _list(list(lex.CATEGORY_OF) + list(catalog.COLOURS) + list(catalog.MATERIALS) + FRAME)
NON = "coalesce(regexp_matches(lower(user_message), '" + extract.NON_ANSWER.replace("'", "''") + "'), false)"
TAG_ROWS = ", ".join(f"('{t}', [{', '.join(repr(w) for w in words)}])" for t, words in TAG_TRAITS.items())
RANKED = pool.SQL["constraint_rank"].rsplit("SELECT request_id, parent_asin, score, matched", 1)
RANK_CTE = RANKED[0] + ", reranked AS (SELECT request_id, parent_asin, score, matched" + RANKED[1] + ")"
SQL = {
    "evidence_residual": f"WITH {MESSAGES_SQL} SELECT request_id, CASE WHEN {NON} THEN [] ELSE {FIRST.format('t')} END AS residual FROM (SELECT request_id, user_message, list_filter({T_SQL}, lambda w: NOT list_contains({NAMED}, w)) AS t FROM messages)",
    "grounding_shares": f"""{pool.BASE}, {pool.SUPPORT}, g AS (SELECT request_id, max(own) AS own FROM (SELECT request_id, 1 AS own FROM said JOIN kept USING (request_id, term)
      UNION ALL SELECT request_id, (said = term)::INT FROM support WHERE support >= 0.05) GROUP BY request_id)
      SELECT CASE WHEN own = 1 THEN 'own words' WHEN own = 0 THEN 'mapped only' ELSE 'none' END AS kind, count(*) AS requests FROM messages LEFT JOIN g USING (request_id) GROUP BY 1""",
    "profile_match": f"""WITH tags AS (SELECT DISTINCT ON (session_id) session_id, user_profile.preference_tags AS t FROM sessions ORDER BY session_id, sample_id),
      wanted AS (SELECT session_id, list(w) AS wanted FROM (SELECT session_id, unnest(list_distinct(t)) AS tag FROM tags) JOIN (VALUES {TAG_ROWS}) v(tag, w) USING (tag) GROUP BY session_id)
      SELECT request_id, parent_asin, round(len(list_filter(wanted, lambda w: list_has_any(w, coalesce(traits, [])))) / len(wanted), 6) AS share
      FROM (SELECT DISTINCT request_id, session_id, parent_asin FROM candidates) JOIN wanted USING (session_id) LEFT JOIN catalog_meta USING (parent_asin)""",
    "rank_sensitivity": f"{RANK_CTE} SELECT request_id, count(*) FILTER (pool_pos != rank) AS moved, count(*) FILTER (rank <= 10 AND coalesce(pool_pos, 11) > 10) AS entered FROM reranked LEFT JOIN pool USING (request_id, parent_asin) GROUP BY request_id",
    "inversions": f"{RANK_CTE} SELECT request_id, coalesce(min(rank) FILTER (matched = 0) < max(rank) FILTER (matched > 0), false) AS inverted FROM reranked GROUP BY request_id",
    "popularity_feature": f"WITH {PRODUCTS_SQL} SELECT parent_asin, CASE WHEN rating_number >= 0 THEN round(ln(1 + rating_number::DOUBLE), 9) END AS popularity FROM products",
}

