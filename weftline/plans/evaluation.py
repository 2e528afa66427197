"""Evaluation queries over session verdicts, targets and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.functions.text import search_terms
from weftline.operators import metrics
from weftline.operators.prefix import below_each
from weftline.operators.session import SLICE
from weftline.plans.messages import MESSAGES_SQL, T_SQL, messages
from weftline.plans.pool import FUSED_SQL, MEMBERS_SQL, VOCAB_SQL, members, meta_vocab, rrf_fusion
from weftline.runtime import table


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "verdicts")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(verdicts(spark, sf_dir))


def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(verdicts(spark, sf_dir), "scenario_type")


def session_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return v.select("sample_id", metrics.session_composite(F.col("hit"), F.col("reciprocal_rank"), F.col("first_hit_turn")).alias("composite"))


def mttc_given_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).filter("hit").groupBy("scenario_type").agg(F.count("*").alias("hits"), F.round(F.avg("first_hit_turn"), 6).alias("mean_turn"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sessions whose best rank is within k; all k in one pass."""
    ks = (1, 3, 5, 10)
    row = verdicts(spark, sf_dir).agg(*[F.round(F.avg(F.coalesce((F.col("best_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"r{k}") for k in ks])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of sessions with the product they are after; a session's first sample holds."""
    s = table(spark, sf_dir, "sessions").groupBy("session_id").agg(F.min_by("ground_truth.parent_asin", "sample_id").alias("target"))
    return messages(spark, sf_dir).join(s, "session_id").select("request_id", "session_id", "turn", "target")


def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each request's target in the logged pool, null where it isn't in it."""
    found = table(spark, sf_dir, "candidates").groupBy("request_id", "parent_asin").agg(F.min("pool_pos").alias("place"))
    return targets(spark, sf_dir).join(found.withColumnRenamed("parent_asin", "target"), ["request_id", "target"], "left")


def rank_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("place")
    bucket = F.when(p <= 10, "top 10").when(p <= 50, "11-50").when(p.isNotNull(), "51 and later").otherwise("not retrieved")
    return target_ranks(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("requests"))


def loss_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the furthest stage their target reached in any request."""
    best = target_ranks(spark, sf_dir).groupBy("session_id").agg(F.min("place").alias("best"))
    stage = F.when(F.col("best") <= 10, "shown").when(F.col("best").isNotNull(), "in pool").otherwise("never retrieved")
    return best.groupBy(stage.alias("stage")).agg(F.count("*").alias("sessions"))


def first_turn_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of each session in which its target was in the pool, and in which it was among the first ten."""
    return target_ranks(spark, sf_dir).groupBy("session_id").agg(
        F.min(F.when(F.col("place").isNotNull(), F.col("turn"))).alias("first_in_pool"), F.min(F.when(F.col("place") <= 10, F.col("turn"))).alias("first_shown"))


def recovery_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the turns between their target's first entry into the pool and its first place among ten."""
    f = first_turn_where(spark, sf_dir).filter(F.col("first_in_pool").isNotNull())
    return f.groupBy((F.col("first_shown") - F.col("first_in_pool")).alias("latency")).agg(F.count("*").alias("sessions"))


def disclosed_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of different words a session has used up to each request, repeats of the turn count included.

    A word counts at the first request that has it, so running sums of those take the place of growing sets.
    """
    words = messages(spark, sf_dir).select("session_id", "request_id", F.explode(F.array_distinct(search_terms(F.col("user_message")))).alias("term"))
    news = words.groupBy("session_id", "term").agg(F.min("request_id").alias("request_id")).groupBy("session_id", "request_id").agg(F.count("*").alias("n_new"))
    rows = messages(spark, sf_dir).select("session_id", "request_id").join(news, ["session_id", "request_id"], "left").withColumn("n", F.coalesce("n_new", F.lit(0)))
    # A session is cut into slices of ids, which bound the window; earlier slices give an offset.
    sliced = rows.withColumn("slice", F.floor(F.col("request_id") / SLICE))
    totals = sliced.groupBy("session_id", "slice").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("session_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("session_id", "slice", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("session_id", "slice").orderBy("request_id")
    return sliced.withColumn("local", F.sum("n").over(upto)).join(offsets, ["session_id", "slice"]).select(
        "session_id", "request_id", (F.col("local") + F.col("offset")).alias("n_words"))


def overlap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by how many of their words their target's vocabulary holds."""
    said = messages(spark, sf_dir).select("request_id", F.array_distinct(search_terms(F.col("user_message"))).alias("said"))
    both = targets(spark, sf_dir).join(said, "request_id").join(meta_vocab(spark, sf_dir).withColumnRenamed("parent_asin", "target"), "target", "left")
    n = F.coalesce(F.size(F.array_intersect("said", "terms")), F.lit(0))
    bucket = F.when(n <= 0, "0").when(n <= 2, "1-2").when(n <= 4, "3-4").otherwise("5 or more")
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("requests"))


def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistics of pool sizes by agent build."""
    sizes = table(spark, sf_dir, "candidates").groupBy("build_tag", "request_id").agg(F.countDistinct("parent_asin").alias("size"))
    return metrics.order_statistics(sizes, "build_tag", "size")


def target_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the targets' popularity lies in the catalogue: share of listings below each target."""
    meta = table(spark, sf_dir, "catalog_meta").filter(F.col("popularity").isNotNull()).select("parent_asin", "popularity")
    counts = meta.groupBy("popularity").agg(F.count("*").alias("n"))
    share = below_each(counts, "popularity", "n", "rows_below").select("popularity", (F.col("rows_below") / F.lit(meta.count())).alias("below"))
    t = table(spark, sf_dir, "sessions").select("sample_id", F.col("ground_truth.parent_asin").alias("parent_asin")).join(meta, "parent_asin")
    return t.join(share, "popularity").select("sample_id", F.round("below", 6).alias("below"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outcomes of each request: target among the first ten of the logged pool, and of the fused one."""
    logged = target_ranks(spark, sf_dir).select("request_id", "target", F.coalesce(F.col("place") <= 10, F.lit(False)).alias("before"))
    fused = rrf_fusion(spark, sf_dir).select("request_id", F.col("parent_asin").alias("target"), F.col("pool_pos").alias("after_place"))
    return logged.join(fused, ["request_id", "target"], "left").withColumn("after", F.coalesce(F.col("after_place") <= 10, F.lit(False)))


def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).groupBy("before", "after").agg(F.count("*").alias("requests"))


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mcnemar(_paired(spark, sf_dir), "before", "after")


def paired_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paired(spark, sf_dir).select("request_id", (F.col("after").cast("int") - F.col("before").cast("int")).alias("d"))
    return metrics.sign_flips(d, "request_id", "d")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(session_composite(spark, sf_dir), "sample_id", "composite")


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with both a verdict and requests."""
    s = table(spark, sf_dir, "sessions")
    return s.join(verdicts(spark, sf_dir).select("sample_id"), "sample_id", "left_semi").select("session_id").intersect(table(spark, sf_dir, "turns").select("session_id"))


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a verdict."""
    return table(spark, sf_dir, "sessions").select("sample_id").subtract(verdicts(spark, sf_dir).select("sample_id"))


def target_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by how fusion moves their target against the logged pool."""
    both = target_ranks(spark, sf_dir).join(rrf_fusion(spark, sf_dir).select("request_id", F.col("parent_asin").alias("target"), "pool_pos"), ["request_id", "target"])
    move = F.when(F.col("pool_pos") < F.col("place"), "up").when(F.col("pool_pos") > F.col("place"), "down").otherwise("same")
    return both.groupBy(move.alias("move")).agg(F.count("*").alias("requests"), F.round(F.avg(F.col("pool_pos") - F.col("place")), 6).alias("mean_move"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by event type: the batch form of the streaming query."""
    from weftline.streaming.windows import hourly

    return hourly(table(spark, sf_dir, "events"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events with gaps under 30 minutes."""
    e = table(spark, sf_dir, "events").filter(F.col("ts").isNotNull())
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return w.select("user_id", F.col("w.start").alias("started"), "events")


QUERIES = {f.__name__: f for f in (
    metric_summary, scenario_metrics, session_composite, mttc_given_hit, recall_at_k, rank_buckets, loss_funnel, first_turn_where, recovery_latency,
    disclosed_so_far, overlap_buckets, percentile_summary, target_percentile, paired_diff, mcnemar, paired_permutation, bootstrap_ci, set_intersect,
    set_except, target_movement, event_windows, session_windows)}

SUMMARY = """SELECT {0} *, round(0.5::DOUBLE * hit_rate + 0.3::DOUBLE * mrr + 0.2::DOUBLE * coalesce(efficiency, 0), 6) AS composite FROM (
  SELECT *, round(greatest(0.0, least(1.0, (11 - mttc) / 10)), 6) AS efficiency FROM (
  SELECT {1} count(*) AS sessions, round(coalesce(avg(coalesce(hit, false)::INT::DOUBLE), 0), 6) AS hit_rate, round(coalesce(avg(coalesce(reciprocal_rank, 0)), 0), 6) AS mrr,
  round(avg(coalesce(first_hit_turn, 11)::DOUBLE), 6) AS mttc FROM verdicts {2}))"""
TARGETS_SQL = """targets AS (SELECT request_id, session_id, turn, target FROM messages JOIN (SELECT DISTINCT ON (session_id) session_id, ground_truth.parent_asin AS target FROM sessions ORDER BY session_id, sample_id) USING (session_id)),
target_ranks AS (SELECT t.*, place FROM targets t LEFT JOIN (SELECT request_id, parent_asin, min(pool_pos) AS place FROM candidates GROUP BY ALL) c ON t.request_id = c.request_id AND t.target = c.parent_asin)"""
RANKS = f"WITH {MESSAGES_SQL}, {TARGETS_SQL}"
FIRST_SQL = "firsts AS (SELECT session_id, min(turn) FILTER (place IS NOT NULL) AS first_in_pool, min(turn) FILTER (place <= 10) AS first_shown FROM target_ranks GROUP BY session_id)"
PAIRED_SQL = f"{RANKS}, {FUSED_SQL}, paired AS (SELECT t.request_id, coalesce(place <= 10, false) AS before, coalesce(pool_pos <= 10, false) AS after FROM target_ranks t LEFT JOIN pool p ON t.request_id = p.request_id AND t.target = p.parent_asin)"
SQL = {
    "metric_summary": SUMMARY.format("", "", ""),
    "scenario_metrics": SUMMARY.format("", "scenario_type,", "GROUP BY scenario_type"),
    "session_composite": "SELECT sample_id, round(0.5::DOUBLE * coalesce(hit, false)::INT + 0.3::DOUBLE * coalesce(reciprocal_rank, 0) + 0.2::DOUBLE * greatest(0, least(1, (11 - coalesce(first_hit_turn, 11)) / 10)), 6) AS composite FROM verdicts",
    "mttc_given_hit": "SELECT scenario_type, count(*) AS hits, round(avg(first_hit_turn), 6) AS mean_turn FROM verdicts WHERE hit GROUP BY scenario_type",
    "recall_at_k": " UNION ALL ".join(f"SELECT {k} AS k, round(avg(coalesce((best_rank <= {k})::INT, 0)), 6) AS recall FROM verdicts" for k in (1, 3, 5, 10)),
    "rank_buckets": f"{RANKS} SELECT CASE WHEN place <= 10 THEN 'top 10' WHEN place <= 50 THEN '11-50' WHEN place IS NOT NULL THEN '51 and later' ELSE 'not retrieved' END AS bucket, count(*) AS requests FROM target_ranks GROUP BY 1",
    "loss_funnel": f"{RANKS} SELECT CASE WHEN best <= 10 THEN 'shown' WHEN best IS NOT NULL THEN 'in pool' ELSE 'never retrieved' END AS stage, count(*) AS sessions FROM (SELECT session_id, min(place) AS best FROM target_ranks GROUP BY session_id) GROUP BY 1",
    "first_turn_where": f"{RANKS}, {FIRST_SQL} SELECT * FROM firsts",
    "recovery_latency": f"{RANKS}, {FIRST_SQL} SELECT first_shown - first_in_pool AS latency, count(*) AS sessions FROM firsts WHERE first_in_pool IS NOT NULL GROUP BY 1",
    "disclosed_so_far": f"""WITH {MESSAGES_SQL}, words AS (SELECT DISTINCT session_id, request_id, unnest({T_SQL}) AS term FROM messages)
      SELECT m.session_id, m.request_id, count(DISTINCT w.term) AS n_words FROM messages m LEFT JOIN words w ON w.session_id = m.session_id AND w.request_id <= m.request_id GROUP BY ALL""",
    "overlap_buckets": f"""{RANKS}, {VOCAB_SQL}, overlap AS (SELECT request_id, coalesce(len(list_intersect(said, terms)), 0) AS n FROM targets JOIN (SELECT request_id, list_distinct({T_SQL}) AS said FROM messages) USING (request_id) LEFT JOIN vocab ON target = vocab.parent_asin)
      SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5 or more' END AS bucket, count(*) AS requests FROM overlap GROUP BY 1""",
    "percentile_summary": """SELECT build_tag, round(avg(size), 6) AS mean, l[len(l) // 2 + 1] AS median, l[least(len(l) - 1, floor(len(l) * 0.9)::BIGINT) + 1] AS p90, max(size) AS highest FROM (
      SELECT build_tag, size, list_sort(list(size) OVER (PARTITION BY build_tag)) AS l FROM (SELECT build_tag, request_id, count(DISTINCT parent_asin) AS size FROM candidates GROUP BY ALL)) GROUP BY ALL""",
    "target_percentile": """WITH meta AS (SELECT parent_asin, popularity AS v FROM catalog_meta WHERE popularity IS NOT NULL)
      SELECT sample_id, round(cast((SELECT count(*) FROM meta m WHERE m.v < t.v) AS DOUBLE) / (SELECT count(*) FROM meta), 6) AS below FROM sessions s JOIN meta t ON s.ground_truth.parent_asin = t.parent_asin""",
    "paired_diff": f"{PAIRED_SQL} SELECT before, after, count(*) AS requests FROM paired GROUP BY ALL",
    "mcnemar": f"""{PAIRED_SQL}, counts AS (SELECT count(*) FILTER (after AND NOT before) AS gained, count(*) FILTER (before AND NOT after) AS lost FROM paired)
      SELECT gained, lost, round(least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))), 9) AS p FROM counts""",
    "set_intersect": "SELECT session_id FROM sessions WHERE sample_id IN (SELECT sample_id FROM verdicts) INTERSECT SELECT session_id FROM turns",
    "set_except": "SELECT sample_id FROM sessions EXCEPT SELECT sample_id FROM verdicts",
    "target_movement": f"""{RANKS}, {FUSED_SQL} SELECT CASE WHEN pool_pos < place THEN 'up' WHEN pool_pos > place THEN 'down' ELSE 'same' END AS move, count(*) AS requests, round(avg(pool_pos - place), 6) AS mean_move
      FROM target_ranks t JOIN pool p ON t.request_id = p.request_id AND t.target = p.parent_asin GROUP BY 1""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "session_windows": """SELECT user_id, min(ts) AS started, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, burst""",
}
