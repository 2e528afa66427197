"""Queries over simulated shoppers: their cards and lines, the closed loop, and what its arms show."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.config import CODED, Config
from weftline.functions import extract, lexicon as lex
from weftline.functions.text import strings
from weftline.operators import catalog, metrics, search, shopper, simulate as sim
from weftline.operators.blocks import Blocks
from weftline.plans.messages import CLEAN, FIRST, GENERAL_PARTS, KIND_SQL, SQL as MESSAGE_SQL, coarse_category, coarse_columns, products
from weftline.plans.pool import meta_vocab
from weftline.plans.search import PRODUCTS_SQL, TEXTS_SQL
from weftline.plans.session import SIGNALS, profile_tags
from weftline.runtime import materialize, release, sweep, table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").select("sample_id", "session_id", "scenario_type", F.col("ground_truth.parent_asin").alias("target")).dropDuplicates(["sample_id"])


def intent_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and soft constraints of a buyer of each product."""
    return shopper.card(products(spark, sf_dir))


def aimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their target's card and category."""
    cards = intent_card(spark, sf_dir).drop("target").withColumnRenamed("parent_asin", "target")
    return samples(spark, sf_dir).join(cards, "target").join(coarse_category(spark, sf_dir).withColumnRenamed("parent_asin", "target"), "target")


def sim_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of the simulated shopper of each sample."""
    return aimed(spark, sf_dir).select("sample_id", shopper.opening().alias("message"))


def undisclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that a shopper has not told with the first line."""
    rows = aimed(spark, sf_dir).select("sample_id", F.array_except(F.concat("hard", "soft"), shopper.disclosed_at_first()).alias("left"))
    return rows.select("sample_id", F.explode("left").alias("constraint"))


def sim_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shopper would answer to each question after the first line, and to none."""
    rows = aimed(spark, sf_dir).select("sample_id", "scenario_type", "hard", "soft", shopper.disclosed_at_first().alias("disclosed"), F.lit(False).alias("refused"),
                                       F.explode(F.concat(strings(*lex.ASKABLE), F.array(F.lit(None).cast("string")))).alias("asks"))
    return shopper.replied(rows).select("sample_id", "asks", "reply")


def sim_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a shopper with a change of mind says so, and what."""
    turns = shopper.override_turns(samples(spark, sf_dir)).filter(F.col("override_turn").isNotNull())
    return aimed(spark, sf_dir).join(turns.select("sample_id", "override_turn"), "sample_id").select("sample_id", "override_turn", shopper.override_line().alias("message"))


def first_scoring_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn whose recommendations can count for each sample."""
    return shopper.override_turns(samples(spark, sf_dir)).select("sample_id", F.coalesce("override_turn", F.lit(1)).alias("turn"))


_BLOCKS: dict[tuple, Blocks] = {}


def blocks_of(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> Blocks:
    """The index in blocks, one for a folder in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BLOCKS:
        _BLOCKS[key] = Blocks(products(spark, sf_dir) if every is None else every)
    return _BLOCKS[key]


_RUNS: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def run(spark: SparkSession, sf_dir: str, arms: dict[str, Config] | None = None) -> tuple[DataFrame, DataFrame]:
    """The closed loop over all samples of the tables: verdicts, and a row for every turn.

    A run is a capture that the queries of a session share: it is written once for a folder and its arms, so the tables of the
    folder must not change meanwhile.
    """
    key = (spark.sparkContext.applicationId, sf_dir, tuple((arms or {}).items()))
    if key not in _RUNS:
        meta = table(spark, sf_dir, "catalog_meta")
        known = meta.select(F.when(~F.isnan("popularity"), F.col("popularity")).alias("popularity"))
        scale = catalog.popularity_scale(known).first()  # one row
        # Repeated rows are unchanged copies and are dropped once for all that reads products; cards are made of targets only.
        every = materialize(products(spark, sf_dir).select("parent_asin", "price", *catalog.FIELDS), "products")
        reliability = {r["slot"]: r["reliability"] for r in catalog.coverage(catalog.signals(every.withColumn("rating_number", F.lit(None).cast("bigint")))).collect()}  # six rows
        aimed_at = materialize(every.join(samples(spark, sf_dir).select(F.col("target").alias("parent_asin")).distinct(), "parent_asin", "left_semi"), "targets")
        blocks = blocks_of(spark, sf_dir, every)
        release(every)
        sweep(spark)
        _RUNS[key] = sim.simulate(
            samples(spark, sf_dir), shopper.card(aimed_at), coarse_columns(aimed_at), meta.select(*SIGNALS), meta_vocab(spark, sf_dir), profile_tags(spark, sf_dir),
            blocks, reliability, (scale["highest"], scale["median"]), arms)
        release(aimed_at)
    return _RUNS[key]


def compared(spark: SparkSession, sf_dir: str, arms) -> tuple[DataFrame, DataFrame]:
    """The verdicts and turns of some arms, from one closed loop of all arms there are."""
    verdicts, turns = run(spark, sf_dir, {**LADDER, **SWEEP})
    return verdicts.filter(F.col("arm").isin(*arms)), turns.filter(F.col("arm").isin(*arms))


def simulate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every simulated session."""
    return run(spark, sf_dir)[0].drop("arm")


def simulated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the closed loop: line, question, and the target's places."""
    return run(spark, sf_dir)[1].drop("arm")


#: Arms of the ablation: each adds a stage to the one before.
LADDER = {
    "core": replace(CODED, popularity=False, rerank=False, ask=False),
    "profile": replace(CODED, profile=True, popularity=False, rerank=False, ask=False),
    "confidence": replace(CODED, confidence=True, popularity=False, rerank=False, ask=False),
    "popularity": replace(CODED, rerank=False, ask=False),
    "rerank": replace(CODED, ask=False),
    "ask": CODED,
}


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each step of the ladder, all arms in one closed loop."""
    return metrics.summary(compared(spark, sf_dir, LADDER)[0], "arm")


#: Arms of the parameter sweep.
SWEEP = {
    **{f"popularity {w}": replace(CODED, popularity_weight=w) for w in (0.0, 0.008, 0.05, 0.4)}, "no decay": replace(CODED, decay=False),
    **{f"window {w}": replace(CODED, window=w) for w in (10, 50, 100)}, **{f"floor {f}": replace(CODED, ask_floor=f) for f in (0.0, 0.3)},
    "no open question": replace(CODED, open_questions=0), "coded": CODED,
}


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by parameter, all arms in one closed loop."""
    return metrics.summary(compared(spark, sf_dir, SWEEP)[0], "arm")


def gate_rows(verdicts: DataFrame, steps: list[tuple[str, str]], alpha: float = 0.05) -> DataFrame:
    """``before, after, gained, lost, p_hits, mean, p_score, passes``: whether a step earns its place.

    It does if either test, exact on hits or by sign flips on composites, finds a gain; a significant loss never passes.
    """
    out = None
    score = metrics.session_composite(F.col("hit"), F.col("reciprocal_rank"), F.col("first_hit_turn"))
    v = verdicts.select("arm", "sample_id", F.col("hit"), score.alias("score"))
    for before, after in steps:
        a = v.filter(F.col("arm") == before).select("sample_id", F.col("hit").alias("was"), F.col("score").alias("s0"))
        pairs = a.join(v.filter(F.col("arm") == after).select("sample_id", F.col("hit").alias("is"), F.col("score").alias("s1")), "sample_id").withColumn("d", F.col("s1") - F.col("s0"))
        hits = metrics.mcnemar(pairs, "was", "is").withColumnRenamed("p", "p_hits")
        flips = metrics.sign_flips(pairs, "sample_id", "d").select(F.col("p").alias("p_score"))
        mean = pairs.agg(F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("mean"))
        row = hits.crossJoin(mean).crossJoin(flips).select(F.lit(before).alias("before"), F.lit(after).alias("after"), "gained", "lost", "p_hits", "mean", "p_score")  # one row each
        out = row if out is None else out.unionByName(row)
    gains = ((F.col("p_hits") < alpha) & (F.col("gained") > F.col("lost"))) | ((F.col("p_score") < alpha) & (F.col("mean") > 0))
    return out.withColumn("passes", gains)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder's steps with their tests."""
    names = list(LADDER)
    return gate_rows(compared(spark, sf_dir, LADDER)[0], [("core", n) for n in names[1:4]] + [("popularity", "rerank"), ("rerank", "ask")])


def ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metrics would be if targets that never reached the pool did, and converted as the others do."""
    verdicts, turns = run(spark, sf_dir)
    return extrapolated(verdicts, turns)


def extrapolated(verdicts: DataFrame, turns: DataFrame) -> DataFrame:
    reached = turns.filter(F.col("eligible") & F.col("pool_pos").isNotNull()).select("sample_id").distinct().withColumn("reached", F.lit(True))
    v = verdicts.join(reached, "sample_id", "left")
    row = v.agg(
        F.count("*").alias("n"), F.count_if(F.col("reached").isNull()).alias("missed"), F.count_if("hit").alias("hits"), F.sum("reciprocal_rank").alias("rr"),
        F.sum(F.coalesce("first_hit_turn", F.lit(lex.TURNS + 1))).alias("turn_sum"), F.sum(F.when(F.col("hit"), F.col("first_hit_turn"))).alias("hit_turns"))
    conversion = F.when(F.col("n") > F.col("missed"), F.col("hits") / (F.col("n") - F.col("missed"))).otherwise(0.0)
    row = row.filter("n > 0").withColumn("conversion", conversion).withColumn("recovered", F.col("missed") * F.col("conversion"))
    mean_rr = F.when(F.col("hits") > 0, F.col("rr") / F.col("hits")).otherwise(0.0)
    mean_turn = F.when(F.col("hits") > 0, F.col("hit_turns") / F.col("hits")).otherwise(float(lex.TURNS + 1))
    row = row.withColumn("hit_rate", (F.col("hits") + F.col("recovered")) / F.col("n")).withColumn("mrr", (F.col("rr") + F.col("recovered") * mean_rr) / F.col("n"))
    mttc = (F.col("turn_sum") - F.col("recovered") * (lex.TURNS + 1 - mean_turn)) / F.col("n")
    row = row.withColumn("efficiency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lex.TURNS + 1 - mttc) / lex.TURNS)))
    return row.select("n", "missed", *[F.round(c, 6).alias(c) for c in ("conversion", "recovered", "hit_rate", "mrr", "efficiency")],
                      F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6).alias("composite"))


#: Arms of the depth gate: windows of 50, 100 and 200.
DEPTHS = ("window 50", "window 100", "coded")


def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window of the reranker: ranks reached, failures of retrieval and of ranking, and failures recovered and introduced against the least window."""
    verdicts, turns = compared(spark, sf_dir, DEPTHS)
    reach = turns.filter("eligible").groupBy("arm", "sample_id").agg(F.max(F.col("pool_pos").isNotNull()).alias("reached"))
    v = verdicts.join(reach, ["arm", "sample_id"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    base = verdicts.filter(F.col("arm") == DEPTHS[0]).select("sample_id", F.col("hit").alias("base_hit"))
    return v.join(base, "sample_id").groupBy("arm").agg(
        *[F.count_if(F.col("best_rank") <= k).alias(f"top{k}") for k in (1, 3, 5, 10)], F.count_if(~F.col("hit") & ~F.col("reached")).alias("retrieval_failures"),
        F.count_if(~F.col("hit") & F.col("reached")).alias("ranking_failures"), F.count_if(F.col("hit") & ~F.col("base_hit")).alias("recovered"),
        F.count_if(~F.col("hit") & F.col("base_hit")).alias("introduced"))


#: Depth at which lost targets are looked for.
DEEP = 5000


def miss_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why targets weren't in the pool of an eligible turn: nothing to search by, cut by the cap, wrong words, or not to be found by their own title."""
    _, turns = run(spark, sf_dir)
    blocks, terms = blocks_of(spark, sf_dir), lambda c, n: F.coalesce(F.slice(F.array_distinct(catalog.search_terms(F.col(c))), 1, n), strings())
    lost = turns.filter(F.col("eligible") & F.col("pool_pos").isNull()).join(samples(spark, sf_dir).select("sample_id", "target"), "sample_id")
    lost = materialize(lost.select(F.md5(F.to_json(F.struct("message"))).alias("key"), "sample_id", "turn", "message", "target"), "lost")
    asked = lost.groupBy("key", "target").agg(F.first(terms("message", search.QUERY_TERMS)).alias("terms"))  # lines are said again and again
    deep = blocks.within(materialize(asked, "asked"), DEEP).withColumn("deep", F.lit(True))
    titles = products(spark, sf_dir).select(F.col("parent_asin").alias("target"), "title").join(lost.select("target").distinct(), "target")
    own = blocks.within(materialize(titles.select(F.lit("").alias("key"), "target", terms("title", 20).alias("terms")), "titles"), DEEP).select("target", F.lit(True).alias("own"))
    said = F.size(F.coalesce(catalog.search_terms(F.col("message")), strings()))
    why = F.when(said <= 0, "state").when(F.col("deep"), "cap").when(F.col("own"), "query").otherwise("never retrieved")
    rows = lost.join(deep, ["key", "target"], "left").join(own, "target", "left")
    return rows.select("sample_id", "turn", why.alias("why"))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario, how sessions recover: those that needed a candidate after an informative answer and got it, turns it took, and turns from a change of mind to the pool."""
    _, turns = run(spark, sf_dir)
    eligible = turns.filter("eligible")
    informative = (F.col("turn") > 1) & ~extract.is_non_answer(F.col("message"))
    first = eligible.groupBy("sample_id", "scenario_type").agg(
        F.min("turn").alias("from"), F.min(F.when(informative, F.col("turn"))).alias("answer"), F.min(F.when(F.col("pool_pos").isNotNull(), F.col("turn"))).alias("pool"),
        F.min(F.when(F.col("rank") <= 10, F.col("turn"))).alias("shown"))
    needed = F.col("answer").isNotNull() & (F.col("pool").isNull() | (F.col("pool") >= F.col("answer")))
    late = F.col("pool") - F.col("from")
    override = F.col("scenario_type") == "intent_override"
    return first.groupBy("scenario_type").agg(
        F.count("*").alias("sessions"), F.count_if(needed).alias("needed"), F.count_if(needed & F.col("pool").isNotNull()).alias("recovered"), F.count_if(needed & F.col("pool").isNull()).alias("failed"),
        F.round(F.avg(F.when(needed, F.col("pool") - F.col("answer"))), 6).alias("mean_latency"), F.round(F.avg(F.col("shown") - F.col("pool")), 6).alias("mean_delay"),
        F.count_if(override & (late <= 0)).alias("override_0"), F.count_if(override & (late == 1)).alias("override_1"), F.count_if(override & (late > 1)).alias("override_later"),
        F.count_if(override & F.col("pool").isNull()).alias("override_failed"))


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reranking does to the target on eligible turns: mean places, up, down, into and out of the first ten, and how the stage ended."""
    _, turns = run(spark, sf_dir)
    before, after = F.col("rank_before"), F.col("rank")
    return turns.filter("eligible AND rank IS NOT NULL").groupBy("outcome").agg(
        F.count("*").alias("turns"), F.round(F.avg(before), 6).alias("mean_before"), F.round(F.avg(after), 6).alias("mean_after"), F.count_if(after < before).alias("up"), F.count_if(after > before).alias("down"),
        F.count_if((before > 10) & (after <= 10)).alias("into_ten"), F.count_if((before <= 10) & (after > 10)).alias("out_of_ten"))


QUERIES = {f.__name__: f for f in (
    recovery, movement, intent_card, sim_opening, undisclosed, sim_reply, sim_override, first_scoring_turn, simulate_sessions, simulated_turns, ablation, param_sweep, gate, ceiling, depth_gate, miss_class)}

_text = "concat_ws(' ', " + ", ".join(TEXTS_SQL[f] for f in ("title", "features", "details", "description", "categories", "store")) + ")"
_find = lambda words: f"nullif(lower(regexp_extract({_text}, '(?i)\\b({words})\\b', 1)), '')"
_clean = lambda x: CLEAN.format(x).replace("180", str(shopper.LIMIT))
CARD_SQL = f"""card AS (SELECT parent_asin, target, a[1:2] AS hard, CASE WHEN len(a) > 2 THEN a[3:4] ELSE a[1:1] END AS soft FROM (
  SELECT parent_asin, target, CASE WHEN len(c) > 0 THEN {FIRST.format('c')} ELSE [target] END AS a FROM (
    SELECT parent_asin, {_clean("coalesce(nullif(title, ''), 'product')")} AS target,
      list_filter(list_transform(list_concat(CASE WHEN colour IS NULL THEN base ELSE list_concat(list_concat(base[1:1], ['color: ' || colour]), base[2:]) END,
        CASE WHEN price IS NOT NULL AND NOT isnan(price) THEN ['budget around $' || price::VARCHAR] ELSE [] END), lambda x: {_clean('x')}), lambda x: x != '') AS c
    FROM (SELECT parent_asin, title, price, {_find(shopper.CARD_COLOURS)} AS colour, list_concat(list_concat(CASE WHEN {_find(shopper.CARD_MATERIALS)} IS NULL THEN [] ELSE [{_find(shopper.CARD_MATERIALS)}] END,
        coalesce(list_filter(features, lambda f: f IS NOT NULL AND f != ''), [])),
        coalesce(list_transform(list_filter(map_entries(details), lambda e: e.value IS NOT NULL AND e.value != ''), lambda e: e.key || ': ' || e.value), [])) AS base FROM products))))"""
_general = ", ".join(f"'{g}'" for g in GENERAL_PARTS)
AIMED_SQL = f"""{PRODUCTS_SQL}, {CARD_SQL}, categorised AS (SELECT parent_asin, {MESSAGE_SQL['coarse_category'].split('SELECT parent_asin, ', 1)[1]}),
aimed AS (SELECT sample_id, scenario_type, hard, soft, category, CASE WHEN scenario_type = 'buying' THEN hard[1:1] ELSE [] END AS disclosed
  FROM (SELECT DISTINCT ON (sample_id) sample_id, scenario_type, ground_truth.parent_asin AS parent_asin FROM sessions) JOIN card USING (parent_asin) JOIN categorised USING (parent_asin))"""
_kind = KIND_SQL.replace("feature)", "x)").replace("lower(feature)", "lower(x)")
_asks = ", ".join(f"('{a}')" for a in lex.ASKABLE) + ", (NULL)"
SQL = {
    "intent_card": f"WITH {PRODUCTS_SQL}, {CARD_SQL} SELECT * FROM card",
    "sim_opening": f"""WITH {AIMED_SQL} SELECT sample_id, CASE scenario_type WHEN 'buying' THEN 'I''m looking for ' || category || '. A key requirement is: ' || hard[1] || '.'
      WHEN 'intent_override' THEN 'I''m looking for ' || category || '. ' || soft[-1] ELSE 'I''m looking for ' || category || ', but I''m still exploring.' END AS message FROM aimed""",
    "undisclosed": f"WITH {AIMED_SQL} SELECT sample_id, unnest({FIRST.format('u')}) AS \"constraint\" FROM (SELECT sample_id, list_filter(list_concat(hard, soft), lambda x: NOT list_contains(disclosed, x)) AS u FROM aimed)",
    "sim_reply": f"""WITH {AIMED_SQL}, asked AS (SELECT *, list_filter(list_concat(hard, soft), lambda x: NOT list_contains(disclosed, x) AND (asks = 'other' OR ({_kind}) = asks))[1:2] AS found FROM aimed, (VALUES {_asks}) q(asks))
      SELECT sample_id, asks, CASE WHEN asks IS NULL THEN 'Those options are not quite right yet. Ask me about one specific attribute.'
        WHEN scenario_type = 'boundary' THEN 'I don''t have a preference for ' || asks || '; please use your judgment.'
        WHEN len(found) > 0 THEN 'For that, what matters is: ' || array_to_string(found, '; ') || '.' ELSE 'I don''t have an additional preference for ' || asks || '.' END AS reply FROM asked""",
}
