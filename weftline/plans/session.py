"""Queries over the state of sessions: the fold of their turns, ranking and reranking by it, questions, mode, and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.config import CODED, Config
from weftline.functions import extract, lexicon as lex
from weftline.functions.text import STOPWORDS, empty, search_terms, strings
from weftline.operators import catalog, metrics, ranked as rk, session as ss, vocabulary
from weftline.operators.catalog import TAG_TRAITS
from weftline.plans.evaluation import target_ranks, targets
from weftline.plans.messages import messages, products
from weftline.plans.pool import members, meta_vocab, rrf_fusion
from weftline.runtime import materialize, table

#: Fixed value: the line that goes with recommendations.
LINE = "Here are the closest matches I found."


def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request once, by its first delivery, with its episode."""
    return ss.episodes(messages(spark, sf_dir))


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.fold(turn_rows(spark, sf_dir))


# -- what messages change --------------------------------------------------------------------------------------------------


def tokens_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of each request with the place they begin at.

    A word's place is found from the pieces between words, which are as many as the words and one.
    """
    low = F.lower("user_message")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    gaps = F.split(low, "[a-z0-9]+")
    rows = messages(spark, sf_dir).filter(F.col("user_message").isNotNull()).select("request_id", words.alias("words"), gaps.alias("gaps"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("token"), (
        F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))).alias("start")))
    kept = F.filter(placed, lambda t: (F.length(t["token"]) > 1) & ~F.array_contains(strings(*STOPWORDS), t["token"]))
    return rows.select("request_id", F.inline(kept))


def cue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin, end and kind of every announcement of a replacement or an addition."""
    from weftline.operators import delta

    return messages(spark, sf_dir).select("request_id", "user_message").filter(F.col("user_message").isNotNull()).mapInPandas(
        lambda frames: (
            f.assign(c=f["user_message"].map(delta.cues)).explode("c").dropna(subset=["c"]).assign(
                start=lambda g: g["c"].str[0].astype("int32"), stop=lambda g: g["c"].str[1].astype("int32"), kind=lambda g: g["c"].str[2])[["request_id", "start", "stop", "kind"]]
            for f in frames), "request_id bigint, start int, stop int, kind string")


def extract_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request changes, one row per slot."""
    return state_rows(spark, sf_dir).select("request_id", F.inline("delta"))


def validate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that each request changes, after validation: values, removed values, confidence where it isn't full."""
    return extract_delta(spark, sf_dir).select("request_id", "slot", "values", "remove", "confidence")


def is_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a request names only to rule them out."""
    return extract_delta(spark, sf_dir).select("request_id", "slot", F.explode("remove").alias("value"))


# -- the fold --------------------------------------------------------------------------------------------------------------


def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and evidence after each request."""
    return state_rows(spark, sf_dir).drop("delta", "log")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written to the state, request by request."""
    return state_rows(spark, sf_dir).select("request_id", "session_id", "episode", F.inline("log"))


def superseded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were displaced from a slot or removed, per session and episode."""
    log = provenance(spark, sf_dir)
    gone = F.concat(F.coalesce("superseded", empty()), F.when(F.col("op") == "REMOVE", F.array("value")).otherwise(empty()))
    return log.select("session_id", "episode", "slot", F.explode(gone).alias("value")).distinct()


def supersede_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that later turns took words from, as it stands at the end of its episode."""
    last = state_rows(spark, sf_dir).groupBy("session_id", "episode").agg(F.max_by("evidence", F.struct("turn", "request_id")).alias("e"))
    return last.select("session_id", "episode", F.inline("e")).filter(F.size("superseded_parts") > 0).select("session_id", "episode", "turn", "normalized", "status", "superseded_parts")


def turn_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per episode with its turns in order: what was asked, and the filled slots after it. An episode is a dialogue, so the arrays are short."""
    rows = state_rows(spark, sf_dir).join(messages(spark, sf_dir).select("request_id", "user_message"), "request_id")
    turn = F.struct("turn", "request_id", "user_message", F.transform("slots", lambda s: s["slot"]).alias("filled"))
    return rows.groupBy("session_id", "episode").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def active_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that count after each request, with their values in lower case and the bounds of a budget."""
    rows = state_rows(spark, sf_dir).select("request_id", F.inline("slots"))
    values = F.filter(F.transform("values", lambda v: F.lower(v)), lambda v: v != "")
    return rows.select("request_id", "slot", values.alias("values"), "bounds.min", "bounds.max").filter(F.size("values") > 0)


def reliabilities(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Reliability of each slot, by the share of products that fill it: six numbers."""
    return {r["slot"]: r["reliability"] for r in catalog.coverage(catalog.signals(products(spark, sf_dir))).collect()}


def constraint_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence times reliability of every active constraint; a slot without either counts 1."""
    trust = catalog.coverage(catalog.signals(products(spark, sf_dir))).select("slot", "reliability")
    rows = state_rows(spark, sf_dir).select("request_id", F.inline("slots")).join(trust, "slot", "left")
    return rows.select("request_id", "slot", F.round(F.coalesce("confidence", F.lit(1.0)) * F.coalesce("reliability", F.lit(1.0)), 9).alias("weight"))


def evidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the popularity prior after each request: 1 / (1 + summed confidence)."""
    total = F.aggregate("slots", F.lit(0.0), lambda a, s: a + F.coalesce(s["confidence"], F.lit(1.0)))
    return state_rows(spark, sf_dir).select("request_id", F.round(1 / (1 + total), 9).alias("decay"))


# -- mode ------------------------------------------------------------------------------------------------------------------


def mode_columns(rows: DataFrame) -> DataFrame:
    """Add ``mode`` and the ``reason`` for it to states with their ``user_message``, by the first rule that holds."""
    said = F.when(extract.is_non_answer(F.col("user_message")), empty()).otherwise(F.coalesce(search_terms(F.col("user_message")), empty()))
    evidence = ss.active_words()
    both = F.concat(said, evidence)
    specific = F.exists("slots", lambda s: s["slot"].isin(*lex.SPECIFIC_SLOTS) & (F.size(s["values"]) > 0))
    named = F.flatten(F.transform("slots", lambda s: F.flatten(F.transform(s["values"], lambda v: F.filter(F.split(F.lower(v), "[^a-z0-9]+"), lambda w: F.length(w) > 1)))))
    vague = strings(*dict.fromkeys((*lex.MODE_SOFT, *lex.MODE_FILLER, *lex.MODE_BROWSING)))
    fresh = F.filter(evidence, lambda w: ~F.array_contains(vague, w))
    concrete = F.exists(fresh, lambda w: ~F.exists(F.col("named"), lambda v: w.startswith(v) | v.startswith(w)))
    rules = F.when(specific, "specific slot filled").when(F.arrays_overlap(both, strings(*lex.MODE_REQUIREMENTS)), "requirement language").when(
        F.arrays_overlap(both, strings(*lex.MODE_BROWSING)), "browsing language").when(concrete, "concrete unslotted detail").otherwise("nothing volunteered")
    out = rows.withColumn("named", named).withColumn("reason", rules).drop("named")
    return out.withColumn("mode", F.when(F.col("reason").isin("browsing language", "nothing volunteered"), "browsing").otherwise("buying"))


def moded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_columns(state_rows(spark, sf_dir).join(messages(spark, sf_dir).select("request_id", "user_message"), "request_id"))


def classify_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request is one of buying or of browsing, and by which rule."""
    return moded(spark, sf_dir).select("request_id", "mode", "reason")


def build_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, routes and their weights, which no mode changes, and what is known so far."""
    routes = CODED.routes
    return moded(spark, sf_dir).select(
        "request_id", "mode", strings(*routes).alias("routes"), F.create_map(*[x for r in routes for x in (F.lit(r), F.lit(1.0))]).alias("route_weights"),
        F.size(F.filter("slots", lambda s: s["slot"].isin(*lex.SPECIFIC_SLOTS) & (F.size(s["values"]) > 0))).alias("specific_slots"),
        F.exists("evidence", lambda e: e["status"] == "active").alias("has_evidence"), "turn")


#: The mode each scenario is labelled with.
EXPECTED = {"buying": "buying", "intent_override": "buying", "browsing": "browsing", "boundary": "browsing"}


def mode_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario, and over all, how many turns, first turns and whole episodes have the mode of the scenario's label."""
    labels = table(spark, sf_dir, "sessions").groupBy("session_id").agg(F.min_by("scenario_type", "sample_id").alias("scenario"))
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    rows = moded(spark, sf_dir).join(labels, "session_id").withColumn("right", F.coalesce(F.col("mode") == F.try_element_at(expected, F.col("scenario")), F.lit(False)))
    each = rows.groupBy("scenario", "session_id", "episode").agg(
        F.count("*").alias("turns"), F.count_if("right").alias("turns_right"), F.min_by("right", F.struct("turn", "request_id")).alias("first"), F.bool_and("right").alias("all"))
    return each.groupBy(F.coalesce("scenario", F.lit("none")).alias("scenario")).agg(
        F.sum("turns").alias("turns"), F.sum("turns_right").alias("turns_right"), F.count("*").alias("episodes"), F.count_if("first").alias("first_right"), F.count_if("all").alias("all_right"))


# -- ranking ---------------------------------------------------------------------------------------------------------------

SIGNALS = ["parent_asin", "colors", "materials", "cats", "store", "sizes", "price", "traits", "popularity"]


def session_rows(spark: SparkSession, sf_dir: str, states: DataFrame, config: Config = CODED) -> DataFrame:
    """Every candidate of each request with its state, signals and verdicts."""
    meta = table(spark, sf_dir, "catalog_meta").select(*SIGNALS)
    if not config.constraints:
        meta = meta.filter(F.lit(False))
    pools = members(spark, sf_dir).join(rrf_fusion(spark, sf_dir).select("request_id", "parent_asin", F.col("fusion_score").alias("base_score")), ["request_id", "parent_asin"], "left")
    rows = pools.withColumn("base_score", F.coalesce("base_score", F.lit(0.0))).join(states.select("request_id", "session_id", "turn", "slots"), "request_id")
    rows = rows.join(meta, "parent_asin", "left")
    wanted = profile_tags(spark, sf_dir)
    met = F.size(F.filter("wanted", lambda w: F.arrays_overlap(w, F.coalesce("traits", empty())))) / F.size("wanted")
    rows = rows.join(wanted, "session_id", "left").withColumn("profile_match", met).drop("wanted") if config.profile else rows.withColumn("profile_match", F.lit(0.0))
    return rk.judged(rows, reliabilities(spark, sf_dir) if config.confidence else None)


def profile_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_of(table(spark, sf_dir, "sessions"))


def tags_of(sessions: DataFrame) -> DataFrame:
    """``session_id, wanted``: the trait words of each mapped preference tag of a session's first sample."""
    tags = sessions.groupBy("session_id").agg(F.min_by(F.struct("user_profile.preference_tags"), "sample_id").alias("p"))
    named = F.array_distinct(F.transform(F.filter("p.preference_tags", lambda t: t.isNotNull()), lambda t: F.lower(F.trim(t))))
    words = F.create_map(*[x for tag, ws in TAG_TRAITS.items() for x in (F.lit(tag), strings(*ws))])
    wanted = F.filter(F.transform(named, lambda t: F.try_element_at(words, t)), lambda w: w.isNotNull())
    return tags.select("session_id", wanted.alias("wanted")).filter(F.size("wanted") > 0)


def ranked_rows(spark: SparkSession, sf_dir: str, states: DataFrame, config: Config = CODED) -> DataFrame:
    meta = table(spark, sf_dir, "catalog_meta").select(F.when(~F.isnan("popularity"), F.col("popularity")).alias("popularity"))
    scale = catalog.popularity_scale(meta).first()  # one row
    rows = rk.scored(session_rows(spark, sf_dir, states, config), config, scale["highest"], scale["median"])
    return rk.ranked(rows)


def session_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate ranked by the session's state, with the parts of its score."""
    return ranked_rows(spark, sf_dir, materialize(state_rows(spark, sf_dir), "states")).select(
        "request_id", "parent_asin", "rank", F.round("base_score", 9).alias("base_score"), F.round("attribute_score", 9).alias("attribute_score"),
        F.round("violation_penalty", 9).alias("violation_penalty"), F.round("popularity_score", 9).alias("popularity_score"), "final_score", "matched", "violated")


def state_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every candidate on each active constraint of its request's state."""
    rows = session_rows(spark, sf_dir, state_rows(spark, sf_dir))
    return rows.select("request_id", "parent_asin", F.inline("verdicts")).select("request_id", "parent_asin", "slot", "verdict", F.round("weight", 9).alias("weight"))


def evidence_words(states: DataFrame) -> DataFrame:
    """``request_id, turn, term``: the words of each request's active evidence."""
    return states.select("request_id", "turn", F.explode(ss.active_words()).alias("term"))


def rerank_rows(spark: SparkSession, sf_dir: str, states: DataFrame, rows: DataFrame, config: Config = CODED) -> tuple[DataFrame, DataFrame]:
    """Ranked rows with the head reranked by evidence, and the contract's report of each request."""
    words = evidence_words(states)
    pools, vocab = members(spark, sf_dir), meta_vocab(spark, sf_dir)
    if config.salt is not None:
        kept = vocabulary.kept(vocabulary.pool_frequencies(pools, vocab))
        words = rk.placebo_words(words, kept, "request_id", config.salt)
    head = rk.heads(rows, "request_id", config.window)
    asked = head.join(words.select("request_id").distinct(), "request_id", "left_semi")
    proposals = rk.pool_proposals(asked, rk.pool_scores(pools, vocab, words.select("request_id", "term").distinct()), "request_id")
    report = rk.contract(head.join(proposals.select("request_id", "proposed"), "request_id", "left"), "request_id")
    return rk.reranked(rows, report, "request_id"), report


def rerank_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reranker did with the head of every request."""
    states = materialize(state_rows(spark, sf_dir), "states")
    rows = materialize(ranked_rows(spark, sf_dir, states).select("request_id", "parent_asin", "rank"), "ranked")
    return rerank_rows(spark, sf_dir, states, rows)[1].drop("ids")


def placebo_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after reranking by words drawn from the pool in place of the request's own: the control of the reranker."""
    states = materialize(state_rows(spark, sf_dir), "states")
    rows = materialize(ranked_rows(spark, sf_dir, states).select("request_id", "parent_asin", "rank"), "ranked")
    return rerank_rows(spark, sf_dir, states, rows, Config(salt=0))[0]


# -- questions -------------------------------------------------------------------------------------------------------------


def answered(spark: SparkSession, sf_dir: str, config: Config = CODED) -> tuple[DataFrame, DataFrame]:
    """The reranked rows of every request, and turns with what questions would be worth; both are written once."""
    states = materialize(state_rows(spark, sf_dir), "states")
    rows = materialize(ranked_rows(spark, sf_dir, states, config).select("request_id", "parent_asin", "rank", "slots", *SIGNALS[1:-2]), "ranked")
    if config.rerank:
        rows = materialize(rerank_rows(spark, sf_dir, states, rows, config)[0], "reranked")
    worth = rk.attribute_worth(rows, "request_id", config, reliabilities(spark, sf_dir))
    turns = turn_rows(spark, sf_dir).join(worth, "request_id", "left")
    return rows, materialize(turns, "worth")


def attribute_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asking for each attribute would be worth to a request's first 50 candidates."""
    return answered(spark, sf_dir)[1].select("request_id", F.inline("worth"))


def rank_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir)[1].select("request_id", F.posexplode("worth").alias("at", "w")).select(
        "request_id", "w.attribute", "w.value", (F.col("at") + 1).alias("rank"))


def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of every turn, and what has been asked and closed by then."""
    return ss.fold_ledger(answered(spark, sf_dir)[1])


def choose_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_fold(spark, sf_dir).select("request_id", "asks")


def ask_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by policy: how many turns ask which attribute."""
    turns = answered(spark, sf_dir)[1]
    arms = [ss.fold_ledger(turns, p).select(F.lit(p).alias("policy"), "asks") for p in ss.POLICIES]
    both = arms[0]
    for a in arms[1:]:
        both = both.unionByName(a)
    return both.groupBy("policy", F.coalesce("asks", F.lit("none")).alias("asks")).agg(F.count("*").alias("turns"))


def ask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn of the dialogue: turns, questions, silent turns, open questions, and breaches (no such attribute, or one that was closed)."""
    rows = ledger_fold(spark, sf_dir)
    asked = F.col("asks").isNotNull()
    return rows.groupBy("turn").agg(
        F.count("*").alias("turns"), F.count_if(asked).alias("asked"), F.count_if(~asked).alias("silent"), F.count_if(F.col("asks") == lex.OPEN_QUESTION).alias("open"),
        F.count_if(asked & ~F.col("asks").isin(*lex.ASKABLE)).alias("illegal"), F.count_if(asked & F.array_contains("closed", F.col("asks"))).alias("after_close"))


def respond_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to every request: the line, the question, the first ten products in order, and no tokens used."""
    rows, turns = answered(spark, sf_dir)
    asks = ss.fold_ledger(turns).select("request_id", "asks")
    return payload(rows, asks, F.lit(CODED.shown))


def payload(rows: DataFrame, asks: DataFrame, k) -> DataFrame:
    """Answers from ranked rows. ``k`` is clamped to 0 to 10; a request without candidates gets an empty list."""
    first = rows.filter(F.col("rank") <= F.greatest(F.lit(0), F.least(F.lit(10), k))).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_asin"))).alias("r"))
    listed = F.transform(F.coalesce("r", F.array().cast("array<struct<rank:int,parent_asin:string>>")), lambda x: F.struct(x["parent_asin"].alias("parent_asin")))
    return asks.join(first, "request_id", "left").select(
        "request_id", F.lit(LINE).alias("message"), F.col("asks").alias("ask_attribute"), listed.alias("recommendations"),
        F.struct(F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens")).alias("usage"))


def normalize_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged pools as recommendations: known products only, each at its first place, ten at most."""
    logged = table(spark, sf_dir, "candidates").select("request_id", F.trim("parent_asin").alias("parent_asin"), "pool_pos").filter(F.col("parent_asin") != "")
    known = logged.join(table(spark, sf_dir, "catalog_items").select("parent_asin").distinct(), "parent_asin", "left_semi")
    first = known.groupBy("request_id", "parent_asin").agg(F.min("pool_pos").alias("place"))
    order = Window.partitionBy("request_id").orderBy(F.asc_nulls_last("place"), "parent_asin")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 10).select("request_id", "parent_asin", "rank")


# -- audits ----------------------------------------------------------------------------------------------------------------

#: Confidence and reliability that count as high.
HIGH_CONFIDENCE, HIGH_RELIABILITY = 0.65, 0.5


def quadrant_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active constraints by slot, confidence and reliability, and what they say of the product the session is after."""
    trust = reliabilities(spark, sf_dir)
    states = state_rows(spark, sf_dir)
    aims = targets(spark, sf_dir).select("request_id", F.col("target").alias("parent_asin"))
    meta = table(spark, sf_dir, "catalog_meta").select(*SIGNALS)
    rows = rk.judged(states.join(aims, "request_id").join(meta, "parent_asin", "left"), trust).select("request_id", F.inline("verdicts"))
    reliable = F.try_element_at(F.create_map(*[F.lit(x) for pair in trust.items() for x in pair]), F.col("slot"))
    return rows.groupBy(
        "slot", (F.col("confidence") >= HIGH_CONFIDENCE).alias("high_confidence"), (F.coalesce(reliable, F.lit(1.0)) >= HIGH_RELIABILITY).alias("high_reliability")).agg(
        F.count("*").alias("constraints"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("match", "violation", "unknown")])


def starvation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by whether their target was ever in a pool: words said, informative turns and filled slots, as order statistics."""
    said = messages(spark, sf_dir).filter(F.col("user_message").isNotNull() & ~extract.is_non_answer(F.col("user_message")))
    words = said.select("session_id", F.explode(search_terms(F.col("user_message"))).alias("term")).groupBy("session_id").agg(F.countDistinct("term").alias("words"))
    informative = said.groupBy("session_id").agg(F.count("*").alias("informative"))
    filled = state_rows(spark, sf_dir).groupBy("session_id").agg(F.max_by(F.size("slots"), F.struct("request_id")).alias("filled"))
    best = target_ranks(spark, sf_dir).groupBy("session_id").agg(F.when(F.min("place").isNotNull(), "found").otherwise("missed").alias("target"))
    rows = best.join(words, "session_id", "left").join(informative, "session_id", "left").join(filled, "session_id", "left")
    long = rows.select(F.inline(F.array(*[F.struct(F.concat_ws(" ", "target", F.lit(m)).alias("measure"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value")) for m in ("words", "informative", "filled")])))
    return metrics.order_statistics(long, "measure", "value")


QUERIES = {f.__name__: f for f in (
    tokens_with_offsets, cue_spans, extract_delta, validate_delta, is_negated, state_fold, provenance, superseded_values, supersede_evidence, turn_capture,
    active_constraints, constraint_weights, evidence_decay, classify_mode, build_strategy, mode_accuracy, session_rank, state_verdicts, rerank_contract,
    placebo_rerank, attribute_value, rank_attributes, ledger_fold, choose_question, ask_policies, ask_audit, respond_payload, normalize_recs, quadrant_census, starvation)}
SQL = {
    "normalize_recs": """SELECT request_id, parent_asin, row_number() OVER (PARTITION BY request_id ORDER BY place NULLS LAST, parent_asin)::INT AS rank FROM (
      SELECT request_id, trim(parent_asin) AS parent_asin, min(pool_pos) AS place FROM candidates WHERE trim(parent_asin) IN (SELECT parent_asin FROM catalog_items) GROUP BY ALL) QUALIFY rank <= 10""",
}
