"""Ranking of a pool against a session's state: verdicts, score, reranking of the head, and what a question would be worth.

Rows are ``request_id, parent_asin`` with the request's state as arrays (``operators.session``) and the product's signals.
Verdicts and scores are expressions over the row, so constraints are never exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.config import Config
from weftline.functions import lexicon as lex
from weftline.functions.text import empty, stem, strings
from weftline.operators import vocabulary
from weftline.operators.prefix import number_rows
from weftline.operators.session import slot_bounds, slot_values
from weftline.runtime import materialize

#: Slots in the order they are scored, and those whose mismatch counts against a product.
SCORED = ("category", "color", "material", "brand", "size", "budget")
STRICT = ("category", "color", "material", "brand", "budget")
#: Scale and median of popularity where the catalogue's can't be used.
SCALE, MEDIAN = 13.0, 0.5


def lowered(name: str) -> Column:
    """A slot's values in lower case, without empty ones; null where none is left."""
    values = F.filter(F.transform(slot_values(name), lambda v: F.lower(v)), lambda v: v != "")
    return F.when(F.size(values) > 0, values)


def verdict(slot: str) -> Column:
    """``match``, ``violation`` or ``unknown`` of the row's product for a slot of its state; null where the slot is empty.

    A product that says nothing is unknown. Of a category every word must begin a category token; a brand is part of the
    store's name; a size that isn't there is unknown; bounds of a budget are inclusive, NaN prices unknown.
    """
    asked = lowered(slot)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    if slot == "budget":
        bounds, price = slot_bounds(), F.when(~F.isnan("price"), F.col("price"))
        known = price.isNotNull() & bounds.isNotNull()
        fails = F.coalesce(price < bounds["min"], F.lit(False)) | F.coalesce(price > bounds["max"], F.lit(False))
        hit = ~fails
    elif slot == "category":
        known = some(F.col("cats"))
        words = lambda v: F.filter(F.split(v, " "), lambda w: w != "")
        begins = lambda w: F.exists("cats", lambda c: c.startswith(stem(w)))
        hit = F.exists(asked, lambda v: F.forall(words(v), begins))
    elif slot == "brand":
        known = F.coalesce(F.col("store") != "", F.lit(False))
        hit = F.exists(asked, lambda v: F.contains(F.lower("store"), v))
    else:
        held = F.col({"color": "colors", "material": "materials", "size": "sizes"}[slot])
        known, hit = some(held), F.arrays_overlap(held, asked)
    hit = F.coalesce(hit, F.lit(False))
    miss = "violation" if slot in STRICT else "unknown"
    return F.when(asked.isNotNull(), F.when(~known, "unknown").when(hit, "match").otherwise(miss))


def trust(slot: str) -> Column:
    """How firmly a state holds a slot, 1 where nothing else is stored."""
    stored = F.get(F.filter("slots", lambda s: s["slot"] == slot), F.lit(0))["confidence"]
    return F.coalesce(F.when(~F.isnan(stored), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stored))), F.lit(1.0))


def judged(rows: DataFrame, reliability: dict[str, float] | None = None) -> DataFrame:
    """Add ``verdicts``: slot, verdict, confidence and weight (confidence times the reliability of the slot) of each active constraint."""
    each = F.array(*[F.struct(
        F.lit(s).alias("slot"), verdict(s).alias("verdict"), trust(s).alias("confidence"), (trust(s) * F.lit((reliability or {}).get(s, 1.0))).alias("weight")) for s in SCORED])
    return rows.withColumn("verdicts", F.filter(each, lambda v: v["verdict"].isNotNull()))


def _column(x) -> Column:
    """A setting as a column: the same for all rows, or one of each row (an arm of a comparison)."""
    return x if isinstance(x, Column) else F.lit(x)


def scored(rows: DataFrame, config: Config, highest: float | None, median: float | None) -> DataFrame:
    """Add the parts of the score and ``final_score`` to rows with ``verdicts``, ``base_score``, ``popularity`` and ``profile_match``.

    ``final = base + match weight * matched share - penalty weight * violated share + profile + popularity``. Shares are of all
    active constraints, unknown ones included. Popularity fades with the summed confidence of what was asked. The settings of
    ``config`` may be columns.
    """
    c = {k: _column(getattr(config, k)) for k in ("confidence", "match_weight", "penalty_weight", "profile", "profile_weight", "popularity", "popularity_weight", "decay")}
    n = F.size("verdicts")

    def total(kind: str) -> Column:
        of = F.filter("verdicts", lambda v: v["verdict"] == kind)
        return F.when(c["confidence"], F.aggregate(of, F.lit(0.0), lambda a, v: a + v["weight"])).otherwise(F.size(of).cast("double"))

    part = lambda kind, w: F.when(n > 0, w * total(kind) / n).otherwise(0.0)
    evidence = F.aggregate("verdicts", F.lit(0.0), lambda a, v: a + v["confidence"])
    known = F.coalesce(F.when(~F.isnan("popularity"), F.col("popularity")), F.lit(median)) / F.lit(highest if highest and highest > 0 else SCALE)
    norm = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)), F.lit(MEDIAN))
    prior = c["popularity_weight"] * norm / F.when(c["decay"], 1 + evidence).otherwise(1.0) if highest is not None else F.lit(0.0)
    named = lambda kind: F.transform(F.filter("verdicts", lambda v: v["verdict"] == kind), lambda v: v["slot"])
    out = (
        rows.withColumn("attribute_score", part("match", c["match_weight"])).withColumn("violation_penalty", part("violation", c["penalty_weight"]))
        .withColumn("profile_score", F.when(c["profile"], F.coalesce(F.col("profile_match"), F.lit(0.0)) * c["profile_weight"]).otherwise(0.0))
        .withColumn("popularity_score", F.when(c["popularity"], prior).otherwise(0.0))
        .withColumn("matched", named("match")).withColumn("violated", named("violation")))
    final = F.col("base_score") + F.col("attribute_score") - F.col("violation_penalty") + F.col("profile_score") + F.col("popularity_score")
    return out.withColumn("final_score", F.round(final, 9))


def ranked(rows: DataFrame, group: str = "request_id") -> DataFrame:
    """Number scored rows by falling final score, base score, then id. A request of any size is cut into slices of its scores."""
    return number_rows(materialize(rows, "scored"), group, "final_score", [F.desc("base_score"), "parent_asin"], "rank")


# -- reranking -------------------------------------------------------------------------------------------------------------


def heads(rows: DataFrame, group: str, window) -> DataFrame:
    """``group, ids``: the ids of the first ``window`` ranks, in order; ``window``, a number or a column, bounds the array."""
    first = rows.filter(F.col("rank") <= window).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "parent_asin"))).alias("h"))
    return first.select(group, F.transform("h", lambda x: x["parent_asin"]).alias("ids"))


def pool_proposals(head: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """Add ``proposed`` to heads: their ids by falling ``score``, then incoming place. Ids without a score have 0; null where a request has no words."""
    flat = head.select(group, F.posexplode("ids").alias("at", "parent_asin")).join(scores.select(group, "parent_asin", "score"), [group, "parent_asin"], "left")
    order = flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("falling"), "at", "parent_asin"))).alias("o"))
    return head.join(order.select(group, F.transform("o", lambda x: x["parent_asin"]).alias("proposed")), group, "left")


def ask_scorer(head: DataFrame, scorer: Callable, group: str, key: str = "string", *columns: str) -> DataFrame:
    """Add ``proposed`` and ``failed`` to heads by a Python ``scorer(ids, row)``, of which nothing is trusted: it may raise or return anything. ``row`` has the request's id and ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, proposed, failed = batch.to_pylist(), [], []
            for row in rows:
                try:
                    got, bad = scorer(list(row["ids"]), {c: row[c] for c in (group, *columns)}), False
                except Exception:
                    got, bad = None, True
                failed.append(bad)
                proposed.append([x if isinstance(x, str) else None for x in got] if isinstance(got, (list, tuple)) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r["ids"] for r in rows], pa.list_(pa.string())), pa.array(proposed, pa.list_(pa.string())), pa.array(failed, pa.bool_())],
                names=[group, "ids", "proposed", "failed"])

    return head.select(group, "ids", *columns).mapInArrow(run, f"{group} {key}, ids array<string>, proposed array<string>, failed boolean")


def contract(proposals: DataFrame, group: str) -> DataFrame:
    """``group, ids, outcome, considered, returned, invented, dropped, moved``: what becomes of a proposal, whatever it holds.

    ``ids`` is a permutation of the head: proposed ids that it has, once each, then those left out, in their order. Ids it
    doesn't have are counted as invented. Outcomes: ``offline`` (no proposal), ``error`` (the scorer failed), ``malformed`` (no
    usable id), ``identity`` and ``applied``; ``empty`` heads don't occur.
    """
    failed = F.coalesce("failed", F.lit(False)) if "failed" in proposals.columns else F.lit(False)
    p = proposals.withColumn("bad", failed).withColumn("usable", F.array_distinct(F.filter("proposed", lambda x: F.array_contains("ids", x))))
    none = F.col("proposed").isNull() | F.col("bad") | (F.coalesce(F.size("usable"), F.lit(0)) <= 0)
    p = p.withColumn("next", F.when(none, F.col("ids")).otherwise(F.concat("usable", F.array_except("ids", "usable"))))
    moved = F.size(F.filter(F.zip_with("ids", "next", lambda a, b: a != b), lambda x: x))
    outcome = F.when(F.col("bad"), "error").when(F.col("proposed").isNull(), "offline").when(none, "malformed").when(moved == 0, "identity").otherwise("applied")
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    strange = F.size(F.filter("proposed", lambda x: x.isNull() | ~F.array_contains("ids", F.coalesce(x, F.lit("")))))
    return p.select(
        group, F.col("next").alias("ids"), outcome.alias("outcome"), F.size("ids").alias("considered"), count("usable").alias("returned"),
        F.when(F.col("proposed").isNull(), 0).otherwise(strange).alias("invented"), F.when(none, 0).otherwise(F.size("ids") - F.size("usable")).alias("dropped"), moved.alias("moved"))


def reranked(rows: DataFrame, contracted: DataFrame, group: str) -> DataFrame:
    """Ranked rows with the head's ranks renumbered; the tail keeps its own."""
    places = contracted.select(group, F.posexplode("ids").alias("at", "parent_asin"))
    return rows.withColumnRenamed("rank", "rank_before").join(places, [group, "parent_asin"], "left").withColumn("rank", F.coalesce(F.col("at") + 1, F.col("rank_before"))).drop("at")


def placebo_words(words: DataFrame, kept: DataFrame, group: str, salt: int) -> DataFrame:
    """``group, term``: as many different words of a pool's vocabulary as the request has of its own, drawn by hash and not by meaning.

    The vocabulary of a pool is bounded, so its words are numbered within it; a draw is a hash of the salt, the turn and the
    request's words, so equal requests draw alike.
    """
    seeds = words.groupBy(group).agg(F.count("*").alias("wanted"), F.xxhash64(F.lit(salt), F.first("turn"), F.concat_ws("|", F.sort_array(F.collect_set("term")))).alias("seed"))
    order = Window.partitionBy(group).orderBy(F.xxhash64("seed", "term"), "term")
    drawn = kept.select(group, "term").join(seeds, group).withColumn("n", F.row_number().over(order))
    return drawn.filter(F.col("n") <= F.col("wanted")).select(group, "term")


# -- questions -------------------------------------------------------------------------------------------------------------


def attribute_worth(rows: DataFrame, group: str, config: Config, reliability: dict[str, float], depth: int = lex.ASK_DEPTH) -> DataFrame:
    """``group, worth``: what asking for each judged attribute would be worth, best first, ties in the listed order.

    Of the first ``depth`` ranks: the share that declares the attribute, times one minus the share of its commonest value
    among those, times the attribute's reliability; 0 for a filled slot. Prices are declared as quarters of their range.
    """
    top = rows.filter(F.col("rank") <= depth)
    pool = Window.partitionBy(group)
    price = F.when(~F.isnan("price"), F.col("price"))
    prices = F.array_sort(F.filter(F.collect_list(price).over(pool), lambda p: p.isNotNull()))  # depth values at most
    top = top.withColumn("price", price).withColumn("prices", prices)
    n = F.size("prices")
    edge = []
    for j in (1, 2, 3):  # the exclusive method: the value at place j (n + 1) / 4
        at = F.greatest(F.lit(1), F.least(F.floor(j * (n + 1) / 4).cast("int"), n - 1))
        low, high = F.get("prices", at - 1), F.get("prices", at)
        edge.append(low + (high - low) * (j * (n + 1) / 4 - at))
    quarter = sum((F.when((n >= 4) & (F.col("price") > e), 1).otherwise(0) for e in edge), F.lit(0))
    declared = {
        "color": F.col("colors"), "material": F.col("materials"), "size": F.col("sizes"), "category": F.col("cats"),
        "brand": F.when(F.col("store") != "", F.array("store")), "budget": F.when(F.col("price").isNotNull(), F.array(F.concat(F.lit("q"), quarter.cast("string"))))}
    stacked = top.select(group, F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.array_distinct(F.coalesce(declared[a], empty())).alias("vals")) for a in config.judged])))
    counts = stacked.select(group, "attribute", F.explode("vals").alias("v")).groupBy(group, "attribute", "v").agg(F.count("*").alias("c"))
    most = counts.groupBy(group, "attribute").agg(F.max("c").alias("most"))
    sizes = stacked.groupBy(group, "attribute").agg(F.count("*").alias("n"), F.count_if(F.size("vals") > 0).alias("declaring"))
    filled = top.groupBy(group).agg(F.first(F.transform("slots", lambda s: s["slot"])).alias("known"))  # equal in all rows of a request
    trust_of = F.create_map(*[F.lit(x) for a in config.judged for x in (a, float(reliability.get(a, 1.0)))])
    value = F.col("declaring") / F.col("n") * (1 - F.col("most") / F.col("declaring")) * F.try_element_at(trust_of, F.col("attribute"))
    each = sizes.join(most, [group, "attribute"], "left").join(filled, group)
    each = each.withColumn("value", F.when(F.array_contains("known", F.col("attribute")), 0.0).otherwise(F.round(F.coalesce(value, F.lit(0.0)), 9)))
    place = F.array_position(strings(*config.judged), F.col("attribute"))
    sorted_ = each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("falling"), place.alias("place"), "attribute", "value"))).alias("w"), F.first("known").alias("known"))
    return sorted_.select(group, F.transform("w", lambda x: F.struct(x["attribute"].alias("attribute"), x["value"].alias("value"))).alias("worth"), "known")


def pool_scores(members: DataFrame, vocab: DataFrame, words: DataFrame) -> DataFrame:
    """``request_id, parent_asin, score`` of the members: summed in-pool rarity of the words (``request_id, term``) that a product holds."""
    return vocabulary.idf_rerank(members, vocab, words, vocabulary.pool_frequencies(members, vocab))
