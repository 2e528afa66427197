"""The simulated shopper: what a product's buyer would ask for, say first, answer, and change.

All of it is expressions over a row, but for the turn of a change of mind, which comes from a seeded generator.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import lexicon as lex
from weftline.functions.extract import constraint_kind
from weftline.functions.text import clean, empty
from weftline.operators.catalog import searchable_text

#: The materials and colours a card looks for, the length of a constraint, and the lines that shoppers say.
CARD_MATERIALS = "cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric"
CARD_COLOURS = "black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange"
LIMIT = 180
OPEN, REQUIRE, EXPLORE = "I'm looking for ", ". A key requirement is: ", ", but I'm still exploring."
REFUSE, REFUSE_END = "I don't have a preference for ", "; please use your judgment."
UNASKED = "Those options are not quite right yet. Ask me about one specific attribute."
NO_MORE, MATTERS = "I don't have an additional preference for ", "For that, what matters is: "
OVERRIDE = "Actually, ignore my earlier preference. What I need is: "
OVERRIDE_TURNS = (3, 4)


def _first(pattern: str, text: Column) -> Column:
    hit = F.regexp_extract(text, rf"(?i)\b({pattern})\b", 1)
    return F.when(hit != "", F.lower(hit))


def card(p: DataFrame) -> DataFrame:
    """``parent_asin, target, hard, soft``: the constraints a buyer of each product has.

    Features and details, the first material in front, the first colour second, the price last; cleaned, without repeats.
    The first two are hard, the next two soft, or else the first; a product that says nothing has its title. NaN prices are
    no prices.
    """
    features = F.filter(F.coalesce("features", empty()), lambda f: f.isNotNull() & (f != ""))
    filled = F.filter(F.map_entries("details"), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    details = F.coalesce(F.transform(filled, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), empty())
    text = searchable_text(p)
    material, colour = _first(CARD_MATERIALS, text), _first(CARD_COLOURS, text)
    base = F.concat(F.when(material.isNotNull(), F.array(material)).otherwise(empty()), features, details)
    rows = p.select("parent_asin", "title", "price", base.alias("base"), colour.alias("colour"))
    said = F.when(F.col("colour").isNotNull(), F.concat(F.slice("base", 1, 1), F.array(F.concat(F.lit("color: "), F.col("colour"))), F.slice("base", F.lit(2), F.size("base")))).otherwise(F.col("base"))
    priced = F.when(F.col("price").isNotNull() & ~F.isnan("price"), F.array(F.concat(F.lit("budget around $"), F.col("price").cast("string")))).otherwise(empty())
    cleaned = F.array_distinct(F.filter(F.transform(F.concat(said, priced), lambda c: clean(c, LIMIT)), lambda c: c != ""))
    title = clean(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("product"), LIMIT)
    rows = rows.select("parent_asin", title.alias("target"), cleaned.alias("c")).withColumn("c", F.when(F.size("c") > 0, F.col("c")).otherwise(F.array("target")))
    soft = F.slice("c", 3, 2)
    return rows.select("parent_asin", "target", F.slice("c", 1, 2).alias("hard"), F.when(F.size(soft) > 0, soft).otherwise(F.slice("c", 1, 1)).alias("soft"))


def override_turns(samples: DataFrame) -> DataFrame:
    """Add ``override_turn`` to samples (``sample_id, scenario_type``): when the shopper changes their mind, null where they don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [random.Random(f"{i or ''}\0{s}").choice(OVERRIDE_TURNS) if s == "intent_override" else None
                     for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.int32())], names=["sample_id", "scenario_type", "override_turn"])

    return samples.select("sample_id", "scenario_type").distinct().mapInArrow(run, "sample_id string, scenario_type string, override_turn int")


def opening() -> Column:
    """The first line, from ``scenario_type, category, hard, soft``."""
    line = F.concat(F.lit(OPEN), F.col("category"))
    buying = (F.col("scenario_type") == "buying") & (F.size("hard") > 0)
    return F.when(buying, F.concat(line, F.lit(REQUIRE), F.get("hard", F.lit(0)), F.lit("."))).when(
        F.col("scenario_type") == "intent_override", F.concat(line, F.lit(". "), F.element_at("soft", -1))).otherwise(F.concat(line, F.lit(EXPLORE)))


def disclosed_at_first() -> Column:
    return F.when((F.col("scenario_type") == "buying") & (F.size("hard") > 0), F.slice("hard", 1, 1)).otherwise(empty())


def override_line() -> Column:
    return F.concat(F.lit(OVERRIDE), F.get("hard", F.lit(0)), F.lit("."))


def replied(rows: DataFrame) -> DataFrame:
    """Add ``reply`` and the next ``disclosed`` and ``refused`` to rows of ``scenario_type, asks, hard, soft, disclosed, refused``.

    A boundary shopper refuses the first question. Without a question nothing is disclosed; an attribute that isn't askable
    counts as the open question; two constraints at most are disclosed, hard ones first.
    """
    refuses = (F.col("scenario_type") == "boundary") & ~F.col("refused") & F.col("asks").isNotNull()
    asked = F.when(F.col("asks").isin(*lex.ASKABLE), F.col("asks")).otherwise(lex.OPEN_QUESTION)
    fits = lambda c: ~F.array_contains("disclosed", c) & ((F.col("asked") == lex.OPEN_QUESTION) | (constraint_kind(c) == F.col("asked")))
    rows = rows.withColumn("asked", asked).withColumn("found", F.slice(F.filter(F.concat("hard", "soft"), fits), 1, 2))
    tells = ~refuses & F.col("asks").isNotNull() & (F.size("found") > 0)
    reply = (
        F.when(refuses, F.concat(F.lit(REFUSE), F.col("asks"), F.lit(REFUSE_END))).when(F.col("asks").isNull(), UNASKED)
        .when(tells, F.concat(F.lit(MATTERS), F.concat_ws("; ", "found"), F.lit("."))).otherwise(F.concat(F.lit(NO_MORE), F.col("asked"), F.lit("."))))
    return rows.withColumn("reply", reply).withColumn("disclosed", F.when(tells, F.array_union("disclosed", "found")).otherwise(F.col("disclosed"))).withColumn(
        "refused", F.col("refused") | refuses).drop("asked", "found")


