"""Measured quantities in common units.

Every listing's details are read for quantities of the item itself. A figure's unit may stand in the value, in its key, in
another entry that states the units of the whole record, or in the store's note about its feed; where it stands nowhere it
has to be guessed. A calibrated random forest predicts the unit of every figure without one in its value from its
magnitude, the source, the category and the neighbouring fields. Confident predictions are converted, the others are kept
for review, and wherever the record or its store does state a unit, that statement is the exact check of the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.runtime import materialize, spread

#: Factors of units to the common unit of their dimension (g, 0.1 mm, ml, m of water).
FACTORS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "oz": 28.349523125, "lb": 453.59237, "dwt": 1.55517384},
    "length": {"mm": 10.0, "cm": 100.0, "m": 10_000.0, "in": 254.0, "ft": 3048.0},
    "volume": {"ml": 1.0, "cl": 10.0, "l": 1000.0, "gal": 3785.411784, "cu in": 16.387064, "cu ft": 28_316.846592},
    "depth": {"m": 1.0, "ft": 0.3048, "atm": 10.0, "bar": 10.0},
}

#: Spellings of units; a trailing full stop is dropped before looking one up.
SPELLINGS = {
    "g": "g gr gram grams gramm gramme grammes gramo gramos gramms",
    "kg": "kg kgs kilogram kilograms kilogramm kilogramme kilogrammes kilo kilos kilogramo kilogramos",
    "mg": "mg milligram milligrams",
    "oz": "oz ounce ounces onza onzas once onces unze unzen",
    "lb": "lb lbs pound pounds libra libras livre livres pfund",
    "dwt": "dwt pennyweight pennyweights",
    "mm": "mm millimeter millimeters millimetre millimetres millimètre millimètres milímetro milímetros",
    "cm": "cm cms centimeter centimeters centimetre centimetres centimètre centimètres centímetro centímetros zentimeter",
    "m": "m meter meters metre metres mètre mètres metro metros",
    "in": 'in inch inches " ” ″ zoll pulgada pulgadas pouce pouces',
    "ft": "ft foot feet fuß pie pies pied pieds ′",
    "ml": "ml milliliter milliliters millilitre millilitres mililitro mililitros",
    "cl": "cl centiliter centiliters centilitre centilitres",
    "l": "l ltr liter liters litre litres litro litros",
    "gal": "gal gals gallon gallons",
    "atm": "atm atmosphere atmospheres",
    "bar": "bar bars",
}
UNIT_OF = {word: unit for unit, words in SPELLINGS.items() for word in words.split()}
COMPOUND = (
    (re.compile(r"^(?:us|u\.s\.) *(?=gal)"), ""),
    (re.compile(r"^(?:cu\.? *in(?:ch(?:es)?)?\.?|cubic inch(?:es)?|in(?:ches)?³|in\^3)"), "cu in"),
    (re.compile(r"^(?:cu\.? *f(?:oo|ee)?t\.?|cubic f(?:oo|ee)t|ft³|ft\^3)"), "cu ft"),
)

#: Keys of the item's own quantities, in lower case, without separators and unit.
KEYS = {
    "weight": ("mass", "item weight|weight|net weight|product weight|poids|gewicht|peso|product dimensions"),
    "heel_height": ("length", "heel height|heel height approx|hauteur du talon|absatzhöhe"),
    "case_diameter": ("length", "case diameter|diameter of case|gehäusedurchmesser"),
    "chain_length": ("length", "chain length|length of chain|necklace chain length|kettenlänge"),
    "band_width": ("length", "band width|width of band|bandbreite"),
    "capacity": ("volume", "capacity|storage volume|volume|fassungsvermögen"),
    "water_depth": ("depth", "water resistance|water resistant depth|waterproof to"),
}
QUANTITY_OF = {key: (quantity, dimension) for quantity, (dimension, keys) in KEYS.items() for key in keys.split("|")}
UNITS = sorted({f"{dimension} {unit}" for dimension, units in FACTORS.items() for unit in units})

VULGAR = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875, "⅙": 1 / 6, "⅕": 0.2}
FIRST = re.compile(rf"\d|[{''.join(VULGAR)}]")
FIGURE = re.compile(
    rf"(\d+(?:[.,]\d+)*)\s+(\d+)\s*/\s*(\d+)|(\d+)\s*/\s*(\d+)|(\d+(?:[.,]\d+)*)\s*([{''.join(VULGAR)}])|([{''.join(VULGAR)}])|(\d+(?:[.,]\d+)*)")
KEY_UNIT = re.compile(r"\s*(?:\(([^()]+)\)|\[([^\[\]]+)\]|\bin ([a-zäöüß³.\" ]+))\s*$", re.I)
STATED = re.compile(r"unit", re.I)


def number(text: str) -> float:
    """A comma before exactly three digits groups thousands; any other is a decimal sign."""
    text = re.sub(r",(?=\d{3}(?!\d))", "", text)
    text = text.replace(",", ".")
    return float(text) if text.count(".") < 2 else float(text.replace(".", "", text.count(".") - 1))


def unit_at(text: str, dimension: str) -> tuple[str | None, int]:
    """The unit that ``text`` begins with, and where it ends."""
    low = text.lower()
    start = len(low) - len(low.lstrip())
    for pattern, unit in COMPOUND:
        m = pattern.match(low[start:])
        if m:
            if unit:
                return (unit if unit in FACTORS[dimension] else None), start + m.end()
            start += m.end()
    m = re.match(r"[^\W\d_]+³?|[\"”″′]", low[start:])
    if not m:
        return None, start
    unit = UNIT_OF.get(m.group())
    end = start + m.end() + (low[start + m.end() : start + m.end() + 1] == ".")
    return (unit if unit in FACTORS[dimension] else None), end


def read_figure(text: str) -> tuple[float, int] | None:
    """The first figure and where it ends; mixed numbers count with their fraction."""
    at = FIRST.search(text)
    if not at:
        return None
    m = FIGURE.match(text, at.start())
    whole, top, bottom, top2, bottom2, whole2, vulgar, alone, plain = m.groups()
    if top and int(bottom):
        return number(whole) + int(top) / int(bottom), m.end()
    if top2 and int(bottom2):
        return int(top2) / int(bottom2), m.end()
    if vulgar:
        return number(whole2) + VULGAR[vulgar], m.end()
    if alone:
        return VULGAR[alone], m.end()
    return (number(plain), m.end()) if plain else None


def read_value(text: str, dimension: str) -> tuple[float, str | None] | None:
    """Figure and unit of a value. Pounds followed by ounces add up; of a value given twice the first figure counts."""
    first = read_figure(text)
    if first is None:
        return None
    figure, end = first
    unit, used = unit_at(text[end:], dimension)
    if unit == "lb":
        rest = text[end + used :]
        joined = re.match(r"\s*(?:,|and|und|et|y)?\s*(?=[\d])", rest)
        if joined:
            more = read_figure(rest[joined.end() :])
            if more:
                ounces, _ = unit_at(rest[joined.end() + more[1] :], dimension)
                if ounces == "oz":
                    return figure + more[0] / 16, "lb"
    return figure, unit


def read_key(key: str) -> tuple[str, str | None]:
    """A key's name and the words of the unit it carries."""
    low = key.lower().replace("_", " ").strip()
    m = KEY_UNIT.search(low)
    words = next((g for g in m.groups() if g), None) if m else None
    name = low[: m.start()] if m else low
    return re.sub(r"[\s.]+$", "", re.sub(r"\s+", " ", name)), words


def unit_words(text: str | None, dimension: str) -> str | None:
    """The unit of a dimension that a free text names; the word "in" only beside a unit of mass, as it mostly is no unit."""
    if not text:
        return None
    words = re.findall(r"[^\W\d_]+", text.lower())
    found = [UNIT_OF[w] for w in words if w in UNIT_OF and UNIT_OF[w] in FACTORS[dimension] and w != "in"]
    if found:
        return found[0]
    masses = any(w in UNIT_OF and UNIT_OF[w] in FACTORS["mass"] for w in words)
    return "in" if dimension == "length" and masses and re.search(r"\bin(?:\.| for\b|$)", text.lower()) else None


def readings(details: list | None) -> Iterator[tuple]:
    """(quantity, dimension, figure, unit in value, unit in key, unit in other entries) of each figure of a record."""
    if not details:
        return
    entries = [(k, v) for k, v in details if k is not None and v is not None]
    near = {d: None for d in FACTORS}
    for key, value in entries:
        if STATED.search(key):
            for d in ("mass", "length", "volume", "depth"):
                kind = {"mass": "weight", "length": "length", "volume": "volume", "depth": "depth"}[d]
                if kind in key.lower() and near[d] is None:
                    near[d] = unit_words(value, d) or unit_at(value, d)[0]
    for key, value in entries:
        name, words = read_key(key)
        if name not in QUANTITY_OF or value.lstrip()[:1] in "[{":
            continue
        quantity, dimension = QUANTITY_OF[name]
        if name == "product dimensions":
            sides, cut, value = value.rpartition(";")
            if not cut:
                continue
        read = read_value(value, dimension)
        if read is None:
            continue
        figure, unit = read
        in_key = unit_at(words, dimension)[0] if words else None
        yield quantity, dimension, figure, unit, in_key, near[dimension] if dimension != "depth" else None


MEASURED = "parent_asin string, store_key string, category string, quantity string, dimension string, figure double, in_value string, in_key string, near string"


def measured(items: DataFrame) -> DataFrame:
    """One row per distinct figure of a listing's details."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asin, store, category, details in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.extend((asin, store, category, *r) for r in readings(details))
            columns = list(zip(*rows)) if rows else [()] * 9
            types = [pa.string()] * 5 + [pa.float64()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in MEASURED.split(", ")])

    source = spread(items.select("parent_asin", store_key("store").alias("store_key"), F.try_element_at("categories", F.lit(-1)).alias("category"), "details"))
    return source.mapInArrow(run, MEASURED).distinct()


def store_key(column: str):
    """Store names without regard to case and spacing; empty is null."""
    key = F.lower(F.regexp_replace(F.col(column), r"\s+", ""))
    return F.when(key != "", key)


def store_units(stores: DataFrame) -> DataFrame:
    """Per store the units its note gives for bare masses and lengths. The table is fixed in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notes = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([unit_words(n, "mass") for n in notes], pa.string()), pa.array([unit_words(n, "length") for n in notes], pa.string()),
            ], names=["store_key", "note_mass", "note_length"])

    notes = stores.select(store_key("store").alias("store_key"), "feed_note").groupBy("store_key").agg(F.max("feed_note").alias("feed_note"))
    return notes.mapInArrow(run, "store_key string, note_mass string, note_length string")


#: Bound on the labelled rows the classifier is fitted on, taken in the order of a hash.
SAMPLE = 20_000

#: Calibrated probability from which a predicted unit is converted, and share of the vote from which a unit counts as possible.
CONFIDENT, POSSIBLE = 0.95, 0.02

#: Share of stores, in 64ths, whose listings are held out of the fit, for the calibration.
HELD = 16


def features(rows: DataFrame) -> DataFrame:
    """Numbers the forest splits on: magnitude, decimals, quantity, category, source, and what neighbouring fields say.

    Whatever states the unit of the figure itself is not among them: units are read from other figures of the record only.
    """
    def code(column: str, names: list[str]):
        out = F.lit(0)
        for i, n in enumerate(names, 1):
            out = F.when(F.col(column) == n, i).otherwise(out)
        return out.cast("double")

    magnitude = F.log10(F.greatest(F.col("figure"), F.lit(1e-6)))
    places = F.length(F.regexp_extract(F.format_number("figure", 4), r"\.(\d*?)0*$", 1)).cast("double")
    return rows.select(
        "*", F.array(
            magnitude, F.round(magnitude) - magnitude, places, code("quantity", [*sorted(KEYS), "price"]),
            F.coalesce(F.col("metric"), F.lit(0)).cast("double"), F.coalesce(F.col("imperial"), F.lit(0)).cast("double"), F.coalesce("beside", F.lit(-9.0)),
            (F.pmod(F.xxhash64("category"), F.lit(64))).cast("double"), (F.pmod(F.xxhash64("store_key"), F.lit(64))).cast("double"),
        ).alias("x"))


def train(rows: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 12, seed: int = 7):
    """A random forest for the unit, and an isotonic regression from its highest vote to the share of right answers.

    Fitted on at most ``sample`` labelled rows. Labels are stated units, masked: nothing that states them is a feature. The
    listings of a quarter of the stores are held out for the calibration, with all that have no store and fall in the same
    part of a hash; single listings instead where that part is under 5 or over 60 % of the rows. Where too few are left, all are fitted and nothing is calibrated, so that no prediction counts as sure; a
    single unit is predicted throughout. None where nothing is labelled, and so nothing stated.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    labelled = rows.filter(F.col("stated").isNotNull()).orderBy(F.xxhash64("parent_asin", "quantity", "figure"), "parent_asin", "quantity", "figure").limit(sample)
    held, of_listing = (F.pmod(F.xxhash64(c), F.lit(64)) < HELD for c in (F.coalesce("store_key", "parent_asin"), F.col("parent_asin")))
    labelled = materialize(features(labelled).select(F.concat_ws(" ", "dimension", "stated").alias("unit"), "x", held.alias("held"), of_listing.alias("of_listing")), "labelled")
    share = labelled.agg(F.avg(F.col("held").cast("double"))).first()[0]
    if share is not None and not 0.05 < share < 0.6:  # a few stores hold nearly all: listings are held out instead
        labelled = labelled.withColumn("held", F.col("of_listing"))
    units = sorted(r["unit"] for r in labelled.select("unit").distinct().collect())  # units of the tables above, or currencies
    if len(units) < 2:
        return (None, units, None) if units else None
    if labelled.filter(~F.col("held")).select("unit").distinct().count() < 2:
        labelled = labelled.withColumn("held", F.lit(False))
    labels = StringIndexer(inputCol="unit", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(labelled.filter(~F.col("held")))
    data = labels.transform(labelled).withColumn("features", array_to_vector("x"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, subsamplingRate=0.7).fit(data.filter(~F.col("held")))
    judged = predict_units(data.filter("held"), forest, labels.labels).withColumn("right", (F.col("guess") == F.col("unit")).cast("double"))
    judged = judged.select(F.col("vote").alias("features"), F.col("right").alias("label"))
    calibration = IsotonicRegression().fit(judged) if judged.take(1) else None
    return forest, list(labels.labels), calibration


def predict_units(rows: DataFrame, forest, units: list[str]) -> DataFrame:
    """Add the row's ``votes`` by unit ("dimension unit"), and of the first among those of its dimension: ``guess`` and ``vote``."""
    from pyspark.ml.functions import vector_to_array

    rows = rows if "dimension" in rows.columns else rows.withColumn("dimension", F.substring_index("unit", " ", 1))
    # The forest runs once for each row: what follows reads its votes from a table.
    kept = [c for c in rows.columns if c not in ("x", "features")]
    if forest is None:
        cast = rows.select(*kept, F.array(F.lit(1.0)).alias("all"))
    else:
        cast = materialize(forest.transform(rows).select(*kept, vector_to_array("probability").alias("all")), "votes")
    votes = F.arrays_zip(F.col("all").alias("vote"), F.array(*[F.lit(u) for u in units]).alias("unit"))
    own = cast.withColumn("votes", F.filter(votes, lambda v: v["unit"].startswith(F.concat(F.col("dimension"), F.lit(" "))))).drop("all")
    best = own.withColumn("best", F.array_max("votes"))
    return best.withColumn("vote", F.coalesce(F.col("best.vote"), F.lit(0.0))).withColumn("guess", F.col("best.unit")).drop("best")


def calibrated(vote, calibration):
    """The isotonic step function as an expression; its steps are no more than the held-out rows' distinct votes."""
    if calibration is None:
        return F.lit(0.0)
    edges, values = calibration.boundaries.toArray().tolist(), calibration.predictions.toArray().tolist()
    steps, bounds = F.array(*[F.lit(v) for v in values]), F.array(*[F.lit(e) for e in edges])
    # The vote is bound once; named within the filter, the forest's votes would be counted again for every step.
    bound = F.transform(F.array(vote), lambda v: F.element_at(steps, F.greatest(F.lit(1), F.size(F.filter(bounds, lambda e: e <= v)))))
    return F.get(bound, F.lit(0))


#: Dimensions of the systems a unit belongs to, for the neighbours of a figure.
METRIC, IMPERIAL = ("g", "kg", "mg", "mm", "cm", "m", "ml", "cl", "l"), ("oz", "lb", "dwt", "in", "ft", "gal", "cu in", "cu ft")


def with_neighbours(figures: DataFrame) -> DataFrame:
    """Add what the other figures of a listing say: how many carry a metric or an imperial unit in their value, and the magnitude beside it.

    A listing's figures are those of one record.
    """
    mine = F.struct("quantity", "figure")
    other = figures.select("parent_asin", mine.alias("other"), F.col("in_value").isin(*METRIC).cast("int").alias("m"), F.col("in_value").isin(*IMPERIAL).cast("int").alias("i"))
    record = other.groupBy("parent_asin").agg(F.collect_list(F.struct("other", "m", "i")).alias("record"))
    rest = F.filter("record", lambda o: o["other"] != F.struct(F.col("quantity"), F.col("figure")))
    joined = figures.join(record, "parent_asin")
    total = lambda name: F.aggregate(F.transform(rest, lambda o: F.coalesce(o[name], F.lit(0))), F.lit(0), lambda a, x: a + x)
    return joined.withColumn("metric", total("m")).withColumn("imperial", total("i")).withColumn(
        "beside", F.log10(F.greatest(F.array_max(F.transform(rest, lambda o: o["other"]["figure"])), F.lit(1e-6)))).drop("record")


def assign_units(items: DataFrame, stores: DataFrame, confident: float = CONFIDENT, rates: DataFrame | None = None) -> DataFrame:
    """Every figure with its unit, where that comes from, and the amount in the common unit.

    ``source`` is ``value`` where the unit stands in the value itself, so that none is missing. All other units come from the
    forest. Where the record or its store states one (by key, other entries or note), the statement is an exact check of the
    prediction: ``agreed`` (the first choice, with calibrated ``confidence`` of at least ``confident``), ``supported`` (among
    the units the forest finds possible) or ``disputed`` (the forest finds it impossible; the statement holds by rule, and the
    rows say how often it had to). Where nothing is stated: ``predicted`` with at least ``confident``, or ``review`` (amount
    null). Without a model every figure without a unit in its value is left for ``review``.

    With ``rates`` prices are figures too, of a forest of their own. Their unit is a currency, followed by "minor" for
    hundredths; the amount is in US cents, null for a currency without a rate.
    """
    figures = measured(items).join(store_units(stores), "store_key", "left")
    note = F.when(F.col("dimension") == "mass", F.col("note_mass")).when(F.col("dimension") == "length", F.col("note_length"))
    hint = F.coalesce("in_key", "near", note)
    rows = figures.withColumn("hint", F.when(F.col("in_value").isNull(), hint)).withColumn("stated", F.coalesce("in_value", "hint"))
    both = decided(materialize(with_neighbours(rows.drop("note_mass", "note_length")), "figures"), confident)
    factor = F.lit(None).cast("double")
    for dimension, units in FACTORS.items():
        for unit, f in units.items():
            factor = F.when((F.col("dimension") == dimension) & (F.col("unit") == unit), f).otherwise(factor)
    out = both.withColumn("amount", F.floor(F.col("figure") * factor + 0.5).cast("bigint"))
    if rates is None:
        return out
    stated = F.when(F.col("currency").isNotNull(), F.concat("currency", F.when(F.col("minor"), " minor").otherwise("")))
    none = F.lit(None).cast("string")
    priced = price_figures(items, stores).select(
        "parent_asin", "store_key", "category", F.lit("price").alias("quantity"), F.lit("currency").alias("dimension"), F.col("price").alias("figure"),
        none.alias("in_value"), none.alias("hint"), stated.alias("stated"), F.lit(0).alias("metric"), F.lit(0).alias("imperial"), F.lit(None).cast("double").alias("beside"))
    usd = rates.groupBy(F.col("currency").alias("named")).agg(F.max("usd_per_unit").alias("usd"))
    money = decided(materialize(priced.distinct(), "prices"), confident).withColumn("named", F.substring_index("unit", " ", 1)).join(usd, "named", "left")
    cents = F.col("figure") * F.col("usd") * F.when(F.col("unit").endswith(" minor"), 1.0).otherwise(100.0)
    return out.unionByName(money.withColumn("amount", F.floor(cents + 0.5).cast("bigint")).select(out.columns))


def decided(rows: DataFrame, confident: float) -> DataFrame:
    """``parent_asin, quantity, dimension, figure, unit, predicted, source, confidence`` of figures with what is stated of them."""
    from pyspark.ml.functions import array_to_vector

    bare = rows.filter(F.col("in_value").isNull())
    model = train(rows)
    columns = ["parent_asin", "quantity", "dimension", "figure", "unit", "predicted", "source", "confidence"]
    if model is None:
        guessed = bare.withColumn("predicted", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0)).withColumn("source", F.lit("review"))
        guessed = guessed.withColumn("unit", F.lit(None).cast("string"))
    else:
        forest, units, calibration = model
        guessed = predict_units(features(bare).withColumn("features", array_to_vector("x")), forest, units)
        guessed = guessed.withColumn("confidence", calibrated(F.col("vote"), calibration)).withColumn("predicted", F.expr("substring(guess, length(dimension) + 2)"))
        sure = F.col("predicted").isNotNull() & (F.col("confidence") >= confident)
        possible = F.exists("votes", lambda v: (v["vote"] >= POSSIBLE) & (v["unit"] == F.concat_ws(" ", "dimension", "stated")))
        guessed = guessed.withColumn(
            "source",
            F.when(F.col("stated").isNull(), F.when(sure, "predicted").otherwise("review"))
            .when(sure & (F.col("predicted") == F.col("stated")), "agreed").when(possible, "supported").otherwise("disputed"))
        guessed = guessed.withColumn("unit", F.when(F.col("source") == "predicted", F.col("predicted")).otherwise(F.col("stated"))).drop("vote", "votes", "guess")
    known = rows.filter(F.col("in_value").isNotNull()).withColumn("source", F.lit("value")).withColumn("unit", F.col("in_value"))
    known = known.withColumn("predicted", F.lit(None).cast("string")).withColumn("confidence", F.lit(1.0))
    return known.select(columns).unionByName(guessed.select(columns))


def masked_accuracy(items: DataFrame, stores: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """``unit, rows, covered, right``: bare figures of stores the forest has not seen whose unit is stated, and what it says of them.

    The statement is masked; ``covered`` are the figures with calibrated confidence of at least ``confident``, ``right`` those
    of them with the stated unit. The calibration is fitted on half of the held-out stores and judged on the other half.
    """
    from pyspark.ml.functions import array_to_vector

    figures = measured(items).join(store_units(stores), "store_key", "left")
    note = F.when(F.col("dimension") == "mass", F.col("note_mass")).when(F.col("dimension") == "length", F.col("note_length"))
    rows = materialize(with_neighbours(figures.withColumn("stated", F.coalesce("in_value", "in_key", "near", note)).drop("note_mass", "note_length")), "figures")
    part = F.pmod(F.xxhash64(F.coalesce("store_key", "parent_asin")), F.lit(64))
    model = train(rows.filter(part >= HELD // 2))
    if model is None:
        return rows.limit(0).select(F.col("stated").alias("unit"), F.lit(0).alias("rows"), F.lit(0).alias("covered"), F.lit(0).alias("right"))
    forest, units, calibration = model
    unseen = rows.filter((part < HELD // 2) & F.col("in_value").isNull() & F.col("stated").isNotNull())
    judged = predict_units(features(unseen).withColumn("features", array_to_vector("x")), forest, units).withColumn("confidence", calibrated(F.col("vote"), calibration))
    unit, sure = F.concat_ws(" ", "dimension", "stated"), F.col("confidence") >= confident
    return judged.groupBy(unit.alias("unit")).agg(F.count("*").alias("rows"), F.count_if(sure).alias("covered"), F.count_if(sure & (F.col("guess") == unit)).alias("right"))


#: What details call currencies, and the words for hundredths.
CURRENCY_WORDS = {
    "EUR": r"\beur|€", "GBP": r"\bgbp\b|pence|sterling|british|£", "CAD": r"\bcad\b|canad", "JPY": r"\bjpy\b|\byen\b|¥",
    "SEK": r"\bsek\b|krona|kronor", "CHF": r"\bchf\b|franc|rappen", "PLN": r"\bpln\b|zloty|złoty|grosz", "USD": r"\busd\b|\bus\b|u\.s\.|\bdollars?\b",
}
MINOR_WORDS = r"\bcents?\b|cent$|pence|\bpenny\b|hundredths|minor unit|rappen|grosz|\böre\b|centimes|céntimos"
PRICE_KEYS = r"^(?:price (?:basis|note|currency|unit)|listed in|currency)$"


def price_figures(items: DataFrame, stores: DataFrame) -> DataFrame:
    """``parent_asin, store_key, category, price, currency, minor`` of prices that are finite and above zero; null currency where none is stated.

    Currency and scale come from the details, both together, else from the store.
    """
    notes = stores.select(store_key("store").alias("store_key"), F.upper(F.trim("currency")).alias("store_currency"),
                          F.coalesce(F.lower("feed_note").rlike(MINOR_WORDS), F.lit(False)).alias("store_minor"))
    notes = notes.groupBy("store_key").agg(F.max("store_currency").alias("store_currency"), F.max("store_minor").alias("store_minor"))
    said = F.try_element_at(F.filter(F.map_entries("details"), lambda e: F.lower(F.trim(F.regexp_replace(e["key"], "_", " "))).rlike(PRICE_KEYS) & e["value"].isNotNull()), F.lit(1))["value"]
    stated = F.lit(None).cast("string")
    for currency, words in reversed(CURRENCY_WORDS.items()):
        stated = F.when(F.lower("said").rlike(words), currency).otherwise(stated)
    return (
        items.filter(F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") > 0) & (F.col("price") < float("inf")))
        .select("parent_asin", "price", store_key("store").alias("store_key"), F.try_element_at("categories", F.lit(-1)).alias("category"), said.alias("said"))
        .withColumn("own", stated)
        .join(notes, "store_key", "left")
        .withColumn("currency", F.coalesce("own", "store_currency"))
        .withColumn("minor", F.when(F.col("own").isNotNull(), F.lower("said").rlike(MINOR_WORDS)).otherwise(F.coalesce("store_minor", F.lit(False))))
        .drop("said", "own", "store_currency", "store_minor"))


def stated_amounts(items: DataFrame, stores: DataFrame, rates: DataFrame) -> DataFrame:
    """``parent_asin, quantity, amount``, each once: the figures whose unit the record or its store states.

    These are the rows of ``assign_units``, prices among them, that pass the exact check: a unit that was only predicted
    isn't stated, and a statement that the forest finds impossible stands by rule. Defined results: null or empty details
    give no rows; a price that is null, NaN, zero or negative, or of no known currency, gives none; repeated listings give
    one; a bare figure without any statement gives none.
    """
    rows = assign_units(items, stores, rates=rates).filter(F.col("source").isin("value", "agreed", "supported", "disputed") & F.col("amount").isNotNull())
    return rows.select("parent_asin", "quantity", "amount").distinct()
