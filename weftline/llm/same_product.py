"""Listings of the same product, by voting over combinations of title tokens.

Titles are cleared of what any listing might say (marketing, types, colours, packs, measures, codes). Of the tokens left,
k-combinations are generated and scored by their frequency over all titles, their length and their average position; each
title is assigned its best combination, misspelt titles the one their corrected tokens vote for. A combination names a
model; clusters are verified and split by brand, generation, colour, pack count and main measure, and merged where
listings share a style code. Statements that a listing doesn't make are filled in only where its cluster leaves no choice.

No step looks at pairs of listings: candidates meet by equal keys, and keys are aggregated before they are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.operators.catalog import COLOURS
from weftline.operators.units import FACTORS, number, readings, unit_at
from weftline.runtime import materialize, spread

#: A token that more than this share of the other brands' listings shows is general language, unless it is a brand.
GENERAL = 0.004

#: Tokens of a combination: models of this domain have two words.
K = 2

#: Announcements that make a word a brand; brands that a general word occurs with at least.
ANNOUNCED, BRANDS = 2, 4

#: A colour is the first of these words that a text has outside the name of a metal; both spellings of grey are one.
COLOUR = re.compile(r"\b(" + "|".join(COLOURS) + r")\b")
#: Materials that contain the name of a colour.
METALS = re.compile(r"\b(?:sterling silver|rose gold(?: plate)?|white gold|gold plate|stainless steel)\b")
#: Endings of the names of surface finishes, which many products share. Without them the votes alone set finishes and models
#: apart, with fewer pairs found: recall on hidden codes 0.674 in place of 0.72.
FINISH = re.compile(r"(?:weave|print|stitch|twill|tone|grain|knit|cut|ette|palette)$")
#: How listings name a style code, a brand, a pack and a generation.
CODE = re.compile(r"\b(?:model|style|ref\.?|art\. no\.?|item no\.?|sku)\s+((?=[a-z]{0,8}[ -]?[a-z0-9]*)[a-z]{1,3}[ -]?[a-z0-9]{4,6})\b(?=\W|$)")
BRAND = re.compile(r"^(?:brand:?|by|made by)\s+(\S+)$")
PACK = re.compile(r"\b(\d+)[- ]?pack\b|\b(?:pack|set) of (\d+)\b|\b(\d+) ?(?:pcs|pieces|piece)\b\.?")
GENERATION = re.compile(r"\b(?:mk|mark|gen|generation|v|version|series)[. ]*(\d{1,2}|[ivx]{1,4})\b")
ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
MEASURE = re.compile(r"(\d+(?:[.,]\d+)*)\s*(mm|cms?|inch(?:es)?|in|[\"”]|feet|ft|met(?:er|re)s?|m|lit(?:er|re)s?|ltr|ml|l|(?:us )?gal(?:lons?)?|cu\.? ?(?:in|ft)\.?)(?![\w])")
MAIN = ("case_diameter", "chain_length", "capacity")
WORDS = re.compile(r"[^\W\d_]{3,}")
#: Words that a line may have beside a measure to be a statement of it: its label.
LABEL = 2


JOINED = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")


def fold(text: str) -> str:
    """Without accents, joined words set apart, in lower case."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(JOINED.sub(" ", text).lower().split())


def precise(figure: str, unit: str) -> tuple[float, float] | None:
    """A figure in the common unit of its dimension, and half a unit of its last place. Volumes are kept apart by their sign."""
    for dimension in ("length", "volume"):
        name, _ = unit_at(unit, dimension)
        if name:
            factor = FACTORS[dimension][name]
            last = len(re.split(r"[.,]", figure)[-1]) if re.search(r"[.,]\d{1,2}$", figure) else 0
            sign = 1 if dimension == "length" else -1
            return sign * number(figure) * factor, 0.5 * factor / 10**last
    return None


def read_listing(title, features, description, details) -> tuple:
    """What a listing states: (brand cue, generation, colour, pack, measure, slack, code, weight, words left of the title)."""
    head = fold(title or "")
    lines = [fold(x) for x in (features or []) if x]
    prose = [fold(x) for x in (description or []) if x]
    code = None
    for text in (head, *lines, *prose):
        m = next((m for m in CODE.finditer(text) if re.search(r"\d", m.group(1)) or re.fullmatch(r"[a-z]{2}[ -]?[a-z]{5}", m.group(1))), None)
        if m:
            code = re.sub(r"[^a-z0-9]", "", m.group(1)).upper()
            break
    head = CODE.sub(" ", head)
    brand = next((m.group(1).strip(".,") for x in lines if (m := BRAND.match(x))), None)
    pack = 1
    for text in (head, *lines, *prose):
        m = PACK.search(text)
        if m:
            pack = int(next(g for g in m.groups() if g))
            break
    head = PACK.sub(" ", head)
    measures, weight = [], None
    for text in (head, *lines, *prose):
        m = MEASURE.search(text)
        if m and (text is head or len(WORDS.findall(text[: m.start()] + " " + text[m.end() :])) <= LABEL):
            got = precise(m.group(1), m.group(2))
            if got:
                measures.append(got)
    for quantity, dimension, figure, in_value, in_key, near in readings(details):
        unit = in_value or in_key or near
        if quantity == "weight" and unit and weight is None:
            weight = figure * FACTORS[dimension][unit]
        if quantity in MAIN and unit:
            factor = FACTORS[dimension][unit]
            text = f"{figure:.10g}"
            last = len(text.partition(".")[2])
            slack = 0.5 * factor / 10 ** min(last, 2) if unit not in ("in", "ft") or last < 3 else factor / 16
            measures.append(((1 if dimension == "length" else -1) * figure * factor, slack))
    measure, slack = min(measures, key=lambda m: m[1] / abs(m[0] or 1)) if measures else (None, None)
    head = MEASURE.sub(" ", head)
    generation = 1
    m = GENERATION.search(head)
    if m:
        generation = int(m.group(1)) if m.group(1).isdigit() else ROMAN.get(m.group(1), 1)
        head = GENERATION.sub(" ", head)
    else:
        for w in re.findall(r"[a-z0-9]+", head):
            if w in ROMAN and w != "v" or w.isdigit() and 2 <= int(w) <= 99:
                generation = ROMAN.get(w) or int(w)
    plain = METALS.sub(" ", head)
    shade = COLOUR.search(plain)
    if not shade:
        shade = next((m for x in lines if len(x.split()) < 5 and (m := COLOUR.search(METALS.sub(" ", x)))), None)
    if not shade:
        shade = next((m for x in prose if " shade " in x and (m := COLOUR.search(x))), None)
    colour = {"gray": "grey"}.get(shade.group(1), shade.group(1)) if shade else None
    words = [w for w in WORDS.findall(COLOUR.sub(" ", plain)) if not FINISH.search(w) and w not in ROMAN]
    return brand, generation, colour, pack, measure, slack, code, weight, list(dict.fromkeys(words))


def facts(listings: DataFrame) -> DataFrame:
    """What each listing states, one row per listing; of repeated rows one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string())]
        names = ["asin", "cued", "generation", "colour", "pack", "measure", "slack", "code", "weight", "words"]
        for batch in batches:
            rows = [(a, *read_listing(*rest)) for a, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)))]
            columns = list(zip(*rows)) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "asin string, cued string, generation int, colour string, pack int, measure double, slack double, code string, weight double, words array<string>"
    one = spread(listings.select("parent_asin", "title", "features", "description", "details"))
    read = one.mapInArrow(run, schema)
    whole = ["cued", "generation", "colour", "pack", "measure", "slack", "code", "weight", "words"]
    return read.groupBy("asin").agg(F.max(F.struct(*whole)).alias("f")).select("asin", "f.*")


def roles(stated: DataFrame, general: float = GENERAL) -> tuple[DataFrame, DataFrame]:
    """Tables of ``w``: brands (words that listings announce as such, twice at least) and general words.

    A word is general by the share of listings that show it outside the brand it occurs with most, over listings of known
    brand, and by ``BRANDS`` different brands. So the words of a product stay, however many copies it has: all of them are
    of one brand, or of none that can be seen. Where fewer brands are known at all, the share of all listings decides.
    """
    n = stated.count()
    brands = materialize(stated.filter(F.col("cued").isNotNull()).groupBy(F.col("cued").alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= ANNOUNCED).select("w"), "brands")
    words = stated.select("asin", F.posexplode("words").alias("at", "w"))
    common = words.groupBy("w").agg(F.count("*").alias("n")).filter((F.col("n") > general * n) & (F.col("n") > 7)).select("w")
    if brands.count() >= BRANDS:
        cued = stated.select("asin", F.col("cued").alias("w")).join(brands, "w").select("asin", F.lit(-1).alias("at"), "w")
        of_brand = cued.unionByName(words.join(brands, "w").select("asin", "at", "w")).groupBy("asin").agg(F.min_by("w", "at").alias("b"))
        of_brand = materialize(of_brand, "of_brand")
        sizes = of_brand.groupBy("b").agg(F.count("*").alias("size"))
        total = of_brand.count()
        held = words.join(common, "w", "left_semi").join(of_brand, "asin").groupBy("w", "b").agg(F.count("*").alias("n")).join(sizes, "b")
        spread_of = held.groupBy("w").agg(F.sum("n").alias("seen"), F.count("*").alias("brands"), F.max(F.struct("n", "size")).alias("top"))
        outside = (F.col("seen") - F.col("top.n")) > general * (F.lit(total) - F.col("top.size"))
        common = spread_of.filter(outside & (F.col("brands") >= BRANDS)).select("w")
    return brands, materialize(common.join(brands, "w", "left_anti"), "general")


def combinations(titles: DataFrame, k: int = K) -> DataFrame:
    """``asin, combination, usual, gap, place``: the ``k``-combinations of each title's tokens, with the distance from first to last and the place of the first.

    ``tokens`` are words with the number of titles that have them; ``usual`` is the geometric mean of a combination's. The
    tokens of a combination are sorted, so that their order in the title counts by the distance only. A title of fewer tokens
    has one combination, of all of them.
    """
    n = F.size("tokens")
    grown = titles.filter(n > 0).withColumn("sets", F.transform("tokens", lambda a, i: F.struct(F.array(a).alias("c"), i.alias("first"), i.alias("last"))))
    for step in range(1, k):
        longer = F.flatten(F.transform("sets", lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > s["last"]),
            lambda j: F.struct(F.concat(s["c"], F.array(F.get("tokens", j))).alias("c"), s["first"].alias("first"), j.alias("last")))))
        grown = grown.withColumn("longer", longer).withColumn("sets", F.when(n > step, F.col("longer")).otherwise(F.col("sets"))).drop("longer")
    whole = F.array(F.struct(F.col("tokens").alias("c"), F.lit(0).alias("first"), (n - 1).alias("last")))
    each = grown.withColumn("sets", F.when(n <= k, whole).otherwise(F.col("sets"))).select("asin", F.inline("sets"))
    usual = F.exp(F.aggregate("c", F.lit(0.0), lambda a, x: a + F.log(x["n"].cast("double"))) / F.size("c"))
    return each.select("asin", F.concat_ws(" ", F.array_sort(F.transform("c", lambda x: x["w"]))).alias("combination"), usual.alias("usual"),
                       (F.col("last") - F.col("first")).alias("gap"), F.col("first").alias("place"))


def vote(titles: DataFrame, k: int = K) -> DataFrame:
    """``asin, combination``: the best combination of each title, directly or by corrected spelling; where none has other votes, its own best.

    Frequency is that of the combination and relative to its tokens' own: words that stand beside anything, such as names of
    finishes, get no weight by being common.
    """
    offered = materialize(combinations(titles, k), "combinations")
    polled = offered.groupBy("combination").agg(F.count("*").alias("votes"), F.max("usual").alias("usual"), F.avg("gap").alias("gap"), F.avg("place").alias("place"))
    # Frequency, length and average position: more votes, longer and closer tokens, and the later place where a brand stands in front.
    score = F.log2(1 + F.col("votes")) * F.sqrt(F.col("votes") / F.col("usual")) * F.sqrt(F.length("combination")) / (F.col("gap") * F.col("gap") + 0.1) + F.least(F.col("place"), F.lit(4.0)) / 10_000
    polled = materialize(polled.withColumn("score", score), "polled")
    backed = polled.filter(F.col("votes") > 1).select("combination", "score")
    best = offered.select("asin", "combination").join(backed, "combination").groupBy("asin").agg(F.max_by("combination", F.struct("score", "combination")).alias("combination"))
    best = materialize(best, "best")
    lone = offered.join(best.select("asin"), "asin", "left_anti")
    own = lone.groupBy("asin").agg(F.max_by("combination", F.struct(
        F.length("combination") / (1 + F.col("gap")) + F.least(F.col("place"), F.lit(4)) / 100, "combination")).alias("combination"))
    lone = lone.select("asin", "combination").distinct()
    fixed = materialize(respelt(lone, backed).unionByName(rejoined(titles.select("asin", F.transform("tokens", lambda x: x["w"]).alias("tokens")).join(best.select("asin"), "asin", "left_anti"), backed))
                        .groupBy("asin").agg(F.max("combination").alias("combination")), "fixed")
    return best.unionByName(fixed).unionByName(own.join(fixed.select("asin"), "asin", "left_anti"))


def rejoined(titles: DataFrame, backed: DataFrame) -> DataFrame:
    """Combinations with votes that a title writes as one word, in either order."""
    words = titles.select("asin", F.explode("tokens").alias("key"))
    parts = F.split("combination", " ")
    glued = F.array_distinct(F.array(F.concat_ws("", parts), F.concat_ws("", F.reverse(parts))))
    return words.join(backed.withColumn("key", F.explode(glued)), "key").groupBy("asin").agg(
        F.max_by("combination", F.struct("score", "combination")).alias("combination"))


def deletions(word: str):
    """A word and all that come of it by leaving out one letter, as an array expression."""
    w = F.col(word)
    return F.array_distinct(F.concat(F.array(w), F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))))


def respelt(lone: DataFrame, backed: DataFrame) -> DataFrame:
    """Combinations with votes that differ in one token, by one letter (left out, added, changed or swapped with the next), from a title's own.

    Each token's neighbourhood is joined together with the hash of the other tokens, so that only spellings meet that share those.
    """
    def near(sets: DataFrame, keep: list) -> DataFrame:
        tokens = sets.withColumn("t", F.split("combination", " "))
        each = tokens.select("*", F.posexplode("t").alias("at", "word"))
        rest = F.xxhash64(F.filter("t", lambda x, i: i != F.col("at")))
        return each.withColumn("rest", rest).withColumn("near", F.explode(deletions("word"))).select(*keep, F.xxhash64("near", "rest").alias("key"), "word", "rest")

    mine = near(lone, ["asin", F.col("combination").alias("own")]).withColumnRenamed("word", "mine").withColumnRenamed("rest", "beside")
    theirs = near(backed, ["combination", "score"])
    return mine.join(theirs, "key").filter((F.col("beside") == F.col("rest")) & (F.levenshtein("mine", "word") <= 2)).groupBy("asin").agg(
        F.max_by("combination", F.struct("score", "combination")).alias("combination"))


def only(column: str) -> Column:
    """The one value that a group has, null if it has several, as an aggregate."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def with_group(rows: DataFrame, keys: list[str], **facts: Column) -> DataFrame:
    """Rows with facts of their group. Rows are written once and read twice: the facts are aggregated before they are shuffled, and joined back by keys without nulls; AQE splits a group of a third of all rows."""
    rows = materialize(rows, "grouped")
    return rows.join(rows.groupBy(*keys).agg(*[f.alias(name) for name, f in facts.items()]), keys)


def cluster(listings: DataFrame, general: float = GENERAL, k: int = K) -> DataFrame:
    """``parent_asin, product`` of every listing that has a model or a style code; equal ``product`` means the same product.

    Defined results: a listing whose title is null or names no model, and that shows no code, gets no row, since nothing
    identifies it; the order of words in a title doesn't matter; repeated rows give one; a colour, brand or measure left out is
    taken from the cluster if that has only one, else the listing stands alone; words that more than the share ``general`` of
    other brands' listings show name no model; other columns aren't read; an empty table gives an empty one.
    """
    stated = materialize(facts(listings), "stated")
    brands, common = roles(stated, general)
    # The first brand word of a title is the brand, later ones are of the model; a title has a model of two words at least.
    words = stated.select("asin", F.posexplode("words").alias("at", "w")).join(common, "w", "left_anti")
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    named = words.join(counts, "w").join(brands.withColumn("is_brand", F.lit(True)), "w", "left")
    left = named.groupBy("asin").agg(F.array_sort(F.collect_list(F.struct("at", "w", "n", F.coalesce("is_brand", F.lit(False)).alias("is_brand")))).alias("left"))
    rows = stated.drop("words").join(left, "asin", "left").join(brands.select(F.col("w").alias("cued"), F.lit(True).alias("announced")), "cued", "left")
    rows = rows.withColumn("left", F.coalesce("left", F.array().cast("array<struct<at:int,w:string,n:bigint,is_brand:boolean>>")))
    first = F.get(F.filter("left", lambda x: x["is_brand"]), F.lit(0))["w"]
    size, at_front = F.size("left"), F.get("left", F.lit(0))["w"] == first
    rows = rows.withColumn("brand", F.when(F.col("announced"), F.col("cued")).when(size != 2, first).when(~at_front, first))
    tokens = F.transform(F.filter("left", lambda x: F.col("brand").isNull() | (x["w"] != F.col("brand"))), lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n")))
    titles = materialize(rows.withColumn("tokens", tokens).drop("left", "cued", "announced"), "titles")
    voted = materialize(titles.drop("tokens").join(vote(titles.select("asin", "tokens"), k), "asin", "left"), "voted")
    # One code is one product: what one of its listings states holds for all of them.
    best = F.min(F.when(F.col("measure").isNotNull(), F.struct("slack", "measure")))
    coded = with_group(voted.filter(F.col("code").isNotNull()), ["code"], c=F.mode("combination", True), b=F.mode("brand", True), s=F.mode("colour", True), w=F.max("weight"), p=F.max("pack"), g=F.max("generation"), m=best)
    coded = coded.select("asin", "code", F.coalesce("c", "combination").alias("combination"), F.coalesce("b", "brand").alias("brand"), F.coalesce("s", "colour").alias("colour"),
                         F.col("w").alias("weight"), F.col("p").alias("pack"), F.col("g").alias("generation"), F.col("m.measure").alias("measure"), F.col("m.slack").alias("slack"))
    rows = coded.unionByName(voted.filter(F.col("code").isNull())).filter(F.col("combination").isNotNull() | F.col("code").isNotNull())
    rows = rows.withColumn("model", F.coalesce("combination", F.concat(F.lit("#"), "code")))
    rows = with_group(rows, ["model"], one=only("brand")).withColumn("brand", F.coalesce("brand", "one", F.lit(""))).drop("one")
    rows = materialize(rows, "models")
    rows = materialize(shaded(rows).select("asin", "model", "brand", "generation", "pack", "shade", "measure", "slack", "code"), "variants")
    # Measures of a variant in rising order: a gap wider than what rounding explains begins another product.
    same = ["model", "brand", "generation", "pack", "shade"]
    steps = Window.partitionBy(*same).orderBy("measure")
    values = rows.filter(F.col("measure").isNotNull()).groupBy(*same, "measure").agg(F.min("slack").alias("slack"))
    gap = F.col("measure") - F.lag("measure").over(steps) > F.col("slack") + F.lag("slack").over(steps) + 6
    values = values.withColumn("step", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(steps)).drop("slack")
    rows = with_group(rows.join(values, [*same, "measure"], "left"), same, one=only("step"), most=F.max("step"))
    filled = F.coalesce("step", "one", F.when(F.col("most").isNotNull(), F.lit(-1)), F.lit(0))
    alone = F.when(F.col("step").isNull() & (F.col("filled") == -1), F.coalesce("code", "asin")).otherwise(F.lit(""))
    rows = rows.withColumn("filled", filled).withColumn("alone", alone).drop("one", "most")
    # Different codes are different products; listings without a code belong to the only code of their key.
    keyed = with_group(rows, [*same, "filled", "alone"], one=only("code"))
    coding = F.when(F.col("one").isNotNull(), F.lit("")).otherwise(F.coalesce("code", F.lit("")))
    return keyed.select(F.col("asin").alias("parent_asin"), F.concat_ws("|", "model", "brand", "generation", "pack", "shade", "filled", "alone", coding).alias("product"))


def shaded(rows: DataFrame) -> DataFrame:
    """Give each row a ``shade``: the colour it states, or the one colour of its variant that its weight and code allow.

    Weights tell variants apart where stated: listings of one product state the same weight up to rounding. A row for which
    no colour or several remain keeps a shade of its own.
    """
    same = ["model", "brand", "generation", "pack"]
    known = rows.filter(F.col("colour").isNotNull())
    shades = known.groupBy(*same, "colour").agg(
        F.min("weight").alias("least"), F.max("weight").alias("most"), F.min("code").alias("low"), F.max("code").alias("high"))
    own = F.concat(F.lit("?"), F.coalesce("code", "asin"))
    open_rows = rows.filter(F.col("colour").isNull()).drop("colour")
    fits = (F.col("weight").isNull() | F.col("least").isNull() | F.col("weight").between(F.col("least") * 0.99 - 0.6, F.col("most") * 1.01 + 0.6)) & (
        F.col("code").isNull() | F.col("low").isNull() | ((F.col("low") == F.col("code")) & (F.col("high") == F.col("code"))))
    offers = open_rows.join(shades, same).filter(fits)
    exact = F.col("weight").isNotNull() & F.col("least").isNotNull()
    # The colours of a variant are few, so are the offers to a row.
    chosen = offers.groupBy("asin").agg(
        F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.min("colour").alias("one"), F.min(F.when(exact, F.col("colour"))).alias("one_exact"))
    pick = F.when(F.col("n_exact") == 1, F.col("one_exact")).when(F.col("n") == 1, F.col("one"))
    filled = open_rows.join(chosen, "asin", "left").withColumn("shade", F.coalesce(pick, own)).drop("n", "n_exact", "one", "one_exact")
    return known.withColumn("shade", F.col("colour")).drop("colour").unionByName(filled)


def same_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of a product, the smaller id first, as the question asks for."""
    a, b = clusters.withColumnRenamed("parent_asin", "asin_a"), clusters.withColumnRenamed("parent_asin", "asin_b")
    return a.join(b, "product").filter("asin_a < asin_b").select("asin_a", "asin_b")
