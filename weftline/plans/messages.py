"""Queries over request messages and single catalogue texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import extract, lexicon as lex, text
from weftline.operators import catalog
from weftline.operators.vocabulary import LISTING_WORDS
from weftline.plans.search import PRODUCTS_SQL, STEM_SQL, STOP_SQL, TERMS_SQL, TEXTS_SQL
from weftline.runtime import table

#: Every request once, by its first delivery.
MESSAGES_SQL = "messages AS (SELECT DISTINCT ON (request_id) request_id, session_id, turn, user_message FROM turns ORDER BY request_id, received_at)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "turns").groupBy("request_id").agg(F.min_by(F.struct("session_id", "turn", "user_message"), "received_at").alias("m"))
    return first.select("request_id", "m.*")


def _of_message(name: str, column):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messages(spark, sf_dir).select("request_id", column(F.col("user_message")).alias(name))
    return query


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.products(table(spark, sf_dir, "catalog_items"))


def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("parent_asin", "title", "store", "average_rating", "rating_number")


def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_lines(table(spark, sf_dir, "catalog_raw")).select("parent_asin", "line_no", "received_at")


def flatten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.field_texts(None)
    return products(spark, sf_dir).select("parent_asin", *[t[f].alias(f) for f in ("categories", "features", "details", "description")])


def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return p.select("parent_asin", catalog.searchable_text(p).alias("text"))


def clean_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).select("parent_asin", F.posexplode("features").alias("pos", "feature"))
    return p.select("parent_asin", "pos", text.clean(F.col("feature"), 180).alias("cleaned"), extract.constraint_kind(F.col("feature")).alias("kind"))


def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = messages(spark, sf_dir).select(F.explode(text.search_terms(F.col("user_message"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).withColumn("stem", text.stem(F.col("term")))


def catalog_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.signals(products(spark, sf_dir)).withColumn("popularity", F.round("popularity", 9))


def product_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of signals that ranking and reranking look up, built from the catalogue."""
    return catalog.product_meta(products(spark, sf_dir)).withColumn("popularity", F.round("popularity", 9))


def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(catalog.signals(products(spark, sf_dir)))


def popularity_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.popularity_scale(catalog.signals(products(spark, sf_dir)))


def popularity_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity over the scale's maximum; unknown ones take the median. The scale is one row."""
    s = catalog.signals(products(spark, sf_dir))
    scale = catalog.popularity_scale(s).first()
    highest, median = scale["highest"] or HIGHEST, scale["median"] or MEDIAN
    return s.select("parent_asin", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("popularity", F.lit(median)) / highest)), 6).alias("norm"))


#: Parts of a category path that say nothing; scale and median of popularity where nothing is known.
GENERAL_PARTS = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
HIGHEST, MEDIAN = 13.0, 0.5


def coarse_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse_columns(products(spark, sf_dir))


def coarse_columns(p: DataFrame) -> DataFrame:
    """``parent_asin, category``: the last two parts of the category path that aren't general."""
    general = text.strings(*GENERAL_PARTS)
    parts = F.transform(F.flatten(F.transform("categories", lambda c: F.split(c, ","))), lambda c: F.trim(c))
    kept = F.coalesce(F.filter(parts, lambda c: (c != "") & ~F.array_contains(general, F.lower(c))), text.empty())
    last = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2))
    return p.select("parent_asin", F.when(F.size(kept) > 0, F.concat_ws(" ", last)).otherwise("clothing item").alias("category"))


def product_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.vocabulary import product_terms as terms

    p = products(spark, sf_dir)
    return p.select("parent_asin", terms(p).alias("terms"))


def extract_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("request_id", extract.budget(F.col("user_message")).alias("b")).select("request_id", "b.least", "b.most")


QUERIES = {f.__name__: f for f in (
    scan_catalog, dedup_last_wins, flatten_text, searchable_text, clean_constraint, stem, catalog_signals, product_meta, slot_coverage, popularity_scale,
    popularity_norm, coarse_category, product_terms, extract_budget)} | {
    "tokenize_terms": _of_message("terms", text.search_terms),
    "extract_category": _of_message("category", extract.category),
    "extract_color": _of_message("colors", extract.colours),
    "extract_material": _of_message("materials", extract.materials),
    "extract_size": _of_message("size", extract.size),
    "extract_brand": _of_message("brand", extract.brand),
    "is_non_answer": _of_message("non_answer", extract.is_non_answer),
    "evidence_confidence": _of_message("confidence", extract.confidence),
}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


COLOUR_LIST, MATERIAL_LIST = _list(catalog.COLOURS), _list(catalog.MATERIALS)
T_SQL = f"coalesce({TERMS_SQL}, [])"
WORD_MAP = "MAP {" + ", ".join(f"'{w}': '{base}'" for w, base in lex.CATEGORY_OF.items()) + "}"
CODE_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in extract.SIZE_CODES.items()) + "}"
ALL_TEXT = "lower(concat_ws(' ', " + ", ".join(TEXTS_SQL[f] for f in ("title", "categories", "store", "features", "details", "description")) + "))"
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
TOK = f"regexp_extract_all({ALL_TEXT}, '[a-z0-9.]+')"
SIGNALS_SQL = f"""signals AS (SELECT parent_asin,
  list_sort(list_distinct(list_transform(list_filter({TOK}, lambda t: list_contains({COLOUR_LIST}, t)), lambda c: CASE WHEN c = 'grey' THEN 'gray' ELSE c END))) AS colors,
  list_sort(list_distinct(list_filter({TOK}, lambda t: list_contains({MATERIAL_LIST}, t)))) AS materials,
  list_sort(list_distinct(regexp_extract_all(lower({TEXTS_SQL['categories']}), '[a-z0-9.]+'))) AS cats,
  lower(coalesce(store, '')) AS store, list_sort(list_distinct(regexp_extract_all({ALL_TEXT}, {_q(catalog.SIZE)}, 1))) AS sizes,
  CASE WHEN NOT isnan(price) THEN price END AS price, CASE WHEN rating_number >= 0 THEN ln(1 + rating_number::DOUBLE) END AS popularity FROM products)"""
CLEAN = "rtrim(left(regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^[ \\-;,.]+|[ \\-;,.]+$', '', 'g'), 180))"
COVER = "SELECT '{0}' AS slot, count(*) FILTER ({1}) / count(*) AS c FROM signals"
LOW = "lower(user_message)"


def _hit(pattern: str, group: int = 1, on: str = LOW) -> str:
    return f"nullif(regexp_extract({on}, {_q(pattern)}, {group}), '')"


MSG = f"WITH {MESSAGES_SQL} SELECT request_id, "
PRO = f"WITH {PRODUCTS_SQL} SELECT parent_asin, "
SCALE_SQL = """known AS (SELECT popularity AS v FROM signals WHERE popularity IS NOT NULL),
scale AS (SELECT round(max(v), 9) AS highest, round(list_sort(list(v))[count(*)::BIGINT // 2 + 1], 9) AS median FROM known)"""
KIND_SQL = """CASE WHEN contains(lower(feature), 'budget') OR regexp_matches(lower(feature), '(\\$|<=|under)\\s*\\d') THEN 'budget'
  WHEN regexp_matches(lower(feature), 'cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric') THEN 'material'
  WHEN regexp_matches(lower(feature), 'color|black|white|blue|red|pink|green') THEN 'color'
  WHEN regexp_matches(lower(feature), 'size|sizing|width|wide|narrow') THEN 'size'
  WHEN regexp_matches(lower(feature), 'department|style|fit|sleeve|neck') THEN 'style'
  WHEN regexp_matches(lower(feature), 'hiking|running|gym|winter|outdoor|work') THEN 'use_case' ELSE 'feature' END"""
SIZE_SQL = f"SELECT request_id, coalesce({CODE_MAP}[raw], raw) AS size FROM (SELECT request_id, coalesce({_hit(extract.SIZED)}, {_hit(extract.BARE_SIZE)}) AS raw FROM messages)"
SQL = {
    "scan_catalog": PRO + "title, store, average_rating, rating_number FROM products",
    "dedup_last_wins": r"""SELECT parent_asin, line_no, received_at FROM (
      SELECT CASE WHEN json_valid(raw_line) AND NOT regexp_matches(raw_line, ',\s*[\}\]]\s*$') THEN json_extract_string(raw_line, '$.parent_asin') END AS parent_asin, line_no, received_at FROM catalog_raw)
      WHERE parent_asin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY received_at DESC NULLS LAST, line_no DESC) = 1""",
    "flatten_text": PRO + ", ".join(f"{TEXTS_SQL[f]} AS {f}" for f in ("categories", "features", "details", "description")) + " FROM products",
    "searchable_text": PRO + "concat_ws(' ', " + ", ".join(TEXTS_SQL[f] for f in ("title", "features", "details", "description", "categories", "store")) + ") AS text FROM products",
    "clean_constraint": f"WITH {PRODUCTS_SQL} SELECT parent_asin, (pos - 1)::INT AS pos, {CLEAN.format('feature')} AS cleaned, {KIND_SQL} AS kind FROM (SELECT parent_asin, unnest(features) AS feature, generate_subscripts(features, 1) AS pos FROM products)",
    "stem": f"WITH {MESSAGES_SQL} SELECT term, count(*) AS n, {STEM_SQL} AS stem FROM (SELECT unnest({TERMS_SQL}) AS term FROM messages) GROUP BY term",
    "catalog_signals": f"WITH {PRODUCTS_SQL}, {SIGNALS_SQL} SELECT * REPLACE (round(popularity, 9) AS popularity) FROM signals",
    "product_meta": "",
    "slot_coverage": f"WITH {PRODUCTS_SQL}, {SIGNALS_SQL} SELECT slot, round(c, 9) AS coverage, round(least(1.0, greatest(0.1, c)), 9) AS reliability FROM (" + " UNION ALL ".join(
        COVER.format(*x) for x in (("category", "len(cats) > 0"), ("brand", "store != ''"), ("material", "len(materials) > 0"), ("color", "len(colors) > 0"), ("size", "len(sizes) > 0"), ("budget", "price IS NOT NULL"))) + ")",
    "popularity_scale": f"WITH {PRODUCTS_SQL}, {SIGNALS_SQL}, {SCALE_SQL} SELECT * FROM scale",
    "popularity_norm": f"WITH {PRODUCTS_SQL}, {SIGNALS_SQL}, {SCALE_SQL} SELECT parent_asin, round(least(1.0, greatest(0.0, coalesce(popularity, median) / highest)), 6) AS norm FROM signals, scale",
    "coarse_category": PRO + """CASE WHEN len(k) > 0 THEN array_to_string(k[greatest(len(k) - 1, 1):], ' ') ELSE 'clothing item' END AS category FROM (
      SELECT parent_asin, coalesce(list_filter(list_transform(flatten(list_transform(categories, lambda c: string_split(c, ','))), lambda c: trim(c)),
        lambda c: c != '' AND NOT list_contains(['clothing', 'clothing shoes & jewelry', 'clothing, shoes & jewelry'], lower(c))), []) AS k FROM products)""",
    "product_terms": PRO + f"""{FIRST.format('t')}[1:40] AS terms FROM (SELECT parent_asin, list_filter(regexp_extract_all(lower(concat_ws(' ', {TEXTS_SQL['title']}, {TEXTS_SQL['categories']},
      {TEXTS_SQL['features']}, {TEXTS_SQL['description']})), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT regexp_matches(w, '[0-9]') AND NOT list_contains({STOP_SQL}, w)
      AND NOT list_contains({_list(LISTING_WORDS)}, w)) AS t FROM products)""",
    "extract_budget": MSG + f"""CASE WHEN r1 IS NOT NULL THEN least(r1, r2) WHEN u IS NULL THEN o END AS least,
      CASE WHEN r1 IS NOT NULL THEN greatest(r1, r2) WHEN u IS NOT NULL THEN u WHEN o IS NULL THEN a END AS most FROM (SELECT request_id,
      {_hit(extract.RANGE)}::DOUBLE AS r1, {_hit(extract.RANGE, 2)}::DOUBLE AS r2, {_hit(extract.UNDER)}::DOUBLE AS u, {_hit(extract.OVER)}::DOUBLE AS o,
      coalesce({_hit(extract.AROUND)}, {_hit(extract.DOLLARS)}, {_hit(extract.SIGN)})::DOUBLE AS a FROM messages)""",
    "tokenize_terms": MSG + f"{T_SQL} AS terms FROM messages",
    "extract_category": MSG + f"list_filter(list_transform({T_SQL}, lambda t: {WORD_MAP}[t]), lambda c: c IS NOT NULL)[1] AS category FROM messages",
    "extract_color": MSG + f"{FIRST.format('c')} AS colors FROM (SELECT request_id, list_transform(list_filter({T_SQL}, lambda t: list_contains({COLOUR_LIST}, t)), lambda c: CASE WHEN c = 'grey' THEN 'gray' ELSE c END) AS c FROM messages)",
    "extract_material": MSG + f"{FIRST.format('c')} AS materials FROM (SELECT request_id, list_filter({T_SQL}, lambda t: list_contains({MATERIAL_LIST}, t)) AS c FROM messages)",
    "extract_size": f"WITH {MESSAGES_SQL} {SIZE_SQL}",
    "extract_brand": MSG + f"coalesce(CASE WHEN b = 'levis' THEN 'levi' ELSE b END, w) AS brand FROM (SELECT request_id, {_hit('(?:^|[^a-z])(' + extract.BRANDS + ')(?:[^a-z]|$)')} AS b, {_hit(chr(92) + 'bbrand' + chr(92) + 's+([a-z][a-z0-9&' + chr(39) + chr(92) + '-]{1,20})' + chr(92) + 'b')} AS w FROM messages)",
    "evidence_confidence": f"""WITH {MESSAGES_SQL}, said AS (SELECT request_id, user_message, {T_SQL} AS t FROM messages)
      SELECT request_id, CASE WHEN len(list_filter(t, lambda w, i: list_contains({_list(lex.REQUIREMENT_WORDS)}, w) AND NOT list_has_any(t[greatest(1, i - 3):i - 1], {_list(lex.NEGATIONS)}))) > 0 THEN 1.0::DOUBLE
        WHEN list_has_any(t, {_list((*lex.REQUIREMENT_WORDS, *lex.HEDGES))}) THEN 0.4 WHEN coalesce(regexp_matches(lower(user_message), {_q(lex.REPLACE_CUE)}), false) THEN 0.9 ELSE 0.7 END AS confidence FROM said""",
    "is_non_answer": MSG + f"coalesce(regexp_matches({LOW}, {_q(extract.NON_ANSWER)}), false) AS non_answer FROM messages",
}
_traits = _list(dict.fromkeys(w for words in catalog.TAG_TRAITS.values() for w in words))
SQL["product_meta"] = f"""WITH {PRODUCTS_SQL}, {SIGNALS_SQL}, named AS ({SQL['product_terms'].split('WITH ' + PRODUCTS_SQL, 1)[1].strip()}),
  traited AS (SELECT parent_asin, list_sort(list_distinct(list_filter({TOK}, lambda t: list_contains({_traits}, t)))) AS traits FROM products)
  SELECT signals.* REPLACE (round(popularity, 9) AS popularity), traits, array_to_string(terms, ' ') AS vocab FROM signals JOIN named USING (parent_asin) JOIN traited USING (parent_asin)"""
