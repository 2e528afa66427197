"""Text expressions of the search pipeline. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words left out of search terms.
STOPWORDS = (
    "a an and are as at be but by for from i in is it me my of on or please some that the this to want with would you looking"
).split()


def strings(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def empty() -> Column:
    return F.array().cast("array<string>")


def flatten_map(column: str) -> Column:
    """``key value`` of every entry, joined by blanks; null gives the empty text."""
    return F.coalesce(F.concat_ws(" ", F.transform(F.map_entries(column), lambda e: F.concat_ws(" ", e["key"], e["value"]))), F.lit(""))


def flatten_array(column: str) -> Column:
    """Elements joined by blanks; null gives the empty text."""
    return F.coalesce(F.concat_ws(" ", column), F.lit(""))


def all_terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), empty())


def search_terms(text: Column) -> Column:
    """Terms longer than one sign that are no stop words, in order, repeats kept."""
    stop = strings(*STOPWORDS)
    return F.filter(all_terms(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def stem(term: Column) -> Column:
    """Without a final s if longer than three signs."""
    return F.when((F.length(term) > 3) & term.endswith("s"), F.left(term, F.length(term) - 1)).otherwise(term)


def clean(text: Column, limit: int) -> Column:
    """One blank for each run of white space, no blanks and separators at the ends, cut to ``limit`` signs."""
    tight = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ \-;,.]+|[ \-;,.]+$", "")
    return F.rtrim(F.substring(tight, 1, limit))


def folded(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def document_terms(text: Column) -> Column:
    """Runs of letters and digits of any script, folded to lower case without marks; null gives none."""
    return F.coalesce(F.regexp_extract_all(folded(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), empty())
