"""Deeply nested records as flat tables: Dewey labels, parents by truncation, one table per schema path.

Every object that is an element of an array gets a Dewey label: the keys and 0-based positions that lead to it. The label
alone carries the hierarchy, since the label of the enclosing object is a prefix of it; no parent pointer is threaded
through the parse. Whether an object that stands alone under a key is an element can only be told from the whole
collection (do other records hold an array of objects there?), so such a step is emitted as *open* together with its
schema path, and settled by a join with the schema paths that hold arrays.

Schema paths leave out positions, and a key that recurs on its own path (a part of a part) leads back to its first
occurrence, so that recursive structures share one table at any depth.

Array elements that are objects are not all that a record holds. What else there is, objects alone under a key and scalars
in arrays or right under a field, comes out as rows of tables of their own if the whole is asked for.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.runtime import materialize, spread

#: Kinds of a step: key, position of an array in an array, position of an object, an object alone whose step is open, and position of a scalar.
KEY, INNER, ELEMENT, OPEN, VALUE = "k", "a", "o", "?", "v"

NODE = T.StructType([
    T.StructField("record", T.LongType()),
    T.StructField("steps", T.ArrayType(T.StringType())),
    T.StructField("kinds", T.ArrayType(T.StringType())),
    T.StructField("open_at", T.ArrayType(T.StringType())),
    T.StructField("schema_path", T.StringType()),
    T.StructField("scalars", T.StringType()),
])


TOKEN = re.compile(r'[ \t\n\r]*([\[\]{},:]|"(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+)', re.S)
END = re.compile(r"[ \t\n\r]*\Z")
#: Halves of a surrogate pair, which JSON can escape one by one but no text column can hold.
LONE = re.compile("[\ud800-\udfff]")


def parse_json(text: str):
    """The value of a JSON text of any depth.

    The library's parser recurses, so it gives up on some depth; what it gives up on is read here with a stack of its own.
    Whole numbers too long for a conversion stay texts. Raises ValueError for what is no JSON.
    """
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)
    except json.JSONDecodeError:
        raise
    except ValueError:  # a number of thousands of digits
        return json.loads(text, parse_int=_whole) if text.count("[") + text.count("{") < 500 else _parse_deep(text)


def _whole(digits: str):
    return int(digits) if len(digits) < 4000 else digits


def _scalar(token: str):
    return json.loads(token, parse_int=_whole)


def _parse_deep(text: str):
    root: list = []
    stack, at, token_at = [root], 0, TOKEN.match
    key, want = None, "value"  # what may come next: a value, the first value or end, a key, the first key or end, a colon, a comma or end
    while not (len(stack) == 1 and root):
        m = token_at(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        token, at, top = m.group(1), m.end(), stack[-1]
        if want in ("key", "first key"):
            if token[0] == '"':
                key, want = json.loads(token), "colon"
                continue
            if token != "}" or want == "key":
                raise ValueError(f"no key at {at}")
        elif want == "colon":
            if token != ":":
                raise ValueError(f"no colon at {at}")
            want = "value"
            continue
        elif want == "comma" and token == ",":
            want = "key" if isinstance(top, dict) else "value"
            continue
        if token in ("]", "}"):
            if want in ("value", "key") or isinstance(top, dict) != (token == "}") or len(stack) == 1:
                raise ValueError(f"unexpected end at {at}")
            stack.pop()
            want = "comma"
            continue
        if want not in ("value", "first"):
            raise ValueError(f"no comma at {at}")
        value = [] if token == "[" else {} if token == "{" else _scalar(token)
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        want = "comma"
        if token in ("[", "{"):
            stack.append(value)
            want = "first" if token == "[" else "first key"
    if not END.match(text, at):
        raise ValueError(f"more than one value at {at}")
    return root[0]


def read_value(v):
    """A text that as a whole is a JSON array or object is read as that value, again and again; anything else stays."""
    while isinstance(v, str):
        s = v.strip()
        if not (s[:1] == "[" and s[-1:] == "]" or s[:1] == "{" and s[-1:] == "}"):
            return v
        try:
            inner = parse_json(s)
        except ValueError:
            return v
        if not isinstance(inner, (list, dict)):
            return v
        v = inner
    return v


def deeper(schema: tuple[str, ...], key: str) -> tuple[str, ...]:
    """The schema path one key further; a key that is already on the path leads back to it."""
    return schema[: schema.index(key, 1) + 1] if key in schema[1:] else (*schema, key)


def joined(schema: tuple[str, ...]) -> str:
    """A schema path as text; "~" and "/" in keys are written "~0" and "~1", as in JSON pointers."""
    return "/".join(k.replace("~", "~0").replace("/", "~1") if "/" in k or "~" in k else k for k in schema)


def values_path(schema: tuple[str, ...]) -> str:
    """The schema path of the scalars in the arrays at ``schema``; no key is written "~", so no table of objects has it."""
    return f"{joined(schema)}/~"


def as_json(flat: dict) -> str:
    """An object of scalars as JSON; NaN and infinities, which JSON has not, become texts, so that they hide no other field."""
    try:
        return json.dumps(flat, ensure_ascii=False, allow_nan=False)
    except ValueError:
        return json.dumps({k: json.dumps(x) if isinstance(x, float) and not math.isfinite(x) else x for k, x in flat.items()}, ensure_ascii=False)


def dewey(record: dict, fields: tuple[str, ...], scalars: bool = True, whole: bool = False) -> Iterator[tuple]:
    """(steps, kinds, schema path of each open step, schema path, scalars) of each object below ``fields`` that is or may be an array's element.

    With ``whole`` also those of each scalar or null that is no field of an object, so that together the rows hold all that
    is below ``fields``. An explicit stack replaces recursion, so depth isn't limited. Keys are escaped in schema paths, so
    that a key with "/" makes no path of two keys.
    """
    stack = [((f,), (KEY,), (), (f,), record[f]) for f in reversed(fields) if f in record]
    while stack:
        steps, kinds, opened, schema, v = stack.pop()
        v = read_value(v)
        if isinstance(v, list):
            below = []
            for i, x in enumerate(v):
                x = read_value(x)
                if isinstance(x, dict):
                    below.append(((*steps, str(i)), (*kinds, ELEMENT), opened, schema, x))
                elif isinstance(x, list):
                    below.append(((*steps, str(i)), (*kinds, INNER), opened, schema, x))
                elif whole:
                    yield (*steps, str(i)), (*kinds, VALUE), opened, values_path(schema), as_json({"value": x}) if scalars else None
            stack.extend(reversed(below))
        elif isinstance(v, dict):
            opened = (*opened, *[None] * (len(steps) - len(opened)))
            if kinds[-1] == KEY:
                steps, kinds, opened = (*steps, "0"), (*kinds, OPEN), (*opened, joined(schema))
            flat = {k: x for k, x in v.items() if x is None or isinstance(x, (str, int, float, bool))} if scalars else None
            yield steps, kinds, opened, joined(schema), as_json(flat) if scalars else None
            stack.extend(((*steps, k), (*kinds, KEY), opened, deeper(schema, k), x) for k, x in reversed(v.items()))
        elif whole and len(steps) == 1:
            yield steps, kinds, opened, values_path(schema), as_json({"value": v}) if scalars else None


def label_nodes(lines: DataFrame, record: str, text: str, fields: tuple[str, ...], scalars: bool = True, whole: bool = False) -> DataFrame:
    """Dewey-labelled objects of every line that parses as a JSON object; others (broken, blank, null, not an object) give none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column("record").to_pylist(), batch.column("line").to_pylist()):
                if raw is None:
                    continue
                try:
                    value = parse_json(raw)
                except ValueError:
                    continue
                if isinstance(value, dict):
                    rows.extend((key, *node) for node in dewey(value, fields, scalars, whole))
                if len(rows) > 20_000:
                    yield to_batch(rows)
                    rows = []
            yield to_batch(rows)

    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        try:
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        except UnicodeEncodeError:
            arrays = [pa.array([encodable(x) for x in c], k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=NODE.fieldNames())

    def encodable(x):
        return LONE.sub("\ufffd", x) if isinstance(x, str) else tuple(map(encodable, x)) if isinstance(x, tuple) else x

    return spread(lines.select(F.col(record).cast("long").alias("record"), F.col(text).alias("line"))).mapInArrow(parse, NODE)


def flatten_records(lines: DataFrame, record: str, text: str, fields: tuple[str, ...], scalars: bool = True, whole: bool = False) -> DataFrame:
    """Flat rows ``record, node_path, parent_path, ordinal, depth, schema_path, scalars`` of all array elements that are objects.

    ``scalars`` holds the element's own scalar fields as JSON, so that rows of one ``schema_path`` form one table, linked
    by ``(record, parent_path)``; it is null without ``scalars``. Defined results: a line that is null, blank, broken or no object gives no rows; empty
    objects count; nulls, scalars and arrays as elements do not; an empty table gives an empty table; repeated lines each
    give their rows; nesting may be of any depth; columns besides ``record`` and ``text`` are ignored, whatever their names.
    Half a surrogate pair becomes U+FFFD; NaN and infinities become texts.

    With ``whole`` there are further rows for the rest of what the fields hold: one for each object alone under a key or
    field that is no element, in the table of its schema path; and one for each scalar or null that is an array's element
    or a field's only value, in the table of the array's schema path and "/~", as ``value``. Their ``parent_path`` is the
    nearest enclosing element too, their ``depth`` the number of enclosing elements, and their ``ordinal`` the place in
    the array, null outside of one. Only empty arrays leave no row.
    """
    nodes = materialize(label_nodes(lines, record, text, fields, scalars, whole).withColumn("node", F.monotonically_increasing_id()), "dewey")
    arrays = nodes.filter(F.element_at("kinds", -1) == ELEMENT).select(F.col("schema_path").alias("at")).distinct()
    is_open = F.exists("open_at", lambda x: x.isNotNull())
    settled = nodes.filter(~is_open).withColumn("held", F.array().cast("array<string>"))
    # Only rows with an open step meet the set of schema paths; the set is broadcast by AQE if its measured size allows.
    label = ["node", "record", "steps", "kinds", "open_at", "schema_path", "scalars"]
    unsettled = (
        nodes.filter(is_open)
        .withColumn("at", F.explode(F.array_distinct(F.filter("open_at", lambda x: x.isNotNull()))))
        .join(arrays.withColumn("known", F.lit(True)), "at", "left")
        .groupBy(*label)
        .agg(F.collect_set(F.when(F.col("known"), F.col("at"))).alias("held"))
    )
    return _settle(settled.unionByName(unsettled), whole)


def _settle(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """Drop the open steps that no array backs, keep rows that end in an element (with ``whole``, all), and derive parents by truncation."""
    walk = F.filter(
        F.transform(F.arrays_zip("steps", "kinds", "open_at"), lambda s: F.struct(
            s["steps"].alias("step"),
            F.when(s["kinds"] != OPEN, s["kinds"]).when(F.array_contains("held", s["open_at"]), F.lit(ELEMENT)).alias("kind"))),
        lambda s: s["kind"].isNotNull())
    path = lambda steps: F.concat_ws("/", F.transform(steps, lambda s: s["step"]))
    is_element = (F.element_at("kinds", -1) == ELEMENT) | F.array_contains("held", F.element_at("open_at", -1))
    above = F.transform(F.slice("walk", F.lit(1), F.size("walk") - 1), lambda s, i: F.when(s["kind"] == ELEMENT, i + 1).otherwise(F.lit(0)))
    last = F.element_at("walk", -1)
    return (
        (nodes if whole else nodes.filter(is_element))
        .withColumn("walk", walk)
        .withColumn("up", F.coalesce(F.array_max(above), F.lit(0)))
        .select(
            "record",
            path(F.col("walk")).alias("node_path"),
            path(F.slice("walk", F.lit(1), F.col("up"))).alias("parent_path"),
            F.when(last["kind"] != KEY, last["step"].try_cast("int")).alias("ordinal"),
            F.size(F.filter("walk", lambda s: s["kind"] == ELEMENT)).alias("depth"),
            "schema_path",
            "scalars",
        )
    )


def table_fields(flat: DataFrame) -> DataFrame:
    """``schema_path, field, kind, rows``: the tables that flat rows make up, with their columns and how many rows fill each.

    ``kind`` is the widest JSON type met: text, decimal, whole, truth, or null where no row says more. One row per column.
    """
    schema = F.expr("json_object_keys(scalars)")
    fields = flat.select("schema_path", "scalars", F.explode_outer(schema).alias("field"))
    raw = F.try_element_at(F.from_json("scalars", "map<string,string>"), F.col("field"))
    quoted = F.from_json("scalars", "map<string,variant>")
    kind = F.regexp_extract(F.schema_of_variant(F.try_element_at(quoted, F.col("field"))), r"^[A-Z]+", 0)
    grade = F.when(kind == "STRING", 4).when(kind.isin("DOUBLE", "FLOAT", "DECIMAL"), 3).when(kind.isin("BIGINT", "LONG", "INT"), 2).when(kind == "BOOLEAN", 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("null", "truth", "whole", "decimal", "text")])
    return (
        fields.filter(F.col("field").isNotNull()).groupBy("schema_path", "field").agg(F.max(grade).alias("grade"), F.count(raw).alias("rows"))
        .select("schema_path", "field", F.get(names, F.col("grade")).alias("kind"), "rows"))


def table_of(flat: DataFrame, schema_path: str, fields: list[str]) -> DataFrame:
    """One flat table: the rows of a schema path with ``fields`` as columns of text, the link to the parent, and the place in it."""
    rows = flat.filter(F.col("schema_path") == schema_path).withColumn("__values", F.from_json("scalars", "map<string,string>"))
    return rows.select("record", "node_path", "parent_path", "ordinal", *[F.try_element_at("__values", F.lit(f)).alias(f) for f in fields])
