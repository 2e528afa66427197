import json

import pytest

from weftline.operators.nested import _parse_deep, deeper, flatten_records, read_value, table_fields, table_of
from weftline.plans.nested_records import p2_fields, p2_found, p2_tables

LINES = [
    (1, json.dumps({"details": {"a": [{"x": 1}, None, 3, {"b": [{"y": 2}]}], "one": {"z": 1}}, "features": ["s", {"text": "t"}]})),
    (2, json.dumps({"details": json.dumps({"a": {"x": 5, "b": {"y": 6}}}), "features": {"text": "u"}})),
    (3, json.dumps({"categories": [["p", {"name": "q"}], [{}]], "details": {"one": {"z": 2}}})),
    (4, "{broken"), (5, None), (6, "  "), (7, "null"), (8, "[1]"), (9, '{"details": null}'), (10, "7"),
]
FIELDS = ("features", "categories", "details")


def paths(spark, lines):
    df = spark.createDataFrame(lines, "line_no bigint, raw_line string").selectExpr("*", "'noise' AS steps", "1 AS kinds")
    return {(r.record, r.node_path, r.parent_path) for r in flatten_records(df, "line_no", "raw_line", FIELDS).collect()}


def test_elements_parents_and_lone_objects(spark):
    assert paths(spark, LINES) == {
        (1, "details/a/0", ""), (1, "details/a/3", ""), (1, "details/a/3/b/0", "details/a/3"), (1, "features/1", ""),
        (2, "details/a/0", ""), (2, "details/a/0/b/0", "details/a/0"), (2, "features/0", ""),
        (3, "categories/0/1", ""), (3, "categories/1/0", ""),
    }


def test_empty_table_and_repeats(spark):
    assert paths(spark, [(1, None)]) == set()
    df = spark.createDataFrame([LINES[0]] * 2, "line_no bigint, raw_line string")
    assert flatten_records(df, "line_no", "raw_line", FIELDS).count() == 8
    assert flatten_records(df.limit(0), "line_no", "raw_line", FIELDS).count() == 0


def test_scalars_and_schema_paths(spark):
    df = spark.createDataFrame(LINES[:1], "line_no bigint, raw_line string")
    rows = {r.node_path: r for r in flatten_records(df, "line_no", "raw_line", FIELDS).collect()}
    assert json.loads(rows["details/a/0"].scalars) == {"x": 1}
    assert rows["details/a/3/b/0"].schema_path == "details/a/b" and rows["details/a/3/b/0"].depth == 2


def test_recursion_leads_back():
    assert deeper(("details", "parts"), "parts") == ("details", "parts")
    assert deeper(("details",), "details") == ("details", "details")
    assert read_value('"[1]"') == '"[1]"' and read_value("[1, {}]") == [1, {}] and read_value("[x") == "[x"


def test_deep_and_long_records(spark):
    deep = {"details": {"p": []}}
    at = deep["details"]["p"]
    for _ in range(60):
        at.append({"p": []})
        at = at[0]["p"]
    wide = {"features": [{"i": i} for i in range(5000)]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(wide))], "line_no bigint, raw_line string")
    assert flatten_records(df, "line_no", "raw_line", FIELDS).groupBy("record").count().orderBy("record").collect() == [(1, 60), (2, 5000)]


def test_any_depth_and_slashes_in_keys(spark):
    """10,000 levels, as JSON and as JSON within text; keys with a slash keep tables apart."""
    n = 10_000
    arrays = '{"details": ' + '{"deep": ' + "[" * n + '{"x": 1}' + "]" * n + "}}"
    objects = '{"details": ' + '{"p": [' * 1500 + "{}" + "]}" * 1500 + "}"
    text = json.dumps({"features": "[" * n + '{"y": [{}]}' + "]" * n})
    slashed = json.dumps({"details": {"a/b": [{"x": 1}], "a": {"b": [{"x": 2}]}}})
    broken = "[" * n + "]" * (n - 1)
    df = spark.createDataFrame([(1, arrays), (2, objects), (3, text), (4, slashed), (5, broken), (6, '{"details": {"q": [{"n": ' + "9" * 5000 + "}]}}")], "line_no bigint, raw_line string")
    flat = flatten_records(df, "line_no", "raw_line", FIELDS)
    assert {r.record: r["count"] for r in flat.groupBy("record").count().collect()} == {1: 1, 2: 1500, 3: 2, 4: 2, 6: 1}
    assert {r.schema_path for r in flat.filter("record = 4").collect()} == {"details/a~1b", "details/a/b"}


def test_deep_parser_agrees_with_the_library():
    for text in ('{"a": [1, -2.5e3, "x\\"y", null, true, {}], "b": []}', "7", '"t"', " [ ] ", "[[],[{}]]", '{"a":{"a":1},"a":2}'):
        assert _parse_deep(text) == json.loads(text)
    for text in ("", "[", "]", "[1,]", "[1 2]", "{1: 2}", '{"a" 1}', '{"a":}', "[1]]", "{]", "[x]", '{"a":1,}', "[,1]", '["a'):
        with pytest.raises(ValueError):
            _parse_deep(text)


def test_tables_and_their_columns(spark):
    lines = [(1, json.dumps({"details": {"a": [{"x": 1, "t": "s"}, {"x": 2.5, "b": [{"ok": True}]}]}})), (2, json.dumps({"details": {"a": [{"x": None}]}}))]
    flat = flatten_records(spark.createDataFrame(lines, "line_no bigint, raw_line string"), "line_no", "raw_line", FIELDS)
    assert {tuple(r) for r in table_fields(flat).collect()} == {("details/a", "x", "decimal", 2), ("details/a", "t", "text", 1), ("details/a/b", "ok", "truth", 1)}
    assert {tuple(r) for r in table_of(flat, "details/a", ["x", "t"]).collect()} == {
        (1, "details/a/0", "", 0, "1", "s"), (1, "details/a/1", "", 1, "2.5", None), (2, "details/a/0", "", 0, None, None)}


WHOLE = [
    json.dumps({"features": ["s", {"text": "t"}, None, ["u", {"n": [7]}]], "categories": "c",
                "details": {"Brand": "B", "care": ["w", 1], "o": [{"x": 1, "ship": {"free": True, "by": {"air": False}, "opts": [{"p": 1}]}}], "5": {"v": 2}}}),
    json.dumps({"features": None, "details": json.dumps({"Brand": "C", "o": {"x": 2, "codes": ["k"]}, "~": {"value": 3}})}),
]


def held(record):
    """(keys and positions without those of lone objects, value) of all scalars and nulls below the fields, by plain recursion."""
    def walk(at, v):
        v = read_value(v)
        if isinstance(v, (dict, list)):
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                yield from walk(f"{at}/{k}", x)
        else:
            yield at, v
    return sorted((at, json.dumps(v)) for f in FIELDS if f in record for at, v in walk(f, record[f]))


def test_whole_tables_hold_every_value(spark):
    """Fields of objects alone under a key, scalars in arrays and right under a field come out too, each once."""
    lines = spark.createDataFrame(list(enumerate(WHOLE, 1)), "line_no bigint, raw_line string")
    flat = flatten_records(lines, "line_no", "raw_line", FIELDS, whole=True)
    rows = flat.collect()
    for record, line in enumerate(WHOLE, 1):
        got = []
        for r in rows:
            if r.record == record:
                got += [(r.node_path if r.schema_path.endswith("/~") else f"{r.node_path}/{k}", json.dumps(x)) for k, x in json.loads(r.scalars).items()]
        # Of the second line, "o" alone counts as element 0, since the first holds an array of objects there.
        assert sorted(got) == [(at.replace("/o/", "/o/0/") if record == 2 else at, v) for at, v in held(json.loads(line))]
    by = {(r.record, r.node_path): (r.parent_path, r.ordinal, r.depth, r.schema_path) for r in rows}
    assert by[1, "details/o/0/ship"] == ("details/o/0", None, 1, "details/o/ship")
    assert by[1, "details/o/0/ship/opts/0"] == ("details/o/0", 0, 2, "details/o/ship/opts")
    assert by[1, "features/3/1/n/0"] == ("features/3/1", 0, 1, "features/n/~") and by[1, "features/2"] == ("", 2, 0, "features/~")
    assert by[1, "details"] == ("", None, 0, "details") and by[1, "details/5"] == ("", None, 0, "details/5")
    assert by[2, "details/~"] == ("", None, 0, "details/~0") and by[2, "details/o/0/codes/0"] == ("details/o/0", 0, 1, "details/o/codes/~")
    elements = flatten_records(lines, "line_no", "raw_line", FIELDS)
    assert set(elements.collect()) < set(rows) and elements.count() == 5
    assert {tuple(r) for r in table_fields(flat).filter("schema_path IN ('details', 'features/~')").collect()} == {("details", "Brand", "text", 2), ("features/~", "value", "text", 2)}


def test_queries_give_the_whole(spark, tmp_path):
    spark.createDataFrame(list(enumerate(WHOLE, 1)), "line_no bigint, raw_line string").write.parquet(f"{tmp_path}/catalog_raw.parquet")
    assert p2_found(spark, str(tmp_path)).count() == 5
    texts = {x for r in p2_tables(spark, str(tmp_path)).collect() for x in json.loads(r.scalars).values() if isinstance(x, str)}
    assert texts == {"s", "t", "u", "c", "B", "w", "C", "k"}
    assert {"details/Brand", "details/care/~/value", "details/o/ship/free"} <= {f"{r.schema_path}/{r.field}" for r in p2_fields(spark, str(tmp_path)).collect()}


def test_numbers_and_halves_that_no_column_holds(spark):
    """NaN hides no other field of its row; half a surrogate pair, in a value or a key, stops no line."""
    lines = ['{"details": {"a": [{"x": NaN, "y": 1}, {"x": -1e999, "y": 2}]}}', '{"details": {"b": [{"t": "p\\ud83d"}], "\\udc00": [{}]}}']
    flat = flatten_records(spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, raw_line string"), "line_no", "raw_line", FIELDS)
    assert {(r.node_path, r.scalars) for r in flat.collect()} == {
        ("details/a/0", '{"x": "NaN", "y": 1}'), ("details/a/1", '{"x": "-Infinity", "y": 2}'), ("details/b/0", '{"t": "p�"}'), ("details/�/0", "{}")}
    assert {tuple(r) for r in table_fields(flat).filter("schema_path = 'details/a'").collect()} == {("details/a", "x", "text", 2), ("details/a", "y", "whole", 2)}
