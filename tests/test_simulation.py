"""The shopper's lines by hand, the closed loop on a small catalogue, and the command line."""

import json
import random

import pytest

from weftline import __main__ as cli
from weftline.operators import shopper
from weftline.sources import read_catalog, read_sessions, results

CARD = "parent_asin string, title string, categories array<string>, features array<string>, details map<string,string>, store string, description array<string>, price double"
ROW = "id int, scenario_type string, asks string, hard array<string>, soft array<string>, disclosed array<string>, refused boolean"


def test_cards(spark):
    rows = [("A", "Blue shirt", ["Shirts"], ["Soft cotton ", "", None, "Wide fit"], {"Department": "men", "x": ""}, "s", [], 49.0), ("B", None, None, None, None, None, None, float("nan")),
            ("C", "Plain", [], [" - one; "], {}, "", [], None), ("D", "red", [], [], {}, "", [], None)]
    got = {r.parent_asin: (r.target, r.hard, r.soft) for r in shopper.card(spark.createDataFrame(rows, CARD)).collect()}
    assert got["A"] == ("Blue shirt", ["cotton", "color: blue"], ["Soft cotton", "Wide fit"])
    assert got["B"] == ("product", ["product"], ["product"]) and got["C"] == ("Plain", ["one"], ["one"]) and got["D"] == ("red", ["color: red"], ["color: red"])


def test_replies(spark):
    hard, soft = ["cotton", "color: blue"], ["Wide fit", "budget around $9.0"]
    rows = [(1, "buying", "material", hard, soft, [], False), (2, "buying", "material", hard, soft, ["cotton"], False), (3, "buying", "other", hard, soft, ["cotton"], False),
            (4, "boundary", "color", hard, soft, [], False), (5, "boundary", "color", hard, soft, [], True), (6, "buying", None, hard, soft, [], False), (7, "boundary", None, hard, soft, [], False),
            (8, "buying", "nonsense", hard, soft, [], False), (9, "buying", "budget", hard, soft, [], False)]
    got = {r.id: (r.reply, r.disclosed, r.refused) for r in shopper.replied(spark.createDataFrame(rows, ROW)).collect()}
    assert got[1] == ("For that, what matters is: cotton.", ["cotton"], False)
    assert got[2] == ("I don't have an additional preference for material.", ["cotton"], False)
    assert got[3] == ("For that, what matters is: color: blue; Wide fit.", ["cotton", "color: blue", "Wide fit"], False)
    assert got[4] == ("I don't have a preference for color; please use your judgment.", [], True) and got[5][0] == "For that, what matters is: color: blue."
    assert got[6][0] == got[7][0] == "Those options are not quite right yet. Ask me about one specific attribute." and not got[7][2]
    assert got[8][0] == "For that, what matters is: cotton; color: blue." and got[9][0] == "For that, what matters is: budget around $9.0."


def test_turn_of_a_changed_mind(spark):
    df = spark.createDataFrame([("s1", "intent_override"), ("s2", "buying")], "sample_id string, scenario_type string")
    got = {r.sample_id: r.override_turn for r in shopper.override_turns(df).collect()}
    assert got == {"s1": random.Random("s1\0intent_override").choice([3, 4]), "s2": None}


PRODUCTS = [
    {"parent_asin": "A", "title": "Blue running shoe", "categories": ["Clothing", "Shoes"], "features": ["breathable mesh"], "details": {"department": "womens"}, "store": "acme", "description": "light", "price": 49.0, "rating_number": 10},
    {"parent_asin": "B", "title": "Red leather boots", "categories": ["Clothing", "Boots"], "features": ["winter lining"], "details": {}, "store": "acme", "description": [], "price": None, "rating_number": 0},
    {"parent_asin": "B", "title": "Red leather boots", "categories": "Boots", "features": None, "store": "", "price": "80", "rating_number": 3},
    {"parent_asin": "C", "title": "Green wool hat", "categories": ["Hats"], "features": ["warm wool"], "details": {"a": {"b": 1}}}]
SESSIONS = [{"sample_id": "s1", "scenario_type": "buying", "user_profile": {"preference_tags": ["warmth"]}, "ground_truth": {"parent_asin": "A"}},
            {"sample_id": "s2", "scenario_type": "intent_override", "user_profile": None, "ground_truth": {"parent_asin": "C"}},
            {"sample_id": "s3", "scenario_type": "browsing", "ground_truth": {"parent_asin": "missing"}}]


def files(tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(p) for p in PRODUCTS))
    (tmp_path / "s.jsonl").write_text("\n\n".join(json.dumps(s) for s in SESSIONS) + "\n")
    return str(tmp_path / "c.jsonl"), str(tmp_path / "s.jsonl")


def test_sources(spark, tmp_path):
    catalog, sessions = files(tmp_path)
    got = {r.parent_asin: r for r in read_catalog(spark, catalog).collect()}
    assert set(got) == {"A", "B", "C"} and got["B"].categories == ["Boots"] and got["B"].features == [] and got["B"].rating_number == 3 and got["B"].price == 80.0
    assert got["A"].description == ["light"] and got["A"].details == {"department": "womens"} and got["C"].title == "Green wool hat"
    assert [r.session_id for r in read_sessions(spark, sessions).orderBy("sample_id").collect()] == ["s1", "s2", "s3"]
    (tmp_path / "bad.jsonl").write_text('{"title": "no id"}')
    with pytest.raises(Exception, match="no product"):
        read_catalog(spark, str(tmp_path / "bad.jsonl")).collect()


def test_results_and_token_counts(spark):
    verdicts = spark.createDataFrame([("a", "buying", True, 2, 2, 0.5), ("b", "browsing", False, None, None, 0.0)], "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
    tokens = spark.createDataFrame([(3, 1), (-5, None), (2, 2)], "prompt_tokens int, completion_tokens int")
    row = results(verdicts, tokens).first()
    assert (row.sessions, row.hit_rate, row.mrr, row.mttc, row.efficiency) == (2, 0.5, 0.25, 6.5, 0.45) and row.reported_token_usage.total_tokens == 8
    assert [(s.scenario_type, s.hit_rate) for s in row.scenario_metrics] == [("browsing", 0.0), ("buying", 1.0)]


def test_command_line_runs_the_closed_loop(spark, tmp_path, capsys):
    catalog, sessions = files(tmp_path)
    cli.main(["--catalog", catalog, "--dataset", sessions, "--output", str(tmp_path / "out")])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    got = {r.sample_id: r for r in spark.read.json(str(tmp_path / "out" / "sessions")).collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].hit and got["s1"].first_hit_turn == 1 and summary["sessions"] == 2
    turn = random.Random("s2\0intent_override").choice([3, 4])
    assert got["s2"].hit and got["s2"].first_hit_turn >= turn  # nothing counts before the change of mind
