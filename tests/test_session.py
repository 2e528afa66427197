"""Folding of sessions: golden dialogues, and the same results in batch and stream, in any order of arrival and partitioning."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import extract
from weftline.operators import delta as d, ranked as rk, session as ss
from weftline.streaming.dialogue import fold_turns, stream_states

TURNS = "request_id bigint, session_id string, turn int, user_message string, received_at timestamp"


def after(*messages):
    state = ss.fresh()
    for i, m in enumerate(messages, 1):
        state = ss.advance(state, m, i)
    return state


def values(state):
    return {k: v["values"] for k, v in state["slots"].items()}


def active(state):
    return [e["normalized"] for e in state["evidence"] if e["status"] == "active"]


def test_slots_are_set_added_replaced_and_removed():
    assert values(after("I'm looking for a black leather jacket")) == {"category": ["jacket"], "color": ["black"], "material": ["leather"]}
    assert values(after("black boots", "also brown")) == {"category": ["boots"], "color": ["black", "brown"]}
    assert values(after("black boots", "actually brown instead")) == {"category": ["boots"], "color": ["brown"]}
    assert values(after("leather boots", "not leather")) == {"category": ["boots"]}
    assert values(after("boots", "sandals")) == {"category": ["sandals"]}
    assert values(after("leather and denim", "without the leather")) == {"material": ["denim"]}
    assert values(after("size large", "size 9.5")) == {"size": ["9.5"]}
    assert values(after("not leather but denim")) == {"material": ["denim"]}
    one_turn = after("black leather boots", "Actually denim, but also navy")
    assert values(one_turn) == {"category": ["boots"], "color": ["black", "navy"], "material": ["denim"]}
    assert after("under $50", "between 20 and 30", "$40 to $20")["slots"]["budget"] == {"values": ["$40 to $20"], "bounds": {"min": 20.0, "max": 40.0}, "confidence": 0.7}


def test_log_and_superseded_values():
    state = after("black boots", "actually brown instead", "not brown")
    assert [(r["turn"], r["slot"], r["op"], r["value"], r["superseded"]) for r in state["log"]] == [
        (1, "category", "SET", "boots", None), (1, "color", "ADD", "black", None), (2, "color", "REPLACE", "brown", ["black"]), (3, "color", "REMOVE", "brown", None)]
    assert ss.superseded_values(state["log"], "color") == {"black", "brown"} and "color" not in state["slots"]
    again = after("black boots", "actually brown instead", "something for winter")
    assert values(again)["color"] == ["brown"]


def test_confidence_rises_only_by_firmer_statements():
    held = lambda *m: after(*m)["slots"]["material"].get("confidence", 1.0)
    assert held("maybe leather") == 0.4 and held("maybe leather", "leather is a must") == 1.0
    assert held("leather is a must", "maybe leather") == 1.0
    assert held("maybe leather and denim", "no leather") == 0.4
    assert held("leather is a must", "actually, maybe denim") == 0.4
    assert d.confidence("leather is not required") == 0.4 and d.confidence("actually, make it denim") == 0.9 and d.confidence("") == d.confidence(None) == 0.7


def test_evidence_is_what_nothing_else_accounts_for():
    assert active(after("Actually, I need denim for winter hiking")) == ["winter hiking"]
    assert active(after("I don't have a preference", "ask me about something", "  ", "not leather")) == []
    assert active(after("for hiking", "for hiking")) == ["hiking"]
    state = {"turn": 1, "slots": {"material": {"values": ["leather"]}}, "evidence": [
        {"turn": 1, "text": "", "normalized": "leather strap", "status": "active"}, {"turn": 1, "text": "", "normalized": "leather", "status": "active"}], "log": []}
    new = ss.advance(state, "not leather", 2)
    assert [(e["normalized"], e["status"], e["superseded_parts"]) for e in new["evidence"]] == [("strap", "active", ["leather"]), ("leather", "superseded", ["leather"])]
    assert state["evidence"][0]["normalized"] == "leather strap"  # the old state is whole


def test_failures_and_strange_turns_leave_the_state():
    state = after("black boots")

    def fails(_):
        raise ValueError

    assert ss.advance(state, "brown", 2, fails) == state
    assert ss.advance(state, None, 2)["slots"] == state["slots"] and ss.advance(state, 7, "x")["turn"] == 1
    late = ss.advance(ss.advance(state, "also brown", 5), "also red", 3)
    assert late["turn"] == 5 and values(late)["color"] == ["black", "brown", "red"]


@pytest.mark.parametrize("raw, clean", [
    (None, {}), ([], {}), ({"x": {"values": ["a"]}}, {}), ({"color": 3}, {}), ({"color": {"values": ["a"], "op": "DROP"}}, {}),
    ({"color": {"values": [" red ", "", None, 3], "cue": "swap"}}, {"color": {"values": ["red"], "cardinality": "multi"}}),
    ({"size": {"values": ["s", "m"], "confidence": 5}}, {"size": {"values": ["s"], "cardinality": "single"}}),
    ({"size": {"values": ["s"], "confidence": float("nan")}}, {}), ({"size": {"values": ["s"], "confidence": 0}}, {}), ({"size": {"values": ["s"], "confidence": "x"}}, {}),
    ({"color": {"values": [], "remove": ["red"]}}, {"color": {"values": [], "cardinality": "multi", "remove": ["red"]}}),
    ({"budget": {"values": ["$5"], "bounds": {"min": "a", "max": 5}}}, {"budget": {"values": ["$5"], "cardinality": "single"}}),
    ({"budget": {"values": ["$5"], "bounds": {"min": None, "max": 5}, "confidence": 0.4, "op": "SET", "cue": "replace"}},
     {"budget": {"values": ["$5"], "cardinality": "single", "bounds": {"min": None, "max": 5}, "op": "SET", "cue": "replace", "confidence": 0.4}})])
def test_validation(raw, clean):
    assert d.validate_delta(raw) == clean


def test_explicit_operations():
    start = after("black boots")
    assert values(ss.apply_delta(start, {"color": {"values": ["red"], "op": "ADD"}}, 2))["color"] == ["black", "red"]
    assert values(ss.apply_delta(start, {"color": {"values": ["red"], "op": "SET"}}, 2))["color"] == ["red"]
    assert "color" not in ss.apply_delta(start, {"color": {"values": ["black"], "op": "REMOVE"}}, 2)["slots"]
    assert values(ss.apply_delta(start, {"category": {"values": ["hat"], "op": "ADD"}}, 2))["category"] == ["hat"]
    assert ss.apply_delta(start, {"color": {"values": ["red"], "op": "X"}, "nope": {"values": ["a"]}, "size": 1}, 2) == start


def test_ledger_and_ladder():
    ledger = ss.record(ss.open_ledger(), "color")
    assert ss.observe(ledger, "black")["closed"] == [] and ss.observe(ledger, "no preference")["closed"] == ["color"] and ss.observe(ledger, None)["pending"] is None
    worth = [("color", 0.3), ("size", 0.05)]
    shut = lambda *closed, used=0: ss.open_ledger() | {"closed": list(closed), "open_questions": used}
    assert ss.choose(worth, shut()) == "color"
    assert ss.choose(worth, shut("color")) == "feature"
    assert ss.choose(worth, shut("color", "feature", "use_case", "style")) == "other"
    assert ss.choose(worth, shut("color", "feature", "use_case", "style", used=1)) == "size"
    assert ss.choose([("color", 0.0)], shut("feature", "use_case", "style", used=1)) is None and ss.choose([], shut("feature", "use_case", "style", "other")) is None
    assert ss.POLICIES["without_open"](worth, shut("color", "feature", "use_case", "style")) is None
    assert ss.POLICIES["first_unfilled"](worth, shut(), ("color",)) == "size" and ss.POLICIES["always_open"](worth, shut("other")) == "other"


MESSAGES = ["black leather boots under $80", "actually brown instead", "no preference", None, "not leather", "maybe something for hiking", "size 9, and also navy", "", "I must have wool"]


def make_turns(seed, sessions=6):
    rng, rows, at = random.Random(seed), [], datetime(2026, 1, 1)
    for s in range(sessions):
        for episode in range(3 if s == 0 else 1):
            for turn in range(1, 6):
                rows.append([f"s{s}", turn, rng.choice(MESSAGES)])
    return [(i, *r, at + timedelta(seconds=i)) for i, r in enumerate(rows)]


def expected(rows):
    out, states = {}, {}
    for i, s, turn, message, _ in rows:
        states[s] = ss.advance((ss.fresh() if turn == 1 else states[s]) | {"log": []}, message, turn)
        out[i] = states[s]
    return out


def as_text(r):
    return json.dumps([r["slots"], r["evidence"], r["log"]], default=lambda x: x.asDict(True))


def columns(state):
    return json.dumps([ss.slots_column(state["slots"]), ss.evidence_column(state["evidence"]), state["log"]])


def plain(text):
    """Nested rows without nulls, as structs have all their fields."""
    def tidy(x):
        return {k: tidy(v) for k, v in sorted(x.items()) if v is not None} if isinstance(x, dict) else [tidy(v) for v in x] if isinstance(x, list) else x
    return tidy(json.loads(text))


def test_batch_fold_in_any_partitioning(spark):
    rows = make_turns(1)
    want = expected(rows)
    shuffled = random.Random(2).sample(rows, len(rows))
    for n in (1, 3, 16):
        got = ss.fold(ss.episodes(spark.createDataFrame(shuffled, TURNS).repartition(n))).collect()
        assert len(got) == len(rows)
        assert all(plain(as_text(r.asDict(True))) == plain(columns(want[r.request_id])) for r in got)
    assert ss.fold(ss.episodes(spark.createDataFrame([], TURNS))).count() == 0


def test_episodes_across_slices(spark, monkeypatch):
    monkeypatch.setattr(ss, "SLICE", 4)
    rows = [(i, "probe" if i % 5 else None, i % 10 + 1 if i != 7 else None, "x", datetime(2026, 1, 1)) for i in range(60)]
    got = {r.request_id: r.episode for r in ss.episodes(spark.createDataFrame(rows, TURNS)).collect()}
    for i, s, *_ in rows:
        assert got[i] == sum(1 for j, t, turn, *_ in rows if t == s and j <= i and turn == 1)


def test_late_and_repeated_turns_in_the_step():
    rows = [{"id": i, "turn": t, "text": m} for i, s, t, m, _ in make_turns(3, 1)]
    want = expected([(r["id"], "s0", r["turn"], r["text"], None) for r in rows])
    for seed in range(5):
        rng, kept, last = random.Random(seed), [], {}
        arrived = []
        for k in range(0, len(rows), 5):  # within a dialogue turns come in any order, and twice
            part = rows[k : k + 5]
            arrived += [part[0], *rng.sample(part[1:], 4), rng.choice(part)]
        while arrived:
            n = rng.randint(1, 4)
            kept, out = fold_turns(kept, arrived[:n])
            arrived = arrived[n:]
            last |= {t["id"]: s for t, s, outcome in out if outcome == "applied"}
        assert {i: columns(s) for i, s in last.items()} == {i: columns(s) for i, s in want.items()}
    kept, out = fold_turns(rows[5:7], [rows[2]])
    assert [o for *_, o in out] == ["late"]


def test_stream_equals_batch(spark, tmp_path):
    rows = make_turns(4, 3)
    folder, want = tmp_path / "in", expected(rows)
    parts = [rows[:7], rows[8:10] + rows[2:4], rows[7:8] + rows[10:]]  # a late turn, and two that come again
    for i, part in enumerate(parts):
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stream_states(source).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(240)
    got = {}
    for r in spark.sql("SELECT * FROM states WHERE outcome = 'applied'").collect():
        text = plain(as_text(r.asDict(True)))
        got.setdefault(r.request_id, []).append(text)
    assert set(got) == set(want) and all(plain(columns(want[i])) in got[i] for i in want)


def test_confidence_as_a_column(spark):
    texts = [*MESSAGES, "A key requirement is: wool", "leather is not a requirement", "I guess, instead", "Scratch that.", "must not, but need it"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.c for r in df.select("i", extract.confidence(F.col("t")).alias("c")).orderBy("i").collect()] == [d.confidence(t) for t in texts]


def slots(**kw):
    return [(k, v if isinstance(v, list) else [v], None, None) for k, v in kw.items()]


def test_verdicts(spark):
    schema = f"id int, slots {ss.SLOTS}, colors array<string>, materials array<string>, cats array<string>, store string, sizes array<string>, price double"
    asked = [("category", ["swim trunks"], None, None), ("color", ["black", "navy"], None, 0.4), ("brand", ["nike"], None, None), ("size", ["m"], None, None), ("budget", ["x"], (10.0, 20.0), None)]
    rows = [(1, asked, ["navy"], None, ["swimwear", "trunk", "trunks"], "The Nike Shop", ["m"], 20.0), (2, asked, ["red"], [], ["swimwear"], "puma", ["l"], 20.5),
            (3, asked, [], [], None, None, [], float("nan")), (4, [("color", [""], None, None)], ["red"], None, None, None, None, None), (5, None, None, None, None, None, None, None)]
    got = {r.id: {v.slot: (v.verdict, v.weight) for v in r.verdicts or []} for r in rk.judged(spark.createDataFrame(rows, schema), {"color": 0.5}).collect()}
    assert got[1] == {"category": ("match", 1), "color": ("match", 0.2), "brand": ("match", 1), "size": ("match", 1), "budget": ("match", 1)}
    assert {s: v for s, (v, _) in got[2].items()} == {"category": "violation", "color": "violation", "brand": "violation", "size": "unknown", "budget": "violation"}
    assert {v for v, _ in got[3].values()} == {"unknown"} and len(got[3]) == 5 and got[4] == got[5] == {}


def test_contract_of_untrusted_scorers(spark):
    heads = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(7)], "request_id bigint, ids array<string>")

    def scorer(ids, row):
        if row["request_id"] == 4:
            raise RuntimeError
        return {0: ["d", "c"], 1: ids, 2: ["zz", None, 4, "b", "b"], 3: "no list", 5: [], 6: list(reversed(ids))}[row["request_id"]]

    proposed = rk.ask_scorer(heads, scorer, "request_id", "bigint")
    got = {r.request_id: (r.ids, r.outcome, r.invented, r.dropped, r.moved) for r in rk.contract(proposed, "request_id").collect()}
    same = ["a", "b", "c", "d"]
    assert got == {
        0: (["d", "c", "a", "b"], "applied", 0, 2, 4), 1: (same, "identity", 0, 0, 0), 2: (["b", "a", "c", "d"], "applied", 3, 3, 2), 3: (same, "malformed", 0, 0, 0),
        4: (same, "error", 0, 0, 0), 5: (same, "malformed", 0, 0, 0), 6: (["d", "c", "b", "a"], "applied", 0, 0, 4)}
    none = rk.contract(heads.withColumn("proposed", F.lit(None).cast("array<string>")), "request_id").collect()
    assert {(tuple(r.ids), r.outcome) for r in none} == {(tuple(same), "offline")}
