"""The state of a session as a fold over its turns, in batches and in streams.

One pure function, ``advance``, takes a state and a turn to the next state. In batch, turns are hashed by session and
episode, sorted, and folded in Arrow batches as they stream by: no group is ever gathered. A session that is used again and
again is cut where its turn count starts again (``episodes``), so that a fold is never longer than a dialogue.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import lexicon as lex
from weftline.operators.delta import ADD, REPLACE, declines, extract_delta, terms, validate_delta

_CONSUMED = frozenset((*lex.MARKER_WORDS, *lex.CORRECTION_WORDS, *lex.FRAMING_WORDS, *lex.STRONG_NEGATIONS, *lex.NEXT_NEGATIONS))

#: Slots, evidence and log of a state, as columns.
BOUNDS = "struct<min:double,max:double>"
SLOTS = f"array<struct<slot:string,values:array<string>,bounds:{BOUNDS},confidence:double>>"
EVIDENCE = "array<struct<turn:int,text:string,normalized:string,status:string,superseded_parts:array<string>>>"
LOG = "array<struct<turn:int,slot:string,op:string,value:string,superseded:array<string>>>"
DELTA = f"array<struct<slot:string,values:array<string>,remove:array<string>,cue:string,bounds:{BOUNDS},confidence:double>>"
_bounds = pa.struct([("min", pa.float64()), ("max", pa.float64())])
_texts = pa.list_(pa.string())
ARROW = {
    "slots": pa.list_(pa.struct([("slot", pa.string()), ("values", _texts), ("bounds", _bounds), ("confidence", pa.float64())])),
    "evidence": pa.list_(pa.struct([("turn", pa.int32()), ("text", pa.string()), ("normalized", pa.string()), ("status", pa.string()), ("superseded_parts", _texts)])),
    "log": pa.list_(pa.struct([("turn", pa.int32()), ("slot", pa.string()), ("op", pa.string()), ("value", pa.string()), ("superseded", _texts)])),
    "delta": pa.list_(pa.struct([("slot", pa.string()), ("values", _texts), ("remove", _texts), ("cue", pa.string()), ("bounds", _bounds), ("confidence", pa.float64())])),
}


def fresh() -> dict:
    """The state at the reset of a session."""
    return {"turn": 0, "slots": {}, "evidence": [], "log": []}


def _sure(entry: dict | None) -> float:
    return entry.get("confidence", 1.0) if entry else 1.0


def _entry(values: list[str], bounds: dict | None, sure: float) -> dict:
    """A slot's entry; a full confidence isn't stored, as absent ones count as full."""
    return {"values": list(values)} | ({"bounds": bounds} if bounds is not None else {}) | ({"confidence": sure} if sure < 1 else {})


def settle(slot: str, old: dict | None, change: dict) -> tuple[dict | None, list[tuple], list[str]]:
    """A slot's next entry (None: emptied), what is logged of it (operation, value, superseded values), and the values that are dead."""
    named = list(change.get("values") or ())
    gone, new = (named, []) if change.get("op") == "REMOVE" else (list(change.get("remove") or ()), named)
    single, sure, bounds = lex.SINGLE[slot], _sure(change), change.get("bounds")
    new = new[:1] if single else new
    held = [v for v in (old["values"] if old else ()) if v not in gone]
    log: list[tuple] = [("REMOVE", v, None) for v in gone]
    if not new:
        if gone:
            old = _entry(held, old.get("bounds"), _sure(old)) if held else None
        return old, log, gone
    verb = change.get("op")
    if verb is None:
        if change.get("cue") == "add":
            verb = "ADD"
        else:
            verb = "REPLACE" if gone or single or change.get("cue") == "replace" and held else "ADD"
    if verb == "ADD" and not single:
        added = [v for v in new if v not in held]
        if added:
            firm = max(sure, _sure(old)) if old else sure
            return _entry(held + added, bounds, firm), log + [("ADD", v, None) for v in added], gone
        if old and sure > _sure(old):  # nothing new, but said more firmly
            return _entry(old["values"], old.get("bounds"), sure), log + [("ADD", new[0], None)], gone
        return old, log, gone
    displaced = [v for v in held if v not in new]
    if old and old["values"] == new and old.get("bounds") == bounds and not gone and sure <= _sure(old):
        return old, log, gone
    name = "SET" if verb == "SET" or not (held or gone) else "REPLACE"
    return _entry(new, bounds, sure), log + [(name, v, displaced or None) for v in new], gone + displaced


def supersede(evidence: list[dict], dead: list[str]) -> list[dict]:
    """Evidence without the words of dead values; an entry that has no others is superseded."""
    words = {t for v in dead for t in terms(str(v))}
    out = []
    for e in evidence:
        said = terms(e["normalized"]) if e["status"] == "active" else []
        hit = words.intersection(said)
        if hit:
            left = " ".join(t for t in said if t not in words)
            e = e | {"superseded_parts": sorted(hit.union(e.get("superseded_parts") or ()))} | ({"normalized": left} if left else {"status": "superseded"})
        out.append(e)
    return out


def residual(message: str, delta: dict) -> list[str]:
    """The words of a message that no slot, cue or framing accounts for; none of one that is blank or declines to say more."""
    if not message.strip() or declines(message):
        return []
    valued = {t for d in delta.values() for v in (*d.get("values", ()), *d.get("remove", ())) for t in terms(v)}
    return [t for t in terms(ADD.sub(" ", REPLACE.sub(" ", message))) if t not in _CONSUMED and t not in valued]


def apply_delta(state: dict, delta: dict, turn: int) -> dict:
    """A new state with the changes of a delta; slots that it doesn't name, and such as aren't known, are left alone."""
    slots, evidence, log = dict(state["slots"]), state["evidence"], list(state["log"])
    for slot, change in delta.items():
        if slot not in lex.SINGLE or not isinstance(change, dict) or change.get("op") not in (None, "SET", "REPLACE", "ADD", "REMOVE"):
            continue
        entry, rows, dead = settle(slot, slots.get(slot), change)
        if entry is None:
            slots.pop(slot, None)
        else:
            slots[slot] = entry
        log += [{"turn": turn, "slot": slot, "op": op, "value": value, "superseded": displaced} for op, value, displaced in rows]
        evidence = supersede(evidence, dead) if dead else evidence
    return state | {"slots": slots, "evidence": evidence, "log": log}


def advance(state: dict, message, turn, read: Callable = extract_delta) -> dict:
    """The state after a turn. What goes wrong leaves it as it was.

    A turn older than the state's is applied like any other, but the state's turn never goes back. A message that is no text
    counts as empty.
    """
    text, at = message if isinstance(message, str) else "", turn if isinstance(turn, int) else state["turn"]
    try:
        delta = validate_delta(read(text))
        new = apply_delta(state, delta, at)
        left = " ".join(residual(text, delta))
        if left and not any(e["status"] == "active" and e["normalized"] == left for e in new["evidence"]):
            new["evidence"] = [*new["evidence"], {"turn": at, "text": text, "normalized": left, "status": "active"}]
    except Exception:
        return state
    return new | {"turn": max(state["turn"], at)}


def superseded_values(log: list[dict], slot: str) -> set[str]:
    """Every value that was ever displaced or removed from a slot."""
    return {v for r in log if r["slot"] == slot for v in (*(r.get("superseded") or ()), *([r["value"]] if r["op"] == "REMOVE" else ()))}


# -- questions -------------------------------------------------------------------------------------------------------------


def open_ledger() -> dict:
    return {"asked": [], "closed": [], "pending": None, "open_questions": 0}


def observe(ledger: dict, message) -> dict:
    """The ledger after a reply: one that declines closes the attribute asked about; nothing stays pending."""
    asked = ledger["pending"]
    closes = asked and declines(message) and asked not in ledger["closed"]
    return ledger | {"closed": sorted((*ledger["closed"], asked)) if closes else ledger["closed"], "pending": None}


def record(ledger: dict, attribute: str | None) -> dict:
    if attribute is None:
        return ledger
    return ledger | {"asked": [*ledger["asked"], attribute], "pending": attribute, "open_questions": ledger["open_questions"] + (attribute == lex.OPEN_QUESTION)}


def choose(values: list[tuple[str, float]], ledger: dict, known: tuple = (), floor: float = lex.ASK_FLOOR, open_questions: int = lex.OPEN_QUESTIONS) -> str | None:
    """The attribute to ask about, given judged attributes with their values, best first.

    The first judged one that isn't closed, if it is worth ``floor``; else the first unjudged one; else the open question, a
    bounded number of times; else that judged one, if it is worth anything.
    """
    closed = ledger["closed"]
    attribute, value = next(((a, v) for a, v in values if a not in closed), (None, 0.0))
    if attribute and value >= floor:
        return attribute
    for a in lex.UNJUDGED:
        if a not in closed:
            return a
    if ledger["open_questions"] < open_questions and lex.OPEN_QUESTION not in closed:
        return lex.OPEN_QUESTION
    return attribute if value > 0 else None


def always_open(values, ledger: dict, known: tuple = (), **_) -> str | None:
    """Policy: nothing but the open question, whether or not it is closed."""
    return lex.OPEN_QUESTION


def first_unfilled(values, ledger: dict, known: tuple = (), **_) -> str | None:
    """Policy: the first judged attribute in fixed order that is neither filled nor closed, then the open question."""
    judged = [a for a in lex.ASKABLE if a in {v for v, _ in values}]
    judged.sort(key=lambda a: lex.JUDGED.index(a) if a in lex.JUDGED else len(lex.JUDGED))
    open_ones = [a for a in judged if a not in known] + [lex.OPEN_QUESTION]
    return next((a for a in open_ones if a not in ledger["closed"]), None)


def without_open(values, ledger: dict, known: tuple = (), **bounds) -> str | None:
    """Policy: the ladder, silent where it would ask the open question."""
    asks = choose(values, ledger, known, **bounds)
    return None if asks == lex.OPEN_QUESTION else asks


def answerable(values, ledger: dict, known: tuple = (), **bounds) -> str | None:
    """Policy: the ladder with brand and category closed, which simulated shoppers never answer."""
    return choose(values, ledger | {"closed": [*ledger["closed"], "brand", "category"]}, known, **bounds)


POLICIES = {"ladder": choose, "always_open": always_open, "first_unfilled": first_unfilled, "without_open": without_open, "answerable": answerable}


# -- columns ---------------------------------------------------------------------------------------------------------------


def slots_column(slots: dict) -> list[dict]:
    return [{"slot": k, "values": v["values"], "bounds": v.get("bounds"), "confidence": v.get("confidence")} for k, v in sorted(slots.items())]


def slots_of(column: list[dict] | None) -> dict:
    return {e["slot"]: _entry(e["values"], e["bounds"], 1.0 if e["confidence"] is None else e["confidence"]) for e in column or ()}


def evidence_column(evidence: list[dict]) -> list[dict]:
    return [{"superseded_parts": None} | e for e in evidence]


def evidence_of(column: list[dict] | None) -> list[dict]:
    return [{k: v for k, v in e.items() if v is not None} for e in column or ()]


#: Ids of a slice: no session can have more requests in one, so a slice's sort is bounded.
SLICE = 1 << 17


def episodes(turns: DataFrame) -> DataFrame:
    """Give each request (``request_id, session_id, turn, ...``) its ``episode``: how often the session's turn count began by then.

    Ids rise as requests are made, so a session is walked in their order. It is cut into slices of ids; a slice's offset is
    the number of beginnings in earlier ones. Defined results: requests before the first beginning are of episode 0; a null
    turn begins nothing; a null session is a session.
    """
    sliced = turns.withColumn("__slice", F.floor(F.col("request_id") / SLICE)).withColumn("__begins", F.coalesce((F.col("turn") == 1).cast("int"), F.lit(0)))
    counts = sliced.groupBy("session_id", "__slice").agg(F.sum("__begins").alias("n"))
    before = Window.partitionBy("session_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("session_id").alias("__s"), F.col("__slice").alias("__o"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("session_id", "__slice").orderBy("request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sliced.withColumn("__local", F.sum("__begins").over(inside))
    joined = numbered.join(offsets, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__o")))
    return joined.select(*turns.columns, (F.col("__local") + F.col("__offset")).cast("bigint").alias("episode"))


def _walk(turns: DataFrame, columns: list[str]) -> DataFrame:
    """Turns hashed by episode and sorted within it, so that a task meets each episode as one run of rows."""
    named = turns.select("session_id", "episode", "request_id", "turn", *columns)
    return named.repartition("session_id", "episode").sortWithinPartitions("session_id", "episode", F.asc_nulls_last("turn"), "request_id")


def fold(turns: DataFrame) -> DataFrame:
    """The state after each turn: ``request_id, session_id, episode, turn, delta, slots, evidence, log``; the log has the turn's own rows.

    ``turns`` has each request once, with its ``episode``. Defined results: turns are applied in their order, late ones too;
    null messages change nothing; an episode starts from nothing; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, fresh()
        for batch in batches:
            session, episode, request, turn, message = (batch.column(i).to_pylist() for i in range(5))
            out: dict[str, list] = {"delta": [], "slots": [], "evidence": [], "log": []}
            for s, e, t, m in zip(session, episode, turn, message):
                if (s, e) != at:
                    at, state = (s, e), fresh()
                state = advance(state | {"log": []}, m, t)
                delta = validate_delta(extract_delta(m)) if isinstance(m, str) else {}
                out["delta"].append([{"slot": k, "values": d["values"], "remove": d.get("remove"), "cue": d.get("cue"), "bounds": d.get("bounds"),
                                      "confidence": d.get("confidence")} for k, d in sorted(delta.items())])
                out["slots"].append(slots_column(state["slots"]))
                out["evidence"].append(evidence_column(copy.copy(state["evidence"])))
                out["log"].append(state["log"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(request, pa.int64()), pa.array(session, pa.string()), pa.array(episode, pa.int64()), pa.array(turn, pa.int32()), *[pa.array(out[c], ARROW[c]) for c in out]],
                names=["request_id", "session_id", "episode", "turn", *out])

    schema = f"request_id bigint, session_id string, episode bigint, turn int, delta {DELTA}, slots {SLOTS}, evidence {EVIDENCE}, log {LOG}"
    return _walk(turns, ["user_message"]).mapInArrow(run, schema)


LEDGER = "request_id bigint, session_id string, episode bigint, turn int, asks string, asked array<string>, closed array<string>, pending string, open_questions int"


def fold_ledger(turns: DataFrame, policy: str = "ladder", **bounds) -> DataFrame:
    """The question each turn asks and the ledger after it.

    ``turns`` has ``user_message``, ``worth`` (judged attributes with values, best first) and ``known`` (filled slots).
    Defined results: a null ``worth`` judges nothing; a null message declines nothing.
    """
    ask = POLICIES[policy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ledger = None, open_ledger()
        for batch in batches:
            session, episode, request, turn, message, worth, known = (batch.column(i).to_pylist() for i in range(7))
            rows = []
            for s, e, m, w, k in zip(session, episode, message, worth, known):
                if (s, e) != at:
                    at, ledger = (s, e), open_ledger()
                ledger = observe(ledger, m)
                asks = ask([(x["attribute"], x["value"]) for x in w or ()], ledger, tuple(k or ()), **bounds)
                ledger = record(ledger, asks)
                rows.append((asks, ledger["asked"], ledger["closed"], ledger["pending"], ledger["open_questions"]))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(request, pa.int64()), pa.array(session, pa.string()), pa.array(episode, pa.int64()), pa.array(turn, pa.int32()),
                 *[pa.array(c, t) for c, t in zip(columns, [pa.string(), _texts, _texts, pa.string(), pa.int32()])]],
                names=[c.split()[0] for c in LEDGER.split(", ")])

    return _walk(turns, ["user_message", "worth", "known"]).mapInArrow(run, LEDGER)


def active_words(evidence: str = "evidence") -> Column:
    """The words of a state's active evidence, in order."""
    active = F.filter(evidence, lambda e: e["status"] == "active")
    return F.array_distinct(F.flatten(F.transform(active, lambda e: F.split(e["normalized"], " "))))


def slot_values(name: str, slots: str = "slots") -> Column:
    """The values of a slot, null where it is empty."""
    return F.get(F.filter(slots, lambda s: s["slot"] == name), F.lit(0))["values"]


def slot_bounds(slots: str = "slots") -> Column:
    return F.get(F.filter(slots, lambda s: s["slot"] == "budget"), F.lit(0))["bounds"]
