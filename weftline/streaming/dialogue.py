"""The fold of sessions over a stream of turns: the same step as in batch, with late and repeated turns put right.

A session's state keeps the turns of its running dialogue, which are few. A turn that comes late is put in its place and the
turns from there on are folded again; their corrected states are emitted once more, so that the last row of a request is
what the batch fold gives. Repeated deliveries change nothing. A first turn with a higher id starts afresh, turns older than
the running dialogue are reported as late, and a session that stays silent for ``silence`` is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import session as ss

STATES = f"request_id bigint, session_id string, turn int, slots {ss.SLOTS}, evidence {ss.EVIDENCE}, log {ss.LOG}, outcome string"
_NO_TURN = 1 << 30


def _place(turn: dict) -> tuple:
    return (_NO_TURN if turn["turn"] is None else turn["turn"], turn["id"])


def fold_turns(kept: list[dict], arrived: list[dict]) -> tuple[list[dict], list[tuple]]:
    """The running dialogue's turns with those that arrived, and rows (turn, state, outcome) for all whose state is new.

    A state is None for a turn that is reported and not applied. Turns are ``{"id", "turn", "text"}``.
    """
    out: list[tuple] = []
    turns, changed = list(kept), None
    for t in sorted(arrived, key=lambda t: t["id"]):
        if any(k["id"] == t["id"] for k in turns):
            out.append((t, None, "repeated"))
            continue
        first = min((k["id"] for k in turns), default=None)
        if turns and t["turn"] == 1 and t["id"] > first:
            out += _states(turns, changed)
            turns, changed = [], None
        elif turns and t["id"] < first and t["turn"] != 1:
            out.append((t, None, "late"))
            continue
        turns.append(t)
        changed = _place(t) if changed is None else min(changed, _place(t))
    return turns, out + _states(turns, changed)


def _states(turns: list[dict], since: tuple | None) -> list[tuple]:
    state, out = ss.fresh(), []
    for t in sorted(turns, key=_place) if since else ():
        state = ss.advance(state | {"log": []}, t["text"], t["turn"])
        if _place(t) >= since:
            out.append((t, state, "applied"))
    return out


def stream_states(turns: DataFrame, late: str = "1 hour", silence: str = "1 day") -> DataFrame:
    """States of a stream of turns (``request_id, session_id, turn, user_message, received_at``), in update mode.

    Rows that come later than ``late`` behind the stream are dropped by the watermark.
    """
    idle = int(pd.Timedelta(silence).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        arrived = [{"id": int(i), "turn": None if pd.isna(t) else int(t), "text": m if isinstance(m, str) else None}
                   for i, t, m in zip(rows["request_id"], rows["turn"], rows["user_message"])]
        kept, out = fold_turns(kept, arrived)
        state.update((json.dumps(kept),))
        newest = int(rows["received_at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle)
        empty = ss.fresh()
        yield pd.DataFrame([{
            "request_id": t["id"], "session_id": key[0], "turn": t["turn"], "slots": ss.slots_column((s or empty)["slots"]), "evidence": ss.evidence_column((s or empty)["evidence"]),
            "log": (s or empty)["log"], "outcome": outcome} for t, s, outcome in out], columns=["request_id", "session_id", "turn", "slots", "evidence", "log", "outcome"])

    timed = turns.select("request_id", "session_id", "turn", "user_message", F.col("received_at").cast("timestamp").alias("received_at")).withWatermark("received_at", late)
    return timed.groupBy("session_id").applyInPandasWithState(run, STATES, "turns string", "update", GroupStateTimeout.EventTimeTimeout)
