"""Settings of the dialogue pipeline as one immutable value that plans take as an argument."""

from __future__ import annotations

from dataclasses import dataclass

from weftline.functions import lexicon as lex


@dataclass(frozen=True)
class Config:
    """Stages that are on, weights, and bounds. ``CODED`` has the values the search pipeline runs with, ``PINNED`` those its scores were published for."""

    state: bool = True
    routes: tuple[str, ...] = ("bm25", "category")
    constraints: bool = True
    profile: bool = False
    confidence: bool = False
    popularity: bool = True
    rerank: bool = True
    ask: bool = True
    match_weight: float = 0.40
    penalty_weight: float = 0.20
    profile_weight: float = 0.008
    popularity_weight: float = 1.2
    decay: bool = True
    judged: tuple[str, ...] = lex.JUDGED
    ask_floor: float = lex.ASK_FLOOR
    open_questions: int = lex.OPEN_QUESTIONS
    policy: str = "ladder"
    window: int = 200
    pool: int = 300
    shown: int = 10
    turns: int = lex.TURNS
    salt: int | None = None  # a salt makes the reranker a placebo


#: The two configurations.
CODED = Config()
PINNED = Config(match_weight=0.10, penalty_weight=0.02, popularity_weight=0.008, judged=("category", "color", "material", "brand", "size", "budget"))
