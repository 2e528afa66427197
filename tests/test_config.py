"""Guard of the configurations: every setting and fixed value that decides a score is stated here once more."""

from dataclasses import FrozenInstanceError, asdict

import pytest

from weftline.config import CODED, PINNED, Config
from weftline.functions import lexicon as lex
from weftline.operators import ranked, search, vocabulary

GOLDEN = {
    "state": True, "routes": ("bm25", "category"), "constraints": True, "profile": False, "confidence": False, "popularity": True, "rerank": True, "ask": True,
    "match_weight": 0.4, "penalty_weight": 0.2, "profile_weight": 0.008, "popularity_weight": 1.2, "decay": True, "judged": ("color", "material", "size", "budget"), "ask_floor": 0.1,
    "open_questions": 1, "policy": "ladder", "window": 200, "pool": 300, "shown": 10, "turns": 10, "salt": None}


def test_configurations_have_not_drifted():
    assert asdict(CODED) == GOLDEN == asdict(Config())
    assert asdict(PINNED) == GOLDEN | {"match_weight": 0.1, "penalty_weight": 0.02, "popularity_weight": 0.008, "judged": ("category", "color", "material", "brand", "size", "budget")}
    with pytest.raises(FrozenInstanceError):
        CODED.window = 10


def test_fixed_values_have_not_drifted():
    assert (lex.ASK_FLOOR, lex.OPEN_QUESTIONS, lex.ASK_DEPTH, lex.TURNS) == (0.1, 1, 50, 10) and (lex.REQUIRED, lex.CORRECTED, lex.STATED, lex.HEDGED) == (1.0, 0.9, 0.7, 0.4)
    assert (search.K1, search.B, search.LEAST_IDF, search.QUERY_TERMS, search.DAMPING, search.POOL) == (1.2, 0.75, 1e-6, 40, 60, 300)
    assert (vocabulary.TERMS, vocabulary.LEAST_POOL, vocabulary.LEAST_DF, vocabulary.LARGEST_SHARE, vocabulary.MOST_TERMS, vocabulary.LEAST_SUPPORT) == (40, 8, 2, 0.8, 1500, 0.05)
    assert ranked.SCORED == ("category", "color", "material", "brand", "size", "budget") and set(ranked.SCORED) - set(ranked.STRICT) == {"size"}
    assert set(lex.JUDGED) | set(lex.UNJUDGED) | {lex.OPEN_QUESTION} <= set(lex.ASKABLE)
