"""Engine settings; each names the behaviour it changes."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that are not searched for. A longer list is a parameter (EngineConfig.stop_words).
STOP_WORDS = (
    "the a an and or to of in is it that this we you i our have has had was were been be do does did would could should "
    "how what when where with about considering problem solved remember data info information de da do dos das e o a os "
    "as um uma que em para por com no na nos nas foi era ja se como qual isso nosso nossa voce sobre problema resolvido "
    "lembrar"
).split()

WINDOW_LINES, WINDOW_STRIDE = 32, 24
CHUNK_LIMIT, CHUNK_LINES, CHUNK_STRIDE = 60, 40, 36
SPAN_WIDTH, SPAN_TERMS = 9, 3
RRF_OFFSET = 60
KNOWLEDGE_BOOST = 1.15
CAPS = {"USER": 1375, "global": 4000, "project": 2500, "hub": 8000}
TRANSCRIPT_CAP = 250_000
SOURCE_CAP = 180_000
HORIZON_DAYS = 35


@dataclass(frozen=True)
class EngineConfig:
    """What a store may set. The defaults switch every optional gate off."""

    stop_words: tuple[str, ...] = tuple(dict.fromkeys(STOP_WORDS))
    recall_min_score: float = 0.0
    recall_min_terms: int = 1
    recall_limit: int = 3
    recall_hybrid: bool = False
    recall_plain_terms: int = 0
    recall_cross_auto_min_score: float = 0.0
    recall_bytes: int = 2000
    recall_semantic: bool = False
    recall_semantic_limit: int = 2
    snapshot_bytes: int = 8000
    span_discount: float = 0.0
    salience_reserve: int = 300
    salience_margin: float = 0.5
    salience_cross_weight: float = 2.0
    salience_recent_days: int | None = None
    closed_heading: str | None = None
    automatic_recall_scope: str = "project"
    extra: dict = field(default_factory=dict)
