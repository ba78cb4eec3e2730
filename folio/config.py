"""Parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from folio.operators.graph import GraphParams


@dataclass(frozen=True)
class Settings:
    top_k: int = 8
    chunk_chars: int = 1800
    overlap_chars: int = 200
    small_to_big: bool = False
    window: int = 1
    expand_top_n: int = 3
    rerank: bool = False
    rerank_candidates: int = 30
    graph: bool = False
    graph_mode: str = "local"
    graph_params: GraphParams = field(default_factory=GraphParams)
    global_m: int = 6
    global_map: bool = False
    global_chunks: int = 2
    faithfulness: bool = False
    faithfulness_threshold: float = 0.5
    crag_max_retries: int = 1
    crag_min_relevant: int = 2
    crag_max_regen: int = 1
    crag_unsupported_max: float = 0.5
    crag_strategy: str = "trigger"
    history_turns: int = 4
    condense_turns: int = 6
    grade_chars: int = 4000
