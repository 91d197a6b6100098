"""All constants of the engine in one place, with an overlay from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class EngineConfig:
    forward_budget: int = 1024  # tokens of a pack
    warmup_turns: int = 3  # turns with the whole budget
    marginal_jaccard: float = 0.8  # a piece this like what is packed stays out
    skip_floor: int = 64
    novelty_floor: float = 0.5
    dedup_turns: int = 3  # packs whose lines are not sent again
    min_cosine: float = 0.03
    fallback_top_k: int = 3
    dim: int = 256
    k_max: int = 32
    ema: float = 0.7
    chunk_target: int = 96  # words of a chunk: aimed at, least and most
    chunk_min: int = 64
    chunk_max: int = 128
    chunks_per_turn: int = 8
    chunks_per_window: int = 32
    facts_per_turn: int = 3
    paths_per_turn: int = 8
    topics_per_turn: int = 8
    max_active_turns: int = 32
    max_facts: int = 48
    max_durable_facts: int = 32
    hot_chars: int = 400
    open_share: float = 0.40  # of the hot set's slots
    decision_share: float = 0.40
    path_share: float = 0.20
    typed_top_k: int = 12
    candidate_typed_top_k: int = 16
    gist_tokens: int = 32
    window_turns: int = 8
    context_chars: int = 8000
    history_rows: int = 32
    flush_every: int = 5
    p1_jaccard: float = 0.15
    cross_turn_dedup: bool = True
    inject_p1: bool = False
    identifiers: tuple[str, ...] = ()  # patterns of names that make a sentence a fact, beside the fixed ones
    reload_each_turn: bool = False  # as one process an event would: path counts go, the last user text is its summary

    @classmethod
    def from_env(cls, prefix: str = "TURNLOOM_") -> EngineConfig:
        """Positive numbers and yes-or-no words from the environment win; anything else leaves the default."""
        out = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper(), "").strip()
            if isinstance(f.default, tuple):
                continue
            if isinstance(f.default, bool):
                if raw.lower() in YES + NO:
                    out[f.name] = raw.lower() in YES
                continue
            try:
                value = type(f.default)(raw)
            except ValueError:
                continue
            if value > 0:
                out[f.name] = value
        if "facts_per_turn" in out:
            out["facts_per_turn"] = min(12, out["facts_per_turn"])
        return cls(**out)


DEFAULT = EngineConfig()
