"""Constants of the memory model, as overridable parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names, weights and windows that results depend on, here and in Params.
BANKS = ("hermes", "hermes-sessions", "knowledge", "reflection", "hermes-docs")
STATES = ("candidate", "trial", "active", "decaying", "archived", "retired")
EDGE_TYPES = ("related", "causal", "parent_child", "contradicts")
ENTITY_TYPES = ("person", "org", "project", "concept", "tool", "place", "event", "other")
OUTCOMES = {"adopted": 1.0, "corrected": -1.0, "useless": -1.0}
CORE_HEADER = "【核心记忆 core block·常驻区，不经检索】"


@dataclass(frozen=True)
class Params:
    rrf_k: int = 60
    w_vector: float = 1.0
    w_text: float = 0.8
    w_time: float = 0.4
    w_graph: float = 0.5
    top_vector: int = 60
    top_text: int = 60
    top_time: int = 30
    life: dict = field(default_factory=lambda: {"active": 1.0, "trial": 0.85, "candidate": 0.85, "decaying": 0.7, "archived": 0.0, "retired": 0.0})
    archived_visible: float = 0.5
    verify: dict = field(default_factory=lambda: {"verified": 1.02, "stale": 0.95, "unverified": 1.0})
    stale: dict = field(default_factory=lambda: {"fresh": 1.0, "aging": 0.9, "stale": 0.7})
    tier: dict = field(default_factory=lambda: {"user": 1.0, "agent": 1.0, "web": 0.85, "cron": 0.9})
    seeds_per_route: int = 10
    seeds_max: int = 24
    max_neighbors: int = 30
    hop_top_k: int = 15
    fanout: int = 50
    hops: int = 2
    hop_decay: float = 0.5
    disambiguation_penalty: float = 0.3
    disambiguation_margin: float = 0.05
    disambiguation_sample: int = 30
    bank_scale: dict = field(default_factory=lambda: {"hermes": 1.5, "knowledge": 1.5, "hermes-sessions": 0.5})
    type_factor: dict = field(default_factory=lambda: {"semantic": 2.0, "procedural": 1.5, "episodic": 1.0})
    candidate_days: int = 6
    trial_days: int = 30
    active_days: int = 90
    archive_days: int = 180
    zero_access_days: int = 90
    revive_days: int = 3
    adopt_days: int = 30
    promote_hits: int = 3
    promote_ratio: float = 0.6
    dedup_cosine: float = 0.97
    dedup_bank_cosine: dict = field(default_factory=lambda: {"hermes": 0.95, "reflection": 0.95, "knowledge": 0.98})
    dedup_days: int = 3
    consolidate_days: int = 14
    consolidate_limit: int = 500
    consolidate_cosine: float = 0.93
    ema_alpha: float = 0.1
    core_budget: int = 1500
    core_per_track: int = 20
    core_types: tuple = ("semantic", "procedural")
    core_polarity: float = 0.5
    core_adopts: int = 2
    core_tail: int = 24
    hard_score: float = 0.005
    hard_min_length: int = 4
    cluster_hits: int = 3
    cluster_days: int = 2
    gate_delta: float = 0.05
    gate_alpha: float = 0.05
    hard_ttl_days: int = 7
    hard_cap: int = 500
    weak_k: int = 3
    weak_group: int = 100

    def window_days(self, base: int, memory_type: str, bank: str) -> int:
        """A look-back window in days, scaled by type and bank; halves round to even."""
        return int(round(base * self.bank_scale.get(bank, 1.0) * self.type_factor.get(memory_type, 1.0)))


DEFAULT = Params()
