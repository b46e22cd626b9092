"""Settings of a store.  READ_TIME ones change without another ingest."""

from __future__ import annotations

from dataclasses import dataclass, replace

FUSIONS = ("minmax", "zscore", "rrf")
WEIGHTINGS = ("idf", "binary", "bm25")
READ_TIME = frozenset("fusion rrf_k w_semantic w_conjunctive w_temporal w_schema w_reinstate reinstate_span schema_generic_boost conj_weighting".split())


@dataclass(frozen=True)
class StoreConfig:
    """The defaults."""

    dim: int = 384
    expansion: int = 8
    sparsity: float = 0.02
    neurogenesis: float = 0.7
    beta: float = 22.0
    conj_order: int = 2
    conj_window: int | None = 4
    conj_weighting: str = "idf"
    schema_merge_threshold: float = 0.72
    replay_batch: int = 32
    sequence_span: int = 3
    interleave: float = 0.3
    promote_after: int = 3
    capacity: int | None = None
    decay_rate: float = 0.9995
    decay_floor: float = 0.05
    fusion: str = "minmax"
    rrf_k: float = 60.0
    w_semantic: float = 1.0
    w_conjunctive: float = 0.9
    w_temporal: float = 0.25
    w_schema: float = 0.6
    w_reinstate: float = 2.0
    reinstate_span: int = 3
    schema_generic_boost: float = 2.4
    seed: int = 0

    def __post_init__(self):
        if self.fusion not in FUSIONS:
            raise ValueError(f"fusion must be one of {FUSIONS}")
        if self.conj_weighting not in WEIGHTINGS:
            raise ValueError(f"weighting must be one of {WEIGHTINGS}")
        if self.conj_order < 1 or (self.conj_window is not None and self.conj_window < 2):
            raise ValueError("order must be 1 or more, window 2 or more")
        if not 0 < self.sparsity < 1:
            raise ValueError("sparsity must lie between 0 and 1")

    def reconfigured(self, **settings) -> StoreConfig:
        if wrong := set(settings) - READ_TIME:
            raise ValueError(f"not changeable at read time: {sorted(wrong)}")
        return replace(self, **settings)
