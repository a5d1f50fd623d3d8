"""Options of a run, clamped to their valid ranges when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MergeOptions:
    """Coalescing of neighbouring matches: least length of a neighbour, greatest mean gap, merges needed."""

    enabled: bool = False
    neighbor_length: int = 2
    gap: int = 6
    required: int = 6

    def __post_init__(self):
        for name in ("neighbor_length", "gap", "required"):
            object.__setattr__(self, name, max(1 if name == "neighbor_length" else 0, getattr(self, name)))


@dataclass(frozen=True)
class FrequencyOptions:
    """Weighting of matches by rarity: strategy, weighting function, factor from 0 to 1, least subsequence."""

    enabled: bool = False
    strategy: str = "complete"
    weighting: str = "sigmoid"
    factor: float = 0.25
    least: int = 12

    def __post_init__(self):
        object.__setattr__(self, "factor", min(1.0, max(0.0, self.factor)))
        object.__setattr__(self, "least", max(1, self.least))


@dataclass(frozen=True)
class ClusterOptions:
    """Clustering: algorithm, preprocessing, linkage and their parameters."""

    enabled: bool = True
    metric: str = "avg_sim"
    algorithm: str = "spectral"
    preprocessing: str = "cdf"
    linkage: str = "average"
    agglomerative_threshold: float = 0.2
    threshold: float = 0.2
    percentile: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Options:
    """A whole run. ``shown`` of 0 shows all comparisons; ``min_match`` counts tokens."""

    language: str = "text"
    min_match: int = 12
    shown: int = 2500
    threshold: float = 0.0
    metric: str = "avg_sim"
    suffixes: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    subdirectory: str | None = None
    normalize: bool = False
    merging: MergeOptions = field(default_factory=MergeOptions)
    frequency: FrequencyOptions = field(default_factory=FrequencyOptions)
    clustering: ClusterOptions = field(default_factory=ClusterOptions)

    def __post_init__(self):
        object.__setattr__(self, "min_match", max(1, self.min_match))
        object.__setattr__(self, "shown", max(0, self.shown))
        object.__setattr__(self, "threshold", min(1.0, max(0.0, self.threshold)))

    @property
    def tile_length(self) -> int:
        """The least length that matching itself uses: neighbours of matches may be shorter."""
        return min(self.min_match, self.merging.neighbor_length) if self.merging.enabled else self.min_match
