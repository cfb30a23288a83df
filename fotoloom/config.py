"""Settings, with the defaults of the command line this engine stands in for."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SimilarityConfig:
    image: float = 0.99
    image_video: float = 0.93
    video: float = 0.93
    step_size: float = 1.0
    #: accepted for compatibility; nothing depends on it
    window_size: int = 5
    #: 'components' (free of order) or 'greedy_star' (in the order of paths)
    cluster_mode: str = "components"
    #: 'lsh4' (pairs that share one of four 16-bit keys), 'pigeonhole' or 'all_pairs' (complete)
    candidates: str = "lsh4"

    def max_distance(self, threshold: float, bits: int = 64) -> int:
        """similarity >= threshold means at most so many differing bits."""
        return int(bits * (1 - threshold) + 1e-9)


@dataclass(frozen=True)
class FrameConfig:
    resolution: int = 64
    target_fps: float = 2.0
    min_frames: int = 5
    max_scene_frames: int = 100
    scene_change_threshold: float = 0.05


@dataclass(frozen=True)
class StatsConfig:
    max_chunk: int = 2 * 1024 * 1024


@dataclass(frozen=True)
class TransferConfig:
    target_dir: str = "library"
    template: str = "{D.YYYY}/{D.MM}/{D.DD}/{NAME}{EXT}"
    duplicate_dir: str | None = None
    error_dir: str | None = None
    move: bool = False
    seed: str = "0"
    #: representatives are transferred unless the reference's routing is asked for
    reference_routing: bool = False


@dataclass(frozen=True)
class EngineConfig:
    similarity: SimilarityConfig = field(default_factory=SimilarityConfig)
    frames: FrameConfig = field(default_factory=FrameConfig)
    stats: StatsConfig = field(default_factory=StatsConfig)
    transfer: TransferConfig = field(default_factory=TransferConfig)
