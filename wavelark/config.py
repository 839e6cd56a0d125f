"""All constants in one place. Rates are parameters: a 16 Hz fixture has the same shape as 32 kHz audio."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # They define the results.
    sample_rate: int = 32_000
    chunk_seconds: float = 60.0
    chunk_overlap_seconds: float = 2.0
    window_seconds: float = 4.0
    hop_seconds: float = 2.0
    speech_threshold: float = 0.15
    band_edges_hz: tuple[float, ...] = (20, 150, 400, 1000, 2500, 6000, 16000)
    band_rate: int = 32_000  # the rate that band_edges_hz are meant for
    flux_frame_seconds: float = 0.5
    check_window_seconds: float = 2.0
    check_hop_seconds: float = 1.0
    max_candidates: int = 10
    shortlist: int = 25
    min_separation_seconds: float = 8.0
    contrast_seconds: float = 30.0
    duplicate_similarity: float = 0.97
    region_similarity: float = 0.92
    region_gap_seconds: float = 2.5
    diversity_weight: float = 0.20
    prior_penalty: float = 0.5
    prior_weight: float = 0.20
    weights: dict[str, float] = field(default_factory=lambda: {"novelty": 0.20, "contrast": 0.20, "layering": 0.20, "distinctiveness": 0.20, "temporal_interest": 0.20})
    weight_jitter: float = 0.40
    score_jitter: float = 0.15
    clip_seconds: float = 5.0
    max_clip_seconds: float = 6.5
    search_padding_seconds: float = 2.5
    frame_seconds: float = 0.05
    active_ratio: float = 1.6
    edge_pad_seconds: float = 0.15
    crossfade_seconds: float = 0.4
    declick_seconds: float = 0.01
    boundary_silence_seconds: float = 0.5
    boundary_pad_seconds: float = 0.15
    min_trim_seconds: float = 0.2


DEFAULT = Config()
#: The class names that count as speech.
SPEECH_LABELS = (
    "Speech", "Male speech, man speaking", "Female speech, woman speaking", "Child speech, kid speaking", "Conversation", "Narration, monologue", "Babbling",
    "Speech synthesizer", "Shout", "Yell", "Whispering", "Chatter", "Crowd", "Hubbub, speech noise, speech babble",
)


def speech_indexes(labels: list[str]) -> list[int]:
    """Where the speech classes stand in a model's vocabulary."""
    return [i for i, x in enumerate(labels) if x in SPEECH_LABELS]
