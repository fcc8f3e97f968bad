"""All tunable values of the operators, with overrides that are cast by the type of what they replace."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Params:
    # choosing between two transcripts
    similarity_threshold: float = 0.85
    min_primary_score: float = 0.55
    max_repetition: float = 0.35
    disagreement_threshold: float = 0.55
    hotword_boost: float = 0.12
    score_margin: float = 0.08
    # finding speech in frames
    sample_rate: int = 16_000
    hop: int = 160
    speech_threshold: float = 0.65
    smoothing: float = 0.35
    start_frames: int = 10
    end_frames: int = 20
    silence_ms: int = 200
    pre_speech_ms: int = 500
    keep_tail_ms: int = 40
    min_segment_ms: int = 350
    partial_interval_ms: int = 500
    # second look at a segment
    gate_enabled: bool = True
    gate_threshold: float = 0.6
    gate_min_voiced_ms: int = 200
    # clips
    enrollment_min_sec: float = 1.0
    enrollment_max_sec: float = 5.0
    target_max_sec: float = 30.0
    emotion_max_sec: float = 20.0
    upload_max_sec: float = 60.0
    upload_max_bytes: int = 25 * 1024 * 1024
    emotion_mode: str = "ser"
    queue_size: int = 40

    @property
    def frame_ms(self) -> float:
        return 1000.0 * self.hop / self.sample_rate

    def frames(self, ms: float, least: int = 1) -> int:
        return max(least, math.ceil(ms / self.frame_ms))

    @property
    def closing_frames(self) -> int:
        return max(self.frames(self.silence_ms), self.end_frames)

    def override(self, values: dict[str, Any] | None) -> Params:
        """With ``values`` for known names; what can't be cast stays. The words false, no, off and 0 are false."""
        changed: dict[str, Any] = {}
        for field in dataclasses.fields(self):
            if values is None or field.name not in values:
                continue
            now, new = getattr(self, field.name), values[field.name]
            try:
                if isinstance(now, bool):
                    changed[field.name] = new.strip().lower() not in ("", "false", "no", "off", "0") if isinstance(new, str) else bool(new)
                else:
                    changed[field.name] = type(now)(new)
            except (TypeError, ValueError):
                continue
        return dataclasses.replace(self, **changed)

    @staticmethod
    def load(text: str | None) -> Params:
        """From a JSON object; no text gives the defaults."""
        return Params().override(json.loads(text) if text else None)
