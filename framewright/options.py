"""Detection options; a value of 0 or less means the default, as in the flags of the same names."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    fps: float = 25.0
    min_block_s: float = 60.0
    max_block_s: float = 900.0
    max_block_fraction: float = 0.5
    min_show_segment_s: float = 60.0
    min_absent_open_s: float = 5.0
    logo_threshold: float = 0.10
    refine_window_s: float = 90.0
    max_ad_gap_s: float = 30.0
    bumper_snap_s: float = 10.0
    bumper_threshold: float = 0.85
    letterbox_snap_s: float = 5.0
    # Options from here on may be 0: 0 switches the step off.
    iframe_snap_s: float = 5.0
    scene_cut_snap_s: float = 0.0
    logo_cross_refine_s: float = 2.0
    logo_smooth_s: float = 5.0
    nn_weight: float = 0.3
    nn_gate: float = 0.3
    nn_smooth_s: float = 10.0
    speaker_weight: float = 0.0
    start_extend_s: float = 0.0
    end_extend_s: float = 0.0
    # Detector thresholds.
    blackframe_d: float = 0.10
    silence_noise_db: float = -30.0
    silence_d: float = 0.50
    scene_threshold: float = 0.40
    bumper_stride: int = 5

    def resolved(self) -> Options:
        """Every option of the first group that is 0 or less becomes its default."""
        first = fields(self)[:12]
        return replace(self, **{f.name: f.default for f in first if getattr(self, f.name) <= 0})

    def frames(self, seconds: float) -> int:
        return int(seconds * self.fps)
