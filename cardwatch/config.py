"""Settings of the scoring job. Values become literals in the plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults of the scoring contract.
    slo_p99_ms: int = 10
    l2_reserve_us: int = 1_000
    l1_uncertain_low: float = 0.35
    l1_uncertain_high: float = 0.65
    deny_threshold: float = 0.85
    review_threshold: float = 0.65
    short_window_s: int = 60
    long_window_s: int = 300
    bucket_ms: int = 100
    late_tolerance_ms: int = 2_000
    max_future_skew_ms: int = 60_000

    # Distribution settings. They change the plan, never the result.
    # A user with more rows than `heavy_rows` is cut into segments of about
    # `segment_rows` arrivals. At most total_rows / heavy_rows users can be heavy.
    heavy_rows: int = 2_000_000
    segment_rows: int = 1_000_000
    # A user with more rows than this per long window, on average over the user's
    # time span, gets its windows from totals of blocks instead of frames over rows.
    dense_rows: int = 256
    # Up to this many heavy or dense users are listed in the plan as a broadcast relation;
    # beyond it the heavy users are joined by shuffle and all users count as dense.
    heavy_listed: int = 10_000

    @property
    def budget_us(self) -> int:
        return self.slo_p99_ms * 1_000

    @property
    def short_buckets(self) -> int:
        return max(self.short_window_s * 1_000 // self.bucket_ms, 1)

    @property
    def long_buckets(self) -> int:
        return max(self.long_window_s * 1_000 // self.bucket_ms, 1)

    @property
    def late_buckets(self) -> int:
        """How far below the running maximum an accepted bucket can lie."""
        return -(-self.late_tolerance_ms // self.bucket_ms)
