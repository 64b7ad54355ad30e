"""Row-at-a-time model of the history features, for comparison only."""

from __future__ import annotations

from collections import defaultdict


def history_features(rows, short=600, long=3000, bucket_ms=100, tolerance=2000):
    """rows: (user, arrival, time_ms, amount); returns {(user, arrival): six values}."""
    seen = defaultdict(list)
    out = {}
    for user, arrival, t, amount in sorted(rows, key=lambda r: (r[0], r[1])):
        past = seen[user]
        b = t // bucket_ms
        top = max((p[0] for p in past), default=None)
        known = top is not None and top > 0
        late = known and t < top
        gap = t - top if known and not late else 0
        newest = b if top is None else max(b, top // bucket_ms)
        held = [p for p in past if p[2] and newest - long < p[0] // bucket_ms <= b]
        in_short = [p for p in held if p[0] // bucket_ms > b - short]
        out[user, arrival] = (
            float(len(in_short)),
            float(len(held)),
            sum(p[1] for p in in_short),
            sum(p[1] for p in held),
            float(gap),
            float(late),
        )
        past.append((t, amount, not (known and top - t > tolerance)))
    return out
