"""Patterns for the one-dimensional cutting-stock problem by column generation.

Everything here works on a length histogram: its size depends on the capacity only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each of which holds counts[i] pieces of lengths[i]."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Knapsack by dynamic programming: value[n] is the worth of a piece of length n + 1."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    longest = len(value)
    for room in range(1, capacity + 1):
        n = min(room, longest)
        worth = value[:n] + best[room - n : room][::-1]
        k = int(worth.argmax())
        if worth[k] > best[room - 1] + 1e-12:
            best[room], took[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    counts: dict[int, int] = {}
    room = capacity
    while room > 0:
        if took[room]:
            counts[int(took[room])] = counts.get(int(took[room]), 0) + 1
            room -= int(took[room])
        else:
            room -= 1
    return float(best[capacity]), counts


def best_limited_pattern(
    value: np.ndarray, capacity: int, limits: np.ndarray
) -> tuple[float, dict[int, int]]:
    """The same with at most limits[n] pieces of length n + 1, which are dealt in lots of
    1, 2, 4, ... Only done where the plain knapsack breaks a limit."""
    worth, counts = best_pattern(value, capacity)
    if all(k <= limits[n - 1] for n, k in counts.items()):
        return worth, counts
    lots = []
    for n in (np.flatnonzero(value > 0) + 1).tolist():
        some, lot = min(capacity // n, int(limits[n - 1])), 1
        while some > 0:
            lot = min(lot, some)
            lots.append((n, lot))
            some, lot = some - lot, 2 * lot
    best = np.zeros(capacity + 1)
    took = np.zeros((len(lots), capacity + 1), bool)
    for k, (n, lot) in enumerate(lots):
        size = n * lot
        with_it = best[: capacity + 1 - size] + lot * value[n - 1]
        took[k, size:] = with_it > best[size:] + 1e-12
        best[size:] = np.where(took[k, size:], with_it, best[size:])
    counts, room = {}, capacity
    for k in range(len(lots) - 1, -1, -1):
        if took[k, room]:
            n, lot = lots[k]
            counts[n] = counts.get(n, 0) + lot
            room -= n * lot
    return float(best[capacity]), counts


def first_columns(
    lengths: np.ndarray, wanted: np.ndarray, capacity: int
) -> tuple[list[dict[int, int]], np.ndarray]:
    """A basis to start with, and its inverse: the longest length left is filled up with the longest that fit.

    Each column is used until one of its lengths is done, which later columns then lack. So
    there is one for each length and together they are triangular, and none holds more pieces
    of a length than there are.
    """
    left, most = wanted.copy(), np.ceil(wanted - 1e-3).astype(np.int64)
    open_, columns, inverse = np.ones(len(lengths), bool), [], np.zeros((len(lengths),) * 2)
    users = [[] for _ in lengths]
    for _ in lengths:
        room, limit, column = capacity, len(lengths), {}
        while room > 0:
            fit = np.flatnonzero(open_[: min(limit, int(np.searchsorted(lengths, room, "right")))])
            if not len(fit):
                break
            limit = int(fit[-1])
            column[limit] = int(min(most[limit], room // lengths[limit]))
            room -= column[limit] * int(lengths[limit])
        rows, counts = np.array(list(column)), np.array(list(column.values()), float)
        ratio = left[rows] / counts
        done = int(ratio.argmin())
        left[rows] -= ratio[done] * counts
        last = int(rows[done])
        open_[last] = False
        own = np.zeros(len(lengths))
        own[last] = 1
        for k, each in users[last]:
            own -= each * inverse[k]
        inverse[len(columns)] = own / counts[done]
        for i, k in column.items():
            users[i].append((len(columns), k))
        columns.append({int(lengths[i]): k for i, k in column.items()})
    return columns, inverse


@dataclass(frozen=True)
class Master:
    """The linear program's patterns with fractional times, and what bounds it from below."""

    shares: list[tuple[dict[int, int], float]]
    total: float
    bound: float
    rounds: int


def solve_master(
    demand: dict[int, int], capacity: int, tolerance: float, rounds: int
) -> Master:
    """The linear program over patterns, to within `tolerance` sequences of a dual bound.

    Simplex; each round prices one column by the knapsack, with no more pieces than there
    are. Prices bound the program by the demand at those prices over the best pattern's
    worth; so do lengths over the capacity, which is the bound to start with.
    Demands are shifted by under a thousandth of a piece against ties in the simplex. Every
    basis covers the demand exactly, so an early end costs padding and nothing else.
    """
    lengths = np.array(sorted(demand))
    exact = np.array([demand[n] for n in lengths], float)
    wanted = exact + 1e-3 * (np.arange(1, len(lengths) + 1) * 0.618034 % 1)
    row = {int(n): i for i, n in enumerate(lengths)}

    def vector(pattern: dict[int, int]) -> np.ndarray:
        column = np.zeros(len(lengths))
        for n, k in pattern.items():
            column[row[n]] = k
        return column

    columns, inverse = first_columns(lengths, wanted, capacity)
    times = inverse @ wanted
    value, limits = np.zeros(int(lengths[-1])), np.zeros(int(lengths[-1]), np.int64)
    limits[lengths - 1] = exact
    bound, done = float(exact @ lengths) / capacity, 0
    while done < rounds and times.sum() > bound + tolerance:
        done += 1
        duals = inverse.sum(axis=0)
        value[lengths - 1] = duals
        worth, pattern = best_limited_pattern(value, capacity, limits)
        bound = max(bound, float(exact @ duals) / worth)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ vector(pattern)
        up = step > 1e-9
        ratio = np.where(up, times / np.where(up, step, 1), np.inf)
        leave = int(ratio.argmin())
        pivot, shift = inverse[leave] / step[leave], times[leave] / step[leave]
        columns[leave] = pattern
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        times = np.maximum(times - step * shift, 0)
        times[leave] = shift
    shares = np.maximum(inverse @ exact, 0).tolist()
    return Master(list(zip(columns, shares, strict=True)), float(times.sum()), bound, done)


def cut(demand: dict[int, int], capacity: int, gap: float, rounds: int) -> list[Pattern]:
    """Patterns whose pieces are exactly the demanded ones.

    Solves the linear program, takes its patterns as often as their shares' whole part and,
    largest rest first, once more where the rest is over a half; what is left is a program
    of its own, to the same number of sequences: `gap` of the whole, or one and a half. At
    least one pattern is taken each time.
    """
    left, found = {n: k for n, k in demand.items() if k}, []
    tolerance = max(1.5, gap * sum(n * k for n, k in left.items()) / capacity)

    def take(pattern: dict[int, int], most: int) -> int:
        times = min([most, *(left[n] // k for n, k in pattern.items())])
        if times > 0:
            order = sorted(pattern, reverse=True)
            found.append(Pattern(tuple(order), tuple(pattern[n] for n in order), times))
            for n, k in pattern.items():
                left[n] -= k * times
        return times

    while left:
        solved = solve_master(left, capacity, tolerance, rounds)
        rounds -= solved.rounds
        rests = []
        for pattern, share in solved.shares:
            whole = int(share + 1e-6)
            rests.append((share - whole, take(pattern, whole), pattern))
        rests.sort(key=lambda r: -r[0])
        taken = sum(times for _, times, _ in rests)
        for rest, _, pattern in rests:
            if rest > 0.5 or not taken:
                taken += take(pattern, 1)
        left = {n: k for n, k in left.items() if k}
    return found
