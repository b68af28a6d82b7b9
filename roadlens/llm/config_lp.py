"""Configuration linear program over a length histogram (driver side, bounded by the capacity).

minimise the number of sequences  sum x_c  over fillings c  with  sum_c a_lc x_c >= n_l  for
each length l.  Multiplicative weights hold one dual price per length.  Each round one knapsack
dynamic program over the capacity finds the dearest filling under these prices, which also scales
the prices to a feasible dual: a proven lower bound.  The round's columns are the dearest filling
and those, read from the same table over the lengths still open, that hold the lengths furthest behind
and are as dear within ``SLACK``; each is used until one of its lengths is covered.  Then prices rise for lengths that are behind
the mean and fall for those ahead.

The fractional answer is rounded down; the same rounds in whole sequences go on over what is left
(``whole``), and what no good filling takes is put by best fit into free space and then into new
sequences.  The histogram has at most ``capacity`` entries and the work does not depend on the
number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROUNDS = 120
RATE = 0.02          # of the prices' update
TILT = 0.02          # prices stay this near to a length's tokens
SLACK = 0.01         # a column is as dear as the best one up to this share, and full but for 2 ** idle rounds - 1 tokens
LONG = 1e-3          # a full-length piece is that much dearer by the token
GAP = 0.002          # a packing this near to the bound stands
LEFT = 0.002         # the fractional program ends with this share of the tokens uncovered


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the highest price of a filling of at most c tokens."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    backwards = -lengths
    for c in range(int(lengths[0]), capacity + 1):
        value = best.take(backwards[:upto[c]] + c)
        value += price[:upto[c]]
        best[c] = max(value.max(), best[c - 1])
    return best


def filling(first: int, sizes: np.ndarray, price: np.ndarray, best: np.ndarray, open_: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest filling by the table that has the length of index ``first``, of lengths that are still
    ``open_`` (indices, ascending): index -> times."""
    found, c = {first: 1}, capacity - int(sizes[first])
    own, worth = sizes[open_], price[open_]
    while c > 0:
        k = int(own.searchsorted(c, side="right"))
        if not k:
            break
        value = worth[:k] + best.take(c - own[:k])
        j = int(open_[k - 1 - int(value[::-1].argmax())])          # the longest of the dearest
        found[j] = found.get(j, 0) + 1
        c -= int(sizes[j])
    return found


@dataclass
class Cover:
    """times: filling (index, times) -> how often; left: uncovered demand; bound: a proven least number."""
    times: dict[tuple, float] = field(default_factory=dict)
    left: np.ndarray | None = None
    bound: float = 0.0

    def value(self, lengths: np.ndarray, capacity: int) -> float:
        """The program's value: what is left counts by best fit's plain bound, a length by itself."""
        alone = sum(float(n) / (capacity // int(s)) for n, s in zip(self.left, lengths, strict=True))
        return sum(self.times.values()) + alone


def cover(lengths: np.ndarray, demand: np.ndarray, capacity: int, whole: bool = False) -> Cover:
    """Multiplicative weights; ``whole``: columns are used a whole number of times."""
    out, left, weight = Cover(), demand.astype(float).copy(), np.ones(len(lengths))
    tokens = float((lengths * demand).sum())
    unit = 1.0 if whole else max(float(demand.min()), 1.0) * 1e-3
    idle = 0
    for _ in range(ROUNDS):
        live = np.flatnonzero(left >= unit)
        if not len(live) or (not whole and float((lengths * left).sum()) < LEFT * tokens):
            break
        # of fillings that are equally dear the one of fewer, longer pieces: short ones fit anywhere later
        sizes, price = lengths[live], lengths[live] / capacity * weight[live] * (1 + LONG * lengths[live] / capacity)
        best = knapsack(sizes, price, capacity)
        top = best[capacity]
        out.bound = max(out.bound, float((demand[live] * price).sum() / top))
        share = left[live] / demand[live]
        used, open_ = 0.0, np.arange(len(live))
        lead = sizes * 2 >= sizes[-1]                  # short lengths fill up: they lead when the long ones are gone
        for j in np.lexsort((-sizes, -share)).tolist():
            if not lead[j]:
                continue
            while left[live[j]] >= unit:
                found = filling(j, sizes, price, best, open_, capacity)
                held = sum(int(sizes[i]) * a for i, a in found.items())
                if held < capacity - (0 if whole else (1 << idle) - 1) or sum(price[i] * a for i, a in found.items()) < (1 - SLACK * (1 << idle)) * top:
                    break
                limit = min(left[live[i]] / a for i, a in found.items())
                x = float(int(limit + 1e-9)) if whole else limit
                if x <= 0:                      # fewer pieces of one length left than the filling holds
                    break
                for i, a in found.items():
                    left[live[i]] -= x * a
                    used += x * a * sizes[i]
                open_ = open_[left[live[open_]] >= unit]
                key = tuple(sorted(((int(live[i]), a) for i, a in found.items()), reverse=True))
                out.times[key] = out.times.get(key, 0.0) + x
        share = left / demand
        weight = np.clip(weight * np.exp(RATE * (share - share[live].mean())), 1 - TILT, 1 + TILT)
        idle = 0 if used > 0.02 * float((lengths * left).sum()) else idle + 1
        if idle > (2 if whole else 9):
            break
    out.left = left
    return out


def best_fit(lengths: np.ndarray, left: np.ndarray, free: dict[int, list[list]], capacity: int) -> int:
    """Puts what is left, longest first, into the tightest free space or a new sequence; ``free`` (space ->
    [filling, number]) is changed.  Returns the number of sequences."""
    left, counts = left.copy(), np.zeros(capacity + 1, np.int64)
    for f, group in free.items():
        counts[f] = sum(n for _, n in group)
    for j in range(len(lengths) - 1, -1, -1):
        size = int(lengths[j])
        while left[j]:
            fits = np.flatnonzero(counts[size:])
            if not len(fits):
                per = min(capacity // size, int(left[j]))
                n = int(left[j]) // per
                free.setdefault(capacity - per * size, []).append([{j: per}, n])
                counts[capacity - per * size] += n
                left[j] -= per * n
                continue
            f = size + int(fits[0])
            group = free[f]
            old, n = group.pop()
            m = min(n, int(left[j]))
            if n > m:
                group.append([old, n - m])
            new = dict(old)
            new[j] = new.get(j, 0) + 1
            free.setdefault(f - size, []).append([new, m])
            counts[f] -= m
            counts[f - size] += m
            left[j] -= m
    return int(counts.sum())


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(filling as length -> times, number of sequences filled so)], exactly covering the histogram.

    Where few lengths fit together (no short ones), full fillings early leave the long lengths without
    partners.  The bound shows it: if the packing is more than ``GAP`` above it and best fit over the
    whole histogram needs fewer sequences, that packing is taken."""
    packed: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        packed.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    if not len(lengths):
        return packed
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    left, used = demand.copy(), lambda key: sum(int(lengths[i]) * a for i, a in key)
    free: dict[int, list[list]] = {}          # free space -> [filling, number]

    def keep(times: dict[tuple, float]) -> None:
        for key, x in sorted(times.items(), key=lambda kx: (-used(kx[0]), -kx[1], kx[0])):
            n = min([int(x + 1e-9), *(int(left[i]) // a for i, a in key)])
            if n > 0:
                for i, a in key:
                    left[i] -= a * n
                free.setdefault(capacity - used(key), []).append([dict(key), n])

    program = cover(lengths, left, capacity)
    keep(program.times)
    rest = np.flatnonzero(left)
    if len(rest):
        more = cover(lengths[rest], left[rest], capacity, whole=True).times
        keep({tuple((int(rest[i]), a) for i, a in key): x for key, x in more.items()})
    number = best_fit(lengths, left, free, capacity)
    if number > (1 + GAP) * program.bound + 1:
        plain: dict[int, list[list]] = {}
        if best_fit(lengths, demand, plain, capacity) < number:
            free = plain
    merged: dict[tuple, int] = {}
    for group in free.values():
        for key, n in group:
            flat = tuple(sorted(((int(lengths[i]), a) for i, a in key.items()), reverse=True))
            merged[flat] = merged.get(flat, 0) + n
    packed += [(dict(k), n) for k, n in sorted(merged.items(), reverse=True) if n]
    return packed
