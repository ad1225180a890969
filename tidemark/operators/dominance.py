"""Fronts of objective vectors inside one task; objectives are maximised.

Two objectives take one sorted sweep. For more, vectors are met best first and looked up in the fronts found so far by binary
search: a vector that some member of a front dominates is dominated by a member of every earlier front.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

SWEPT = 1024  # vectors compared with the front at once


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors, best first (a dominating vector always precedes), and for each row the place of its own."""
    found, which = np.unique(-values, axis=0, return_inverse=True)
    return -found, which.reshape(-1)


def _beaten(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mask of the vectors that some other one reaches in every objective; vectors of both sides are distinct."""
    out = np.zeros(len(values), dtype=bool)
    for start in range(0, len(others), SWEPT):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        part = others[start : start + SWEPT]
        reached = np.ones((len(left), len(part)), dtype=bool)
        for k in range(values.shape[1]):
            reached &= part[None, :, k] >= values[left, None, k]
        out[left] = reached.any(axis=1)
    return out


def front_mask(values: np.ndarray) -> np.ndarray:
    """Rows that no other row dominates; equal rows do not dominate each other."""
    if len(values) == 0:
        return np.zeros(0, dtype=bool)
    found, which = _distinct(values)
    if values.shape[1] == 1:
        keep = found[:, 0] == found[0, 0]
    elif values.shape[1] == 2:
        best = np.concatenate([[-np.inf], np.maximum.accumulate(found[:-1, 1])])
        keep = found[:, 1] > best
        keep[0] = True  # also where it is minus infinity
    else:
        keep = np.zeros(len(found), dtype=bool)
        front = found[:0]
        for start in range(0, len(found), SWEPT):
            part = found[start : start + SWEPT]
            left = np.flatnonzero(~_beaten(part, front))
            # Inside the part: row i can only be dominated by an earlier one.
            own = part[left]
            reached = np.ones((len(own), len(own)), dtype=bool)
            for k in range(own.shape[1]):
                reached &= own[None, :, k] >= own[:, None, k]
            left = left[~np.tril(reached, -1).any(axis=1)]
            keep[start + left] = True
            front = np.concatenate([front, part[left]])
    return keep[which]


def front_numbers(values: np.ndarray) -> np.ndarray:
    """Front of each row: 0 for those no row dominates, 1 for those left when these are taken away, and so on."""
    if len(values) == 0:
        return np.zeros(0, dtype=np.int32)
    found, which = _distinct(values)
    ranks = np.zeros(len(found), dtype=np.int32)
    if values.shape[1] == 2:
        # Largest second objective of each front so far, negated: ascending, so the first front that does not reach a vector is bisected.
        tails: list[float] = []
        for i, y in enumerate((-found[:, 1]).tolist()):
            at = bisect_right(tails, y)
            ranks[i] = at
            if at == len(tails):
                tails.append(y)
            else:
                tails[at] = y
        return ranks[which]
    fronts: list[np.ndarray] = []
    sizes: list[int] = []
    for i, vector in enumerate(found):
        low, high = 0, len(fronts)
        while low < high:
            middle = (low + high) // 2
            members = fronts[middle][: sizes[middle]]
            if (members >= vector).all(axis=1).any():
                low = middle + 1
            else:
                high = middle
        ranks[i] = low
        if low == len(fronts):
            fronts.append(np.empty((8, found.shape[1])))
            sizes.append(0)
        elif sizes[low] == len(fronts[low]):
            fronts[low] = np.concatenate([fronts[low], np.empty_like(fronts[low])])
        fronts[low][sizes[low]] = vector
        sizes[low] += 1
    return ranks[which]
