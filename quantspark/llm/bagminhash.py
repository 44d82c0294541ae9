"""BagMinHash signatures of multisets (Ertl, "BagMinHash - Minwise Hashing Algorithm for Weighted Sets", 2018).

Each element of a bag owns a Poisson process on (time x weight) with unit intensity, seeded by the element alone. A
point of it below the element's weight throws its time at one of ``m`` signature places, chosen by the point; a place
keeps the earliest point. Two bags agree in a place with the probability of their weighted Jaccard similarity.

Weights are counts, discretised dyadically: [0, 1), [1, 2), [2, 4), [4, 8), ... Each interval is a process of its own
with the interval's length as its rate, so a count of c costs about log2(c) processes instead of c; points of the
last interval that lie above the count are thinned out. Points are drawn in order of time and only until each place
of a bag is taken, so a long text costs about one draw for each element and not one for each element and place.
"""

from __future__ import annotations

import numpy as np

from quantspark.llm.words import mix

_U = np.uint64
_STEP, _LEVEL = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def bags(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) pairs with their counts."""
    _, at, n = np.unique(keys ^ mix(owner.astype(np.uint64)), return_index=True, return_counts=True)
    return keys[at], owner[at], n


def _processes(keys: np.ndarray, owner: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each interval of an element's weight: seed, owner, interval's low end and length, count."""
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1
    at = np.repeat(np.arange(len(keys)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, np.exp2(np.maximum(level - 1, 0)), 0.0)
    with np.errstate(over="ignore"):
        seed = mix(keys[at] + level.astype(np.uint64) * _LEVEL)
    return seed, owner[at], low, np.maximum(low, 1.0), count[at].astype(np.float64)


def _unit(bits: np.ndarray) -> np.ndarray:
    return ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(keys: np.ndarray, owner: np.ndarray, count: np.ndarray, n_owners: int, m: int) -> np.ndarray:
    """A matrix (n_owners, m) that names the earliest point of each place; rows of owners without elements are 0."""
    names = np.zeros(n_owners * m, np.uint64)
    taken = np.zeros(n_owners * m, bool)
    seed, own, low, rate, weight = _processes(keys, owner, count)
    total = np.bincount(own, rate * 0 + np.minimum(weight - low, rate), n_owners)
    step = np.divide(m * (np.log(m) + 1), total, out=np.zeros(n_owners), where=total > 0)
    until = step.copy()
    time, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    while len(seed):
        got_cell, got_time, got_name = [], [], []
        todo = np.arange(len(seed))
        while len(todo):
            # A few draws ahead for each process, as many as are expected; it is done once one lies beyond the stretch.
            n = np.maximum(1, ((until[own[todo]] - time[todo]) * rate[todo]).astype(np.int64))
            at = np.repeat(todo, n)
            first = np.cumsum(n) - n
            place = np.arange(len(at)) - np.repeat(first, n)
            with np.errstate(over="ignore"):
                name = mix(seed[at] + (drawn[at] + place.astype(np.uint64)) * _STEP)
            gap = -np.log(_unit(name)) / rate[at]
            passed = np.cumsum(gap)
            t = time[at] + passed - np.repeat(passed[first] - gap[first], n)
            ok = t <= until[own[at]]
            inside = np.add.reduceat(ok.astype(np.int64), first)
            some = inside > 0
            time[todo[some]] = t[first[some] + inside[some] - 1]
            drawn[todo] += inside.astype(np.uint64)
            ok &= (rate[at] <= 1) | (low[at] + rate[at] * _unit(mix(name ^ _LEVEL)) < weight[at])
            at, t, name = at[ok], t[ok], name[ok]
            cell = own[at] * m + ((mix(name ^ _STEP) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            free = ~taken[cell]
            got_cell.append(cell[free])
            got_time.append(t[free])
            got_name.append(name[free])
            todo = todo[inside == n]
        cell, t, name = np.concatenate(got_cell), np.concatenate(got_time), np.concatenate(got_name)
        order = np.argsort(t)[::-1]
        names[cell[order]] = name[order]
        taken[cell] = True
        full = taken.reshape(n_owners, m).all(1)
        until += step
        rest = ~full[own]
        seed, own, low, rate, weight, time, drawn = (x[rest] for x in (seed, own, low, rate, weight, time, drawn))
    return names.reshape(n_owners, m)
