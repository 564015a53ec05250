"""T-occurrence search over inverted lists by DivideSkip.

The lists of a query's hashes are divided into the longest, at most L of them, and the others. The short lists are merged by a heap; what
occurs in at least T - L of them is looked up in the long lists by binary probes; what reaches T in all is a match.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np

#: Weight of a probe against a step of the merge, in the number of lists that are set apart as long.
PROBE_WEIGHT = 0.0085
#: Probes of long lists that are made at a time; between, ids that can't reach the threshold any more are left out.
PROBES = 4096


def least_overlap(n: int, percent: int) -> int:
    """Least intersection of a set of n with any set that is similar enough."""
    return -(-n * percent // 100)


def t_occurrence(lists: list[np.ndarray], t: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur in at least ``t`` of the lists (each ascending, without repeats), and in how many they occur."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t or not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    apart = min(t - 1, int(t / (PROBE_WEIGHT * math.log(len(lists[-1]) + 1) + 1)))
    cut = len(lists) - apart
    found, counts = [], []
    for own, times in groupby(heapq.merge(*(x.tolist() for x in lists[:cut]))):
        n = sum(1 for _ in times)
        if n >= t - apart:
            found.append(own)
            counts.append(n)
    ids, n = np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)
    if not apart or not len(ids):
        return ids[n >= t], n[n >= t]
    long_ = lists[cut:]
    width = int(max(x[-1] for x in long_)) + 1
    width = max(width, int(ids[-1]) + 1)
    keys = np.concatenate(long_) + np.repeat(np.arange(apart) * width, [len(x) for x in long_])
    done = 0
    while done < apart and len(ids):
        step = min(apart - done, max(1, PROBES // len(ids)))
        probe = (np.arange(done, done + step) * width)[:, None] + ids
        at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        n = n + (keys[at] == probe).sum(axis=0)
        done += step
        stay = n + apart - done >= t
        ids, n = ids[stay], n[stay]
    return ids, n


def search(query: np.ndarray, size: int, members: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets are similar enough to the query. ``size``, ``sizes``: of whole sets; ``query``, ``members``: those of their hashes that other sets may have, ascending."""
    t = least_overlap(size, percent)
    if len(query) < t:
        return np.zeros(0, dtype=np.int64)
    hashes, owner = np.concatenate(members), np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = np.minimum(np.searchsorted(query, hashes), len(query) - 1)
    hit = query[at] == hashes
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")  # owners ascend within a list
    at, owner = at[order], owner[order]
    ends = np.flatnonzero(np.diff(at, append=-1)) + 1
    ids, both = t_occurrence(np.split(owner, ends[:-1]) if len(ends) else [], t)
    return ids[100 * both >= percent * (size + sizes[ids] - both)]
