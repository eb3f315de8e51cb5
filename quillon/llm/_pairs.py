"""Runs of equal keys in sorted batches, union-find within one, and the draws that let pairs meet."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd


class UnionFind:
    """Roots are the least indices."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def runs(batches, key: str):
    """Frames of equal key, from batches sorted by key; a run may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1][key].iloc[-1] != keys[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def whole_runs(batches, key: str, rows: int = 4096):
    """Frames of about rows rows, from batches sorted by key, that never cut a run of equal keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held) if len(held) > 1 else held[0]
        keys = frame[key].to_numpy()
        last = np.flatnonzero(keys != keys[-1])
        end = last[-1] + 1 if len(last) else 0
        if end:
            yield frame.iloc[:end]
        held = [frame.iloc[end:]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def merge_labels(labels: np.ndarray, i: int, js: np.ndarray) -> None:
    """Give i's label to all that share a label with one of js."""
    if len(js):
        labels[np.isin(labels, labels[js])] = labels[i]


@lru_cache(maxsize=64)
def draws_needed(length: int, agree: float, take: int, miss: float) -> int:
    """Draws of take positions out of length, so that two signatures agree throughout some draw but for a probability of miss.

    Positions agree independently, each with probability agree; all draws are from the same ones, so
    the probability is averaged over the number of positions that agree.
    """
    share = np.array([math.comb(length, m) * agree**m * (1 - agree) ** (length - m) for m in range(length + 1)])
    whole = np.array([math.comb(m, take) / math.comb(length, take) for m in range(length + 1)])
    if share[:take].sum() >= miss:
        raise ValueError(f"signatures of {length} positions are too short for an agreement of {agree:g}")
    missed = lambda n: share @ (1 - whole) ** n
    most = 1
    while missed(most) > miss:
        most *= 2
    least = most // 2
    while most - least > 1:
        n = (least + most) // 2
        least, most = (n, most) if missed(n) > miss else (least, n)
    return most
