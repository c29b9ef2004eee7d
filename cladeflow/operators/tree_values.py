"""Single trees as values: what a row of `snapshots` holds, and the distance of two of them."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from cladeflow.operators.splits import root_children, snapshots


@dataclass(frozen=True)
class TreeSnapshot:
    """Sorted leaf sets (ranks) with their lengths; equal sets may repeat in a rooted tree."""

    parts: tuple[tuple[int, ...], ...]
    lengths: tuple[float, ...]
    num_leaves: int
    rooted: bool = False
    root_children: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def from_row(cls, row: Row, children: tuple = ()) -> TreeSnapshot:
        return cls(tuple(tuple(p.split) for p in row.parts), tuple(p.length for p in row.parts), row.n, row.rooted, children)

    @classmethod
    def from_tree(cls, tree: DataFrame, rooted: bool = False, use_map: bool = False) -> TreeSnapshot:
        """The snapshot of a frame with one tree."""
        below = root_children(tree, use_map).first()
        return cls.from_row(snapshots(tree, rooted, use_map).first(), tuple(tuple(c) for c in below.children) if below else ())

    def numbered(self) -> dict[tuple[tuple[int, ...], int], float]:
        """Lengths by set and number among equal sets."""
        seen: dict[tuple[int, ...], int] = defaultdict(int)
        out = {}
        for s, x in zip(self.parts, self.lengths, strict=True):
            seen[s] += 1
            out[s, seen[s]] = x
        return out


def rf_from_snapshots(a: TreeSnapshot, b: TreeSnapshot) -> int:
    return len(a.numbered().keys() ^ b.numbered().keys())


def weighted_rf_from_snapshots(a: TreeSnapshot, b: TreeSnapshot) -> float:
    x, y = a.numbered(), b.numbered()
    return math.fsum(abs(x[k] - y[k]) if k in x and k in y else x.get(k, 0.0) + y.get(k, 0.0) for k in x.keys() | y.keys())


def kf_from_snapshots(a: TreeSnapshot, b: TreeSnapshot) -> float:
    x, y = a.numbered(), b.numbered()
    return math.sqrt(math.fsum((x.get(k, 0.0) - y.get(k, 0.0)) ** 2 for k in x.keys() | y.keys()))
