"""Gradient-boosted trees over yes/no features, fitted on few weighted patterns, scored in SQL.

Fitting sees each distinct pattern of features once, with its weights of both labels, so its
cost hangs on the number of patterns; scoring is a Column of nested conditions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

Pattern = tuple[int, float, float]  # bits, weight of positives, weight of negatives


def sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


@dataclass
class Trees:
    """``trees``: (root feature, feature if set, feature if not, four leaves); then Platt's slope and shift."""

    base: float = 0.0
    trees: list[tuple[int, int, int, tuple[float, float, float, float]]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, bits: int) -> float:
        has = lambda f: bits >> f & 1
        return self.base + sum(v[0 if has(a) else 1] if has(r) else v[2 if has(b) else 3] for r, a, b, v in self.trees)

    def probability(self, bits: int) -> float:
        return sigmoid(self.slope * self.margin(bits) + self.shift)

    def score(self, bits: Column) -> Column:
        """The calibrated probability as a Column of a pattern's bits."""
        has = lambda f: bits.bitwiseAND(F.lit(1 << f)) != 0
        total = F.lit(self.base)
        for r, a, b, v in self.trees:
            total = total + F.when(has(r), F.when(has(a), v[0]).otherwise(v[1])).otherwise(F.when(has(b), v[2]).otherwise(v[3]))
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def _split(rows: list[tuple[int, float, float]], features: int, l2: float) -> tuple[int, float, float, float]:
    """The feature that splits gradients best, its gain, and the leaf values where set and not."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (0, -1.0, 0.0, 0.0)
    for f in range(features):
        gs = hs = 0.0
        for bits, gi, hi in rows:
            if bits >> f & 1:
                gs, hs = gs + gi, hs + hi
        gain = gs * gs / (hs + l2) + (g - gs) ** 2 / (h - hs + l2)
        if gain > best[1] + 1e-12:
            best = (f, gain, gs / (hs + l2), (g - gs) / (h - hs + l2))
    return best


def fit(patterns: list[Pattern], features: int, rounds: int = 30, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Boost trees of depth two on logistic loss."""
    pos, neg = sum(p[1] for p in patterns), sum(p[2] for p in patterns)
    model = Trees(base=log((pos + 1) / (neg + 1)))
    margins = [model.base] * len(patterns)
    for _ in range(rounds):
        rows = []
        for (bits, p, n), m in zip(patterns, margins):
            q = sigmoid(m)
            rows.append((bits, p - (p + n) * q, (p + n) * q * (1 - q)))
        root = _split(rows, features, l2)[0]
        yes, no = [r for r in rows if r[0] >> root & 1], [r for r in rows if not r[0] >> root & 1]
        a, b = _split(yes, features, l2), _split(no, features, l2)
        model.trees.append((root, a[0], b[0], tuple(rate * x for x in (a[2], a[3], b[2], b[3]))))
        margins = [model.margin(bits) for bits, _, _ in patterns]
    return model


def calibrate(model: Trees, held: list[Pattern], precision: float) -> float:
    """Fit Platt's slope and shift on held-out patterns; return the least threshold (0.5 or more)
    at which the held-out precision reaches ``precision`` (1.0 if none does)."""
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for bits, p, n in held:
            m = model.margin(bits)
            q = sigmoid(model.slope * m + model.shift)
            d, w = p - (p + n) * q, (p + n) * q * (1 - q)
            ga, gb, haa, hab, hbb = ga + d * m, gb + d, haa + w * m * m, hab + w * m, hbb + w
        haa, hbb = haa + 1e-2, hbb + 1e-2
        ga, gb = ga - 1e-2 * (model.slope - 1), gb - 1e-2 * model.shift
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        model.slope += max(-1.0, min(1.0, (hbb * ga - hab * gb) / det))
        model.shift += max(-1.0, min(1.0, (haa * gb - hab * ga) / det))
    ranked = sorted(((model.probability(bits), p, n) for bits, p, n in held), reverse=True)
    best, pos, neg = 1.0, 0.0, 0.0
    for i, (q, p, n) in enumerate(ranked):
        pos, neg = pos + p, neg + n
        last_of_tie = i + 1 == len(ranked) or ranked[i + 1][0] < q
        if last_of_tie and q >= 0.5 and pos and pos / (pos + neg) >= precision:
            best = q
    return best
