"""Fit of rule consequents under sign constraints: a concave search, every step from one pass of sums."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.gain import CONSEQUENTS, NEGATIVE_CHAINS, NEGATIVE_SINGLES, POSITIVE_CHAINS

LN10 = math.log(10.0)
FIXED = ("anchor", "seis_normal")
STEPS = (1.0, 0.5, 0.25, 0.125, 0.03125, 0.0)


@dataclass(frozen=True)
class SignOrder:
    """Order constraints of a fit: very low <= low <= 0, very high >= high >= 0, single low rules <= 0, the others >= 0."""

    names: Sequence[str]
    low: float = -1.0
    high: float = 1.7
    negative_chains: Sequence[tuple[str, str]] = tuple(NEGATIVE_CHAINS)
    negative_singles: Sequence[str] = tuple(NEGATIVE_SINGLES)
    positive_chains: Sequence[tuple[str, str]] = tuple(POSITIVE_CHAINS)

    def chains(self) -> list[list[int]]:
        """Indices of each chain in rising order of value; rules outside any chain stand alone."""
        at = {n: i for i, n in enumerate(self.names)}
        found = [[at[b], at[a]] for a, b in self.negative_chains if a in at and b in at]
        found += [[at[a], at[b]] for a, b in self.positive_chains if a in at and b in at]
        used = {i for c in found for i in c}
        return found + [[i] for i in range(len(self.names)) if i not in used]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        down = {x for c in self.negative_chains for x in c} | set(self.negative_singles)
        lo = np.array([self.low if n in down else 0.0 for n in self.names])
        hi = np.array([0.0 if n in down else self.high for n in self.names])
        return lo, hi

    def project(self, x: np.ndarray) -> np.ndarray:
        """Nearest point that keeps order and signs: pool neighbours of a chain that are out of order, then clip."""
        lo, hi = self.bounds()
        out = x.copy()
        for chain in self.chains():
            pooled: list[list[float]] = []
            for i in chain:
                pooled.append([x[i], 1])
                while len(pooled) > 1 and pooled[-2][0] > pooled[-1][0]:
                    (a, m), (b, n) = pooled[-2:]
                    pooled[-2:] = [[(a * m + b * n) / (m + n), m + n]]
            out[chain] = np.repeat([v for v, _ in pooled], [int(m) for _, m in pooled])
        return np.clip(out, lo, hi)

    def minimise(self, curve: np.ndarray, slope: np.ndarray, start: np.ndarray, rounds: int = 500) -> np.ndarray:
        """Least value of slope'd + d'curve d / 2 around *start*: exact steps along single rules and along tied
        neighbours of a chain together, each kept within its neighbours and bounds, until nothing moves."""
        lo, hi = self.bounds()
        x = self.project(start)
        grad = slope + curve @ (x - start)
        for _ in range(rounds):
            moved = 0.0
            for chain in self.chains():
                groups = [[i] for i in chain] + [chain[a:b] for a in range(len(chain)) for b in range(a + 2, len(chain) + 1) if np.ptp(x[chain[a:b]]) == 0.0]
                for g in groups:
                    if np.ptp(x[g]) > 0.0:
                        continue
                    first, last = chain.index(g[0]), chain.index(g[-1])
                    least = max(lo[g[0]], x[chain[first - 1]] if first else -np.inf)
                    most = min(hi[g[0]], x[chain[last + 1]] if last + 1 < len(chain) else np.inf)
                    bend = curve[np.ix_(g, g)].sum()
                    if bend <= 0:
                        continue
                    step = float(np.clip(x[g[0]] - grad[g].sum() / bend, least, most) - x[g[0]])
                    if step:
                        x[g] = x[g[0]] + step
                        grad = grad + step * curve[:, g].sum(1)
                        moved = max(moved, abs(step))
            if moved < 1e-12:
                break
        return x


def _sums(frame: DataFrame, names: Sequence[str], candidates: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood of each candidate, and slope and curve at the first one: one pass, one small matrix for each task."""
    r = len(names)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates) + r + r * r)
        for batch in batches:
            v = np.stack([np.nan_to_num(batch.column(f"__v{i}").to_numpy(zero_copy_only=False)) for i in range(r)], 1) if batch.num_rows else np.zeros((0, r))
            lam, n = (np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("__lam", "__n"))
            power = v @ candidates.T
            total[:len(candidates)] += LN10 * (n @ power) - lam @ np.exp(LN10 * power)
            rate = lam * np.exp(LN10 * power[:, 0])
            total[len(candidates):len(candidates) + r] += LN10 * ((n - rate) @ v)
            total[len(candidates) + r:] += (LN10 * LN10 * (v * rate[:, None]).T @ v).ravel()
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    rows = frame.mapInArrow(one, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    found = np.zeros(len(candidates) + r + r * r)
    for row in rows:
        found[row["i"]] = row["x"]
    k = len(candidates)
    return found[:k], found[k:k + r], found[k + r:].reshape(r, r)


def fit_consequents(frame: DataFrame, lam: str, n: str, prior: Mapping[str, float] = CONSEQUENTS, fixed: Sequence[str] = FIXED, ridge: float = 2.0,
                    order: SignOrder | None = None, events_per_rule: int = 2, rounds: int = 30, prefix: str = "w_") -> tuple[dict[str, float], dict]:
    """Consequents that maximise the likelihood of refined daily rates, with a ridge to the prior and the sign order kept.

    *frame* has the baseline rate, the number of target events and the strengths of all rules of each entity and
    day. The gain is 10 to the strength-weighted mean consequent, so the objective is concave and its value,
    slope and curvature are sums over the rows. A round takes them in one pass, finds the constrained step on the driver
    (a problem of the number of rules), scores all step lengths in a second pass and keeps the best.
    With fewer than *events_per_rule* events for each free rule the prior is returned as it is.
    """
    names = [c for c in prior if c not in fixed]
    order = order or SignOrder(names)
    weight = sum((F.coalesce(F.col(prefix + c), F.lit(0.0)) for c in prior), F.lit(0.0)) + 1e-9
    rows = frame.filter(F.col(lam) > 0).select(F.col(lam).cast("double").alias("__lam"), F.coalesce(F.col(n), F.lit(0)).cast("double").alias("__n"),
                                               *[(F.coalesce(F.col(prefix + c), F.lit(0.0)) / weight).alias(f"__v{i}") for i, c in enumerate(names)])
    start = np.array([float(prior[c]) for c in names])
    events = rows.agg(F.coalesce(F.sum("__n"), F.lit(0.0))).first()[0]
    info = {"events": int(events), "trained": bool(events >= events_per_rule * len(names)), "rounds": 0}
    if not info["trained"]:
        return dict(prior), info

    def penalty(c):
        return ridge * ((c - start) ** 2).sum(-1)

    x = order.project(start)
    value, slope, curve = _sums(rows, names, x[None, :], prefix)
    value = value[0] - penalty(x)
    for info["rounds"] in range(1, rounds + 1):
        target = order.minimise(curve + 2 * ridge * np.eye(len(x)), -(slope - 2 * ridge * (x - start)), x)
        tried = np.stack([x + a * (target - x) for a in STEPS])
        scored = _sums(rows, names, tried, prefix)[0] - penalty(tried)
        best = int(np.argmax(scored))
        gain, x = scored[best] - value, tried[best]
        if gain <= 1e-9 * max(1.0, abs(value)):
            break
        value, slope, curve = _sums(rows, names, x[None, :], prefix)
        value = value[0] - penalty(x)
    info["objective"] = float(value)
    return {**prior, **dict(zip(names, map(float, x)))}, info
