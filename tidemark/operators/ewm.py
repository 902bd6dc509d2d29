"""Exponential moving averages: y = (1 - a) y + a x from the first value on.

A missing x keeps y while the weight of the past decays on. One pass computes all averages of a series. A
series too long for a task is cut into blocks: each block is an affine map of the y that enters it, the maps of
a series are composed in order from one small row per block, and the blocks run again with their own y.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.series import SERIES, TIME
from tidemark.operators.stretches import in_blocks


@dataclass(frozen=True)
class Ewm:
    """``name`` is the average of column ``source`` with smoothing factor ``alpha``."""

    name: str
    source: str
    alpha: float

    @classmethod
    def span(cls, name: str, source: str, span: float) -> Ewm:
        return cls(name, source, 2 / (span + 1))

    @classmethod
    def com(cls, name: str, source: str, com: float) -> Ewm:
        return cls(name, source, 1 / (1 + com))


def _schema(df: DataFrame, specs: Sequence[Ewm]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{s.name}` double" for s in specs])


def ewm(df: DataFrame, specs: Sequence[Ewm], by: Sequence[str] = SERIES, time: str = TIME, block_rows: int | None = None) -> DataFrame:
    """``df`` with a column per average. ``block_rows`` cuts long series."""
    if block_rows:
        return ewm_blocks(in_blocks(df, block_rows, by, time), specs, by, time).drop("_block", "_row")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time, kind="stable")
        for s in specs:
            group[s.name] = group[s.source].ewm(alpha=s.alpha, adjust=False).mean()
        return group

    return df.groupBy(*by).applyInPandas(run, _schema(df, specs))


def advance(x: np.ndarray, alpha: float, y: float, weight: float) -> np.ndarray:
    """Averages of x after a state: y, NaN before any value, and the weight of the past, less than 1 after missing values."""
    at = np.flatnonzero(~np.isnan(x))
    if np.isnan(y) or not len(at):
        return np.full(len(x), y) if not len(at) else pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    first = int(at[0])
    out = np.full(len(x), y)
    old = weight * (1 - alpha) ** (first + 1)
    rest = x[first:].copy()
    rest[0] = (old * y + alpha * x[first]) / (old + alpha)
    out[first:] = pd.Series(rest).ewm(alpha=alpha, adjust=False).mean()
    return out


def affine(x: np.ndarray, alpha: float) -> tuple[float, float, float, int, int]:
    """(first value, factor, shift, missing before it, missing after the last): last y = factor * y1 + shift."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return np.nan, 1.0, 0.0, len(x), 0
    old = (1 - alpha) ** np.diff(at)
    factor = float(np.prod(old / (old + alpha)))
    rest = x[at[0] :].copy()
    rest[0] = 0.0
    shift = float(pd.Series(rest).ewm(alpha=alpha, adjust=False).mean().iloc[-1])
    return float(x[at[0]]), factor, shift, int(at[0]), int(len(x) - 1 - at[-1])


def ewm_blocks(df: DataFrame, specs: Sequence[Ewm], by: Sequence[str] = SERIES, time: str = TIME, block: str = "_block") -> DataFrame:
    """The same for series that are cut into blocks: two passes over a block, and between them a row per block and average."""
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by]
    summary = ", ".join([*types, f"{block} long", "k int", "x double", "factor double", "shift double", "before long", "after long"])
    state = ", ".join([*types, f"{block} long", "k int", "y double", "weight double"])

    def summarize(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time, kind="stable")
        rows = [(*key, k, *affine(group[s.source].to_numpy(float), s.alpha)) for k, s in enumerate(specs)]
        return pd.DataFrame(rows, columns=[*by, block, "k", "x", "factor", "shift", "before", "after"])

    def carry(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, part in group.sort_values(block).groupby("k"):
            a, y, weight = specs[k].alpha, np.nan, 1.0
            for b in part.rename(columns={block: "block"}).itertuples():
                rows.append((*key, b.block, k, y, weight))
                if np.isnan(b.x):
                    weight *= (1 - a) ** b.before
                    continue
                old = weight * (1 - a) ** (b.before + 1)
                first = b.x if np.isnan(y) else (old * y + a * b.x) / (old + a)
                y, weight = b.factor * first + b.shift, (1 - a) ** b.after
        return pd.DataFrame(rows, columns=[*by, block, "k", "y", "weight"])

    def apply(key: tuple, group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time, kind="stable")
        for k, s in enumerate(specs):
            at = before[before["k"] == k].iloc[0]
            group[s.name] = advance(group[s.source].to_numpy(float), s.alpha, at["y"], at["weight"])
        return group

    blocks = df.groupBy(*by, block)
    needed = list(dict.fromkeys([*by, block, time, *(s.source for s in specs)]))
    states = df.select(*needed).groupBy(*by, block).applyInPandas(summarize, summary).groupBy(*by).applyInPandas(carry, state)
    return blocks.cogroup(states.groupBy(*by, block)).applyInPandas(apply, _schema(df, specs))
