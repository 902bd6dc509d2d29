"""The live scan as a stream of closed bars: what a scan needs of a symbol is held as state, and no history is read again.

A symbol's state has, for each of its timeframes, the exponential averages, the last bar, and short rings of volumes,
ranges and trend signs. Every new bar of any timeframe gives one row of inputs, from which scoring, filtering,
news, levels and sizing follow as for a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = ("15m", "1h", "4h")  # entry first
VOLUMES, RANGES, RUNS = 21, 14, 6
STATE = "body string"
INPUTS = (
    "symbol string, bars long, us long, open_time_us long, close double, atr double, rsi double, adx double, trend double, ema20 double, ema50 double, ema200 double, "
    "vol_prev double, vol_mean_prev double, range_pct double, ema20_1h double, ema50_1h double, rsi_4h double, ema20_4h double, ema50_4h double, up_bars int, down_bars int"
)
COLUMNS = [c.split()[0] for c in INPUTS.split(", ")]


class Mean:
    """An exponential average, with the weight that its past has left after missing values."""

    def __init__(self, alpha: float):
        self.alpha, self.y, self.weight = alpha, None, 1.0

    def step(self, x: float | None) -> float | None:
        if x is None:
            self.weight *= 1 - self.alpha
        elif self.y is None:
            self.y, self.weight = x, 1.0
        else:
            old = self.weight * (1 - self.alpha)
            self.y, self.weight = (old * self.y + self.alpha * x) / (old + self.alpha), 1.0
        return self.y


class Timeframe:
    """The features of one timeframe that a scan reads, one bar at a time."""

    MEANS = {"ema20": 2 / 21, "ema50": 2 / 51, "ema200": 2 / 201, "gain": 1 / 14, "loss": 1 / 14, "atr": 2 / 15, "up": 2 / 15, "down": 2 / 15, "dx": 2 / 15}

    def __init__(self) -> None:
        self.means = {n: Mean(a) for n, a in self.MEANS.items()}
        self.at, self.bar, self.adx, self.rsi = -1, None, 0.0, 50.0
        self.volumes: list[float] = []
        self.ranges: list[float] = []
        self.signs: list[int] = []  # of EMA20 over EMA50, newest last

    def dump(self) -> list:
        return [[[m.y, m.weight] for m in self.means.values()], self.at, self.bar, self.adx, self.rsi, self.volumes, self.ranges, self.signs]

    @classmethod
    def load(cls, held: list) -> Timeframe:
        out = cls()
        means, out.at, out.bar, out.adx, out.rsi, out.volumes, out.ranges, out.signs = held
        for m, (y, weight) in zip(out.means.values(), means):
            m.y, m.weight = y, weight
        return out

    def step(self, at: int, high: float, low: float, close: float, volume: float) -> bool:
        """Takes a bar that is newer than the last; an older one, or one seen before, changes nothing."""
        if at <= self.at:
            return False
        m = self.means
        span, gain, loss, up, down = high - low, None, None, 0.0, 0.0
        if self.bar:
            h, lo, c = self.bar
            span = max(span, abs(high - c), abs(low - c))
            gain, loss = max(close - c, 0.0), max(c - close, 0.0)
            rise, fall = max(high - h, 0.0), max(lo - low, 0.0)
            up = rise if rise > fall else 0.0
            down = fall if fall > up else 0.0
        for n in ("ema20", "ema50", "ema200"):
            m[n].step(close)
        g, lost, a = m["gain"].step(gain), m["loss"].step(loss), m["atr"].step(span)
        u, d = m["up"].step(up), m["down"].step(down)
        dx = None
        if a:
            u, d = 100 * u / a, 100 * d / a
            dx = 100 * abs(u - d) / (u + d + 1e-10)
        adx = m["dx"].step(dx)
        self.adx = adx if adx is not None else self.adx
        self.rsi = 100 - 100 / (1 + g / lost) if lost else 50.0
        self.at, self.bar = at, [high, low, close]
        self.volumes = [*self.volumes, volume][-VOLUMES:]
        self.ranges = [*self.ranges, span][-RANGES:]
        e20, e50 = m["ema20"].y, m["ema50"].y
        self.signs = [*self.signs, (e20 > e50) - (e20 < e50)][-RUNS:]
        return True

    def run(self, sign: int) -> int:
        """How many bars just before the newest had that sign without a break."""
        n = 0
        for s in reversed(self.signs[:-1]):
            if s != sign:
                break
            n += 1
        return n


def inputs_of(symbol: str, bars: int, us: int, frames: dict[str, Timeframe]) -> tuple:
    """The row of a scan, after the newest bars of all timeframes."""
    own, hour, slow = (frames[i] for i in INTERVALS)
    value = lambda f, n: f.means[n].y if f.bar else None
    before = own.volumes[:-1]
    mean = sum(before[-20:]) / 20 if len(before) >= 20 else None
    plain = 100 * sum(own.ranges) / RANGES / own.bar[2] if len(own.ranges) == RANGES and own.bar[2] else None
    sign = float(own.signs[-1])
    return (
        symbol, bars, us, own.at, own.bar[2], value(own, "atr"), own.rsi, own.adx, sign, *(value(own, n) for n in ("ema20", "ema50", "ema200")),
        before[-1] if before else None, mean, plain, value(hour, "ema20"), value(hour, "ema50"), slow.rsi if slow.bar else None, value(slow, "ema20"), value(slow, "ema50"),
        slow.run(1) if slow.bar else None, slow.run(-1) if slow.bar else None,
    )


def scan_inputs(bars: DataFrame) -> DataFrame:
    """A stream of closed bars (symbol, interval, open_time, closed_at, high, low, close, volume) to rows of inputs.

    A symbol's bars are taken in order of their close, slower timeframes last, within a micro-batch; a bar older than
    one of its timeframe that was seen is passed over, so a repeated batch adds nothing. ``bars`` numbers the rows of a
    symbol; its newest has the most.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def scan(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = json.loads(state.get[0]) if state.exists else (0, [])
        frames = {i: Timeframe.load(h) for i, h in zip(INTERVALS, held)} if held else {i: Timeframe() for i in INTERVALS}
        rows = []
        for b in pd.concat(list(parts)).sort_values(["closed_us", "rank"], kind="stable").itertuples():
            if frames[b.interval].step(b.open_us, b.high, b.low, b.close, b.volume) and frames[INTERVALS[0]].bar:
                n += 1
                rows.append(inputs_of(key[0], n, b.closed_us, frames))
        state.update((json.dumps([n, [frames[i].dump() for i in INTERVALS]]),))
        yield pd.DataFrame(rows, columns=COLUMNS)

    rank = F.array_position(F.array(*[F.lit(i) for i in INTERVALS]), F.col("interval"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = bars.where(rank > 0).select("symbol", "interval", rank.alias("rank"), micros("open_time").alias("open_us"), micros("closed_at").alias("closed_us"), "high", "low", "close", "volume")
    out = timed.groupBy("symbol").applyInPandasWithState(scan, INPUTS, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("open_time", F.timestamp_micros("open_time_us")).drop("open_time_us", "us")
