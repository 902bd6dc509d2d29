"""Edge cases and invariants of the operators, mostly against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import backtest, ewm, features, joins, labels, market, series, signals, splits, summaries
from tidemark.operators import ledger as book
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, interval string, segment string, open_time timestamp, open double, high double, low double, close double, volume double, taker_buy_base_vol double"


def make_bars(spark, n=120, symbols=("A", "B"), seed=1, **fixed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        price = 100 + np.cumsum(rng.normal(0, 1, n))
        for i in range(n):
            c = float(price[i])
            row = dict(symbol=s, interval="15m", segment="all", open_time=START + dt.timedelta(minutes=15 * i), open=c - 0.1, high=c + float(rng.random()), low=c - float(rng.random()), close=c, volume=float(rng.integers(1, 50)), taker_buy_base_vol=float(rng.integers(0, 20)))
            rows.append(tuple((row | {k: v(i) if callable(v) else v for k, v in fixed.items()}).values()))
    return spark.createDataFrame(rows, BAR)


def pandas_of(df, sort=("symbol", "open_time")):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_strength_and_range_equal_pandas(spark):
    bars = make_bars(spark)
    got = pandas_of(features.add_features(bars, fill=False))
    for _, g in got.groupby("symbol"):
        d = g["close"].diff()
        gain, loss = d.clip(lower=0).ewm(com=13, adjust=False).mean(), (-d).clip(lower=0).ewm(com=13, adjust=False).mean()
        want = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50)
        np.testing.assert_allclose(g["rsi"], want, rtol=1e-9)
        before = g["close"].shift(1)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - before).abs(), (g["low"] - before).abs()], axis=1).max(axis=1)
        np.testing.assert_allclose(g["atr"], tr.ewm(span=14, adjust=False).mean(), rtol=1e-9)
        np.testing.assert_allclose(g["bb_high"].iloc[19:], (g["close"].rolling(20).mean() + 2 * g["close"].rolling(20).std()).iloc[19:], rtol=1e-9)
        assert g["bb_high"].iloc[:19].isna().all()


def test_first_true_range_is_high_minus_low(spark):
    got = pandas_of(features.atr(make_bars(spark, 3, ("A",))))
    assert got["atr"][0] == pytest.approx(got["high"][0] - got["low"][0])


@pytest.mark.parametrize("n", [1, 19, 20, 99])
def test_short_and_flat_series_have_no_missing_features(spark, n):
    flat = make_bars(spark, n, ("A",), open=5.0, high=5.0, low=5.0, close=5.0, volume=0.0, taker_buy_base_vol=None)
    got = features.add_features(flat).toPandas()
    made = [c for c in got.columns if c not in features.RAW]
    assert not got[made].isna().any().any() and np.isfinite(got[made].to_numpy(float)).all()
    assert (got["taker_buy_ratio"] == 0.5).all() and (got["rsi"] == 50).all()


def test_rising_closes_have_strength_50(spark):
    got = features.rsi(make_bars(spark, 30, ("A",), close=lambda i: 10.0 + i)).toPandas()
    assert (got["rsi"] == 50).all()


def test_regimes_are_one_hot(spark):
    got = features.add_features(make_bars(spark, 200)).toPandas()
    assert (got[[c for c in got.columns if c.startswith("regime_")]].sum(axis=1) == 1).all()


def test_average_with_missing_values_equals_pandas_and_blocks_equal_one_shot(spark):
    rng = np.random.default_rng(3)
    x = [None if rng.random() < 0.3 else float(rng.normal()) for _ in range(101)]
    x[:3] = [None] * 3
    df = spark.createDataFrame([("A", START + dt.timedelta(minutes=i), v) for i, v in enumerate(x)], "symbol string, open_time timestamp, x double")
    specs = [ewm.Ewm.span("y", "x", 5), ewm.Ewm.com("z", "x", 13)]
    want = pd.Series(x, dtype=float).ewm(span=5, adjust=False).mean()
    for rows in (None, 7, 10, 200):
        got = ewm.ewm(df, specs, ("symbol",), block_rows=rows).toPandas().sort_values("open_time")
        np.testing.assert_allclose(got["y"], want, rtol=1e-12)


def test_results_do_not_depend_on_partitions(spark):
    bars = make_bars(spark)
    a = pandas_of(features.add_features(bars.coalesce(1)))
    b = pandas_of(features.add_features(bars.repartition(8)))
    pd.testing.assert_frame_equal(a, b)


def test_features_share_one_shuffle_per_pass(spark):
    df = features.add_features(make_bars(spark).repartition(3, *series.SERIES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # one per pass of averages, one for the windows


def test_asof_takes_equal_times_and_defaults_before_the_first(spark):
    left = spark.createDataFrame([("A", "all", START + dt.timedelta(hours=h), float(h)) for h in range(5)], "symbol string, segment string, open_time timestamp, close double")
    right = spark.createDataFrame([("A", "all", START + dt.timedelta(hours=2), 7.0), ("A", "all", START + dt.timedelta(hours=4), None)], "symbol string, segment string, open_time timestamp, rsi double")
    got = joins.asof_join(left, right, {"rsi": "r"}, ("symbol", "segment"), {"r": 50.0}).toPandas().sort_values("open_time")
    assert got["r"].tolist() == [50.0, 50.0, 7.0, 7.0, 50.0]
    few = joins.asof_join(left, right, {"rsi": "r"}, ("symbol", "segment"), {"r": 50.0}, least_rows=5).toPandas()
    assert (few["r"] == 50).all()


def test_barrier_label_needs_target_and_no_stop(spark):
    base = dict(open=100.0, close=100.0, low=99.5)
    up = make_bars(spark, 30, ("A",), high=lambda i: 200.0 if i == 10 else 100.5, **base).withColumn("atr", F.lit(1.0))
    got = pandas_of(labels.make_targets(up))
    assert len(got) == 6 and (got["target"] == "BUY").all()
    both = make_bars(spark, 30, ("A",), high=lambda i: 200.0 if i == 10 else 100.5, open=100.0, close=100.0, low=lambda i: 1.0 if i == 10 else 99.5).withColumn("atr", F.lit(1.0))
    assert (labels.make_targets(both).toPandas()["target"] == "NO_TRADE").all()


def test_first_touch_prefers_the_target_and_exit_the_stop_on_a_tie(spark):
    tie = make_bars(spark, 120, ("A",), open=100.0, close=100.0, high=lambda i: 102.0 if i == 3 else 100.1, low=lambda i: 98.9 if i == 3 else 99.95)
    tie = tie.withColumns({"atr": F.lit(1.0), "adx": F.lit(30.0)})
    got = pandas_of(labels.first_touch_targets(tie))
    assert got["target"][2] == "BUY" and got["target"][5] == "NO_TRADE"
    trades = tie.withColumns({"signal": F.lit("BUY"), "confidence": F.lit(60.0)})
    wide = trades.withColumn("high", F.when(F.col("high") > 101, 110.0).otherwise(F.col("high"))).withColumn("low", F.when(F.col("low") < 99, 90.0).otherwise(F.col("low")))
    out = backtest.simulate_exits(wide).toPandas().sort_values("entry_time").reset_index(drop=True)
    assert out["outcome"][0] == "SL" and out["outcome"].iloc[-1] == "TIME_EXIT" and len(out) == 96


def test_split_parts_are_disjoint_with_gaps(spark):
    ds = make_bars(spark, 300, ("A",)).withColumn("regime", F.lit("r")).unionByName(make_bars(spark, 40, ("A",)).withColumn("regime", F.lit("small")))
    got = splits.embargo_split(ds).toPandas()
    big = got[got["regime"] == "r"].sort_values("open_time")
    ends = {p: (g["open_time"].min(), g["open_time"].max()) for p, g in big.groupby("part")}
    gap = dt.timedelta(minutes=15 * 25)
    assert ends["calib"][0] - ends["train"][1] >= gap and ends["test"][0] - ends["calib"][1] >= gap
    assert set(got[got["regime"] == "small"]["part"]) == {"train"}
    by_bar = splits.embargo_split(make_bars(spark, 300).withColumn("regime", F.lit("r")), unit="bars").toPandas()
    per = by_bar.groupby("part")["open_time"].agg(["min", "max"])
    assert per.loc["calib", "min"] - per.loc["train", "max"] >= gap


def test_undersample_is_exact_and_repeatable(spark):
    ds = spark.createDataFrame([(i, "NO_TRADE" if i % 4 else "BUY") for i in range(400)], "id long, target string")
    one = splits.undersample(ds, F.col("id")).toPandas()
    assert one["target"].value_counts().to_dict() == {"NO_TRADE": 100, "BUY": 100}
    two = splits.undersample(ds.repartition(7), F.col("id")).toPandas()
    assert set(one["id"]) == set(two["id"])


def test_cap_is_never_exceeded_and_a_close_frees_its_place(spark):
    t = lambda m: START + dt.timedelta(minutes=m)
    rows = [("r", f"s{i:02d}", t(i), t(i + 5)) for i in range(40)]
    got = backtest.admit(spark.createDataFrame(rows, "run_id string, symbol string, entry_time timestamp, exit_time timestamp"), most=2).toPandas()
    for at in got["entry_time"]:
        assert ((got["entry_time"] <= at) & (got["exit_time"] > at)).sum() <= 2
    assert set(got["entry_time"]) >= {t(0), t(1), t(5), t(6)}


def test_equity_compounds_and_ruin_stays(spark):
    t = lambda m: START + dt.timedelta(minutes=m)
    rows = [("r", "s", t(i), t(i + 1), r) for i, r in enumerate((0.1, -0.05, -1.5, 0.3))]
    got = backtest.equity_curve(spark.createDataFrame(rows, "run_id string, symbol string, entry_time timestamp, exit_time timestamp, ret double"), 100.0).toPandas().sort_values("exit_time")
    np.testing.assert_allclose(got["equity"], [110.0, 104.5, 0.0, 0.0])


def test_leverage_is_capped(spark):
    df = spark.createDataFrame([("BUY", 100.0, 99.99, 100.1), ("SELL", 100.0, 110.0, 90.0)], "signal string, entry double, stop double, exit_price double")
    got = backtest.trade_returns(df).toPandas()
    assert got["notional"].tolist() == [10.0, pytest.approx(0.1)] and got["capped"].tolist() == [True, False]


def test_lots_add_up_and_bad_ticks_are_not_believed(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (5.0, 2.0), (7.0, 0.5)], "q double, step double")
    a, b = signals.split_amount(F.col("q"), F.col("step"))
    got = df.select("q", (a + b).alias("s"), b.alias("b")).toPandas()
    assert (got["q"] == got["s"]).all()
    one = spark.range(1).select(signals.round_price(F.lit(0.163), F.lit(1.0), F.lit(0.001)).alias("p"), signals.round_price(F.lit(-1.0), F.lit(1.0), F.lit(1.0)).alias("z"))
    assert one.first()["p"] == pytest.approx(0.163) and one.first()["z"] == 0


def test_empty_books_are_untradeable(spark):
    df = spark.createDataFrame([([], [[1.0, 1.0]]), ([[100.0, 1.0]], [[100.1, 1.0]])], "bids array<array<double>>, asks array<array<double>>")
    assert [(r["spread_pct"] == 999, r["tradeable"]) for r in market.book_spread(df).collect()] == [(True, False), (False, True)]


def test_words_may_be_parts_or_whole(spark):
    df = spark.createDataFrame([("Toward a RALLY, rally",), (None,)], "t string")
    got = df.select(scalars.title_score("t", ["rally"], ["war"]).alias("a"), scalars.title_score("t", ["rally"], ["war"], True).alias("b"), scalars.page_score("t", ["rally"], ["war"]).alias("c")).collect()
    assert tuple(got[0]) == (0, 1, 1) and tuple(got[1]) == (None, None, None)


def test_signal_filters_name_the_first_reason(spark):
    base = dict(symbol="X", signal="BUY", confidence=70.0, adx=30.0, rsi=40.0, ema20=2.0, ema50=1.0, ema20_1h=2.0, ema50_1h=1.0, ema20_4h=2.0, ema50_4h=1.0, rsi_4h=50.0, trend_bars=5, btc_bias="BUY", btc_score_mod=1, flow_bias="SELL", flow_score_mod=1, fg_bias=None, fg_score_mod=0, fg_blocks_buy=False, fg_blocks_sell=False, vol_prev=20.0, vol_mean_prev=10.0, min_confidence=50, min_adx=15, min_score=3, close=10.0, atr=1.0)
    rows = [base, base | {"confidence": 10.0}, base | {"fg_blocks_buy": True}, base | {"adx": 1.0}, base | {"ema20_4h": 0.5}, base | {"trend_bars": 0}, base | {"vol_prev": 1.0}, base | {"min_score": 99}, base | {"atr": 0.0}]
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in base.items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = signals.filter_signals(signals.score_signals(df)).toPandas()
    assert got["reject_reason"].fillna("").tolist() == ["", "confidence", "sentiment", "adx", "4h bias", "4h fresh", "volume", "score", "price"]
    assert got["score"][0] == 8


def test_fear_greed_bounds(spark):
    got = market.classify_fear_greed(spark.createDataFrame([(v,) for v in (19, 20, 25, 26, 70, 75, 81)], "value int")).toPandas()
    assert got["fg_bias"].fillna("").tolist() == ["BUY", "BUY", "BUY", "", "", "SELL", "SELL"]
    assert got["trade_ok"].tolist() == [False, False, False, True, True, False, False]


def test_ledger_reports_on_empty_and_recovered_rows(spark):
    schema = "symbol string, signal string, pnl double, opened_at timestamp, closed_at timestamp, close_reason string"
    empty = spark.createDataFrame([], schema)
    assert book.performance(empty).first()["trades"] == 0
    some = spark.createDataFrame([("A", "RECOVERED", 5.0, START, START, "x"), ("A", "BUY", None, START, None, "x"), ("A", "BUY", 2.0, START, START, "TP2 hit")], schema)
    row = book.performance(some).first()
    assert (row["trades"], row["wins"], row["profit_factor"]) == (2, 1, 0.0)


def test_cooldown_and_its_end(spark):
    t = lambda h: START + dt.timedelta(hours=h)
    ledger = spark.createDataFrame([("A", -1.0, t(0), "SL hit"), ("B", -1.0, t(0), "SL hit"), ("B", 5.0, t(0.5), "TP2 hit")], "symbol string, pnl double, closed_at timestamp, close_reason string")
    asked = spark.createDataFrame([(1, "A", t(1)), (2, "A", t(2)), (3, "B", t(1)), (4, "C", t(1))], "id int, symbol string, ts timestamp")
    assert sorted(r["id"] for r in book.drop_on_cooldown(asked, ledger).collect()) == [2, 3, 4]


def test_reports_zero_on_nothing_called(spark):
    pred = spark.createDataFrame([("BUY", "NO_TRADE"), ("NO_TRADE", "NO_TRADE")], "target string, call string")
    got = {r["class"]: r for r in summaries.classification_report(pred).collect()}
    assert got["BUY"]["precision"] == 0 and got["NO_TRADE"]["recall"] == 1 and got["BUY"]["accuracy"] == 0.5


def test_sweep_defaults_when_nothing_pays(spark):
    pred = spark.createDataFrame([("SELL", [0.9, 0.05, 0.05])], "target string, probs array<double>")
    assert summaries.best_threshold(summaries.threshold_sweep(pred), 0.45) == 0.45


def test_late_ticks_are_dropped_by_the_stream(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, qty double, is_taker_buy boolean"
    t = lambda m: START + dt.timedelta(minutes=m)
    for k, rows in enumerate([[("A", t(1), 1.0, 1.0, True), ("A", t(40), 2.0, 1.0, True)], [("A", t(2), 9.0, 1.0, True), ("A", t(90), 3.0, 1.0, True)], [("A", t(200), 3.0, 1.0, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = jobs.stream_bars(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values("open_time")
    assert got["open"].tolist()[:2] == [1.0, 2.0] and got["high"].tolist()[0] == 1.0


def test_trade_life(spark):
    t = lambda m: START + dt.timedelta(minutes=m)
    trade = [("x", "A", "BUY", 100.0, 95.0, 104.0, 110.0, 2.0, 1.0, 50.0, t(0))]
    trades = spark.createDataFrame(trade, "trade_id string, symbol string, signal string, entry double, stop double, tp1 double, tp2 double, qty double, qty_tp1 double, risk_usd double, opened_at timestamp")
    prices = lambda *ps: spark.createDataFrame([("A", t(i + 1), p) for i, p in enumerate(ps)], "symbol string, ts timestamp, price double")
    events = lambda *ps: [(r["event"], r["qty"]) for r in jobs.trade_lifecycle(trades, prices(*ps)).orderBy("at").collect()]
    assert events(104.0, 110.0) == [("TP1", 1.0), ("TP2", 1.0)]
    assert events(104.0, 100.0) == [("TP1", 1.0), ("BREAK-EVEN", 1.0)]
    assert events(106.0, 103.9) == [("TP1", 1.0), ("STOPPED OUT", 1.0)]
    assert events(94.0) == [("STOPPED OUT", 2.0)]
    assert events(10.0) == [("MAE", 2.0)]


def test_gate_blocks_repeats_and_cooldowns(spark, tmp_path):
    t = lambda m: START + dt.timedelta(minutes=m)
    rows = [("A", "BUY", t(0), False), ("A", "BUY", t(1), False), ("A", "", t(2), True), ("A", "SELL", t(3), False), ("A", "SELL", t(200), False), ("B", "BUY", t(300), False)]  # B moves the watermark past A
    df = spark.createDataFrame(rows, "symbol string, signal string, at timestamp, lost boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = jobs.signal_gate(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("symbol = 'A'").orderBy("at").collect()
    assert [(r["allowed"], r["reason"]) for r in got] == [(True, None), (False, "same"), (False, "cooldown"), (True, None)]


def test_sources_round_trip(spark, tmp_path):
    from tidemark.sources import bars as source
    from tidemark.sources import ledger as trades

    bars = make_bars(spark, 5, ("A",))
    source.write_bars(bars, f"{tmp_path}/bars")
    assert source.read_bars(spark, f"{tmp_path}/bars").count() == 5
    (tmp_path / "trades.json").write_text('{"AUSDT": {"symbol": "AUSDT", "qty": 3, "order_ids": {"tp1": "7"}, "reasons": ["a"]}}')
    row = trades.read_open_trades(spark, f"{tmp_path}/trades.json").first()
    assert row["qty"] == 3.0 and row["order_ids"] == {"tp1": "7"}
    (tmp_path / "ledger.json").write_text('[{"symbol": "A", "pnl": 1, "closed_at": "2024-01-01T00:00:00+00:00"}, {"symbol": "B", "closed_at": "bad"}]')
    got = trades.read_ledger(spark, f"{tmp_path}/ledger.json").orderBy("symbol").collect()
    assert got[0]["closed_at"] == START and got[1]["closed_at"] is None
    trades.append(bars, f"{tmp_path}/more")
    trades.append(bars, f"{tmp_path}/more")
    assert spark.read.parquet(f"{tmp_path}/more").count() == 10
    trades.write_report(book.performance(spark.createDataFrame([], "signal string, pnl double")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first()["trades"] == 0
