"""Series in blocks, as-of joins by stretches of time, runs in slices, and streams out of order."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import START, make_bars, pandas_of

from tidemark.operators import backtest, ewm, features, joins, labels, market, ml, series, splits, stretches
from tidemark.operators import ledger as book
from tidemark.sources import ledger as ledgers
from tidemark.streaming import jobs
from tidemark.streaming.scan import Mean, Timeframe

MINUTE = dt.timedelta(minutes=1)


def test_buckets_are_even_when_one_day_holds_most_rows(spark):
    rng = np.random.default_rng(3)
    day = [START + dt.timedelta(seconds=float(x)) for x in rng.uniform(0, 86_400, 20_000)]
    rest = [START + dt.timedelta(days=int(d)) for d in rng.integers(1, 300, 500)]
    rows = [("big", "r", t) for t in day + rest] + [("small", "r", START)] * 3 + [(None, "r", START)]
    df = spark.createDataFrame(rows, "symbol string, regime string, open_time timestamp")
    sizes = stretches.equal_depth(df, ["symbol"], "open_time", 1000).groupBy("symbol", "_bucket").count().toPandas()
    assert sizes["count"].max() <= 1500 and len(sizes) >= 18
    got = stretches.numbered(df, ["symbol"], ["open_time"], rows=1000).toPandas()
    big = got[got["symbol"] == "big"].sort_values(["open_time", "row_no"])
    assert big["row_no"].tolist() == list(range(20_500)) and set(big["rows_in"]) == {20_500}
    assert sorted(got[got["symbol"].isna()]["row_no"]) == [0]
    few = splits.embargo_split(df.where("symbol = 'big'"), order=("open_time",), bucket_rows=500).groupBy("part").count()
    many = splits.embargo_split(df.where("symbol = 'big'"), order=("open_time",)).groupBy("part").count()
    assert {r["part"]: r["count"] for r in few.collect()} == {r["part"]: r["count"] for r in many.collect()}


@pytest.mark.parametrize("block", [24, 37, 500])
def test_features_in_blocks_equal_features_at_once(spark, block):
    holes = make_bars(spark, 150, ("A", "B"), close=lambda i: None if i % 41 == 7 else 100.0 + (i * 37) % 23, volume=lambda i: float(i % 5))
    whole, parts = pandas_of(features.add_features(holes)), pandas_of(features.add_features(holes, block_rows=block))
    assert sorted(whole.columns) == sorted(parts.columns)
    for c in whole.columns:
        if whole[c].dtype.kind == "f":
            np.testing.assert_allclose(parts[c], whole[c], rtol=1e-7, atol=1e-7, err_msg=c)


def test_no_window_of_blocked_features_is_over_a_whole_series(spark):
    df = features.add_features(make_bars(spark, 60), block_rows=30, fill=False)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if "Window [" in line]
    assert specs and all("_block" in line.split("windowspecdefinition(", 1)[1] for line in specs)
    with pytest.raises(ValueError):
        stretches.with_halo(df, 40, 30)


@pytest.mark.parametrize("seed", range(4))
def test_averages_after_a_state_equal_pandas(seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(200) < 0.4, np.nan, rng.normal(0, 1, 200))
    want = pd.Series(x).ewm(alpha=0.2, adjust=False).mean().to_numpy()
    for cut in (0, 1, 50, 199):
        first, factor, shift, _, after = ewm.affine(x[:cut], 0.2)
        y = factor * first + shift if not np.isnan(first) else np.nan
        np.testing.assert_allclose(ewm.advance(x[cut:], 0.2, y, (1 - 0.2) ** after), want[cut:], equal_nan=True)
    mean = Mean(0.2)
    stepped = [mean.step(None if np.isnan(v) else float(v)) for v in x]
    np.testing.assert_allclose([np.nan if v is None else v for v in stepped], want, equal_nan=True)


def test_asof_carries_a_value_over_empty_days_and_null_times(spark):
    left = spark.createDataFrame([("A", START + d * dt.timedelta(days=1), k) for k, d in enumerate((0, 1, 9, 30))] + [("A", None, 9), (None, START, 10)], "symbol string, open_time timestamp, id int")
    right = spark.createDataFrame([("A", START + dt.timedelta(hours=1), 1.0), ("A", START + dt.timedelta(days=9), 2.0), ("A", START + dt.timedelta(days=9), 3.0), ("B", START, 4.0)], "symbol string, open_time timestamp, v double")
    for every in ("hour", "day", "month", "year"):
        got = {r["id"]: r["w"] for r in joins.asof_join(left, right, {"v": "w"}, ("symbol",), every=every).collect()}
        assert got == {0: None, 1: 1.0, 2: 3.0, 3: 3.0, 9: None, 10: None}
    plan = joins.asof_join(left, right, {"v": "w"}, ("symbol",))._jdf.queryExecution().optimizedPlan().toString()
    assert all("_bucket" in line for line in plan.splitlines() if "Window [" in line)


def test_cooldown_takes_the_loss_of_two_closes_at_one_time(spark):
    ledger = spark.createDataFrame([("A", START, -1.0, "SL hit"), ("A", START, 1.0, "TP2 hit"), ("B", START, 1.0, "TP2 hit")], "symbol string, closed_at timestamp, pnl double, close_reason string")
    asked = spark.createDataFrame([("A", START + 60 * MINUTE), ("A", START + 121 * MINUTE), ("B", START + MINUTE)], "symbol string, ts timestamp")
    assert sorted((r["symbol"], r["ts"].hour) for r in book.drop_on_cooldown(asked, ledger).collect()) == [("A", 2), ("B", 0)]


def brute_admit(rows, most):
    taken, held = [], []
    for start, end, name in sorted(rows, key=lambda r: (r[0], r[2])):
        held = [h for h in held if h > start]
        if len(held) < most:
            held.append(end)
            taken.append((start, end, name))
    return sorted(taken)


@pytest.mark.parametrize("crowd", [3, 60])
def test_cap_in_slices_equals_one_fold(spark, crowd):
    rng = np.random.default_rng(crowd)
    rows = []
    for run in ("x", "y"):
        for k in range(60):
            start = int(rng.integers(0, 2000))
            rows.append((run, f"s{k}", START + start * MINUTE, START + (start + int(rng.integers(1, 4 * crowd))) * MINUTE, "BUY", 100.0, 99.0, float(rng.normal(100, 1))))
    df = spark.createDataFrame(rows, "run_id string, symbol string, entry_time timestamp, exit_time timestamp, signal string, entry double, stop double, exit_price double")
    got = backtest.admit(df, 2, slice_rows=25)
    assert got.columns == df.columns
    for run, part in got.toPandas().groupby("run_id"):
        mine = sorted((r.entry_time.to_pydatetime(), r.exit_time.to_pydatetime(), r.symbol) for r in part.itertuples())
        assert mine == brute_admit([(r[2], r[3], r[1]) for r in rows if r[0] == run], 2)
    keys = ["run_id", "symbol"]
    whole, cut = (pandas_of(backtest.equity_curve(backtest.trade_returns(df), slice_rows=n), keys) for n in (None, 25))
    for c in ("equity", "peak", "drawdown", "pnl"):
        np.testing.assert_allclose(cut[c], whole[c], rtol=1e-9)


@pytest.mark.parametrize("n", [70, 150])
def test_far_touches_equal_a_walk_over_the_bars(spark, n):
    bars = make_bars(spark, 320, ("A", "B"))
    df = features.add_features(bars).withColumns({"signal": F.when(F.minute("open_time") == 0, "BUY").when(F.minute("open_time") == 15, "SELL").otherwise("NO_TRADE"), "confidence": F.lit(60.0)})
    got = pandas_of(backtest.simulate_exits(df, n, 3.0, 6.0), ("symbol", "entry_time"))
    rows = pandas_of(df)
    want = []
    for s, g in rows.groupby("symbol"):
        g = g.reset_index(drop=True)
        for i, r in g.iterrows():
            if r.signal == "NO_TRADE" or i + n >= len(g) or r.atr <= 0:
                continue
            side = 1 if r.signal == "BUY" else -1
            stop, goal = r.close - side * 3 * r.atr, r.close + side * 6 * r.atr
            end = "TIME_EXIT", i + n
            for k in range(i + 1, i + n + 1):
                b = g.iloc[k]
                if (b.low <= stop) if side > 0 else (b.high >= stop):
                    end = "SL", k
                    break
                if (b.high >= goal) if side > 0 else (b.low <= goal):
                    end = "TP1", k
                    break
            want.append((s, r.open_time, end[0], g.open_time[end[1]]))
    assert [(r.symbol, r.entry_time, r.outcome, r.exit_time) for r in got.itertuples()] == want
    near = {(r["symbol"], r["open_time"]): r["target"] for r in labels.first_touch_targets(df, n, 4.0, 2.0).collect()}
    labels.ARRAY_BARS, kept = 1000, labels.ARRAY_BARS
    try:
        assert near == {(r["symbol"], r["open_time"]): r["target"] for r in labels.first_touch_targets(df, n, 4.0, 2.0).collect()}
    finally:
        labels.ARRAY_BARS = kept


def run_stream(spark, made, schema, batches, path):
    """One file per micro-batch, in the order given."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = made(spark.readStream.schema(schema).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_gate_keeps_its_cap_when_a_row_of_yesterday_comes_between(spark, tmp_path):
    schema = "symbol string, signal string, at timestamp, lost boolean"
    at = lambda m: START + dt.timedelta(days=1, minutes=m)
    turns = [("A", "BUY" if k % 2 else "SELL", at(k), False) for k in range(60)]
    late, end = ("A", "BUY", at(-5), False), ("A", "BUY", at(600), False)
    out = run_stream(spark, jobs.signal_gate, schema, [turns[:30], [late], turns[30:], [end], [("A", "SELL", at(900), False)]], tmp_path).toPandas()
    today = out[(out["at"] >= at(0)) & (out["at"] < at(60))]
    assert len(today) == 60 and today["allowed"].sum() == jobs.DAILY_CAP
    assert set(today[~today["allowed"]]["reason"]) == {"cap", "same"}  # a refused signal is not the last one


def test_gate_judges_the_last_rows_once_the_stream_has_ended(spark, tmp_path):
    schema = "symbol string, signal string, at timestamp, lost boolean"
    rows = [("A", "BUY", START + k * MINUTE, False) for k in range(3)]
    end = (None, None, START + dt.timedelta(hours=2), False)
    out = run_stream(spark, jobs.signal_gate, schema, [rows, [end]], tmp_path).orderBy("at").toPandas()
    assert out["symbol"].tolist() == ["A"] * 3 and out["allowed"].tolist() == [True, False, False]


@pytest.mark.parametrize("seed", range(6))
def test_gate_in_leaps_equals_a_walk_over_the_rows(seed):
    rng = np.random.default_rng(seed)
    names, cap, pause = ["", "BUY", "HOLD", "SELL"], 3, 3_600_000_000
    us = np.sort(rng.integers(0, 4 * jobs.DAY_US // (1, 40)[seed % 2], 700))
    code, lost = rng.integers(0, 4, 700), rng.random(700) < (0.01, 0.2)[seed % 2]
    last, until, day, n, want = "SELL", int(us[0]) + 100, 0, 1, []
    for now, c, gone in zip(us.tolist(), code.tolist(), lost.tolist()):
        if now // jobs.DAY_US != day:
            day, n = now // jobs.DAY_US, 0
        if gone:
            until = now + pause
            want.append((False, None))
            continue
        why = "same" if names[c] == last else "cooldown" if now < until else "cap" if n >= cap else None
        if why is None:
            last, n = names[c], n + 1
        want.append((why is None, why))
    state, got = ("SELL", int(us[0]) + 100, 0, 1), []
    for a, b in ((0, 250), (250, 250), (250, 700)):
        allowed, reason, *state = jobs._judged(us[a:b], code[a:b], lost[a:b], names, tuple(state), cap, pause)
        got += zip(allowed.tolist(), reason.tolist())
    assert got == want and tuple(state) == (last, until, day, n)


def test_stream_gate_judges_every_signal(spark):
    from tidemark.plans.registry import QUERIES
    from tidemark.plans.signal_queries import ruled

    sf = "/root/testdata/sf0.001"
    asked = ruled(spark, sf).where("signal <> 'NO_TRADE' AND rsi >= 35").count()
    assert QUERIES["stream_signal_gate"](spark, sf).count() == asked


def test_trade_life_in_order_of_time_whatever_the_order_of_arrival(spark, tmp_path):
    trade = [("t", "A", "BUY", 100.0, 95.0, 104.0, 110.0, 2.0, 1.0, 50.0, START)]
    trades = spark.createDataFrame(trade, "trade_id string, symbol string, signal string, entry double, stop double, tp1 double, tp2 double, qty double, qty_tp1 double, risk_usd double, opened_at timestamp")
    path = [(1, 101.0), (2, 104.5), (3, 103.0), (4, 100.0), (5, 120.0)]  # first target, then back to the entry
    schema = "symbol string, ts timestamp, price double"
    rows = [("A", START + 10 * m * MINUTE, p) for m, p in path]
    shuffled = [[rows[4], rows[2]], [rows[0], rows[3]], [rows[1]], [("B", START + dt.timedelta(hours=9), 1.0)], [("B", START + dt.timedelta(hours=10), 1.0)]]
    out = run_stream(spark, lambda s: jobs.stream_lifecycle(trades, s), schema, shuffled, tmp_path).toPandas().sort_values("at")
    assert out["event"].tolist() == ["TP1", "BREAK-EVEN"]
    whole = jobs.trade_lifecycle(trades, spark.createDataFrame(rows, schema)).toPandas().sort_values("at")
    assert whole["event"].tolist() == out["event"].tolist()


def test_trade_lives_span_batches_and_no_group_holds_a_whole_one(spark):
    schema = "trade_id string, symbol string, signal string, entry double, stop double, tp1 double, tp2 double, qty double, qty_tp1 double, risk_usd double, opened_at timestamp"
    trades = spark.createDataFrame([(f"t{k}", "A", "BUY", 100.0, 95.0, 104.0, 110.0, 2.0, 1.0, 50.0, START + k * MINUTE) for k in range(3)], schema)
    path = [100.5] * 40 + [104.5] + [103.0] * 40 + [100.0] + [120.0] * 5
    prices = spark.createDataFrame([("A", START + (m + 5) * MINUTE, p) for m, p in enumerate(path)], "symbol string, ts timestamp, price double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = jobs.trade_lifecycle(trades, prices)
        got = [(r["trade_id"], r["event"]) for r in out.orderBy("trade_id", "at").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(f"t{k}", e) for k in range(3) for e in ("TP1", "BREAK-EVEN")]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scan_state_passes_over_bars_seen_and_survives_json():
    frame = Timeframe()
    for k in range(40):
        assert frame.step(k, 11.0 + k % 3, 9.0, 10.0 + k % 3, 1.0)
    again = Timeframe.load(frame.dump())
    assert not again.step(39, 50.0, 1.0, 20.0, 1.0) and again.dump() == frame.dump()
    assert len(frame.volumes) == 21 and len(frame.ranges) == 14 and 0 <= frame.run(1) <= 5


def test_exposure_answers_points_and_hands_them_to_all_their_signals(spark):
    rng = np.random.default_rng(5)
    at = lambda: START + int(rng.integers(0, 5000)) * MINUTE
    some = lambda: (["A", "B", "C", None][int(rng.integers(4))], ["BUY", "SELL"][int(rng.integers(2))])
    held = [(*some(), at(), None if k % 9 == 0 else at()) for k in range(80)]
    asked = [(f"s{k}", *some(), at()) for k in range(40)]
    asked += [(f"t{k}", *asked[k % 7][1:]) for k in range(60)] + asked[:3]
    trades = spark.createDataFrame(held, "symbol string, signal string, opened_at timestamp, closed_at timestamp")
    signals = spark.createDataFrame(asked, "id string, symbol string, signal string, ts timestamp")
    out = book.open_exposure(signals, trades, spark.createDataFrame([("A", "x"), ("B", "x")], "symbol string, sector string"))
    sector = {"A": "x", "B": "x"}

    def want(row):
        steps = [(s, d, t, v) for s, d, a, b in held for t, v in ((a, 1), (b, -1)) if t is not None and t <= row[3]]
        own = (lambda s, d: True, lambda s, d: d == row[2], lambda s, d: sector.get(s) == sector.get(row[1]) is not None, lambda s, d: s == row[1] is not None)
        return (row[0], *(sum(v for s, d, _, v in steps if f(s, d)) for f in own))

    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in out.select("id", "open_all", "open_side", "open_sector", "open_symbol").collect()]
    assert sorted(got, key=key) == sorted(map(want, asked), key=key)
    assert "struct(id" not in out._jdf.queryExecution().optimizedPlan().toString()  # only points are dealt out by cap, no whole signals


def test_batches_appended_again_change_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    row = lambda k, v: spark.createDataFrame([(i, v) for i in k], "id int, v string")
    for _ in range(2):
        ledgers.append_batch(row((1, 2), "a"), path, "2024-01")
        ledgers.append_batch(row((2, 3), "b"), path, "2024-02")
    got = {r["id"]: (r["v"], r["batch"]) for r in ledgers.read_batches(spark, path, ["id"]).collect()}
    assert got == {1: ("a", "2024-01"), 2: ("b", "2024-02"), 3: ("b", "2024-02")}
    ledgers.append_batch(row((9,), "c"), path, "2024-01")
    assert {r["id"] for r in ledgers.read_batches(spark, path, ["id"]).collect()} == {2, 3, 9}


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        x, y = rng.normal(0, 1, 2)
        rows.append(("A", START + k * MINUTE, float(x), float(y), "BUY" if x > 0.5 else "SELL" if x < -0.5 else "NO_TRADE"))
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, x double, noise double, target string")


def test_models_keep_the_properties_of_probabilities(spark, training, tmp_path):
    train, calib, test = (training.where(f"minute(open_time) % 3 = {k}") for k in range(3))
    model = ml.train_ensemble(train, ["x", "noise"], trees=8, rounds=4)

    def error(m):
        rows = ml.score(m, test).toPandas()
        probs = np.array(rows["probs"].tolist())
        np.testing.assert_allclose(probs.sum(axis=1), 1, rtol=1e-9)
        truth = np.array([[t == c for c in ml.CLASSES] for t in rows["target"]], float)
        return float(((probs - truth) ** 2).sum(axis=1).mean()), float((rows["call"] == rows["target"]).mean())

    raw, hits = error(model)
    again = ml.score(ml.train_ensemble(train, ["x", "noise"], trees=8, rounds=4), test).select("open_time", "probs").orderBy("open_time").collect()
    assert again == ml.score(model, test).select("open_time", "probs").orderBy("open_time").collect()
    calibrated = ml.calibrate(model, calib)
    better, _ = error(calibrated)
    assert hits > 0.85 and better < raw
    by = {r["feature"]: r["importance"] for r in ml.importances(train, ["x", "noise"], 8).collect()}
    assert sum(by.values()) == pytest.approx(1) and by["x"] > by["noise"]
    for method in ("isotonic", "sigmoid"):
        ml.save_bundle(spark, ml.Bundle(ml.calibrate(model, calib, method), 0.5, START.isoformat()), f"{tmp_path}/{method}")
        loaded = ml.load_bundle(spark, f"{tmp_path}/{method}")
        rows = [ml.score(m, test).select("open_time", "probs", "call").orderBy("open_time").collect() for m in (model, loaded.model)]
        assert rows[0] == rows[1] and loaded.trained_at == START.isoformat() and loaded.threshold == 0.5
    assert series.after_cutoff(test, F.lit(loaded.trained_at).cast("timestamp")).count() == test.where(F.col("open_time") > F.lit(START)).count()


@pytest.mark.parametrize("missing", ["SELL", "NO_TRADE"])
def test_models_of_rows_without_a_class_score_all_classes(spark, training, missing, tmp_path):
    rest = training.where(F.col("target") != missing)
    train, calib = (rest.where(f"minute(open_time) % 2 = {k}") for k in range(2))
    model = ml.train_ensemble(train, ["x", "noise"], trees=4, rounds=2)
    for method in (None, "isotonic", "sigmoid"):
        if method:
            model = ml.calibrate(model, calib, method)
            ml.save_bundle(spark, ml.Bundle(model, 0.5, START.isoformat()), f"{tmp_path}/{method}")
            model = ml.load_bundle(spark, f"{tmp_path}/{method}").model
        rows = ml.score(model, training).toPandas()
        probs = np.array(rows["probs"].tolist(), float)
        assert probs.shape == (600, 3) and not rows["call"].isna().any()
        np.testing.assert_allclose(probs.sum(axis=1), 1, rtol=1e-9)
        assert probs[:, ml.CLASSES.index(missing)].max() < 0.3
    linear = ml.LogisticRegression(weightCol="weight", family="multinomial", maxIter=5).fit(ml.prepared(train, ["x", "noise"]))
    assert ml.Softmax.of(linear).predict_proba(np.zeros((2, 2))).shape == (2, 3)


def test_a_training_set_without_a_signal_is_not_undersampled_to_nothing(spark, training):
    still = training.withColumns({"target": F.lit("NO_TRADE"), "regime": F.lit("w0")})
    rows = ml.train_and_score(still, ["x", "noise"], trees=4, rounds=2).toPandas()
    probs = np.array(rows["probs"].tolist(), float)
    assert len(rows) == 120 and probs.shape == (120, 3) and set(rows["call"]) == {"NO_TRADE"}
    np.testing.assert_allclose(probs.sum(axis=1), 1, rtol=1e-9)


def test_a_model_of_the_calls_needs_a_call_to_learn_from(spark, training):
    names = ["x", "noise", "confidence"]
    side = F.when(F.col("x") > 0, "BUY").otherwise("NO_TRADE")
    scored = training.withColumns({"call": side, "confidence": F.lit(0.9)})
    assert ml.train_meta(scored.where("call = 'NO_TRADE'"), names, 2) is None
    none = ml.meta_filter(scored, None, names, 0.35, 0.4)
    some = ml.meta_filter(scored, ml.train_meta(scored, names, 2), names, 0.35, 0.4)
    assert none.count() == 0 and none.columns == some.columns and some.where("x > 0.5").count() == training.where("x > 0.5").count()


def test_external_models_score_in_batches_and_missing_features_are_zero(spark, training):
    soft = ml.Softmax(np.array([[1.0, 0.0], [0.0, 0.0], [-1.0, 0.0]]), np.zeros(3))
    odd = training.limit(3).withColumn("x", F.when(F.minute("open_time") == 0, None).when(F.minute("open_time") == 1, float("inf")).otherwise(2.0))
    got = ml.score_external(odd, ["x", "noise"], soft).orderBy("open_time").collect()
    assert [r["call"] for r in got] == ["BUY", "BUY", "BUY"] and got[0]["confidence"] == pytest.approx(1 / 3) and got[2]["confidence"] > 0.8
    assert ml.score_external(odd.where("false"), ["x", "noise"], soft).count() == 0


def test_all_volatility_states_and_reasons_of_rejection_occur(spark):
    from tidemark.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    states = {r["vol_state"]: r["count"] for r in QUERIES["volatility_states_all"](spark, sf).groupBy("vol_state").count().collect()}
    assert set(states) == {"UNKNOWN", "VERY_HIGH", "HIGH", "NORMAL", "DEAD"} and min(states.values()) > 50
    reasons = {r["reject_reason"]: r["count"] for r in QUERIES["filter_branches"](spark, sf).groupBy("reject_reason").count().collect()}
    assert set(reasons) == {None, "no trade", "confidence", "sentiment", "adx", "4h bias", "4h fresh", "volume", "score", "price"} and min(reasons.values()) > 50
    caps = QUERIES["open_exposure_at_the_caps"](spark, sf).withColumn(
        "by", F.when(F.col("allowed"), "allowed").when((F.col("open_all") >= 10) & (F.col("open_side") < 3), "all").when((F.col("open_side") >= 3) & (F.col("open_sector") < 2), "side").when((F.col("open_sector") >= 2) & (F.col("open_symbol") < 1), "sector").when(F.col("open_symbol") >= 1, "symbol")
    )
    counts = {r["by"]: r["count"] for r in caps.groupBy("by").count().collect()}
    assert {"allowed", "side", "sector", "symbol"} <= set(counts) and min(counts[k] for k in ("allowed", "side", "sector", "symbol")) > 20


def test_all_endings_and_gate_reasons_occur(spark):
    from tidemark.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    ended = {r["event"]: r["count"] for r in QUERIES["trade_lifecycle_endings"](spark, sf).groupBy("event").count().collect()}
    assert {"TP1", "TP2", "BREAK-EVEN", "STOPPED OUT", "TIME"} <= set(ended) and min(ended.values()) >= 3, ended
    gated = {r["reason"]: r["count"] for r in QUERIES["stream_signal_gate_shuffled"](spark, sf).groupBy("reason").count().collect()}
    assert set(gated) == {"", "same", "cooldown", "cap"} and min(gated.values()) > 20, gated


def test_market_states_of_a_mean_range(spark):
    df = spark.createDataFrame([(None,), (5.0,), (4.0,), (2.0,), (0.05,), (0.01,)], "p double")
    state, risk = market.states_of(F.col("p"))
    assert [(r[0], r[1]) for r in df.select(state, risk).collect()] == [("UNKNOWN", 1.0), ("VERY_HIGH", 0.25), ("HIGH", 0.5), ("NORMAL", 1.0), ("NORMAL", 1.0), ("DEAD", 0.0)]
