"""Goldens and invariants of the trade engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions import series
from tickloom.operators import bars as B
from tickloom.operators import footprint as FP
from tickloom.operators import labels as L
from tickloom.plans import transforms as X
from tickloom.plans.features import Compose, Feature, FeatureKit
from tickloom.sources import archives, store
from tickloom.sources import trades as T

NS = 1_000_000_000


def feed(spark, rows, cols="symbol string, id long, ts long, price double, amount double"):
    return spark.createDataFrame(rows, cols)


def trades(spark, prices, amounts=None, sides=None, ts=None):
    n = len(prices)
    return spark.createDataFrame([("A", i, i + 1, (ts or [k * NS for k in range(n)])[i], float(prices[i]), float((amounts or [1] * n)[i]), int((sides or [1] * n)[i])) for i in range(n)], "symbol string, seq long, id long, ts_ns long, price double, amount double, side int")


def rows(df, *cols, order="seq"):
    return [tuple(r) for r in df.orderBy(order).select(*cols).collect()]


def test_preprocess_merges_and_orders(spark):
    df = feed(spark, [("A", 2, 1000, 10.0, 1.0), ("A", 1, 1000, 10.0, 2.0), ("A", 3, 2000, 11.0, 1.5), ("A", 4, 3000, 12.0, 1.0)])
    out = T.preprocess(df, unit="ms")
    assert rows(out, "seq", "amount") == [(0, 3.0), (1, 1.5), (2, 1.0)]
    assert [r[0] for r in rows(out, "ts_ns")] == [1000 * 10**6, 2000 * 10**6, 3000 * 10**6]


def test_merge_keeps_sides_with_their_rows(spark):
    df = feed(spark, [("A", 1, 3, 1.0, 1.0, True), ("A", 2, 1, 2.0, 1.0, True), ("A", 3, 1, 2.0, 1.0, False), ("A", 4, 2, 3.0, 1.0, True)], "symbol string, id long, ts long, price double, amount double, is_buyer_maker boolean")
    assert rows(T.preprocess(df, unit="ns"), "side", "amount") == [(-1, 1.0), (1, 1.0), (-1, 1.0), (-1, 1.0)]


def test_units_and_integrity(spark):
    df = feed(spark, [("A", 1, 0, 1.0, 1.0), ("A", 2, 1, 1.0, 1.0), ("A", 10, 120, 1.0, 1.0)])
    assert T.infer_unit(df) == "s"
    d = T.sort_trades(df.withColumn("ts_ns", T.to_ns(F.col("ts"), "s")))
    assert [tuple(r)[1:4] for r in T.integrity(d).collect()] == [(2, 10, 7)]
    assert T.missing_percent(d).first().missing_pct == pytest.approx(700 / 3)
    with pytest.raises(ValueError):
        T.to_ns(F.col("ts"), "h")
    with pytest.raises(ValueError):
        T.preprocess(df.drop("amount"))


@pytest.mark.parametrize("prices, side", [([100, 100, 101, 101, 100.5], [0, 0, 1, 1, -1])])
def test_tick_rule(spark, prices, side):
    assert [r[0] for r in rows(T.add_side(trades(spark, prices)), "side")] == side


def test_days_give_what_a_whole_symbol_gives(spark, monkeypatch):
    rng = np.random.default_rng(12)
    raw = [("AB"[k % 2], k, int(rng.integers(0, 40)) * 3600 * 8 * NS, float(rng.integers(1, 4)), 1.0) for k in range(400)]
    df = spark.createDataFrame(raw, "symbol string, id long, ts_ns long, price double, amount double")
    got = []
    for chunk in (10**18, 86_400 * NS, 3600 * NS):  # one chunk, days, and chunks of one time
        monkeypatch.setattr(T, "CHUNK_NS", chunk)
        got.append(sorted(map(tuple, T.add_side(T.add_seq(df)).select("symbol", "seq", "id", "side").collect())))
    assert got[0] == got[1] == got[2] and [r[1] for r in got[0] if r[0] == "A"] == list(range(200))
    last, side, want = None, 0, []
    for _, _, _, p, _ in sorted((r for r in raw if r[0] == "A"), key=lambda r: (r[2], r[1])):
        side = side if last is None or p == last else 1 if p > last else -1
        last = p
        want.append(side)
    assert [r[3] for r in got[0] if r[0] == "A"] == want


def test_tick_size(spark):
    assert T.tick_size(trades(spark, [1.0, 1.1, 1.3, 1.2])) == pytest.approx(0.1)
    assert T.tick_size(trades(spark, [1.0, 1.0])) == 0.0


def test_time_bars_close_on_the_right(spark):
    t = trades(spark, [1, 2, 3, 4, 5, 6], ts=[int(x * NS) for x in (1, 1.5, 2, 2.5, 3, 4)])
    out = B.TimeBars(t, 2).build_ohlcv()
    assert rows(out, "bar_id", "trades", "close", order="bar_id") == [(2 * NS, 3, 3.0), (4 * NS, 3, 6.0), (6 * NS, 0, 6.0)]


def test_ohlcv_golden(spark):
    t = trades(spark, [10, 11, 12, 13, 14, 15], [100, 100, 150, 200, 25, 50])
    d = t.where("seq > 0").withColumn("bar_id", F.when(F.col("seq") <= 3, 0).otherwise(1))
    assert rows(B.ohlcv(d), "open", "high", "low", "close", "volume", "trades", "median_trade_size", order="bar_id") == [(11.0, 13.0, 11.0, 13.0, 450.0, 3, 150.0), (14.0, 15.0, 14.0, 15.0, 75.0, 2, 37.5)]


@pytest.mark.parametrize("theta", [1, 2, 3, 4, 7])
def test_tick_bars_follow_the_counter(spark, theta):
    n = 23
    count, closes = 1, [0]
    for i in range(1, n):
        count += 1
        if count >= theta:
            closes.append(i)
            count = 0
    want = [(k, closes[k + 1] - closes[k]) for k in range(len(closes) - 1)]
    got = B.tick_bars(trades(spark, range(1, n + 1)), theta).groupBy("bar_id").count()
    assert rows(got, "bar_id", "count", order="bar_id") == want


def test_dollar_and_volume_bars_follow_the_loop(spark):
    rng = np.random.default_rng(1)
    p, a = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 200).astype(float)
    for f, x, th, carry in ((B.volume_bars, a, 20.0, False), (B.dollar_bars, p * a, 40.0, True)):
        total, at, want = x[0], 0, {}
        for i in range(1, len(x)):
            want[i] = at
            total += x[i]
            if total >= th:
                total, at = (total - th if carry else 0.0), at + 1
        got = dict(rows(f(trades(spark, p, list(a)), th), "seq", "bar_id"))
        assert got == {i: b for i, b in want.items() if b < at}


def test_directional_golden(spark):
    t = trades(spark, [100, 101, 102], [10, 15, 20], [1, 1, 1])
    r = B.directional(t, t.where("seq > 0").withColumn("bar_id", F.lit(0))).first()
    assert (r.ticks_buy, r.ticks_sell, r.volume_buy, r.dollars_buy, r.cum_ticks_min, r.cum_ticks_max) == (2, 0, 35.0, 3555.0, 1, 2)


def test_trade_size_golden(spark):
    d = trades(spark, [1] * 3, [10, 20, 60]).withColumn("bar_id", F.lit(0))
    r = B.trade_size(d, 10.0, 5.0).first()
    assert r.mean_size_rel == pytest.approx(math.log1p(30 / 50)) and r.pct_block == pytest.approx(60 / 90)
    assert B.trade_size(d, 0.0).first().mean_size_rel is None


def test_footprint_golden(spark):
    d = trades(spark, [100, 100.5, 100.5, 101.0], [1, 2, 1, 1.5], [0, 1, -1, 1]).withColumn("bar_id", F.lit(0))
    r = FP.footprints(d, 0.5, 1.5).first()
    assert [x.level for x in r.fp] == [200, 201, 202] and [x.buy_volume for x in r.fp] == [0, 2, 1.5] and [x.sell_volume for x in r.fp] == [0, 1, 0] and r.cot_level == 201


def test_value_area_grows_by_two():
    assert K.value_area(np.array([1, 1, 10, 1, 1.0]), 70) == (2, 2, 2)
    assert K.value_area(np.array([1, 1, 10, 5, 5.0]), 80) == (2, 2, 4)


def test_stubs():
    for f in (B.imbalance_bars, B.run_bars, L.z_score_peak_filter):
        with pytest.raises(NotImplementedError):
            f(None)


def test_triple_barrier_golden(spark):
    t = trades(spark, [100, 101, 103, 104, 120, 130, 115, 116])
    ev = spark.createDataFrame([("A", 0, 0.05), ("A", 2, 0.03), ("A", 7, 0.01)], "symbol string, event_idx long, target double")
    got = rows(L.triple_barrier(t, ev, 5 * NS), "event_idx", "touch_idx", "label", order="event_idx")
    assert got == [(0, 4, 1), (2, 4, 1), (7, 7, 0)]


def test_uniqueness_goldens(spark):
    t = trades(spark, range(1, 11))
    lab = spark.createDataFrame([("A", a, b) for a, b in ((0, 4), (1, 5), (3, 8), (6, 9))], "symbol string, event_idx long, touch_idx long")
    got = [r[0] for r in rows(L.average_uniqueness(t, lab), "avg_uniqueness", order="event_idx")]
    assert got == pytest.approx([0.5333333, 0.4333333, 0.4444444, 0.625], abs=1e-6)


def test_time_decay_golden(spark):
    d = spark.createDataFrame([("A", i, 0.5) for i in range(4)], "symbol string, event_idx long, u double")
    assert [r[0] for r in rows(d.withColumn("w", L.time_decay("u", 0.4)), "w", order="event_idx")] == pytest.approx([0.55, 0.7, 0.85, 1.0])


def test_cusum_filter_golden(spark):
    assert [r[0] for r in rows(L.cusum_filter(trades(spark, [100 + k / 100 for k in range(6)]), 1e-5), "seq")] == [1, 2, 3, 4, 5]


def test_windows_guard_the_warm_up(spark):
    d = trades(spark, [1, 2, 3, 4, 5]).withColumn("close", F.col("price"))
    ax = series.Axis()
    assert [r[0] for r in rows(X.ZScore(3, input_col="close")(d, ax), "close_z3")] == pytest.approx([None, None, 1.22474487, 1.22474487, 1.22474487])
    assert [r[0] for r in rows(X.BurstRatio(3, input_col="close")(d, ax), "close_burst3")] == pytest.approx([None, None, 1.5, 4 / 3, 1.25])
    with pytest.raises(ValueError):
        X.SMA(3, input_col="nothing")(d, ax)


def test_ewma_matches_pandas():
    import pandas as pd

    y = np.random.default_rng(0).normal(size=200)
    y[[3, 50]] = np.nan
    assert K.ewma(y, 10) == pytest.approx(pd.Series(y).ewm(span=10, ignore_na=False).mean().to_numpy(), nan_ok=True)
    y = y[~np.isnan(y)]
    assert K.ewms(y, 10)[5:] == pytest.approx(pd.Series(y).ewm(span=10).std().to_numpy()[5:])


def test_adx_and_rsi_shapes():
    p = np.exp(np.cumsum(np.full(60, 0.01)))
    a = K.adx(p * 1.01, p * 0.99, p, 5)
    assert a[:9].sum() == 0 and a[-1] > 90
    assert np.isnan(K.rsi_wilder(p, 5)).all()  # no losses


def test_kit_graph_order_and_round_trip(spark, tmp_path):
    c = Feature(X.Identity("close"))
    kit = FeatureKit([(c * 2 + 1).rename("lin"), c.rolling_mean(2), c.ema(3), Feature(X.EWMA(3, input_col="close")).rename("e"), Feature(Compose(X.Return(1), X.SMA(2, input_col="x")))], retain=["close"])
    d = trades(spark, [1, 2, 4, 8]).withColumn("close", F.col("price"))
    out = kit.build(d)
    assert out.columns == ["symbol", "ts_ns", "close", "lin", "close_sma2", "close_ewma3", "e", "close_ret1_sma2"]
    kit.save_config(tmp_path / "kit.json")
    again = FeatureKit.from_config(tmp_path / "kit.json").build(d, order="topo")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert "input:close -> [" in kit.build_graph().visualize()
    with pytest.raises(ValueError):
        kit.build(d, backend="gpu")
    with pytest.raises(TypeError):
        Feature(X.Identity("close")) + "x"


def test_store_round_trip(spark, tmp_path):
    s = store.TradeStore(spark, str(tmp_path / "store"))
    t = trades(spark, [1, 2, 3, 4], ts=[1_704_067_200 * NS + k * 20 * 86_400 * NS for k in range(4)])
    s.save(t)
    assert [tuple(r) for r in s.months().collect()] == [("A", "2024-01"), ("A", "2024-02"), ("A", "2024-03")]
    assert s.load("A", start_ns=1_704_067_200 * NS + 1, end_ns=1_704_067_200 * NS + 41 * 86_400 * NS).count() == 2
    plan = s.load("A", month="2024-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-02" in plan
    with pytest.raises(KeyError):
        s.load("B")
    s.save(t.where("seq = 0"))
    assert s.load("A", month="2024-01").count() == 1
    s.add_time_bars(86_400.0)
    assert s.add_time_bars(86_400.0).count() == 0
    assert s.read_bars("A").count() > 0


def test_store_keeps_the_flags_of_other_months(spark, tmp_path):
    s = store.TradeStore(spark, str(tmp_path / "store"))
    day, start = 86_400 * NS, 1_704_067_200 * NS
    jan = trades(spark, [1, 2, 3], ts=[start, start + day, start + 9 * day]).withColumn("id", F.when(F.col("seq") == 2, 7).otherwise(F.col("id")))
    feb, again = trades(spark, [4, 5], ts=[start + 40 * day, start + 41 * day]), trades(spark, [6], ts=[start + 12 * day])
    flags = lambda: {r.month: (r.record_count, r.data_integrity_ok) for r in s._read("meta").collect()}
    s.save(jan, integrity_table=T.integrity(jan))
    assert flags() == {"2024-01": (3, False)} and s.integrity("A").count() == 1 and s.mean_missing_percent() > 0
    s.save(feb, integrity_table=T.integrity(feb))
    sound = store.TradeStore(spark, str(tmp_path / "sound"))
    sound.save(feb, integrity_table=T.integrity(feb))
    assert not sound.integrity().count() and not sound.integrity_summary().count()
    assert flags() == {"2024-01": (3, False), "2024-02": (2, True)}
    assert [r.month for r in s.integrity_summary().collect()] == ["2024-01"]
    s.save(again, overwrite_month=False)  # a month that is added to stays unsound
    assert flags() == {"2024-01": (4, False), "2024-02": (2, True)}
    s.save(again)  # written anew without gaps it is sound
    assert flags() == {"2024-01": (1, True), "2024-02": (2, True)} and not s.integrity().count() and s.mean_missing_percent() is None
    assert [r.ts_ns for r in s.load("A", ordered=True).collect()] == [start + 12 * day, start + 40 * day, start + 41 * day]


def test_symbols_of_digits_stay_strings(spark, tmp_path):
    s = store.TradeStore(spark, str(tmp_path / "store"))
    s.save(trades(spark, [1, 2]).withColumn("symbol", F.lit("007")))
    assert s.load("007").first().symbol == "007" and [tuple(r) for r in s.months().collect()] == [("007", "1970-01")]


def test_bar_catalog_and_whole_days(spark, tmp_path):
    s = store.TradeStore(spark, str(tmp_path / "store"))
    day, start = 86_400 * NS, 1_704_067_200 * NS
    s.save(trades(spark, [1, 2, 3, 4], ts=[start + k * day // 2 + 5 for k in range(4)]))
    with pytest.raises(KeyError):
        s.bar_range()
    s.add_time_bars(3600.0)
    first, last = s.bar_range("A")
    assert (first, last) == tuple(s.bar_keys().agg(F.min("first_ns"), F.max("last_ns")).first())
    assert s.read_bars("A", end_ns=start + day).agg(F.max("bar_id")).first()[0] == min(last, start + 2 * day - 3600 * NS)
    assert [r.bar_id for r in s.read_bars("A", end_ns=start + day, seconds=86_400).collect()] == [start]


def test_prices_that_are_not_positive_move_nothing():
    p = np.array([10.0, 11.0, 0.0, 12.0, 12.5, -1.0, 13.0, 14.0])
    r = K.log_returns(p)
    assert np.flatnonzero(~np.isnan(r)).tolist() == [1, 4, 7]
    assert K.cusum_events(p, 0.05).tolist() == [False, True, False, False, False, False, False, True]
    closes, first = K.cusum_closes(np.arange(8), p, np.full(8, 0.05), 1e-4, 1.0)
    assert closes.tolist() == [False, True, False, False, False, False, False, True] and first == 0
    up = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 80)))
    whole = K.cusum_test_developing(up, 10)
    assert np.allclose(K.cusum_test_last(up), whole[-1])
    bad = up.copy()
    bad[40] = 0
    assert np.isnan(K.cusum_test_developing(bad, 10)[40:]).all() and np.allclose(K.cusum_test_developing(bad, 10)[:40], whole[:40], equal_nan=True)
    rolled, clean = K.cusum_test_rolling(bad, 20, 10), K.cusum_test_rolling(up, 20, 10)
    assert np.isnan(rolled[40:61]).all() and np.allclose(rolled[61:], clean[61:]) and np.isnan(K.cusum_test_last(bad)).all()


def test_zip_scan_and_names(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "1,10.5,2,21,1000,true,true\n2,x,1,1,1001,0,true\n")
    got = archives.read_zip(spark, str(tmp_path / "a.zip")).orderBy("id").collect()
    assert [(r.id, r.price, r.is_buyer_maker) for r in got] == [(1, 10.5, True), (2, None, False)]
    assert archives.verify_checksums(spark, str(tmp_path / "a.zip")).first().ok
    assert archives.months("2024-11", "2025-01") == ["2024-11", "2024-12", "2025-01"]
    assert archives.parse_store_name("BTCUSDT_um_2401-2403.x") == ("BTCUSDT", "um", "2024-01", "2024-03")
    with pytest.raises(ValueError):
        archives.market_path("moon")


def test_checksum_files_and_ingest(spark, tmp_path):
    import hashlib
    import zipfile

    remote, local = tmp_path / "remote" / "spot" / "monthly" / "trades" / "ABC", tmp_path / "local"
    remote.mkdir(parents=True)
    local.mkdir()
    for m, start, good in (("2024-01", 1_704_067_200_000, True), ("2024-02", 1_706_745_600_000, False)):
        name = f"ABC-trades-{m}.zip"
        with zipfile.ZipFile(remote / name, "w") as z:
            z.writestr("a.csv", "".join(f"{k},{10 + k},1,1,{start + 1000 * k},true,true\n" for k in range(5)))
        sum_ = hashlib.sha256((remote / name).read_bytes()).hexdigest() if good else "0" * 64
        (remote / f"{name}.CHECKSUM").write_text(f"{sum_}  {name}\n")
    got = archives.ingest(spark, f"file://{tmp_path}/remote", "ABC", "spot", "2024-01", "2024-02", str(local), str(tmp_path / "store"))
    assert got == {"2024-01": True, "2024-02": False}
    s = store.TradeStore(spark, str(tmp_path / "store"))
    assert s.load("ABC").count() == 5 and s.read_bars("ABC").count() >= 5
    for name in ("ABC_spot_2401-2402", "ABC_spot_2312-2401", "ABC_um_2401-2409", "other"):
        (tmp_path / "stores" / name).mkdir(parents=True)
    at = archives.find_store(str(tmp_path / "stores"), "ABC", "spot")
    assert at.endswith("ABC_spot_2401-2402") and archives.find_store(str(tmp_path / "stores"), "XYZ", "spot") is None
    assert archives.extend_name(at, "2024-02", "2024-05").endswith("ABC_spot_2401-2405")


def test_feed_types(spark):
    good = "symbol string, id long, ts long, price double, amount double"
    row = ("A", 1, 1_700_000_000, 1.0, 1.0)
    assert T.preprocess(feed(spark, [row], good)).count() == 1
    with pytest.raises(TypeError):
        T.preprocess(feed(spark, [("A", "1", *row[2:])], good.replace("id long", "id string")))
    with pytest.raises(TypeError):
        T.preprocess(feed(spark, [(*row[:3], "1", 1.0)], good.replace("price double", "price string")))
    with pytest.raises(ValueError):
        T.preprocess(feed(spark, [row], good).drop("id"))


def test_arity_is_checked(spark):
    class Double(X.SISO):
        def __init__(self, input_col="close"):
            self._set(input_col, "double", input_col=input_col)

        def columns(self, ax, x):
            return 2 * x

    class Both(X.MIMO):
        def __init__(self, results=2):
            self._set(["close", "volume"], ["sum", "gap"], results=results)

        def columns(self, ax, a, b):
            return [a + b, a - b][: self.params["results"]]

    df = spark.createDataFrame([("A", 1, 3.0, 4.0)], "symbol string, ts_ns long, close double, volume double")
    ax = series.Axis()
    assert Double()(df, ax).first()["close_double"] == 6.0
    assert Both()(df, ax).select("sum", "gap").first() == (7.0, -1.0)
    with pytest.raises(ValueError):
        Both(1)(df, ax)
    with pytest.raises(ValueError):
        Double(["close", "volume"])
    with pytest.raises(ValueError):
        Double("missing")(df, ax)


def test_structural_break_frames(spark):
    p = 100 * np.exp(np.cumsum(np.random.default_rng(8).normal(0, 0.01, 60)))
    df = spark.createDataFrame([("A", k, float(x)) for k, x in enumerate(p)] + [("B", 0, 1.0)], "symbol string, ts_ns long, close double")
    want = K.cusum_test_developing(p, 20)
    t = X.CUSUMDeveloping(20)
    got = [[r[c] for c in t.produces] for r in t(df, series.Axis()).where("symbol = 'A'").orderBy("ts_ns").collect()]
    assert np.allclose(np.array(got, float), want, equal_nan=True)
    last = {r.symbol: tuple(r)[1:] for r in X.cusum_last(df).collect()}
    assert np.allclose(last["A"], want[-1]) and last["B"] == (None,) * 4


def test_label_accessors(spark):
    f = spark.createDataFrame([("A", k * NS, 0.01) for k in range(4)], "symbol string, ts_ns long, vol double")
    tb = L.TripleBarrier(f, "vol", 0.001, (1.0, 1.0), 2.0)
    assert (tb.event_count(), tb.first_event(), tb.last_event()) == (4, 0, 3 * NS)
    with pytest.raises(ValueError):
        tb.event_labels()
    tb.compute_labels(trades(spark, [1, 2, 3, 4, 5, 6]))
    assert tb.event_labels().count() == tb.event_returns().count() == 4 and tb.target_returns().columns == ["symbol", "ts_ns", "target"]


def test_logging_leaves_the_root_alone(tmp_path):
    import logging

    from tickloom import log

    root = list(logging.getLogger().handlers)
    path = tmp_path / "logs" / "run.log"
    for _ in range(2):
        logger = log.setup_logging("ERROR", "DEBUG", str(path))
    log.get_logger("part").debug("told")
    assert logging.getLogger().handlers == root and len(logger.handlers) == 2 and path.read_text().count("told") == 1
    with pytest.raises(ValueError):
        log.setup_logging("loud")
    log.setup_logging("ERROR")


def test_window_profiles_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    made, at = [], 0
    for _ in range(60):
        at += int(rng.integers(1, 9)) * NS
        made.append((at, [(int(k), float(rng.integers(0, 4)), float(rng.integers(0, 3))) for k in range(int(rng.integers(0, 6)), int(rng.integers(7, 12)))]))
    cell = "array<struct<level:int,buy_volume:double,sell_volume:double>>"
    fp = spark.createDataFrame([("A", t, c) for t, c in made], f"symbol string, bar_id long, fp {cell}")
    got = {(r.bar_id, r.level): r.volume for r in FP.window_levels(fp, 7.0).collect()}
    want = {}
    for t, _ in made:
        for past, cells in made:
            if t - 7 * NS <= past <= t:
                for level, b, s in cells:
                    want[t, level] = want.get((t, level), 0.0) + b + s
    assert got == want


def test_streaming_samplers_equal_batch(spark, tmp_path):
    from tickloom.streaming import bars as SB

    t = T.add_side(trades(spark, np.random.default_rng(2).integers(1, 50, 60).astype(float)))
    src = str(tmp_path / "in")
    t.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).write.parquet(src)
    for k, (f, batch) in enumerate({"v": (lambda s: SB.volume_closes(s, 7.0), B.volume_bars(t, 7.0)), "t": (lambda s: SB.tick_closes(s, 5), B.tick_bars(t, 5))}.values()):
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        q = f(stream).writeStream.format("memory").queryName(f"closes{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = {(r.bar_id, r.m) for r in batch.groupBy("bar_id").agg(F.max("id").alias("m")).collect()}
        assert {(r.bar_id, r.id) for r in spark.table(f"closes{k}").collect()} == want


def test_plans_have_no_nested_loops(spark):
    from tickloom.queries import QUERIES

    for name in ("ret_03_return_t", "lbl_01_triple_barrier", "jn_06_asof_two_tables", "vp_03_window_levels", "wgt_01_uniqueness"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def brute_labels(t, vertical, target):
    """Labels and weights of one symbol's trades (ts_ns, price), each of them an event, by plain loops."""
    n, out = len(t), []
    for e in range(n):
        path = [(k, math.log(t[k][1]) - math.log(t[e][1]), t[k][0] - t[e][0] >= NS) for k in range(e + 1, n) if t[k][0] <= t[e][0] + vertical]
        if not path:
            out.append({"touch_idx": e, "label": 0, "ret": None, "vertical_touch_weight": None})
            continue
        touch = next((k for k, r, op in path if op and abs(r) >= target), path[-1][0])
        seen = [(k, r) for k, r, op in path if op and k <= touch]
        ret = next((r for k, r in seen if k == touch), 0.0)
        up, down = max([max(r, 0) / target for _, r in seen], default=0.0), max([max(-r, 0) / target for _, r in seen], default=0.0)
        weight = 1.0 if touch < path[-1][0] or not seen else min(1.0, up / (1 + down) if ret > 0 else down / (1 + up))
        out.append({"touch_idx": touch, "label": 1 if ret >= 0 else -1, "ret": ret, "vertical_touch_weight": weight})
    c = [sum(e <= k <= o["touch_idx"] for e, o in enumerate(out)) for k in range(n)]
    lr = [0.0] + [math.log(t[k][1]) - math.log(t[k - 1][1]) for k in range(1, n)]
    for e, o in enumerate(out):
        span = range(e, o["touch_idx"] + 1)
        o["avg_uniqueness"] = sum(1 / c[k] for k in span) / len(span)
        o["return_attribution"] = abs(sum(lr[k] / c[k] for k in span))
    total, run = sum(o["avg_uniqueness"] for o in out), 0.0
    mean = sum(o["return_attribution"] for o in out) / n
    for o in out:
        run += o["avg_uniqueness"]
        o["decay"] = 0.5 + 0.5 * run / total
        o["w"] = o["decay"] * o["return_attribution"] / mean * (1.0 if o["vertical_touch_weight"] is None else o["vertical_touch_weight"]) if mean else None
    if mean and sum(o["w"] for o in out):
        scale = n / sum(o["w"] for o in out)
        classes = {o["label"]: 0.0 for o in out}
        for o in out:
            o["w"] *= scale
            classes[o["label"]] += o["w"]
        for o in out:
            o["class_weight"] = n / (len(classes) * classes[o["label"]]) if classes[o["label"]] > 0 else 0.0
            o["weights"] = o["w"] * o["class_weight"]
    return out


def test_labels_and_weights_take_every_trade(spark):
    from tickloom.queries import QUERIES, VERTICAL, trades

    sf = "/root/testdata/sf0.001"
    by = {}
    for r in trades(spark, sf).select("symbol", "seq", "ts_ns", "price").orderBy("symbol", "seq").collect():
        by.setdefault(r.symbol, []).append((r.ts_ns, r.price))
    want = {(s, e): o for s, t in by.items() for e, o in enumerate(brute_labels(t, VERTICAL * NS, 0.6))}
    for name in ("lbl_01_triple_barrier", "wgt_01_uniqueness", "wgt_02_attribution", "wgt_03_time_decay", "wgt_06_final_weights"):
        got = {(r.symbol, r.event_idx): r.asDict() for r in QUERIES[name](spark, sf).collect()}
        assert got.keys() == want.keys(), name
        for k, row in got.items():
            for c in row.keys() - {"symbol", "event_idx"}:
                assert row[c] == want[k][c] if row[c] is None or want[k][c] is None else row[c] == pytest.approx(want[k][c], abs=2e-6), (name, k, c)


def test_dollar_bars_keep_the_loops_last_bits(spark):
    """45 trades of 11.6 are twice 261 in decimals, but not in the loop's doubles."""
    flat = [11.6] * 100
    total, at, want = flat[0], 0, {}
    for i in range(1, len(flat)):
        want[i] = at
        total += flat[i]
        if total >= 261.0:
            total, at = total - 261.0, at + 1
    assert dict(rows(B.dollar_bars(trades(spark, flat), 261.0), "seq", "bar_id")) == {i: b for i, b in want.items() if b < at}


def test_results_are_rounded_as_the_sql_rounds(spark):
    from tickloom.queries import tidy

    below = math.nextafter(57.1603125, 0)  # a million times this is 57160312.5
    x = [below, -below, 1e301, math.inf, -math.inf, None, -1e-9, 0.1234565]
    got = tidy(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double")).orderBy("k").collect()
    assert [r.x for r in got] == [57.160313, -57.160313, 1e301, math.inf, -math.inf, None, 0.0, 0.123457]


def priced(spark, closes):
    """Six-hour bars of one symbol with the given closes; every other price of a bar is its close."""
    t = trades(spark, closes, ts=[k * 6 * 3600 * NS for k in range(len(closes))])
    b = t.select("symbol", "seq", "ts_ns", *[F.col("price").alias(c) for c in ("open", "high", "low", "close", "vwap")])
    return b.withColumn("ret1", series.ratio(F.col("close"), series.Axis().lag(F.col("close"))) - 1)


def column_by(df, c, order):
    return [r[0] for r in rows(df, c, order=order)]


def column(df, c):
    return [r[0] for r in rows(df, c, order="ts_ns")]


def same(got, want):
    """Equal values; NULL, NaN and infinities are told apart."""
    assert [x is None for x in got] == [x is None for x in want], got
    return [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], nan_ok=True)


NAN, INF = math.nan, math.inf


def test_vwap_drift_from_an_open_of_zero(spark):
    b = priced(spark, [1, 0, 0, 4]).withColumn("vwap", F.when(F.col("seq") == 1, 3.0).otherwise(F.col("close")))
    assert same(column(X.CandleShape()(b), "vwap_drift"), [0.0, INF, NAN, 0.0])


def test_barriers_at_prices_of_zero(spark):
    t = trades(spark, [10, 0, 0, 5, 5.5])
    ev = spark.createDataFrame([("A", k, NAN if k == 3 else 0.3) for k in range(4)], "symbol string, event_idx long, target double")
    got = rows(L.triple_barrier(t, ev, 5 * NS), "touch_idx", "label", "ret", order="event_idx")
    assert [r[:2] for r in got] == [(1, -1), (2, 1), (3, 1), (4, 1)]
    assert same([r[2] for r in got], [-INF, NAN, INF, math.log(1.1)])


def test_bars_return_from_a_close_of_zero(spark, tmp_path):
    from tickloom.queries import bars

    day = 1_704_067_200_000_000
    e = [(k, k, 7, p, '{"k": 1}') for k, p in enumerate([5.0, 10.0, 0.0, 0.0, 8.0])]
    df = spark.createDataFrame(e, "event_id long, k long, user_id long, value double, props string")
    df.withColumn("ts", F.timestamp_micros(F.lit(day + 1) + F.col("k") * 21_600_000_000)).drop("k").write.parquet(f"{tmp_path}/events.parquet")
    assert same(column(bars(spark, str(tmp_path)), "ret1"), [None, 1.0, -1.0, NAN, INF])


def test_deviation_in_time_after_a_price_of_zero(spark):
    b = priced(spark, [1, 2, 0, 4, 5, 6])
    got = column(X.EWMST(86_400.0, input_col="ret1")(b), "ret1_ewms86400s")
    assert got[:1] == [None] and all(x is not None and math.isnan(x) for x in got[3:]) and got[2] > 0
    zero = column(X.EWMST(86_400.0, input_col="ret1", mean0=True)(priced(spark, [1, 2, 0, 0, 5])), "ret1_ewms86400s")
    assert all(x is not None and math.isnan(x) for x in zero[3:])


def test_true_range_over_a_mid_of_zero(spark):
    got = column(X.ATR(2, ema_based=True, normalize=True)(priced(spark, [4, 2, 0, 8])), "atr2_ema_norm")
    assert same(got, [None, 0.5, INF, 4.75 / 8])
    assert same(column(X.ATR(2, normalize=True)(priced(spark, [0, 0, 0])), "atr2_norm"), [None, NAN, NAN])


def test_runs_count_infinite_returns(spark):
    assert column(X.DirRunLen()(priced(spark, [2, 0, 0, 3, 4, 3, 2])), "ret1_dir_run_len") == [0, 1, 0, 1, 2, 1, 2]


def test_expanding_breaks_go_on_after_a_price_of_zero(spark):
    p = [10.0, 11.0, 10.5, 12.0, 0.0, 11.0, 12.0, 12.5, 13.0]
    t = X.CUSUMDeveloping(3)
    got = [[r[c] for c in t.produces] for r in t(priced(spark, p)).orderBy("ts_ns").collect()]
    crit = lambda gap: math.sqrt(4.6 + math.log(gap))
    assert got[:3] == [[None] * 4] * 3 and None not in got[3]
    for row, (stat, gap) in zip(got[4:], [(NAN, 3), (0.0, 4), (NAN, 2), (NAN, 3), (NAN, 4)], strict=True):
        assert same(row, [stat, stat, crit(gap), crit(gap)])


def test_returns_over_time_from_a_price_of_zero(spark):
    b = priced(spark, [2, 0, 0, 3])
    assert same(column(X.ReturnT(window=6 * 3600.0)(b), "close_ret21600s"), [None, -1.0, NAN, INF])
    assert same(column(X.ReturnT(window=6 * 3600.0, is_log=True)(b), "close_ret21600s"), [None, -INF, NAN, INF])


def test_daily_gap_from_a_price_of_zero(spark):
    assert same(column(X.DailyGap()(priced(spark, [1, 1, 1, 0, 5, 1, 1, 0, 0])), "close_daily_gap"), [None] * 4 + [INF] + [None] * 3 + [NAN])


def test_event_filter_at_prices_of_zero(spark):
    t = trades(spark, [10, 10.1, 0, 0, 12, 12.1, 12, 20, 8])
    assert column(L.cusum_filter(t, 0.4), "seq") == column(L.cusum_filter(t.withColumn("h", F.lit(0.4)), "h"), "seq") == [2, 3, 4, 7, 8]


def test_attribution_at_prices_of_zero(spark):
    t = trades(spark, [10, 0, 0, 5, 5.5, 6])
    lab = spark.createDataFrame([("A", a, b) for a, b in ((0, 1), (1, 3), (2, 2), (3, 3), (4, 5))], "symbol string, event_idx long, touch_idx long")
    got = column_by(L.return_attribution(t, lab), "return_attribution", "event_idx")
    assert same(got, [INF, NAN, NAN, INF, math.log(6 / 5)])


def test_weights_of_a_symbol_with_infinite_attribution(spark):
    t = trades(spark, [10, 0, 5, 5.5, 6, 6.6])
    lab = spark.createDataFrame([("A", a, b, y, 1.0) for a, b, y in ((0, 1, -1), (2, 3, 1), (4, 5, 1))], "symbol string, event_idx long, touch_idx long, label int, vertical_touch_weight double")
    got = L.final_weights(L.info_weights(t, lab), 0.5)
    assert same(column_by(got, "class_weight", "event_idx"), [NAN] * 3) and same(column_by(got, "weights", "event_idx"), [NAN] * 3)


def test_realized_volatility_holds_infinite_returns(spark):
    got = column(X.RealizedVolatility(3, input_col="ret1")(priced(spark, [1, 2, 0, 4, 6, 9, 9])), "ret1_rv3")
    assert same(got, [None, None, 1.0, INF, INF, INF, math.sqrt(0.5 / 3)])


def test_variance_of_infinite_returns_is_nan(spark):
    b = priced(spark, [1, 2, 0, 4, 6, 9, 9])
    got = column(b.withColumn("v", series.rolling_variance(series.Axis(), F.col("ret1"), 3, 1, 2)), "v")
    assert same(got, [None, None, 2.0, NAN, NAN, NAN, 1 / 12])


AT_ZERO = ["fn_12_candle_shape", "lbl_04_events_to_labels", "rec_03_ewmst", "rec_07_atr_ema", "rec_09_dir_run_len", "rec_12_cusum_developing", "ret_03_return_t", "ret_07_daily_gap", "smp_01_cusum_filter", "wgt_02_attribution", "wgt_06_final_weights", "win_08_realized_vol", "win_16_rolling_variance"]


@pytest.fixture(scope="module")
def with_zeros(spark, tmp_path_factory):
    """Events of three users: without a price of 0, with one, and with several in a row."""
    rng = np.random.default_rng(21)
    e = []
    for user, zeros in ((1, ()), (2, (20,)), (3, (15, 16, 17, 30))):
        at = 1_704_067_200_000_000
        for k in range(40):
            at += int(rng.integers(2, 9)) * 3_600_000_000 + 1
            e.append((len(e), user, at, 0.0 if k in zeros else float(rng.integers(100, 9000)) / 100, f'{{"k": {int(rng.integers(0, 9))}}}'))
    d = str(tmp_path_factory.mktemp("zeros"))
    spark.createDataFrame(e, "event_id long, user_id long, t long, value double, props string").coalesce(1).withColumn("ts", F.expr("cast(timestamp_micros(t) as timestamp_ntz)")).drop("t").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", AT_ZERO)
def test_queries_equal_their_sql_at_prices_of_zero(spark, with_zeros, name):
    import duckdb

    from tickloom.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{with_zeros}/events.parquet/*.parquet'")
    q = con.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    key = lambda r: tuple("null" if x is None else "nan" if x != x else x for x in r)
    want = sorted(map(key, q.fetchall()), key=str)
    assert sorted((key(r) for r in QUERIES[name](spark, with_zeros).select(*[f"`{c}`" for c in names]).collect()), key=str) == want and want


def test_returns_that_cancel_leave_no_attribution(spark):
    """The shares of event 2 are ln 2 and -2 ln 2 / 2; rounded prefix sums left a rest of the rows before."""
    t = trades(spark, [2, 4, 8, 2])
    lab = spark.createDataFrame([("A", k, 3 if k == 2 else k) for k in range(4)], "symbol string, event_idx long, touch_idx long")
    assert column_by(L.return_attribution(t, lab), "return_attribution", "event_idx") == [0.0, math.log(4) - math.log(2), 0.0, (math.log(8) - math.log(2)) / 2]


def test_attribution_equals_the_exact_sum_of_an_events_rows(spark):
    p = [float(x) for x in np.random.default_rng(3).integers(1, 9, 60)]
    spans = [(k, min(59, k + k % 5)) for k in range(60)]
    t, lab = trades(spark, p), spark.createDataFrame([("A", *x) for x in spans], "symbol string, event_idx long, touch_idx long")
    c = [sum(a <= i <= b for a, b in spans) for i in range(60)]
    lr = [0.0] + [math.log(y) - math.log(x) for x, y in zip(p, p[1:], strict=False)]
    got = rows(L.info_weights(t, lab), "return_attribution", "avg_uniqueness", order="event_idx")
    want = [(abs(math.fsum(lr[i] / c[i] for i in range(a, b + 1))), math.fsum(1 / c[i] for i in range(a, b + 1)) / (b - a + 1)) for a, b in spans]
    assert [tuple(r) for r in got] == [pytest.approx(w, rel=1e-13, abs=1e-20) for w in want]


def equals_sql(spark, name, events, d):
    """The query over events (id, user, microseconds, price) and its SQL, row for row."""
    import duckdb

    from tickloom.queries import ORACLES, QUERIES

    e = spark.createDataFrame(events, "event_id long, user_id long, t long, value double").coalesce(1)
    e.select("event_id", F.expr("cast(timestamp_micros(t) as timestamp_ntz)").alias("ts"), "user_id", "value", F.lit('{"k": 3}').alias("props")).write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    q = con.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    want = q.fetchall()
    assert sorted(rows(QUERIES[name](spark, str(d)), *names, order=names[:2]), key=str) == sorted(want, key=str) and want


START, DAY = 1_704_067_200_000_000, 86_400_000_000


def test_final_weights_equal_their_sql_where_returns_cancel(spark, tmp_path):
    days = {1: [(7.486, 2.0), (13.972, 4.0), (21.066, 8.0), (22.831, 2.0), (26.454, 2.0), (28.669, 2.0)], 2: [(13.899, 2.0), (14.595, 4.0), (19.472, 8.0), (19.829, 2.0), (28.517, 8.0)]}
    equals_sql(spark, "wgt_06_final_weights", [(10 * u + k, u, START + int(x * DAY), p) for u, ts in days.items() for k, (x, p) in enumerate(ts)], tmp_path)


def odd(without: str) -> list[tuple]:
    """80 trades of two users in eight days; every seventh lacks a value."""
    rng = np.random.default_rng(8)
    e = [(k, k % 2, START + k * DAY // 10 + 1, float(rng.integers(100, 9000)) / 100) for k in range(80)]
    at = ["id", "user", "time", "price"].index(without)
    return [tuple(None if i == at and x[0] % 7 == 3 else v for i, v in enumerate(x)) for x in e]


@pytest.mark.parametrize("without", ["price", "user"])
def test_realized_volatility_equals_its_sql_where_a_value_is_missing(spark, tmp_path, without):
    equals_sql(spark, "win_08_realized_vol", odd(without), tmp_path)


@pytest.mark.parametrize("without", ["time", "price", "user"])
def test_final_weights_equal_their_sql_where_a_value_is_missing(spark, tmp_path, without):
    """Trades without a time come last."""
    equals_sql(spark, "wgt_06_final_weights", odd(without), tmp_path)
