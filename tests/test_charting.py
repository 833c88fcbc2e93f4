import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paths import SF01
from tickerpulse.operators import market
from tickerpulse.sources import fixtures as fx


def _pandas_window(w):
    r = w["close"].pct_change()
    out = pd.DataFrame(index=w.index)
    out["ret_z"] = (r - r.rolling(20, min_periods=20).mean()) / r.rolling(20, min_periods=20).std()
    v = w["volume"]
    out["vol_z"] = (v - v.rolling(20, min_periods=20).mean()) / v.rolling(20, min_periods=20).std()
    prev = w["close"].shift(1)
    tr = pd.concat([w["high"] - w["low"], (w["high"] - prev).abs(), (w["low"] - prev).abs()], axis=1).max(axis=1)
    atr = tr.rolling(14, min_periods=14).mean()
    out["atr_move"] = w["close"].diff(3).abs() / atr
    p3 = w["close"].pct_change(periods=3) * 100
    out["pct_3d_z"] = (p3 - p3.rolling(20, min_periods=20).mean()) / p3.rolling(20, min_periods=20).std()
    out["vol_expansion"] = r.rolling(3).std() / r.rolling(20).std()
    return out


def test_charting_window_matches_pandas_slices(spark):
    bars = fx.price_bars(spark, SF01).filter(F.col("ticker").isin("S1", "S4")).cache()
    pdf = bars.toPandas().sort_values(["ticker", "date"])
    anchors_pd = pdf.groupby("ticker").nth([5, 30, 45, 200, -1])[["ticker", "date"]]
    anchors = spark.createDataFrame(anchors_pd.rename(columns={"date": "target_date"}))
    got = market.charting_window(bars, anchors).toPandas()
    assert len(got) > 0
    for _, a in anchors_pd.iterrows():
        g = pdf[pdf["ticker"] == a["ticker"]].reset_index(drop=True)
        i = int(g.index[g["date"] == a["date"]][0])
        w = g.iloc[max(0, i - 39): i + 1].reset_index(drop=True)
        want = _pandas_window(w)
        mine = got[(got["ticker"] == a["ticker"]) & (got["target_date"] == a["date"])].sort_values("date")
        assert len(mine) == len(w)
        for col in ("ret_z", "vol_z", "atr_move", "pct_3d_z", "vol_expansion"):
            x = mine[col].to_numpy(dtype="float64")
            y = want[col].to_numpy(dtype="float64")
            both = ~np.isnan(x) & ~np.isnan(y)
            assert (np.isnan(x) == np.isnan(y)).all(), (a["ticker"], a["date"], col)
            assert np.allclose(x[both], y[both], rtol=1e-9, atol=1e-9), (a["ticker"], a["date"], col)
