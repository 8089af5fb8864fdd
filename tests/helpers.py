"""Small builders of rows."""

import datetime as dt

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long, ordinal long"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def bar(ts, o=10.0, h=11.0, low=9.0, c=10.5, adj=None, v=100, k=0, symbol="AAAA3"):
    return (symbol, at(ts) if isinstance(ts, str) else ts, float(o), float(h), float(low), float(c), adj, v, k)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)
