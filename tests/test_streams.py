"""The provider as a stream, and averages that are worked out again."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.functions import calendar as C
from candlespark.operators import read
from candlespark.sources import provider
from candlespark.streaming import corrections
from tests.helpers import at, bar, bars


@pytest.fixture
def server():
    """A provider with a bar a day, that notes what it is asked for."""
    asked, broken = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            o = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
            asked.append((path.rsplit("/", 1)[-1], o["startDate"], o["endDate"]))
            if broken:
                self.send_response(400)
                self.end_headers()
                return
            first, last = (dt.date.fromisoformat(o[k]) for k in ("startDate", "endDate"))
            days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
            bars_ = [{"date": int(dt.datetime(d.year, d.month, d.day, 13, tzinfo=dt.UTC).timestamp()), "open": 1.0, "high": 2.0, "low": 0.5, "close": float(d.day), "adjustedClose": None, "volume": 3} for d in days]
            body = json.dumps({"results": [{"symbol": path.rsplit("/", 1)[-1], "historicalDataPrice": bars_}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked, broken
    s.shutdown()


def test_a_restarted_stream_asks_for_new_sessions_only(spark, tmp_path, server):
    url, asked, broken = server
    days = C.sessions(spark, "2024-03-11", "2024-03-20")

    def run(now):
        stream = provider.bars_of(provider.quote_stream(spark, days, url=url, tickers="PETR4,VALE3", interval="1d", rate="0", now=str(at(now).replace(tzinfo=dt.UTC).timestamp())))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run("2024-03-13T21:00")  # three sessions have closed
    assert sorted(asked) == [("PETR4", "2024-03-11", "2024-03-13"), ("VALE3", "2024-03-11", "2024-03-13")]
    asked.clear()
    run("2024-03-14T15:00")  # the fourth is open
    assert asked == []
    broken.append(1)
    with pytest.raises(Exception, match="400"):
        run("2024-03-15T23:00")
    broken.clear(), asked.clear()
    run("2024-03-15T23:00")  # what failed is asked for again, and nothing else
    assert sorted(asked) == [("PETR4", "2024-03-14", "2024-03-15"), ("VALE3", "2024-03-14", "2024-03-15")]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.symbol, r.ts.day) for r in got.collect()) == sorted((s, d) for s in ("PETR4", "VALE3") for d in range(11, 16))


def test_a_stream_that_begins_after_what_is_covered(spark, tmp_path, server):
    url, asked, _ = server
    stream = provider.quote_stream(spark, C.sessions(spark, "2024-03-11", "2024-03-20"), url=url, tickers="PETR4", rate="0", after="2024-03-19", now="1e12")
    stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert asked == [("PETR4", "2024-03-20", "2024-03-20")]


def average(values, n):
    out, e = [None] * len(values), 0.0
    for i, v in enumerate(values):
        e = e + v / n if i < n else e + (v - e) * 2 / (n + 1)
        out[i] = e if i >= n - 1 else None
    return out


def test_late_and_corrected_bars_replay_their_tail(spark, tmp_path):
    schema, t = "symbol string, at timestamp, close double", dt.datetime(2024, 3, 11, 13, tzinfo=dt.UTC)
    row = lambda m, c, s="A": (s, t + dt.timedelta(minutes=5 * m), c)
    seen: dict = {}
    counts = []

    def write(batch, _):
        rows = batch.collect()
        counts.append((len(rows), sum(r.again for r in rows)))
        seen.update({(r.symbol, r["at"].astimezone(dt.UTC)): r.ema for r in rows})

    def more(name, rows):
        spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        corrections.ema(stream, 3, "30 minutes").writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    def check(values, symbol="A"):
        got = [seen[symbol, t + dt.timedelta(minutes=5 * m)] for m in sorted(values)]
        want = average([values[m] for m in sorted(values)], 3)
        assert np.allclose([np.nan if v is None else v for v in got], [np.nan if v is None else v for v in want], equal_nan=True)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        values = {m: float(10 + (m * 7) % 5) for m in (0, 1, 2, 4, 5, 6)}
        more("1", [row(m, v) for m, v in values.items()] + [row(0, 1.0, "B"), row(1, None, "B")])
        check(values)
        counts.clear()
        values |= {3: 50.0, 5: 8.5}  # a late bar and a corrected one; all from the late one on comes again
        more("2", [row(3, 50.0), row(5, 8.5), row(6, values[6])])
        check(values)
        assert (4, 3) in counts and seen["B", t] is None
        values |= {m: float(m) for m in range(7, 30)}  # the watermark passes the first bars, which are folded into the base
        more("3", [row(m, values[m]) for m in range(7, 30)])
        check(values)
        values |= {28: 99.0, 30: 1.0}
        more("4", [row(28, 99.0), row(30, 1.0), row(0, 1e9)])  # the last is too late
        check(values)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_apply_offsets(spark):
    df = bars(spark, *[bar(f"2024-01-02T{h}:00", symbol="A") for h in (13, 14, 15)])
    hours = lambda rows: [r.ts.hour for r in rows.orderBy("ts").collect()]
    assert hours(read.between(df, "2024-01-02T11:00:00-03:00", "2024-01-02T15:00:00Z")) == [14]
    assert hours(read.between(df, "2024-01-02", dt.date(2024, 1, 3))) == [13, 14, 15]
    assert hours(read.between(df, at("2024-01-02T14:00"), F.lit("2024-01-02 15:00:00").cast("timestamp_ntz"))) == [14]
    assert hours(read.timestamps(df, "A", "2024-01-02T10:00:00-03:00", "2024-01-02T11:00:00-03:00")) == [13]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert hours(read.between(df, "2024-01-02T14:00:00", "2024-01-02T15:00:00")) == [14]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
