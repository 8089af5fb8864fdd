import json

import pytest
from pyspark.sql import functions as F

from candlespark.functions import calendar as C
from candlespark.functions.bars import as_instant
from candlespark.operators import fold, store
from candlespark.sources import config, provider
from candlespark.streaming import indicators, refresh
from tests.helpers import at


def write(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


CALENDAR = {"timezone": "America/Bogota", "session": {"open": "08:15", "close": "15:45"}, "holidays": [{"date": "2031-06-03", "name": "closed all day"}, {"date": "2031-06-20", "name": "late start", "open": "11:30"}]}


def test_calendar_source(spark, tmp_path):
    zone, o, c, rows = config.calendar(spark, write(tmp_path / "c.json", CALENDAR))
    assert (zone, o, c, rows.count()) == ("America/Bogota", "08:15", "15:45", 2)
    for change, why in (({"extra": 1}, "unknown fields"), ({"holidays": []}, "needs holidays"), ({"holidays": CALENDAR["holidays"][:1] * 2}, "repeated"), ({"session": {"open": "15:45", "close": "08:15"}}, "close"), ({"timezone": "Mars/Base"}, "Mars/Base")):
        with pytest.raises(Exception, match=why):
            config.calendar(spark, write(tmp_path / "bad.json", CALENDAR | change))


FUTURE = {"root": "QRS", "name": "Barley", "long_name": "Barley by the ton", "point_value": 7.5, "tick_size": 0.25, "lot_size": 3, "months": "HNZ"}
SEED = {"ticker": "^TEST1", "kind": "index", "short_name": "T1", "long_name": "Test composite", "currency": "COP", "lot_size": 2, "tick_size": 0.5, "point_value": 3.0, "tracked": True}


def test_contracts_source(spark, tmp_path):
    futures, seeds = config.contracts(spark, write(tmp_path / "k.json", {"futures": [FUTURE], "symbols": [SEED]}))
    assert futures.count() == 1 and seeds.first().tracked
    nameless, _ = config.contracts(spark, write(tmp_path / "n.json", {"futures": [{k: v for k, v in FUTURE.items() if k != "name"}], "symbols": [SEED]}))
    assert nameless.first().name is None
    for doc in ({"futures": [FUTURE | {"months": "A"}], "symbols": [SEED]}, {"futures": [FUTURE, FUTURE], "symbols": [SEED]}, {"futures": [FUTURE | {"tick_size": 0.0}], "symbols": [SEED]}, {"futures": [FUTURE], "symbols": [SEED | {"kind": "bond"}]}):
        with pytest.raises(ValueError):
            config.contracts(spark, write(tmp_path / "bad.json", doc))


def test_index_lists_keep_the_newest(spark, tmp_path):
    folder = tmp_path / "indexes"
    folder.mkdir()
    for month, tickers in (("01", ["QAAA3"]), ("03", ["QBBB3", " qccc3"])):
        write(folder / f"wide-2024-{month}.json", {"index": "wide", "as_of": f"2024-{month}-05", "source": "x", "tickers": tickers})
    (r,) = config.index_lists(spark, str(folder)).collect()
    assert (r.month, r.tickers) == (3, ["QBBB3", "QCCC3"])
    write(folder / "other-2024-01.json", {"index": "wide", "as_of": "2024-01-05", "source": "x", "tickers": ["A"]})
    with pytest.raises(ValueError, match="differs"):
        config.index_lists(spark, str(folder))


def test_limiter_and_retries():
    now, slept = [0.0], []
    limiter = provider.Limiter(2, 2, lambda: now[0], slept.append)
    assert [limiter.wait() for _ in range(4)] == [0, 0, 0.5, 1.0]
    answers = [(429, {"Retry-After": "3"}, b"{}"), (500, {}, b"oops"), (200, {}, b'{"results": [{"symbol": "A"}]}')]
    pauses = []
    client = provider.Client("http://x", "SECRET", provider.Limiter(0), lambda url: answers.pop(0), pauses.append, lambda: 0.5)
    assert client.quote(["a "]) == [{"symbol": "A"}] and client.requests == 3 and pauses == [3.0, 0.5]
    denied = provider.Client("http://x", "SECRET", provider.Limiter(0), lambda url: (401, {}, b'{"message": "bad SECRET"}'), pauses.append)
    with pytest.raises(provider.ProviderError) as e:
        denied.quote(["A"])
    assert "SECRET" not in str(e.value) and e.value.unauthorized and denied.requests == 1
    with pytest.raises(LookupError):
        provider.Client("http://x", "", provider.Limiter(0), lambda url: (200, {}, b"{}")).quote(["A"])
    with pytest.raises(ValueError):
        client.quote(["a b"])


def test_landed_quotes_to_candles(spark, tmp_path):
    quote = {"symbol": "qwer3", "shortName": "Qw", "longName": "Qwer works", "currency": "COP", "regularMarketTime": "2024-03-11T13:00:00Z", "historicalDataPrice": [{"date": 1710162000, "open": 31.0, "high": 34.5, "low": 30.25, "close": 33.0, "adjustedClose": None, "volume": 12}]}
    rows = provider.bars_of(provider.landed_quotes(spark, write(tmp_path / "q.json", {"results": [quote]})))
    candles, rejected = fold.normalize(rows, C.sessions(spark, "2024-03-11", "2024-03-11"), "5m")
    assert candles.first().ts == at("2024-03-11T13:00") and rejected.count() == 0
    available = provider.available_of(spark.createDataFrame([(["qwer3"], ["^test1"])], "stocks array<string>, indexes array<string>"))
    assert {r.ticker for r in available.collect()} == {"QWER3", "^TEST1"}


def test_streaming_refresh_equals_batch(spark, tmp_path):
    schema = "symbol_id long, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long, ordinal long"
    rows = [(1, at(f"2024-03-11T13:{m:02d}"), 1.0 + m, 9.0 + m, 1.0, 2.0 + m, None, m, m) for m in range(30)]
    days = C.sessions(spark, "2024-03-11", "2024-03-11")
    source, path = str(tmp_path / "in"), str(tmp_path / "candles")
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(source)
    for _ in range(2):
        refresh.refresh(spark.readStream.schema(schema).parquet(source), days, "5m", path, str(tmp_path / "ck")).awaitTermination()
        got = sorted((r.ts, r.open, r.close, r.volume) for r in store.read(spark, path).collect())
        batch, _rejected = fold.normalize(spark.createDataFrame(rows, schema), days, "5m", keys=("symbol_id",))
        assert got == sorted((r.ts, r.open, r.close, r.volume) for r in batch.collect())


def test_windowed_stream_closes_buckets(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, price double, volume long"
    rows = [("A", at("2024-03-11T13:01"), 1.0, 1), ("A", at("2024-03-11T13:04"), 2.0, 1), ("A", at("2024-03-11T19:00"), 5.0, 1)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(source)
    stream = refresh.windowed(spark.readStream.schema(schema).parquet(source), C.sessions(spark, "2024-03-11", "2024-03-11"), "5m", "1 hour")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    (r,) = spark.table("closed").collect()
    assert (r.open, r.close, r.volume) == (1.0, 2.0, 2)


def test_streams_keep_one_bar_a_key_and_average_with_constant_state(spark, tmp_path):
    schema = "symbol string, ts timestamp_ntz, close double"
    first, second = str(tmp_path / "in" / "1"), str(tmp_path / "in" / "2")
    row = lambda m, c: ("A", at(f"2024-03-11T13:{m:02d}"), c)
    spark.createDataFrame([row(5, 2.0), row(0, 1.0), row(10, 6.0), row(10, 6.0)], schema).repartition(1).write.parquet(first)

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    once = run(refresh.once_per_key(source().withColumn("at", as_instant(F.col("ts"))).drop("ts")), "once")
    assert len(once) == 3
    out = str(tmp_path / "out")

    def more():
        indicators.ema(source(), 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return [r.ema for r in spark.read.parquet(out).orderBy("ts", "ema").collect()]

    got = more()
    assert got[:2] == [None, 1.5] and abs(got[2] - 4.5) < 1e-9 and abs(got[3] - 5.5) < 1e-9
    spark.createDataFrame([row(15, 10.0)], schema).repartition(1).write.parquet(second)
    assert abs(more()[4] - (5.5 + 4.5 * 2 / 3)) < 1e-9
