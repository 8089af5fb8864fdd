"""The store under writers and readers at once."""

import datetime as dt
import threading

import pytest

from candlespark.operators import store
from tests.helpers import at

CANDLES = "symbol_id long, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long"


def rows(symbol, days, close=1.0, month=3):
    return [(symbol, "5m", at(f"2024-{month:02d}-11T13:00") + dt.timedelta(days=d), 1.0, 2.0, 0.5, close, None, 10) for d in range(days)]


def together(*jobs):
    failed = []

    def run(job):
        try:
            job()
        except Exception as e:  # told after the join
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed


def test_writers_of_one_month_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "candles")

    def writer(symbol):
        def run():
            for k in range(3):
                store.upsert(spark.createDataFrame(rows(symbol, 4, k + symbol * 10.0), CANDLES), path)

        return run

    together(*map(writer, (1, 2, 3)))
    got = store.read(spark, path).collect()
    assert sorted((r.symbol_id, r.ts.day, r.close) for r in got) == sorted((s, 11 + d, 2 + s * 10.0) for s in (1, 2, 3) for d in range(4))
    assert store.versions(spark, path) == list(range(1, 10))  # every write has a version of its own
    assert not list((tmp_path / "candles" / "_staged").iterdir()) and not list((tmp_path / "candles" / "_versions").glob("*draft*"))


def test_a_conflict_in_another_month_writes_no_data_again(spark, tmp_path, monkeypatch):
    path, real, lost = str(tmp_path / "candles"), store.create_once, []

    def beaten(spark_, name, text):
        if not lost:  # just before the version is made, somebody else makes it, with another month
            lost.append(name)
            monkeypatch.setattr(store, "create_once", real)
            store.upsert(spark.createDataFrame(rows(9, 1, month=7), CANDLES), path)
            folders = {p.name for p in (tmp_path / "candles" / "data").iterdir()}
            monkeypatch.setattr(store, "create_once", lambda *a: (again.append({p.name for p in (tmp_path / "candles" / "data").iterdir()} == folders), real(*a))[1])
        return real(spark_, name, text)

    again: list = []
    monkeypatch.setattr(store, "create_once", beaten)
    assert store.upsert(spark.createDataFrame(rows(1, 2), CANDLES), path) == 2
    assert again == [True] and sorted(store.listing(spark, path, 2)) == [("5m", "2024-03"), ("5m", "2024-07")]
    assert store.read(spark, path).count() == 3


def test_a_conflict_in_the_same_month_merges_again(spark, tmp_path, monkeypatch):
    path, real, lost = str(tmp_path / "candles"), store.create_once, []

    def beaten(*a):
        if not lost:
            lost.append(1)
            monkeypatch.setattr(store, "create_once", real)
            store.upsert(spark.createDataFrame(rows(2, 2), CANDLES), path)
        return real(*a)

    monkeypatch.setattr(store, "create_once", beaten)
    assert store.upsert(spark.createDataFrame(rows(1, 2), CANDLES), path) == 2
    assert sorted((r.symbol_id, r.ts.day) for r in store.read(spark, path).collect()) == [(1, 11), (1, 12), (2, 11), (2, 12)]
    assert len(list((tmp_path / "candles" / "data").iterdir())) == 2  # what was merged in vain is gone


def test_a_reader_sees_the_old_or_the_new_state(spark, tmp_path):
    path, seen = str(tmp_path / "candles"), []
    store.upsert(spark.createDataFrame(rows(1, 20, 0.0), CANDLES), path)
    ended = threading.Event()

    def write():
        try:
            for k in range(1, 4):
                store.upsert(spark.createDataFrame(rows(1, 20, float(k)), CANDLES), path)
        finally:
            ended.set()

    def look():
        while not ended.is_set():
            seen.append([r.close for r in store.read(spark, path).collect()])

    together(write, look)
    assert seen and all(len(s) == 20 and len(set(s)) == 1 for s in seen)
    before = store.read(spark, path)  # keeps its version
    store.upsert(spark.createDataFrame(rows(1, 20, 9.0), CANDLES), path)
    assert {r.close for r in before.collect()} == {3.0} and {r.close for r in store.read(spark, path).collect()} == {9.0}


def test_a_failed_writer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "candles")
    store.upsert(spark.createDataFrame(rows(1, 2), CANDLES), path)

    def broken(*a):
        raise OSError("lost")

    monkeypatch.setattr(store, "create_once", broken)
    with pytest.raises(OSError, match="lost"):
        store.upsert(spark.createDataFrame(rows(2, 2), CANDLES), path)
    assert store.latest(spark, path) == 1 and store.read(spark, path).count() == 2 and len(list((tmp_path / "candles" / "data").iterdir())) == 1


def test_vacuum_keeps_what_versions_list(spark, tmp_path):
    path = str(tmp_path / "candles")
    for k in range(4):
        store.upsert(spark.createDataFrame(rows(1, 2, float(k)), CANDLES), path)
    store.upsert(spark.createDataFrame(rows(1, 2, 8.0, month=7), CANDLES), path)
    assert store.vacuum(spark, path, keep=2) == 0  # nothing is old enough
    assert store.versions(spark, path) == [4, 5]
    assert store.vacuum(spark, path, keep=2, hours=0) == 3
    assert store.read(spark, path).count() == 4 and store.read(spark, path, version=4).count() == 2
    assert store.vacuum(spark, str(tmp_path / "nothing")) == 0
