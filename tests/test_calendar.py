import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlespark.functions import calendar as C
from tests.helpers import at


@pytest.fixture(scope="module")
def holidays(spark):
    rows = [("2024-02-12", "Carnival", None, None), ("2024-02-14", "Ashes", "13:00", None)]
    return spark.createDataFrame(rows, "day string, name string, open string, close string").withColumn("day", F.col("day").cast("date"))


def test_sessions_leave_out_weekends_and_closed_days_and_shorten_partial_ones(spark, holidays):
    got = {r.dy.isoformat(): (r.open_ts, r.close_ts) for r in C.sessions(spark, "2024-02-09", "2024-02-15", holidays).collect()}
    assert sorted(got) == ["2024-02-09", "2024-02-13", "2024-02-14", "2024-02-15"]
    assert got["2024-02-09"] == (at("2024-02-09T13:00"), at("2024-02-09T20:00"))
    assert got["2024-02-14"] == (at("2024-02-14T16:00"), at("2024-02-14T20:00"))


def test_no_days_in_the_wrong_order(spark):
    assert C.sessions(spark, "2024-02-09", "2024-02-01").count() == 0


def test_bucket_counts_round_up(spark, holidays):
    s = C.sessions(spark, "2024-02-13", "2024-02-14", holidays).select("dy", *[C.bucket_count(tf, F.col("open_ts"), F.col("close_ts")).alias(tf) for tf in ("5m", "15m", "30m", "1h", "1d")])
    assert [tuple(r)[1:] for r in s.orderBy("dy").collect()] == [(84, 28, 14, 7, 1), (48, 16, 8, 4, 1)]


def test_bucket_open_is_anchored_at_the_session_open_under_any_session_zone(spark):
    rows = spark.createDataFrame([(at("2024-03-11T13:07:31"), at("2024-03-11T13:00")), (at("2024-03-10T07:30"), at("2024-03-10T05:00"))], "ts timestamp_ntz, open_ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = rows.select(C.bucket_open("15m", F.col("ts"), F.col("open_ts")).alias("b"), C.seconds_between(F.col("open_ts"), F.col("ts")).alias("s")).collect()
            assert [r.b for r in got] == [at("2024-03-11T13:00"), at("2024-03-10T07:30")]
            assert [r.s for r in got] == [451, 9000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_refresh_window_counts_sessions_back(spark, holidays):
    r = C.refresh_window(spark, "2024-02-12", 3, holidays).first()
    assert (r.start_day, r.end_day) == (dt.date(2024, 2, 7), dt.date(2024, 2, 9))


def test_neighbours_skip_closed_days(spark, holidays):
    rows = {r.dy.isoformat(): r for r in C.neighbours(C.sessions(spark, "2024-02-09", "2024-02-15", holidays)).collect()}
    assert rows["2024-02-13"].prev_day == dt.date(2024, 2, 9) and rows["2024-02-09"].next_day == dt.date(2024, 2, 13)


def test_clock_is_strict(spark):
    good = spark.createDataFrame([("09:30",)], "c string").select(C.minutes(F.col("c"))).first()[0]
    assert good == 570
    with pytest.raises(Exception, match="bad clock"):
        spark.createDataFrame([("9:30",)], "c string").select(C.minutes(F.col("c"))).collect()


def test_day_bounds_are_local_midnights(spark):
    a, b = C.day_bounds(F.lit("2024-01-02").cast("date"), F.lit("2024-01-03").cast("date"))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (r.a, r.b) == (at("2024-01-02T03:00"), at("2024-01-04T03:00"))


def test_nearest_sessions_of_days_on_and_off_the_calendar(spark, holidays):
    sessions = C.sessions(spark, "2024-01-02", "2024-03-29", holidays)
    rows = {r.dy.isoformat(): r for r in C.nearest_sessions(spark, C.days(spark, "2024-02-09", "2024-02-14"), sessions, "2024-02-09", "2024-02-14").collect()}
    assert (rows["2024-02-10"].prev_day, rows["2024-02-10"].next_day) == (dt.date(2024, 2, 9), dt.date(2024, 2, 13))
    assert (rows["2024-02-13"].prev_day, rows["2024-02-13"].next_day) == (dt.date(2024, 2, 9), dt.date(2024, 2, 14))
    with pytest.raises(Exception, match="no session in 30 days after 2024-03-29"):
        C.nearest_sessions(spark, C.days(spark, "2024-03-28", "2024-03-29"), sessions, "2024-03-28", "2024-03-29").collect()


def test_coverage_by_year(spark, holidays):
    got = C.covered_days(spark.createDataFrame([("2023-12-31",), ("2024-05-01",), (None,)], "dy string").withColumn("dy", F.col("dy").cast("date")), holidays)
    assert [r.covered for r in got.orderBy("dy").collect()] == [False, False, True]
