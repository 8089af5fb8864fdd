"""The quote provider as a Spark data source, with its rate limit and retries.

The source reads landed JSON responses (``path``) or asks an HTTP endpoint (``url``). Its requests share one rate limit,
so it has a single partition; what it returns is exploded and processed on all executors.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from candlespark.functions.bars import epoch_seconds, from_epoch_or_text
from candlespark.schemas import QUOTE

# Requests a second, burst, attempts, backoff bounds in seconds, most bytes of a response.
RATE, BURST, ATTEMPTS, BACKOFF_LOW, BACKOFF_HIGH, MAX_BODY = 2.0, 4, 4, 0.5, 30.0, 64 << 20


class Limiter:
    """Token bucket; a rate of 0 or less never waits. Tokens may go below zero: callers queue."""

    def __init__(self, rate: float = RATE, burst: int = BURST, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def wait(self) -> float:
        """Takes a token, sleeping as long as it takes; returns the seconds slept."""
        if self.rate <= 0:
            return 0.0
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
        self.at = now
        pause = max(0.0, -self.tokens / self.rate)
        if pause:
            self.sleep(pause)
        return pause


class ProviderError(Exception):
    """An HTTP answer that isn't a success; the token never appears in it."""

    def __init__(self, status: int, message: str, after: float | None = None):
        super().__init__(f"provider answered {status}: {message[:200]}")
        self.status, self.after = status, after

    @property
    def retryable(self) -> bool:
        return self.status == 429 or self.status >= 500

    @property
    def unauthorized(self) -> bool:
        return self.status in (401, 402, 403)


def backoff(attempt: int, after: float | None, jitter: Callable = random.random) -> float:
    """Pause before the next attempt: what the provider asked for, else exponential with full jitter."""
    if after is not None:
        return min(after, BACKOFF_HIGH)
    return max(0.001, jitter() * min(BACKOFF_HIGH, BACKOFF_LOW * 2**attempt))


class Client:
    """GET with limit, retries and a counter of answered requests."""

    def __init__(self, url: str, token: str = "", limiter: Limiter | None = None, fetch: Callable | None = None, sleep: Callable = time.sleep, jitter: Callable = random.random):
        self.url, self.token, self.limiter = url.rstrip("/"), token, limiter or Limiter()
        self.fetch, self.sleep, self.jitter, self.requests = fetch or self._fetch, sleep, jitter, 0

    @staticmethod
    def _fetch(url: str) -> tuple[int, dict, bytes]:
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return r.status, dict(r.headers), r.read(MAX_BODY + 1)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read(MAX_BODY)

    def _scrub(self, text: str) -> str:
        return text.replace(self.token, "***") if self.token else text

    def get(self, path: str, params: dict[str, str]) -> dict:
        """The decoded answer; empty parameters are left out."""
        sent = {k: v for k, v in params.items() if v} | ({"token": self.token} if self.token else {})
        url = f"{self.url}/{path.lstrip('/')}" + (f"?{urllib.parse.urlencode(sent)}" if sent else "")
        for attempt in range(ATTEMPTS):
            self.limiter.wait()
            after = None
            try:
                status, headers, body = self.fetch(url)
                self.requests += 1
                if status == 200:
                    if len(body) > MAX_BODY:
                        raise ValueError("answer too large")
                    return json.loads(body)
                after = headers.get("Retry-After")
                try:
                    message = json.loads(body).get("message", "")
                except ValueError:
                    message = body.decode(errors="replace")
                error: Exception = ProviderError(status, self._scrub(str(message)), float(after) if str(after or "").isdigit() else None)
                if not error.retryable or attempt == ATTEMPTS - 1:
                    raise error
                after = error.after
            except OSError as e:
                if attempt == ATTEMPTS - 1:
                    raise OSError(self._scrub(str(e))) from None
            self.sleep(backoff(attempt, after, self.jitter))
        raise AssertionError

    def quote(self, tickers: list[str], range_: str = "", interval: str = "", start: str = "", end: str = "") -> list[dict]:
        """Quotes of checked, joined tickers; LookupError where there are none."""
        names = [t.strip().upper() for t in tickers]
        for name in names:
            if not name or any(c in name for c in " /?&#%\t\n"):
                raise ValueError(f"bad ticker {name!r}")
        found = self.get("quote/" + ",".join(urllib.parse.quote(n, safe="^") for n in names), {"range": range_, "interval": interval, "startDate": start, "endDate": end}).get("results") or []
        if not found:
            raise LookupError("no results")
        return found

    def available(self, search: str = "") -> dict:
        """The provider's lists of stocks and indexes."""
        return self.get("available", {"search": search})


def asked(o: dict) -> Iterator[tuple]:
    """The quotes that a source's options ask for, one request a ticker."""
    client = Client(o["url"], o.get("token", ""), Limiter(float(o.get("rate", RATE)), int(o.get("burst", BURST))))
    for ticker in o["tickers"].split(","):
        for quote in client.quote([ticker], o.get("range", ""), o.get("interval", ""), o.get("start", ""), o.get("end", "")):
            yield (json.dumps(quote),)


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        return asked(self.options)


class Days(InputPartition):
    """The sessions that a micro-batch asks for."""

    def __init__(self, first: str, last: str):
        self.first, self.last = first, last


class QuoteStreamReader(DataSourceStreamReader):
    """Quotes session by session. An offset is the last day that is covered, so a restart asks for what is missing only, and a
    batch that failed asks again for its own days. A session is asked for once it has closed."""

    def __init__(self, options: dict):
        self.options = options
        self.sessions = sorted((day, float(closes)) for day, closes in json.loads(options["sessions"]))

    def initialOffset(self) -> dict:
        return {"day": self.options.get("after", "")}

    def latestOffset(self) -> dict:
        now = float(self.options.get("now") or time.time())
        return {"day": max([self.initialOffset()["day"], *(day for day, closes in self.sessions if closes <= now)])}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        days = [day for day, _ in self.sessions if start["day"] < day <= end["day"]]
        return [Days(days[0], days[-1])] if days else []

    def read(self, partition: Days) -> Iterator[tuple]:
        return asked(self.options | {"start": partition.first, "end": partition.last})


class QuoteSource(DataSource):
    """``spark.read.format("candle_quotes")`` with url, tickers, range, interval, start, end, token; ``spark.readStream`` with sessions
    (a JSON list of days and the seconds since 1970 at which they close) and after (the last day that is covered already)."""

    @classmethod
    def name(cls) -> str:
        return "candle_quotes"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))

    def streamReader(self, schema) -> QuoteStreamReader:
        return QuoteStreamReader(dict(self.options))


def quotes(spark: SparkSession, **options: str) -> DataFrame:
    """Quotes from the provider, one row each."""
    spark.dataSource.register(QuoteSource)
    body = spark.read.format("candle_quotes").options(**options).load()
    return body.select(F.from_json("body", QUOTE).alias("q")).select("q.*")


def quote_stream(spark: SparkSession, sessions: DataFrame, **options: str) -> DataFrame:
    """A stream of quotes of the calendar's ``sessions`` (dy, close_ts), each asked for once after it has closed; ``bars_of`` makes
    bars of it. The calendar, a row a day, is all that comes to the driver."""
    spark.dataSource.register(QuoteSource)
    days = sessions.select(F.col("dy").cast("string"), epoch_seconds(F.col("close_ts"))).collect()
    body = spark.readStream.format("candle_quotes").options(sessions=json.dumps([list(r) for r in days]), **options).load()
    return body.select(F.from_json("body", QUOTE).alias("q")).select("q.*")


def landed_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes from landed responses (JSON files with ``results``)."""
    rows = spark.read.schema(f"results array<struct<{', '.join(_ddl_fields())}>>").option("multiLine", True).json(path)
    return rows.select(F.inline("results"))


def _ddl_fields() -> list[str]:
    from pyspark.sql import types as T

    return [f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(QUOTE).fields]


def bars_of(quotes_: DataFrame) -> DataFrame:
    """Raw bars of quotes: symbol, ts, prices, adj_close, volume, ordinal (place in the answer)."""
    rows = quotes_.select(F.upper(F.trim("symbol")).alias("symbol"), F.posexplode("historicalDataPrice").alias("ordinal", "b"))
    return rows.select("symbol", from_epoch_or_text(F.col("b.date").cast("string")).alias("ts"), "b.open", "b.high", "b.low", "b.close", F.col("b.adjustedClose").alias("adj_close"), "b.volume", F.col("ordinal").cast("long"))


def available_of(rows: DataFrame) -> DataFrame:
    """Availability answers (stocks, indexes) as one column of tickers."""
    both = rows.select(F.explode("stocks").alias("t")).unionByName(rows.select(F.explode("indexes").alias("t")))
    return both.select(F.upper(F.trim("t")).alias("ticker")).distinct()
