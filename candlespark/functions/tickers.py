"""Column rules for tickers, names and other short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespark.schemas import FREE_TICKERS, FUTURE_ROOTS, MONTH_CODES, RANGES


def normal(ticker: Column) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(ticker))


# Shapes of tickers by kind, in the order in which they are tried.
SHAPES = (
    (r"\^[A-Z0-9]{3,6}", "index"),
    ("[A-Z0-9]{2,10}-[A-Z]{3}", "crypto"),
    ("[A-Z]{4}(31|32|33|34|35|39)", "bdr"),
    ("[A-Z]{4}11", "unit"),
    ("[A-Z]{4}[345678]", "stock"),
    (f"({'|'.join(FUTURE_ROOTS)})([{MONTH_CODES}][0-9]{{2}})?", "future"),
)


def classify(ticker: Column) -> Column:
    """Instrument kind by the ticker's shape, null for unknown shapes."""
    t = normal(ticker)
    return F.coalesce(*[F.when(t.rlike(f"^{shape}$"), F.lit(kind)) for shape, kind in SHAPES])


def default_lot(kind: Column) -> Column:
    """Lot size that a kind starts with."""
    return F.when(kind.isin("stock", "unit"), 100).otherwise(1)


def default_tick(kind: Column) -> Column:
    """Tick size that a kind starts with."""
    return F.when(kind == "index", F.lit(1.0)).otherwise(F.lit(0.01))


def display_name(ticker: Column, short: Column, long: Column) -> Column:
    """The long name, else a short name that isn't the ticker, else the ticker."""
    short_ok = (F.trim(short) != "") & (F.lower(F.trim(short)) != F.lower(ticker))
    return F.coalesce(F.nullif(F.trim(long), F.lit("")), F.when(short_ok, F.trim(short)), ticker)


def split_list(text: Column) -> Column:
    """Comma list as upper-case items without empty ones."""
    return F.filter(F.transform(F.split(text, ","), normal), lambda x: x != "")


def join_list(items: Column, shown: int) -> Column:
    """``a, b and n more``."""
    rest = F.size(items) - shown
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.when(rest > 0, F.concat(head, F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(head)


def valid_ticker(ticker: Column) -> Column:
    """True for a ticker that a request path can hold."""
    return (F.trim(ticker) != "") & ~ticker.rlike(r"[\s/?&#%]")


def reachable(ticker: Column, has_token: bool, free: tuple[str, ...] = FREE_TICKERS) -> Column:
    """True where the provider answers: with a token always, else for the free tickers."""
    return F.lit(has_token) | normal(ticker).isin(*free)


def intraday_range(days: Column) -> Column:
    """Smallest range token that covers so many days."""
    rule = F.when(days <= RANGES[0][1], RANGES[0][0])
    for token, most in RANGES[1:]:
        rule = rule.when(days <= most, token)
    return rule.otherwise("max")


def check_intraday_range(token: str) -> str:
    """``token`` where it can be used for 5m; ValueError lists the valid ones."""
    known = [t for t, _ in RANGES] + ["max"]
    if token not in known:
        raise ValueError(f"5m series can't be asked for by {token!r}; ranges: {' '.join(known)}")
    return token


def months_ok(months: Column) -> Column:
    """True where every character is a contract month code."""
    return (months != "") & F.forall(F.split(months, ""), lambda c: F.instr(F.lit(MONTH_CODES), c) > 0)


def etag(body: Column) -> Column:
    """Quoted SHA-256 of a response body."""
    return F.concat(F.lit('"'), F.sha2(body.cast("binary"), 256), F.lit('"'))


def etag_matches(header: Column, tag: Column) -> Column:
    """True where an If-None-Match list holds the tag, a weak form of it, or a star."""
    items = F.transform(F.split(header, ","), lambda x: F.regexp_replace(F.trim(x), "^W/", ""))
    return F.array_contains(items, tag) | F.array_contains(items, F.lit("*"))
