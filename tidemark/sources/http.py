"""A Python data source for paged JSON over HTTP: candles, funding rates, filings.

spark.dataSource.register(JsonPages); spark.read.format("json_pages").schema(...).option("url", ...).load()

Options: url (with {symbol} and {after}), symbols (comma-separated; one partition each), path (dotted path of the list in a
page), fields (comma-separated keys or positions in the order of the schema), cursor (the field whose value of a page's last
row is the next {after}), more (text with {after} that follows url from the second page on), ok (key=value that a good page
holds; any other page ends the symbol), full (rows of a full page: a shorter one is the last), pages (most pages), tries, pause,
wait (seconds after an answer that asks for patience).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType


#: Fixed value: the status by which a server asks for patience.
TOO_MANY = 429


def get_json(url: str, tries: int = 3, pause: float = 0.6, opener: Callable = urllib.request.urlopen, wait: float = 20.0) -> object | None:
    """The parsed page, or None after `tries` failures; after an answer of too many requests it waits longer."""
    for i in range(tries):
        try:
            with opener(url, timeout=20) as page:
                return json.load(page)
        except urllib.error.HTTPError as e:
            if i + 1 < tries:
                time.sleep(wait if e.code == TOO_MANY else pause)
        except (OSError, ValueError):
            if i + 1 < tries:
                time.sleep(pause)
    return None


def dig(page: object, path: str) -> list:
    for part in filter(None, path.split(".")):
        page = page.get(part) if isinstance(page, dict) else None
    return page if isinstance(page, list) else []


def good(page: object, ok: str) -> bool:
    """Whether the page holds the key and value of ok; an error payload doesn't."""
    key, _, value = ok.partition("=")
    return not key or (isinstance(page, dict) and str(page.get(key)) == value)


def convert(value: object, kind: object) -> object:
    """value as kind, None if it can't be."""
    try:
        if value is None or value == "":
            return None
        if isinstance(kind, DoubleType):
            return float(value)
        if isinstance(kind, (IntegerType, LongType)):
            return int(value)
        return str(value)
    except (TypeError, ValueError):
        return None


class Symbol(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.kinds = [f.dataType for f in schema.fields]
        self.options = dict(options)

    def partitions(self) -> list[Symbol]:
        return [Symbol(s.strip()) for s in self.options.get("symbols", "").split(",")]

    def read(self, partition: Symbol) -> Iterator[tuple]:
        o = self.options
        fields = [f.strip() for f in o["fields"].split(",")]
        cursor, after, seen = o.get("cursor"), "", set()
        pick = lambda row, f: partition.name if f == "@symbol" else (row.get(f) if isinstance(row, dict) else row[int(f)] if int(f) < len(row) else None)
        for _ in range(int(o.get("pages", 1))):
            url = o["url"] + (o.get("more", "") if after else "")
            page = get_json(url.format(symbol=partition.name, after=after), int(o.get("tries", 3)), float(o.get("pause", 0.6)), wait=float(o.get("wait", 20)))
            rows = dig(page, o.get("path", "")) if good(page, o.get("ok", "")) else []
            for row in rows:
                yield tuple(convert(pick(row, f), k) for f, k in zip(fields, self.kinds))
            after = str(pick(rows[-1], cursor)) if rows and cursor else ""
            if not after or after in seen or len(rows) < int(o.get("full", 0)):
                return
            seen.add(after)


class JsonPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)


#: A public exchange's pages of candles and of funding rates, newest first.
CANDLES = "https://www.okx.com/api/v5/market/history-candles?instId={symbol}&bar=%s&limit=100"
FUNDING = "https://www.okx.com/api/v5/public/funding-rate-history?instId={symbol}&limit=100"


def read_pages(spark: SparkSession, url: str, symbols: list[str], schema: str, fields: str, cursor: str, pages: int, **options) -> DataFrame:
    """(asset, bar_ts, columns of schema) of paged symbols whose rows start with epoch milliseconds; of rows with equal time the
    greatest counts."""
    spark.dataSource.register(JsonPages)
    names = [c.split()[0] for c in schema.split(", ")]
    o = {"path": "data", "ok": "code=0", "full": "100", "more": "&after={after}", "pause": "0.15", **options}
    d = spark.read.format("json_pages").schema(f"asset string, ms bigint, {schema}").option("url", url).option("symbols", ",".join(symbols))
    d = d.option("fields", f"@symbol,{fields}").option("cursor", cursor).option("pages", pages).options(**o).load().where("ms is not null")
    best = d.groupBy("asset", "ms").agg(F.max(F.struct(*names)).alias("r"))
    return best.select("asset", F.timestamp_millis("ms").alias("bar_ts"), "r.*")


def read_candles(spark: SparkSession, symbols: list[str], width: str = "1H", pages: int = 400, url: str | None = None, **options) -> DataFrame:
    """(asset, bar_ts, open, high, low, close): candles of `width` ('1H', '1D')."""
    return read_pages(spark, url or CANDLES % width, symbols, "open double, high double, low double, close double", "0,1,2,3,4", "0", pages, **options)


def read_funding(spark: SparkSession, symbols: list[str], pages: int = 200, url: str | None = None, **options) -> DataFrame:
    """(asset, bar_ts, rate): funding rates."""
    return read_pages(spark, url or FUNDING, symbols, "rate double", "fundingTime,fundingRate", "fundingTime", pages, **options)
