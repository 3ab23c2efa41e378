"""A Spark data source for paged kline services: one partition a symbol and page, with retries; rows come as strings, as served."""

from __future__ import annotations

import json
import random
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .market import TIMEFRAMES, from_rows

PAGE = 1000


def delay(attempt: int, header: str | None, base: float = 0.5, most: float = 30.0) -> float:
    """Seconds to wait: what the service asks for, else doubling with jitter."""
    if header:
        try:
            return min(most, float(header))
        except ValueError:
            pass
    return min(most, base * 2**attempt) * (0.5 + random.random() / 2)


def payload(body: bytes) -> list:
    """The rows of an answer: a list, or the data (or its list) of an envelope with a zero code. Raises ValueError otherwise."""
    found = json.loads(body)
    if isinstance(found, dict):
        if found.get("code") not in (0, None):
            raise ValueError(f"service error {found.get('code')}")
        found = found.get("data")
        found = found.get("list", []) if isinstance(found, dict) else found
    if not isinstance(found, list):
        raise ValueError("no rows in the answer")
    return found


def fetch(url: str, tries: int = 4) -> list:
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=15) as answer:
                return payload(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in (418, 429) and e.code < 500 or attempt == tries - 1:
                raise
            time.sleep(delay(attempt, e.headers.get("Retry-After")))
        except urllib.error.URLError:
            if attempt == tries - 1:
                raise
            time.sleep(delay(attempt, None))
    return []


@dataclass
class Page(InputPartition):
    symbol: str
    start: int
    end: int


class KlineReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeframe = options["url"], options.get("timeframe", "1m")
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.start, self.end = int(options["start_ms"]), int(options["end_ms"])

    def partitions(self) -> list[Page]:
        width = TIMEFRAMES[self.timeframe] * PAGE
        return [Page(s, at, min(self.end, at + width) - 1) for s in self.symbols for at in range(self.start, self.end, width)]

    def read(self, page: Page) -> Iterator[tuple]:
        fields = {"symbol": page.symbol, "interval": self.timeframe, "startTime": page.start, "endTime": page.end, "limit": PAGE}
        url = self.url if self.url.startswith("file:") else f"{self.url}?{urllib.parse.urlencode(fields)}"
        for row in fetch(url):
            if page.start <= int(row[0]) <= page.end:
                yield page.symbol, self.timeframe, [str(x) for x in row]


class Klines(DataSource):
    """Options: url, symbols (comma-joined), timeframe, start_ms, end_ms."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, timeframe string, row array<string>"

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)


def read_klines(spark: SparkSession, **options) -> DataFrame:
    """Candles of a service."""
    spark.dataSource.register(Klines)
    return from_rows(spark.read.format("klines").options(**{k: str(v) for k, v in options.items()}).load())


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines or CSV with a header."""
    (df.write.mode("overwrite").option("header", "true").csv if kind == "csv" else df.write.mode("overwrite").json)(path)
