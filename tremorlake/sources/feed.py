"""A catalog service that answers queries by time, magnitude and box with comma-separated text, as a data source.

``spark.dataSource.register(QuakeFeed)``, then ``spark.read.format("quake_feed").option("url", ...)`` with ``start``, ``end``
(ISO dates) and ``days`` of a request. Every span of days is a partition with a request of its own. Options of the
service's names (``minmagnitude``, ``minlatitude`` and so on) go into every request.

``FilteredQuakeFeed`` makes filters on time, magnitude and place parameters of the requests too, and does not ask for spans
that they leave out. Spark keeps the first plan of a loaded frame of it, so each query needs a frame loaded for it.
"""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source_catalog string, native_event_id string, origin_time timestamp, latitude double, longitude double, depth_km double, original_magnitude double, magnitude_type string, magnitude_uncertainty double, horizontal_uncertainty_km double, n_stations long, gap_deg double, quality_flag string"
# Parameters of the service for the least and the largest value of a column.
BOUNDS = {"original_magnitude": ("minmagnitude", "maxmagnitude"), "latitude": ("minlatitude", "maxlatitude"), "longitude": ("minlongitude", "maxlongitude")}
TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


class Span(InputPartition):
    def __init__(self, start: datetime, end: datetime):
        self.start, self.end = start, end


def _utc(value: str) -> datetime:
    """ISO time, in UTC where it names no zone."""
    t = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text and text.strip() else None
    except ValueError:
        return None


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.attempts = options["url"], int(options.get("attempts", "3"))
        self.start, self.end = _utc(options["start"]), _utc(options["end"])
        self.days = float(options.get("days", "30"))
        self.filters: list[tuple[type, str, object]] = []
        for column, names in BOUNDS.items():
            self.filters += [(kind, column, float(options[name])) for kind, name in zip((GreaterThanOrEqual, LessThanOrEqual), names, strict=True) if name in options]

    def _range(self, column: str) -> tuple[object | None, object | None]:
        low = [v for kind, c, v in self.filters if c == column and kind in (EqualTo, GreaterThan, GreaterThanOrEqual)]
        high = [v for kind, c, v in self.filters if c == column and kind in (EqualTo, LessThan, LessThanOrEqual)]
        return max(low, default=None), min(high, default=None)

    def partitions(self) -> list[Span]:
        low, high = self._range("origin_time")
        # The last microsecond of a range that a filter includes is asked for too.
        start, end = max(self.start, low or self.start), min(self.end, high + timedelta(microseconds=1) if high else self.end)
        spans = []
        while start < end:
            stop = min(end, start + timedelta(days=self.days))
            spans.append(Span(start, stop))
            start = stop
        return spans

    def _text(self, span: Span) -> str:
        stamp = lambda t: t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
        asked: dict[str, object] = {"format": "csv", "starttime": stamp(span.start), "endtime": stamp(span.end), "orderby": "time-asc"}
        for column, names in BOUNDS.items():
            asked |= {name: value for name, value in zip(names, self._range(column), strict=True) if value is not None}
        for attempt in range(self.attempts):
            try:
                with urlopen(f"{self.url}?{urlencode(asked)}", timeout=180) as answer:
                    return answer.read().decode("utf-8")
            except (URLError, TimeoutError) as e:
                # A refused question stays refused; a service that is busy is asked again.
                if attempt + 1 == self.attempts or isinstance(e, HTTPError) and e.code < 500 and e.code != 429:
                    raise
                time.sleep(min(30.0, 0.5 * 2**attempt))
        return ""

    def read(self, partition: Span) -> Iterator[tuple]:
        """Rows of a span, without those that have no magnitude, time or place. Spans share no row."""
        flags = {"reviewed": "reviewed", "automatic": "automatic"}
        for r in csv.DictReader(io.StringIO(self._text(partition))):
            magnitude, lat, lon = (_number(r.get(c)) for c in ("mag", "latitude", "longitude"))
            if magnitude is None or lat is None or lon is None or not r.get("time"):
                continue
            at = _utc(r["time"])
            mine = {"origin_time": at, "original_magnitude": magnitude, "latitude": lat, "longitude": lon}
            if not partition.start <= at < partition.end or not all(TESTS[kind](mine[c], v) for kind, c, v in self.filters):
                continue
            stations = _number(r.get("nst"))
            yield (
                "usgs", r.get("id"), at, lat, lon, _number(r.get("depth")), magnitude, (r.get("magType") or "").strip().lower(), _number(r.get("magError")),
                _number(r.get("horizontalError")), None if stations is None else int(stations), _number(r.get("gap")), flags.get((r.get("status") or "").strip().lower(), "unknown"),
            )


class PushingReader(FeedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of time, magnitude and place; their rows are tested here, so Spark need not do it again."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in ("origin_time", *BOUNDS):
                value = f.value.astimezone(timezone.utc) if isinstance(f.value, datetime) else f.value
                self.filters.append((type(f), f.attribute[0], value))
            else:
                yield f


class QuakeFeed(DataSource):
    """Observations of a query service, selected by the options alone."""

    @classmethod
    def name(cls) -> str:
        return "quake_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


class FilteredQuakeFeed(QuakeFeed):
    """The same with filters pushed to the service; ``spark.sql.python.filterPushdown.enabled`` must be set."""

    @classmethod
    def name(cls) -> str:
        return "filtered_quake_feed"

    def reader(self, schema) -> FeedReader:
        return PushingReader(self.options)
