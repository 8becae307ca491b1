"""A Python data source for services that hand out features in pages.

``paged.read(spark, url, layer, "name string, length double")``, or ``spark.read.format("pages")`` with options. What a query
does not need does not travel: only declared properties are asked for, filters on the box columns or on ``fid`` go with the
requests, and a request for the number of hits tells the pages beforehand. ``fetch`` is the one place that opens a connection.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StructType

from rillflow.sources.layers import LayerTooLarge

PAGE = 5000
TRIES = 3
CODES_A_REQUEST = 100
IN_FLIGHT = 8


def fetch(url: str, timeout: float = 60, delay: float = 2.0, tries: int = TRIES, empty: bool = False) -> bytes:
    """Content of a URL; server and network errors, and empty replies unless allowed, are tried again with growing delay, client errors are not."""
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                if (body := reply.read()) or empty:
                    return body
                raise OSError("empty reply")
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == tries:
                raise
        except OSError:
            if k == tries:
                raise
        time.sleep(delay * k)
    raise AssertionError


def page_url(base: str, layer: str, **more: object) -> str:
    query = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typenames": layer} | {k: v for k, v in more.items() if v not in (None, "")}
    return f"{base}?{urllib.parse.urlencode(query)}"


def features(url: str, empty: bool = False, delay: float = 2.0, tries: int = TRIES) -> list[dict]:
    """Features of one reply. One that cannot be read is asked for again under another URL, so that no cache hands it out anew.

    With ``empty``, a reply without content has no features; else it counts as an error.
    """
    for k in range(tries):
        try:
            return json.loads(fetch(f"{url}&_again={k}" if k else url, delay=delay, tries=tries, empty=empty) or b"{}").get("features") or []
        except ValueError:
            if k == tries - 1:
                raise
        time.sleep(delay * (k + 1))
    raise AssertionError


def hits(base: str, layer: str, **more: object) -> int | None:
    """Number of features that a service would hand out, or None if it does not tell."""
    found = re.search(rb'numberMatched="(\d+)"|"numberMatched"\s*:\s*(\d+)', fetch(page_url(base, layer, resulttype="hits", **more)))
    return int(found[1] or found[2]) if found else None


#: Columns that are not properties.
_SHAPE = ("kind", "coordinates", "xmin", "ymin", "xmax", "ymax")
_OWN = ("fid", "ord", "properties", *_SHAPE)


def read(spark: SparkSession, url: str, layer: str, columns: str | None = None, **options: object) -> DataFrame:
    """Features of a layer: fid, ord, kind, coordinates, box and the properties that ``columns`` declares (without it: all, as JSON)."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = PagedSource.base + (f", {columns}" if columns else ", properties string")
    return spark.read.format("pages").schema(schema).options(url=url, layer=layer, **options).load()


class PagedSource(DataSource):
    """Options: url, layer; page_size; parallel (requests at once, at most); limit (more features are an error, before any page is read);
    bbox (goes with each request, in place of filters); geometry (its property's name); empty (an empty reply is a page without features);
    box_filters ("false" for services that test a box against shapes, not boxes, as filters on the box columns would then lose features).

    A declared schema takes of fid, ord, properties (JSON), kind, coordinates, xmin, ymin, xmax, ymax what it needs; all other columns are
    properties: text, numbers or booleans, null where absent or not of the kind. ``ord`` is the place in the service's answer.
    """

    base = "fid string, ord long, kind string, coordinates string, xmin double, ymin double, xmax double, ymax double"

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return f"{self.base}, properties string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


@dataclass
class Pages(InputPartition):
    """Pages that one task reads, one after the other: from ``start`` to ``stop`` (None: until one is not full), or lists of ids."""

    start: int = 0
    stop: int | None = None
    ids: tuple[tuple[str, ...], ...] | None = None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.base, self.layer, self.schema = options["url"], options["layer"], schema
        self.size, self.parallel = int(options.get("page_size", PAGE)), max(1, int(options.get("parallel", IN_FLIGHT)))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.bbox, self.geometry, self.empty = options.get("bbox"), options.get("geometry", "geom"), options.get("empty", "false") == "true"
        self.given, self.box_filters = bool(self.bbox), options.get("box_filters", "true") == "true"
        self.ids: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Boxes and ids go with the requests; Spark tests all filters again, as a service may hand out more."""
        if self.given:
            return filters
        sides: dict[str, float] = {}
        for f in filters:
            column, value = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, getattr(f, "value", None)
            if column in ("xmin", "ymin") and isinstance(f, (LessThan, LessThanOrEqual)):
                sides[column] = min(float(value), sides.get(column, float("inf")))
            elif column in ("xmax", "ymax") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                sides[column] = max(float(value), sides.get(column, float("-inf")))
            elif column == "fid" and isinstance(f, (EqualTo, In)):
                some = {str(v) for v in (value if isinstance(f, In) else (value,)) if v is not None}
                self.ids = sorted(some if self.ids is None else some & set(self.ids))
        if self.ids is None and len(sides) == 4 and self.box_filters:
            xs, ys = sorted((sides["xmin"], sides["xmax"])), sorted((sides["ymin"], sides["ymax"]))
            self.bbox = ",".join(map(repr, (xs[0], ys[0], xs[1], ys[1])))
        return filters

    def _columns(self) -> str | None:
        names = self.schema.fieldNames()
        asked = [n for n in names if n not in _OWN]
        if any(n in _SHAPE for n in names):
            asked.append(self.geometry)
        return None if "properties" in names else ",".join(asked) or None

    def partitions(self) -> list[InputPartition]:
        """At most ``parallel``, so that no more requests are on their way; a lost executor repeats its partition's pages only."""
        if self.ids is not None:
            lists = [tuple(self.ids[k : k + CODES_A_REQUEST]) for k in range(0, len(self.ids), CODES_A_REQUEST)]
            return [Pages(ids=tuple(lists[k :: self.parallel])) for k in range(max(1, min(self.parallel, len(lists))))]
        total = hits(self.base, self.layer, bbox=self.bbox)
        if total is None:
            return [Pages()]
        if self.limit is not None and total > self.limit:
            raise LayerTooLarge(self.limit)
        pages = -(-total // self.size)
        cuts = [k * pages // min(self.parallel, pages or 1) * self.size for k in range(min(self.parallel, pages or 1) + 1)]
        return [Pages(a, b) for a, b in zip(cuts[:-1], cuts[1:])]

    def read(self, partition: Pages) -> Iterator:
        ask = {"outputformat": "application/json", "propertyname": self._columns()}
        if partition.ids is not None:
            for k, some in enumerate(partition.ids):
                found = features(page_url(self.base, self.layer, resourceid=",".join(some), **ask), self.empty)
                yield from self._batch(found, k * CODES_A_REQUEST)
            return
        start = partition.start
        while partition.stop is None or start < partition.stop:
            found = features(page_url(self.base, self.layer, startindex=start, count=self.size, bbox=self.bbox, **ask), self.empty)
            if partition.stop is None and self.limit is not None and start + len(found) > self.limit:
                raise LayerTooLarge(self.limit)
            yield from self._batch(found, start)
            start += self.size
            if partition.stop is None and len(found) < self.size:
                return

    def _batch(self, found: list[dict], start: int) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        if not found:
            return
        shapes = [f.get("geometry") or {} for f in found]
        boxes = [_box(g.get("coordinates")) for g in shapes]
        own = {
            "fid": lambda: [str(f.get("id", "")) for f in found],
            "ord": lambda: list(range(start, start + len(found))),
            "properties": lambda: [json.dumps(f.get("properties") or {}, ensure_ascii=False) for f in found],
            "kind": lambda: [g.get("type") for g in shapes],
            "coordinates": lambda: [json.dumps(g["coordinates"]) if g.get("coordinates") is not None else None for g in shapes],
        } | {n: lambda k=k: [b and b[k] for b in boxes] for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))}
        columns = []
        for field in self.schema:
            values = own[field.name]() if field.name in own else [_as(field.dataType, (f.get("properties") or {}).get(field.name)) for f in found]
            columns.append(pa.array(values, to_arrow_type(field.dataType)))
        yield pa.record_batch(columns, names=self.schema.fieldNames())


def _box(coordinates: object) -> tuple[float, float, float, float] | None:
    """Box of coordinates nested to any depth; None if there are none."""
    xs: list[float] = []
    ys: list[float] = []
    waiting = [coordinates]
    while waiting:
        c = waiting.pop()
        if c and isinstance(c, list):
            if isinstance(c[0], list):
                waiting += c
            else:
                xs.append(float(c[0]))
                ys.append(float(c[1]))
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def _as(kind: DataType, value: object) -> object:
    """A property as a declared type; null if it is not of the kind."""
    if value is None:
        return None
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (IntegralType, FractionalType)):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        if isinstance(kind, FractionalType):
            return number
        return int(value) if number.is_integer() else None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def records(codes: DataFrame, column: str, url: str, parameter: str, size: int = PAGE, chunk: int = CODES_A_REQUEST) -> DataFrame:
    """Records (record: JSON, codes: those of its request) of a service that takes lists of codes, all pages of each list.

    Each partition of the distinct codes asks for its own lists of ``chunk`` and follows the ``next`` links of the replies;
    its loss repeats its requests only. Codes that are null or empty are not asked for. Replies without data have no rows.
    """

    def ask(batches):
        import pyarrow as pa

        def replies(some: list[str]) -> Iterator[pa.RecordBatch]:
            more, seen = f"{url}?{urllib.parse.urlencode({parameter: ','.join(some), 'size': size})}", set()
            while more and more not in seen:
                seen.add(more)
                reply = json.loads(fetch(more))
                rows = [json.dumps(r, ensure_ascii=False) for r in reply.get("data") or []]
                yield pa.record_batch([pa.array(rows, pa.string()), pa.array([",".join(some)] * len(rows), pa.string())], names=["record", "codes"])
                more = reply.get("next")

        waiting: list[str] = []
        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= chunk:
                some, waiting = waiting[:chunk], waiting[chunk:]
                yield from replies(some)
        if waiting:
            yield from replies(waiting)

    wanted = codes.select(F.col(column).cast("string").alias("code")).where("code <> ''").distinct()
    return wanted.mapInArrow(ask, "record string, codes string")
