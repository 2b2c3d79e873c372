"""Sources that Python code pages through (an API, an archive, another database), read in parallel.

The space of document ids is cut at ``bounds``; each piece is a partition, whose rows a generator yields on a worker, so neither the driver nor a task holds more than a batch of them. Conditions on the id are pushed down:
pieces that can't have a wanted id aren't opened, and the others are asked for the narrower range alone. A piece that is lost with its executor is asked for again, so the functions must give the same rows for the same range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodeweave.sources.tables import FunctionSource

#: Rows of ids from the first one (None: the least of all) up to, and without, the second (None: no end).
Fetch = Callable[[str | None, str | None], Iterable[tuple]]

DOCUMENTS = "external_id string, title string, metadata map<string,string>"
SEGMENTS = "external_id string, position int, text string"


def after(value: str) -> str:
    """The id that comes next in order."""
    return value + "\u0000"


def narrowed(ranges: list[tuple[str | None, str | None]], low: str | None, high: str | None) -> list[tuple[str | None, str | None]]:
    """What of each range lies between ``low`` and ``high``; ranges of which nothing does are left out."""
    out = []
    for a, b in ranges:
        a = a if low is None else low if a is None else max(a, low)
        b = b if high is None else high if b is None else min(b, high)
        if a is None or b is None or a < b:
            out.append((a, b))
    return out


def pushed(ranges: list[tuple[str | None, str | None]], filters: Iterable[Filter], column: str) -> list[tuple[str | None, str | None]]:
    """The ranges that conditions on the id leave. Spark compares strings by code points, as Python does."""
    for f in filters:
        if getattr(f, "attribute", None) != (column,):
            continue
        v: Any = getattr(f, "value", None)
        if isinstance(f, EqualTo):
            ranges = narrowed(ranges, v, after(v))
        elif isinstance(f, In):
            ranges = [r for one in sorted(set(f.value)) for r in narrowed(ranges, one, after(one))]
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            ranges = narrowed(ranges, v if isinstance(f, GreaterThanOrEqual) else after(v), None)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            ranges = narrowed(ranges, None, v if isinstance(f, LessThan) else after(v))
    return ranges


def paged_frame(spark: SparkSession, name: str, columns: str, bounds: Sequence[str], fetch: Fetch) -> DataFrame:
    """The rows of ``fetch`` over all ids, a partition between each two ``bounds``; the first of ``columns`` is the id. ``name`` is registered in the session, whose Python sources then take filters."""
    cuts = [None, *sorted(set(bounds)), None]
    pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
    column = columns.split()[0]

    class Reader(DataSourceReader):
        def __init__(self) -> None:
            self.ranges = pieces

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
            self.ranges = pushed(self.ranges, filters, column)
            return filters  # Spark applies all of them again

        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(r) for r in self.ranges or [("", "")]]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            low, high = partition.value
            if high != "":
                yield from fetch(low, high)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def paged_source(spark: SparkSession, key: str, bounds: Sequence[str], documents: Fetch, segments: Fetch) -> FunctionSource:
    """A source of documents (id, title, metadata) and segments (id, position, text) that functions page through. Its filter ``external_ids`` is a list; nothing else is filtered. A null id is left out."""

    def rows(kind: str, columns: str, fetch: Fetch) -> Callable[[dict[str, Any]], DataFrame]:
        def make(filters: dict[str, Any]) -> DataFrame:
            found = paged_frame(spark, f"{key}_{kind}", columns, bounds, fetch).where("external_id IS NOT NULL")
            if filters.get("external_ids") is not None:
                found = found.where(F.col("external_id").isin(list(filters["external_ids"])))
            return found.select(F.lit(key).alias("source_key"), "*")

        return make

    return FunctionSource(key, rows("documents", DOCUMENTS, documents), rows("segments", SEGMENTS, segments))


def parquet_rows(path: str, id_column: str, columns: Sequence[str], low: str | None, high: str | None) -> Iterator[tuple]:
    """(id as text, columns) of Parquet files whose ids lie from ``low`` up to, and without, ``high``. A scan of a dataset holds whole row groups, and several of them ahead; this holds pages of one, and a batch."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    for piece in ds.dataset(path).get_fragments():
        with piece.open() as f:
            for batch in pq.ParquetFile(f, buffer_size=1 << 18, pre_buffer=False).iter_batches(256, columns=[id_column, *columns], use_threads=False):
                key = batch[id_column].cast("string")
                within = pc.greater_equal(key, low or "")
                wanted = batch.filter(within if high is None else pc.and_(within, pc.less(key, high)))
                yield from zip(wanted[id_column].cast("string").to_pylist(), *(wanted[c].to_pylist() for c in columns), strict=True)
