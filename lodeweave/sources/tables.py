"""Knowledge sources: named, filterable, countable sets of documents, each an ordered run of text segments.

``documents`` gives source_key, external_id, title, metadata; ``segments`` gives source_key, external_id, position, text. Both are lazy frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeweave.functions.text import moment
from lodeweave.sources.filters import FilterSet

Values = dict[str, Any] | None


class KnowledgeSource(Protocol):
    """What every source offers."""

    key: str

    def documents(self, filters: Values = None) -> DataFrame: ...

    def segments(self, filters: Values = None) -> DataFrame: ...

    def count_documents(self, filters: Values = None) -> DataFrame: ...

    def find_document(self, external_id: str) -> DataFrame: ...


@dataclass(frozen=True)
class SegmentMap:
    """Where segments come from: a child table with ``foreign_key``, or a text column of the document itself."""

    text: str
    child: DataFrame | None = None
    foreign_key: str = ""
    position: str = ""
    order_by: str | None = None

    @staticmethod
    def column(text: str) -> SegmentMap:
        return SegmentMap(text)

    @staticmethod
    def relation(child: DataFrame, foreign_key: str, text: str, position: str, order_by: str | None = None) -> SegmentMap:
        return SegmentMap(text, child, foreign_key, position, order_by)


def _metadata(columns: dict[str, str | Column]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), (F.col(c) if isinstance(c, str) else c).cast("string"))])


@dataclass(frozen=True)
class TableSource:
    """One row, one document."""

    key: str
    table: DataFrame
    id_column: str
    map: SegmentMap
    title: str | None = None
    metadata: dict[str, str | Column] = field(default_factory=dict)
    scope: Callable[[DataFrame], DataFrame] | None = None
    filters: FilterSet = field(default_factory=FilterSet)
    updated_column: str | None = None

    def rows(self, filters: Values = None) -> DataFrame:
        return self.filters.apply(self.scope(self.table) if self.scope else self.table, filters)

    def _draft(self, rows: DataFrame) -> DataFrame:
        title = F.lit(None).cast("string") if self.title is None else F.when(F.col(self.title) != "", F.col(self.title).cast("string"))
        return rows.select(F.lit(self.key).alias("source_key"), F.col(self.id_column).cast("string").alias("external_id"), title.alias("title"), _metadata(self.metadata).alias("metadata"))

    def documents(self, filters: Values = None) -> DataFrame:
        return self._draft(self.rows(filters))

    def count_documents(self, filters: Values = None) -> DataFrame:
        return self.rows(filters).agg(F.count("*").alias("documents"))

    def find_document(self, external_id: str) -> DataFrame:
        """By id, whatever the scope and the filters say."""
        return self._draft(self.table.where(F.col(self.id_column).cast("string") == external_id)).limit(1)

    def segments(self, filters: Values = None) -> DataFrame:
        """Of a column: one segment at position 1, none for an empty text. Of a relation: the child's rows."""
        rows, m = self.rows(filters), self.map
        key = F.lit(self.key).alias("source_key")
        if m.child is None:
            own = rows.select(key, F.col(self.id_column).cast("string").alias("external_id"), F.lit(1).alias("position"), F.col(m.text).cast("string").alias("text"))
            return own.where(F.length("text") > 0)
        child = m.child.select(F.col(m.foreign_key).alias("_fk"), F.col(m.position).cast("int").alias("position"), F.col(m.text).cast("string").alias("text"))
        ids = rows.select(F.col(self.id_column).alias("_id"))
        return child.join(ids, F.col("_fk") == F.col("_id"), "left_semi").select(key, F.col("_fk").cast("string").alias("external_id"), "position", "text")


@dataclass(frozen=True)
class GroupedSource:
    """One group of rows, one document: ``group`` is a SQL expression, and rows in the order of ``order_by`` are its segments, from 1."""

    key: str
    table: DataFrame
    group: str
    text: str
    order_by: str | None = None
    title: str = ":group"
    filters: FilterSet = field(default_factory=FilterSet)
    scope: Callable[[DataFrame], DataFrame] | None = None

    def _rows(self) -> DataFrame:
        rows = self.scope(self.table) if self.scope else self.table
        return rows.withColumn("_group", F.expr(self.group).cast("string")).where(F.col("_group").isNotNull())

    def _matching(self, filters: Values) -> DataFrame:
        return self.filters.apply(self._rows(), filters)

    def documents(self, filters: Values = None) -> DataFrame:
        g = self._matching(filters).groupBy("_group").agg(F.count("*").alias("entries"))
        title = F.replace(F.lit(self.title), F.lit(":group"), F.col("_group"))
        return g.select(F.lit(self.key).alias("source_key"), F.col("_group").alias("external_id"), title.alias("title"), F.create_map(F.lit("entries"), F.col("entries").cast("string")).alias("metadata"))

    def count_documents(self, filters: Values = None) -> DataFrame:
        return self._matching(filters).agg(F.count_distinct("_group").alias("documents"))

    def find_document(self, external_id: str) -> DataFrame:
        return self.documents().where(F.col("external_id") == external_id)

    def segments(self, filters: Values = None) -> DataFrame:
        """Filters choose groups; of a chosen group all rows are read."""
        rows = self._rows()
        if filters:
            rows = rows.join(self._matching(filters).select("_group").distinct(), "_group", "left_semi")
        order = Window.partitionBy("_group").orderBy(*dict.fromkeys([self.order_by or self.text, self.text]))
        return rows.select(F.lit(self.key).alias("source_key"), F.col("_group").alias("external_id"), F.row_number().over(order).alias("position"), F.col(self.text).cast("string").alias("text"))


@dataclass(frozen=True)
class FunctionSource:
    """Documents and segments from functions; counting and finding go through all documents unless they have functions too."""

    key: str
    make_documents: Callable[[dict[str, Any]], DataFrame]
    make_segments: Callable[[dict[str, Any]], DataFrame]
    make_count: Callable[[dict[str, Any]], DataFrame] | None = None
    find: Callable[[str], DataFrame] | None = None

    def documents(self, filters: Values = None) -> DataFrame:
        return self.make_documents(filters or {})

    def segments(self, filters: Values = None) -> DataFrame:
        return self.make_segments(filters or {})

    def count_documents(self, filters: Values = None) -> DataFrame:
        return self.make_count(filters or {}) if self.make_count else self.documents(filters).agg(F.count("*").alias("documents"))

    def find_document(self, external_id: str) -> DataFrame:
        return self.find(external_id) if self.find else self.documents().where(F.col("external_id") == external_id).limit(1)


class SourceRegistry:
    """Sources by key; a source may be made when it is first asked for."""

    def __init__(self, exposed: list[str] | None = None):
        self._made: dict[str, KnowledgeSource] = {}
        self._makers: dict[str, Callable[[], KnowledgeSource]] = {}
        self._exposed = exposed

    def register(self, source: KnowledgeSource) -> None:
        self._made[source.key] = source

    def extend(self, key: str, make: Callable[[], KnowledgeSource]) -> None:
        self._makers[key] = make

    def keys(self) -> list[str]:
        return sorted({*self._made, *self._makers})

    def get(self, key: str) -> KnowledgeSource:
        if key not in self._made:
            if key not in self._makers:
                raise KeyError(f"unknown source {key!r}; known: {', '.join(self.keys())}")
            self._made[key] = self._makers[key]()
        return self._made[key]

    def exposed_keys(self) -> list[str]:
        """Keys that callers from outside may use: all, or those of the allow-list."""
        return [k for k in self.keys() if self._exposed is None or k in self._exposed]


def read_eval_cases(spark: SparkSession, path: str, categories: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Evaluation cases from a file with a JSON list: case_id (its place from 1, where none is given), question, category (``general``), sources, expected (document_id, source, page, pages).

    ``categories``, ``only``: those of these categories or with these ids. The file is one that people write by hand, so one task reads it.
    """
    schema = "array<struct<id:string,question:string,category:string,sources:array<string>,expected:array<struct<document_id:string,source:string,page:int,pages:array<int>>>>>"
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("n", "c"))
    cases = each.select(F.coalesce("c.id", (F.col("n") + 1).cast("string")).alias("case_id"), "c.question", F.coalesce("c.category", F.lit("general")).alias("category"), "c.sources", "c.expected")
    for name, values in (("category", categories), ("case_id", only)):
        cases = cases if not values else cases.where(F.col(name).isin(values))
    return cases


def prune_files(files: DataFrame, now: datetime, days: int) -> DataFrame:
    """Files that are kept: those created within the last ``days``."""
    return files.where(F.col("created_at") >= moment(now - timedelta(days=days)))
