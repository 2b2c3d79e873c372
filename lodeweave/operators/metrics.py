"""Declarative metrics: measures by dimensions over periods, compiled to one aggregate each.

A dimension may be a path of many-to-one relations (``customer.nation.name``): each relation is joined once, from the left, whatever number of
dimensions uses it, and only if a dimension that is asked for does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import moment
from lodeweave.operators.periods import Period, Refusal, resolve
from lodeweave.sources.filters import is_blank

BUCKETS = ("day", "week", "month", "year")
RESERVED = ("period", "from", "to", "compare", "group_by", "sort_by", "limit", "series")


@dataclass(frozen=True)
class Measure:
    """``of`` is a column or a SQL expression. Counts are integers; others are divided by ``divisor`` and rounded to 2 digits. Nothing sums to 0."""

    name: str
    kind: str
    of: str | None = None
    distinct: bool = False
    unit: str = ""
    divisor: float = 1
    when: Callable[[Any], bool] | None = None

    def raw(self) -> Column:
        if self.kind == "count":
            return F.count_distinct(F.expr(self.of)) if self.distinct and self.of else F.count("*")
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.kind](F.expr(self.of or "1").cast("double"))

    def shown(self, raw: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(raw, F.lit(0)).cast("long")
        return F.round(F.coalesce(raw, F.lit(0.0)) / F.lit(float(self.divisor)), 2)


@dataclass(frozen=True)
class Relation:
    """A many-to-one relation: this frame's ``key`` equals ``foreign_key`` of the frame that it hangs on."""

    frame: DataFrame
    foreign_key: str
    key: str
    relations: dict[str, Relation] = field(default_factory=dict)


@dataclass(frozen=True)
class Dimension:
    """A column of the base, or a path of relations that ends in a column; or a join of one's own with a column."""

    name: str
    path: str
    join: Callable[[DataFrame], DataFrame] | None = None
    when: Callable[[Any], bool] | None = None


@dataclass(frozen=True)
class MetricFilter:
    """Narrows the base by an argument that isn't blank; ``options`` lists the values that it may have."""

    name: str
    apply: Callable[[DataFrame, Any], DataFrame]
    options: Sequence[str] | None = None
    when: Callable[[Any], bool] | None = None


@dataclass(frozen=True)
class MetricDefinition:
    """A base frame with its date column, and what can be asked of it."""

    name: str
    base: DataFrame
    date_column: str
    measures: tuple[Measure, ...]
    dimensions: tuple[Dimension, ...] = ()
    filters: tuple[MetricFilter, ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)
    periods: dict[str, tuple[str, str]] = field(default_factory=dict)


def bucket(c: Column, unit: str) -> Column:
    """The label of a date's day, ISO week (2026-W05), month or year."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), c).cast("string"), 2, "0"))
    return F.date_format(c, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


class MetricQuery:
    """A narrowed base, ready for totals, groups and series."""

    def __init__(self, definition: MetricDefinition, frame: DataFrame, period: Period):
        self.definition, self.period = definition, period
        low, high = map(moment, period.bounds)
        self.frame = frame.where(F.col(definition.date_column).between(low, high))

    def _key(self, dimension: Dimension) -> tuple[DataFrame, Column]:
        """The frame with the dimension's relations joined, and its column."""
        if dimension.join:
            return dimension.join(self.frame), F.col(dimension.path)
        *steps, column = dimension.path.split(".")
        frame, known, at = self.frame, self.definition.relations, ""
        for step in steps:
            if step not in known:
                raise Refusal(f"dimension [{dimension.name}]: no relation [{step}].")
            r, here = known[step], f"{at}{step}__"
            # only the key, the column or the next foreign key of a relation are read
            side = r.frame.select(*[F.col(c).alias(f"{here}{c}") for c in r.frame.columns])
            frame = frame.join(side, F.col(f"{at}{r.foreign_key}") == F.col(f"{here}{r.key}"), "left")
            known, at = r.relations, here
        return frame, F.col(f"{at}{column}")

    def totals(self, measures: Sequence[Measure]) -> DataFrame:
        """One row, for an empty base too."""
        return self.frame.agg(*[m.shown(m.raw()).alias(m.name) for m in measures])

    def groups(self, dimension: Dimension, measures: Sequence[Measure], sort_by: str | None = None, limit: int = 10) -> DataFrame:
        """The ``limit`` (1 to 50) groups with the largest raw ``sort_by`` (the first measure), then by key; a null key is a group."""
        frame, key = self._key(dimension)
        raw = frame.groupBy(key.alias(dimension.name)).agg(*[m.raw().alias(f"_{m.name}") for m in measures])
        top = raw.orderBy(F.col(f"_{sort_by or measures[0].name}").desc_nulls_last(), F.col(dimension.name).asc_nulls_last()).limit(min(50, max(1, limit)))
        return top.select(dimension.name, *[m.shown(F.col(f"_{m.name}")).alias(m.name) for m in measures])

    def series(self, unit: str, measures: Sequence[Measure]) -> DataFrame:
        """By day, week, month or year, in order; without empty buckets."""
        key = bucket(F.col(self.definition.date_column), unit)
        return self.frame.groupBy(key.alias("bucket")).agg(*[m.shown(m.raw()).alias(m.name) for m in measures]).orderBy("bucket")


def change(value: Column, before: Column, whole: bool) -> tuple[Column, Column]:
    """(difference, percent with 1 digit, null where there was nothing)."""
    diff = value - before
    percent = F.when(before != 0, F.round(diff / F.abs(before) * 100, 1))
    return (diff if whole else F.round(diff, 2)), percent


class Metric:
    """A metric that is asked with arguments; wrong ones are refused in words (``Refusal``)."""

    def __init__(self, definition: MetricDefinition, context: Any = None, today: date | None = None):
        self.definition, self.context, self.today = definition, context, today

    def _open(self, things: Sequence[Any]) -> dict[str, Any]:
        return {t.name: t for t in things if t.when is None or t.when(self.context)}

    def _narrowed(self, arguments: dict[str, Any]) -> DataFrame:
        frame = self.definition.base
        for name, f in self._open(self.definition.filters).items():
            value = arguments.pop(name, None)
            if is_blank(value):
                continue
            if f.options is not None and str(value) not in f.options:
                raise Refusal(f"[{name}] must be one of: {', '.join(f.options)}.")
            frame = f.apply(frame, value)
        return frame

    def run(self, period: str | None = None, *, compare: str | None = None, group_by: str | None = None, sort_by: str | None = None, limit: int = 10, series: str | None = None, measures: Sequence[str] | None = None, **arguments: Any) -> dict[str, Any]:
        """``period`` and frames: ``totals``; ``groups`` and ``series`` if asked for; with ``compare`` (previous_period, previous_year) totals and groups have ``_before``, ``_change`` and ``_percent`` too."""
        d, first, last = self.definition, arguments.pop("from_", None), arguments.pop("to", None)
        known, dimensions = self._open(d.measures), self._open(d.dimensions)
        chosen = [known[m] for m in (measures or known) if m in known]
        if not chosen:
            raise Refusal("no measure is available.")
        if group_by and group_by not in dimensions:
            raise Refusal(f"unknown dimension [{group_by}]. Use one of: {', '.join(dimensions)}.")
        if sort_by and sort_by not in {m.name for m in chosen}:
            raise Refusal(f"unknown measure [{sort_by}]. Use one of: {', '.join(m.name for m in chosen)}.")
        if series and series not in BUCKETS:
            raise Refusal(f"unknown series [{series}]. Use one of: {', '.join(BUCKETS)}.")
        if compare not in (None, "previous_period", "previous_year"):
            raise Refusal("compare must be previous_period or previous_year.")
        p = resolve(period, first, last, d.periods, self.today)
        frame = self._narrowed(arguments)
        if arguments:
            raise Refusal(f"unknown arguments: {', '.join(arguments)}.")
        now = MetricQuery(d, frame, p)
        out: dict[str, Any] = {"period": p, "totals": now.totals(chosen)}
        if group_by:
            out["groups"] = now.groups(dimensions[group_by], chosen, sort_by, limit)
        if series:
            out["series"] = now.series(series, chosen)
        if compare:
            q = p.previous() if compare == "previous_period" else p.previous_year()
            before = MetricQuery(d, frame, q)
            out["compared_with"] = q
            rename = lambda df: df.select(*[F.col(c).alias(f"{c}_before") for c in df.columns])
            both = out["totals"].crossJoin(rename(before.totals(chosen)))  # one row each
            out["totals"] = _with_changes(both, chosen, [])
            if group_by:
                key = dimensions[group_by].name
                # all groups of the period before, not only its largest, are what the chosen groups are compared with
                old_frame, old_key = before._key(dimensions[group_by])
                old = rename(old_frame.groupBy(old_key.alias(key)).agg(*[m.shown(m.raw()).alias(m.name) for m in chosen]))
                joined = out["groups"].join(old, F.col(key).eqNullSafe(F.col(f"{key}_before")), "left").fillna(0, [f"{m.name}_before" for m in chosen])
                out["groups"] = _with_changes(joined, chosen, [key])
        return out


def _with_changes(df: DataFrame, measures: Sequence[Measure], keys: list[str]) -> DataFrame:
    columns: list[Column] = [F.col(k) for k in keys]
    for m in measures:
        diff, percent = change(F.col(m.name), F.col(f"{m.name}_before"), m.kind == "count")
        columns += [F.col(m.name), F.col(f"{m.name}_before"), diff.alias(f"{m.name}_change"), percent.alias(f"{m.name}_percent")]
    return df.select(*columns)
