"""The filter kit: named predicates over a source, given by value.

A value that is None, '' or [] is blank and leaves a filter out; False and 0 are values. A filter that is given a list with nothing in it
matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_blank(value: Any) -> bool:
    return value is None or value == "" or (isinstance(value, (list, tuple)) and not value)


def as_list(value: Any) -> list[str]:
    """A list's items, or those of a comma-separated text, without empty ones."""
    if isinstance(value, (list, tuple)):
        return [str(v) for v in value]
    return [s.strip() for s in str(value).split(",") if s.strip()]


def as_bounds(value: Any) -> tuple[str | None, str | None]:
    """(from, to) of ``10-50``, ``10..50``, [10, 50] or {from, to}; a bound may be missing. Negative numbers and dates need ``..``."""
    if isinstance(value, dict):
        pair: Sequence[Any] = (value.get("from"), value.get("to"))
    elif isinstance(value, (list, tuple)):
        pair = (*value, None, None)[:2]
    else:
        pair = (*(s.strip() for s in str(value).split(".." if ".." in str(value) else "-", 1)), None)[:2]
    low, high = (None if is_blank(v) else str(v) for v in pair)
    return low, high


def as_bool(value: Any) -> bool:
    """True, or text that says so: 1, true, on, yes."""
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "on", "yes")


def within(c: Column, low: Any, high: Any) -> Column:
    """Inclusive; a missing bound doesn't limit."""
    out = F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low))
    if high is not None:
        out = out & (c <= F.lit(high))
    return out


def any_of(c: Column, values: Iterable[Any] | None) -> Column:
    """An allow-list: None doesn't filter, an empty one matches nothing."""
    if values is None:
        return F.lit(True)
    values = list(values)
    return c.isin(values) if values else F.lit(False)


def overlaps(start: Column, end: Column, low: int | None, high: int | None) -> Column:
    """Position ranges that share a position with [low, high]; a missing bound doesn't limit."""
    return within(end, low, None) & within(start, None, high)


def contains_text(c: Column, text: str, limit: int = 200) -> Column:
    """Case-insensitive contains; the text's own wildcards are ordinary characters."""
    safe = text[:limit].replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return F.ilike(c.cast("string"), F.lit(f"%{safe}%"), F.lit("!"))


Predicate = Callable[[DataFrame, Any], DataFrame]


@dataclass(frozen=True)
class Filter:
    """One filter: ``apply`` narrows a frame by a value that isn't blank; ``default`` is taken where none is given."""

    name: str
    apply: Predicate
    default: Any = None
    label: str = ""
    options: dict[str, str] | None = None

    @staticmethod
    def _on(name: str, column: str | None, make: Callable[[Column, Any], Column], **more: Any) -> Filter:
        return Filter(name, lambda df, v: df.where(make(F.col(column or name), v)), **more)

    @staticmethod
    def ids(name: str, column: str | None = None, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: any_of(c, as_list(v)), **more)

    @staticmethod
    def one_of(name: str, options: dict[str, str], column: str | None = None, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: any_of(c, as_list(v)), options=options, **more)

    @staticmethod
    def range(name: str, column: str | None = None, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: within(c, *as_bounds(v)), **more)

    @staticmethod
    def date_range(name: str, column: str | None = None, **more: Any) -> Filter:
        def make(c: Column, v: Any) -> Column:
            low, high = (None if b is None else F.to_date(F.lit(b)) for b in as_bounds(v))
            return within(F.to_date(c), low, high)

        return Filter._on(name, column, make, **more)

    @staticmethod
    def like(name: str, column: str | None = None, **more: Any) -> Filter:
        """Contains, where % and _ in the value are wildcards."""
        return Filter._on(name, column, lambda c, v: c.like(f"%{v}%"), **more)

    @staticmethod
    def equals(name: str, column: str | None = None, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: c == F.lit(v), **more)

    @staticmethod
    def boolean(name: str, column: str | None = None, default: Any = False, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: c == F.lit(as_bool(v)), default=default, **more)

    @staticmethod
    def is_null(name: str, column: str | None = None, **more: Any) -> Filter:
        return Filter._on(name, column, lambda c, v: c.isNull() if as_bool(v) else c.isNotNull(), **more)

    @staticmethod
    def callback(name: str, apply: Predicate, **more: Any) -> Filter:
        return Filter(name, apply, **more)


@dataclass(frozen=True)
class FilterSet:
    """Filters by name."""

    filters: tuple[Filter, ...] = ()
    known: dict[str, Filter] = field(init=False, compare=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.known.update({f.name: f for f in self.filters})

    def apply(self, df: DataFrame, values: dict[str, Any] | None = None) -> DataFrame:
        values = values or {}
        if unknown := set(values) - set(self.known):
            raise KeyError(f"unknown filters: {sorted(unknown)}; known: {sorted(self.known)}")
        for f in self.filters:
            value = values.get(f.name)
            value = f.default if is_blank(value) else value
            if not is_blank(value):
                df = f.apply(df, value)
        return df


def parse_inputs(entries: Iterable[str]) -> dict[str, str]:
    """``name:value`` entries, cut at the first colon; others are ignored."""
    return {k.strip(): v.strip() for k, sep, v in (e.partition(":") for e in entries) if sep}


def narrow(allowed: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """All that is allowed, or what of it is wanted."""
    return [s for s in allowed if not wanted or s in wanted]


def user_scope(df: DataFrame, scopes: dict[str, Callable[[DataFrame], Column] | None], source_col: str = "source_key") -> DataFrame:
    """Rows that a user may see: of each source those its scope allows (None: all). A scope that fails allows nothing."""
    allowed = F.lit(False)
    for key, scope in scopes.items():
        try:
            own = F.lit(True) if scope is None else scope(df)
        except Exception:  # noqa: BLE001  closed, not open
            own = F.lit(False)
        allowed = allowed | ((F.col(source_col) == key) & own)
    return df.where(allowed)


def table_filters(blueprint: dict[str, dict[str, Any]]) -> FilterSet:
    """Filters of a table as typed arguments: name -> {kind, column?, options?}.

    Kinds: toggle (constrains only when true), ternary, select, multi_select, date, number, boolean, string. A select of more than 100
    options takes ids. The reserved names search, sort, direction and page are skipped.
    """
    made: list[Filter] = []
    for name, spec in blueprint.items():
        column = spec.get("column", name)
        if name in ("search", "sort", "direction", "page", "per_page"):
            continue
        kind, options = spec["kind"], spec.get("options")
        if kind == "toggle":
            made.append(Filter(name, lambda df, v, c=column: df.where(F.col(c)) if as_bool(v) else df))
        elif kind in ("ternary", "boolean"):
            made.append(Filter.boolean(name, column, default=None))
        elif kind in ("select", "multi_select"):
            made.append(Filter.one_of(name, options, column) if options and len(options) <= 100 else Filter.ids(name, column))
        elif kind == "date":
            made.append(Filter.date_range(name, column))
        elif kind == "number":
            made.append(Filter.range(name, column))
        else:
            made.append(Filter.equals(name, column))
    return FilterSet(tuple(made))
