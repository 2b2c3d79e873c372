"""Record listings: search, filter, sort and page, and how values are shown."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.metrics import Relation
from lodeweave.sources.filters import FilterSet, contains_text, is_blank


def search(df: DataFrame, text: str | None, columns: Sequence[str], relations: dict[str, Relation] | None = None) -> DataFrame:
    """Rows with the text in any of the columns, whatever its case. ``relation.column`` looks into a related row; unknown ones are left out."""
    if is_blank(text):
        return df
    found: Column = F.lit(False)
    for c in columns:
        name, dot, column = c.partition(".")
        if not dot:
            if c in df.columns:
                found = found | F.coalesce(contains_text(F.col(c), str(text)), F.lit(False))
        elif relations and name in relations and column in relations[name].frame.columns:
            r = relations[name]
            keys = r.frame.where(contains_text(F.col(column), str(text))).select(F.col(r.key).alias(f"_{name}_key")).distinct()
            df = df.join(keys, F.col(r.foreign_key) == F.col(f"_{name}_key"), "left")
            found = found | F.col(f"_{name}_key").isNotNull()
    return df.where(found).drop(*[f"_{n}_key" for n in relations or ()])


def page(df: DataFrame, key: str, sort: str | None = None, direction: str = "asc", number: int = 1, size: int = 15) -> DataFrame:
    """One page: by ``sort`` if given and then by key, the largest first."""
    order = [] if not sort else [F.col(sort).desc() if direction == "desc" else F.col(sort).asc()]
    return df.orderBy(*order, F.col(key).desc()).offset((max(1, number) - 1) * size).limit(size)


def list_records(df: DataFrame, key: str, *, text: str | None = None, search_columns: Sequence[str] = (), relations: dict[str, Relation] | None = None, filters: FilterSet | None = None, values: dict[str, Any] | None = None, sort: str | None = None, direction: str = "asc", number: int = 1, size: int = 15) -> tuple[DataFrame, DataFrame]:
    """(page, total): the total is exact, over all that matches."""
    rows = search(df, text, search_columns, relations)
    if filters:
        rows = filters.apply(rows, values)
    return page(rows, key, sort, direction, number, size), rows.agg(F.count("*").alias("total"))


def view(df: DataFrame, key: str, value: str) -> DataFrame:
    """One record by its key; a key that can't be one (not digits, a UUID, a ULID or 1 to 191 word characters) finds nothing."""
    import re

    return df.where(F.col(key).cast("string") == value).limit(1) if re.fullmatch(r"[\w.:-]{1,191}", value) else df.limit(0)


def shown(c: Column, kind: str = "string", *, placeholder: str = "—", options: dict[str, str] | None = None, limit: int = 300) -> Column:
    """A value as text: nothing is the placeholder; lists are joined, options have their labels, booleans are Yes or No, dates ISO."""
    if kind == "array":
        text = F.array_join(c, ", ")
    elif kind == "boolean":
        text = F.when(c, "Yes").when(~c, "No")
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind == "datetime":
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    else:
        text = c.cast("string")
    if options:
        labels = F.create_map(*[F.lit(x) for pair in options.items() for x in pair])
        text = F.coalesce(F.try_element_at(labels, text), text)
    text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.when(text.isNull() | (text == ""), placeholder).otherwise(text)


def present(df: DataFrame, key: str, title: str | None = None, hidden: Sequence[str] = ()) -> DataFrame:
    """Records for reading: id, title and readable columns; dates as ISO 8601."""
    columns = [F.col(key).cast("string").alias("id")]
    if title:
        columns.append(F.col(title).cast("string").alias("title"))
    for f in df.schema.fields:
        if f.name in (key, title, *hidden):
            continue
        kind = f.dataType.typeName()
        c = F.col(f.name)
        columns.append((F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else c).alias(f.name))
    return df.select(*columns)


def semi(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows that have a partner."""
    return df.join(other.select(F.col(right).alias("_right")), F.col(left) == F.col("_right"), "left_semi")


def anti(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows that have none."""
    return df.join(other.select(F.col(right).alias("_right")), F.col(left) == F.col("_right"), "left_anti")


def with_counts(df: DataFrame, child: DataFrame, key: str, foreign_key: str, flag: Column, count_name: str = "n_children", flag_name: str = "has_flagged") -> DataFrame:
    """With the number of children, and whether any of them has the flag."""
    c = child.groupBy(F.col(foreign_key).alias("_fk")).agg(F.count("*").alias(count_name), F.max(F.coalesce(flag, F.lit(False))).alias(flag_name))
    return df.join(c, F.col(key) == F.col("_fk"), "left").drop("_fk").fillna(0, [count_name]).fillna(False, [flag_name])


def with_related(rows: DataFrame, related: DataFrame, foreign_key: str, owner_key: str, label: str, alias: str) -> DataFrame:
    """Rows with the label of what they refer to, by one join for the whole list; null where there is none."""
    r = related.select(F.col(owner_key).alias("_owner"), F.col(label).alias(alias)).dropDuplicates(["_owner"])
    return rows.join(r, F.col(foreign_key) == F.col("_owner"), "left").drop("_owner")


def admin_filters(df: DataFrame, chosen: dict[str, object]) -> DataFrame:
    """Rows that meet the choices of an administrator's list: each names a column and the value, or list of values, that it may have; None and an empty list choose nothing.

    ``negative_feedback`` (true) keeps rows whose ``feedback`` is -1.
    """
    for name, value in chosen.items():
        if value is None or value == []:
            continue
        if name == "negative_feedback":
            df = df.where(F.col("feedback") == -1) if value else df
        else:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df
