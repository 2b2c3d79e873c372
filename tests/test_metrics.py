"""Golden figures of nine orders of a shop, on 22 October 2026."""

from datetime import date, datetime

import pytest

from lodeweave.operators.metrics import Dimension, Measure, Metric, MetricDefinition, MetricFilter, Relation
from lodeweave.operators.periods import Period, Refusal, resolve

ORDERS = [
    ("linen", "Lucia", 4900, 1, "2026-08-10 10:00", "completed"), ("jeans", "Marco", 8000, 1, "2026-08-31 18:00", "completed"), ("linen", "Lucia", 9800, 2, "2026-09-01 09:00", "completed"),
    ("jeans", "Lucia", 8000, 1, "2026-09-15 12:00", "completed"), ("jeans", "Marco", 16000, 2, "2026-09-30 19:30", "completed"), ("jeans", "Marco", 99900, 9, "2026-09-20 12:00", "cancelled"),
    ("linen", "Marco", 4900, 1, "2026-10-02 11:00", "completed"), ("linen", "Lucia", 4900, 1, "2026-10-20 11:00", "completed"), ("jeans", "Lucia", 8000, 1, "2026-10-22 10:00", "completed"),
]
TODAY = date(2026, 10, 22)


@pytest.fixture(scope="module")
def metric(spark):
    rows = [(b, s, a, q, datetime.strptime(t, "%Y-%m-%d %H:%M"), st) for b, s, a, q, t, st in ORDERS]
    orders = spark.createDataFrame(rows, "book string, seller string, amount int, quantity int, ordered_at timestamp_ntz, status string").where("status = 'completed'")
    books = spark.createDataFrame([("linen", "Camicia lino", "Tessitura"), ("jeans", "Jeans", "Denim & Co")], "id string, title string, author string")
    return Metric(
        MetricDefinition(
            "sales", orders, "ordered_at", (Measure("orders", "count"), Measure("revenue", "sum", "amount", unit="EUR", divisor=100), Measure("pieces", "sum", "quantity")),
            (Dimension("seller", "seller"), Dimension("title", "book.title"), Dimension("author", "book.author")), (MetricFilter("seller", lambda df, v: df.where(df.seller == v), ("Lucia", "Marco")),),
            {"book": Relation(books, "book", "id")}, {"saldi_estivi_2026": ("2026-07-01", "2026-08-31")},
        ), today=TODAY,
    )


def one(out, *names):
    r = out["totals"].first()
    return tuple(r[n] for n in names)


def test_totals(metric):
    assert one(metric.run(from_="2026-09-01", to="2026-09-30"), "orders", "revenue", "pieces") == (3, 338, 5)
    assert one(metric.run(), "orders") == (3,)
    assert one(metric.run("this_week"), "orders", "revenue", "pieces") == (2, 129, 2)
    assert one(metric.run("today"), "orders") == (1,)
    assert one(metric.run("saldi_estivi_2026"), "orders") == (2,)
    assert one(metric.run(from_="2026-09-01", to="2026-09-30", seller="Marco"), "orders") == (1,)
    assert one(metric.run(from_="2020-01-01", to="2020-12-31"), "orders", "revenue") == (0, 0)


def test_groups(metric):
    september = {"from_": "2026-09-01", "to": "2026-09-30"}
    assert [tuple(r) for r in metric.run(**september, group_by="seller")["groups"].collect()] == [("Lucia", 2, 178, 3), ("Marco", 1, 160, 2)]
    assert [tuple(r) for r in metric.run(**september, group_by="title", sort_by="pieces", limit=1)["groups"].collect()] == [("Jeans", 2, 240, 3)]


def test_comparison(metric):
    out = metric.run(from_="2026-09-01", to="2026-09-30", compare="previous_period")
    assert (out["compared_with"].first, out["compared_with"].last) == (date(2026, 8, 1), date(2026, 8, 31))
    assert one(out, "revenue_before", "revenue_change", "revenue_percent", "orders_change", "orders_percent") == (129, 209, 162, 1, 50)
    out = metric.run(from_="2026-09-01", to="2026-09-30", compare="previous_year")
    assert out["compared_with"].first == date(2025, 9, 1) and one(out, "revenue_percent") == (None,)
    out = metric.run("this_month", compare="previous_period")
    assert (out["compared_with"].first, out["compared_with"].last) == (date(2026, 9, 1), date(2026, 9, 22)) and one(out, "orders_before") == (2,)


def test_series(metric):
    rows = metric.run(from_="2026-08-01", to="2026-10-31", series="month")["series"].collect()
    assert [(r.bucket, r.revenue) for r in rows] == [("2026-08", 129), ("2026-09", 338), ("2026-10", 178)]


@pytest.mark.parametrize("arguments", [{"seller": "Nobody"}, {"group_by": "colour"}, {"period": "next_decade"}, {"from_": "30/09/2026"}, {"sort_by": "weight"}, {"series": "decade"}, {"from_": "2026-09-02", "to": "2026-09-01"}, {"colour": "red"}])
def test_refusals(metric, arguments):
    with pytest.raises(Refusal):
        metric.run(**arguments)


def test_periods():
    p = resolve("this_month", today=date(2026, 3, 31)).previous()
    assert (p.first, p.last) == (date(2026, 2, 1), date(2026, 2, 28))
    p = Period.days(date(2026, 7, 1), date(2026, 8, 31), "x").previous()
    assert (p.first, p.last) == (date(2026, 5, 1), date(2026, 6, 30))
    p = Period.days(date(2026, 9, 10), date(2026, 9, 19), "x").previous()
    assert (p.first, p.last) == (date(2026, 8, 31), date(2026, 9, 9))
    assert Period.days(date(2024, 2, 29), date(2024, 2, 29), "x").previous_year().first == date(2023, 3, 1)
    p = resolve("last_quarter", today=TODAY)
    assert (p.first, p.last, p.unit, p.units) == (date(2026, 7, 1), date(2026, 9, 30), "quarter", 1)
    p = resolve("last_week", today=TODAY)
    assert (p.first, p.last) == (date(2026, 10, 12), date(2026, 10, 18))
