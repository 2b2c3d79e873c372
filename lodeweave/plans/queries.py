"""One query for each operator on the driver's tables, with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.config import ChunkingOptions, RetrievalOptions
from lodeweave.functions import text as T
from lodeweave.functions import vectors as V
from lodeweave.functions.slices import by_slices
from lodeweave.operators import answering, chunking, dashboards, evaluation, ingest, listing, retrieval
from lodeweave.operators.metrics import Dimension, Measure, Metric, MetricDefinition, MetricFilter, Relation
from lodeweave.operators.ranges import overlap_join
from lodeweave.sources import filters as S
from lodeweave.sources.tables import GroupedSource, SegmentMap, SourceRegistry, TableSource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- metrics -----------------------------------------------------------------------------------------------------------------------------


def orders_metric(spark: SparkSession, d: str) -> MetricDefinition:
    region = Relation(table(spark, d, "region"), "n_regionkey", "r_regionkey")
    nation = Relation(table(spark, d, "nation"), "c_nationkey", "n_nationkey", {"region": region})
    customer = Relation(table(spark, d, "customer"), "o_custkey", "c_custkey", {"nation": nation})
    return MetricDefinition(
        "orders", table(spark, d, "orders"), "o_orderdate",
        (Measure("orders", "count"), Measure("customers", "count", "o_custkey", distinct=True), Measure("revenue", "sum", "o_totalprice"), Measure("average", "avg", "o_totalprice"), Measure("smallest", "min", "o_totalprice"), Measure("largest", "max", "o_totalprice")),
        (Dimension("region", "customer.nation.region.r_name"), Dimension("nation", "customer.nation.n_name"), Dimension("segment", "customer.c_mktsegment"), Dimension("priority", "o_orderpriority"), Dimension("status", "o_orderstatus")),
        (MetricFilter("status", lambda df, v: df.where(F.col("o_orderstatus") == v), ("F", "O", "P")), MetricFilter("priority", lambda df, v: df.where(F.col("o_orderpriority") == v))),
        {"customer": customer}, {"summer_1997": ("1997-06-01", "1997-08-31")},
    )


TODAY = date(1998, 3, 18)
SHOWN = "count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(coalesce(sum(o_totalprice), 0), 2) AS revenue, round(coalesce(avg(o_totalprice), 0), 2) AS average, round(coalesce(min(o_totalprice), 0), 2) AS smallest, round(coalesce(max(o_totalprice), 0), 2) AS largest"
JOINED = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
IN_1997 = "o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'"


def ask(spark: SparkSession, d: str, period: str | None = None, **arguments: object) -> dict:
    return Metric(orders_metric(spark, d), today=TODAY).run(period, **arguments)  # type: ignore[arg-type]


@query("metric_totals", f"SELECT {SHOWN} FROM orders WHERE {IN_1997}")
def metric_totals(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year")["totals"]


@query("metric_empty_period", f"SELECT {SHOWN} FROM orders WHERE o_orderdate < TIMESTAMP '1900-01-01'")
def metric_empty_period(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, from_="1899-01-01", to="1899-12-31")["totals"]


@query("metric_count_distinct", f"SELECT count(DISTINCT o_custkey) AS customers FROM orders WHERE {IN_1997}")
def metric_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year", measures=["customers"])["totals"]


def lines_metric(spark: SparkSession, d: str) -> MetricDefinition:
    part = Relation(table(spark, d, "part"), "l_partkey", "p_partkey")
    nation = Relation(table(spark, d, "nation"), "s_nationkey", "n_nationkey")
    supplier = Relation(table(spark, d, "supplier"), "l_suppkey", "s_suppkey", {"nation": nation})
    return MetricDefinition(
        "lines", table(spark, d, "lineitem"), "l_shipdate",
        (Measure("lines", "count"), Measure("net", "sum", "l_extendedprice * (1 - l_discount)", divisor=1000), Measure("quantity", "sum", "l_quantity")),
        (Dimension("brand", "part.p_brand"), Dimension("nation", "supplier.nation.n_name")), (), {"part": part, "supplier": supplier},
    )


LINES = "count(*) AS lines, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0) / 1000, 2) AS net, round(coalesce(sum(l_quantity), 0), 2) AS quantity"
SHIPPED_1997 = "l_shipdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'"


@query("metric_expr_measure", f"SELECT {LINES} FROM lineitem WHERE {SHIPPED_1997}")
def metric_expr_measure(spark: SparkSession, d: str) -> DataFrame:
    return Metric(lines_metric(spark, d), today=TODAY).run("last_year")["totals"]


@query("metric_groups_brand", f"SELECT p_brand AS brand, {LINES} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE {SHIPPED_1997} GROUP BY p_brand ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, brand LIMIT 5")
def metric_groups_brand(spark: SparkSession, d: str) -> DataFrame:
    return Metric(lines_metric(spark, d), today=TODAY).run("last_year", group_by="brand", sort_by="net", limit=5)["groups"]


@query("metric_groups_region", f"SELECT r_name AS region, {SHOWN} FROM {JOINED} WHERE {IN_1997} GROUP BY r_name ORDER BY orders DESC, region LIMIT 5")
def metric_groups_region(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year", group_by="region", limit=5)["groups"]


@query("metric_groups_flat", f"SELECT o_orderpriority AS priority, {SHOWN} FROM orders WHERE {IN_1997} GROUP BY 1 ORDER BY sum(o_totalprice) DESC, priority LIMIT 10")
def metric_groups_flat(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year", group_by="priority", sort_by="revenue")["groups"]


@query("metric_groups_null_key", "SELECT n_name AS nation, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0 LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY orders DESC, nation NULLS LAST LIMIT 50")
def metric_groups_null_key(spark: SparkSession, d: str) -> DataFrame:
    # here the rule is the feature: relations that two of three orders don't have make a group of their own
    nation = Relation(table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    customer = Relation(table(spark, d, "customer").where("c_custkey % 3 = 0"), "o_custkey", "c_custkey", {"nation": nation})
    m = MetricDefinition("orders", table(spark, d, "orders"), "o_orderdate", (Measure("orders", "count"),), (Dimension("nation", "customer.nation.n_name"),), (), {"customer": customer})
    return Metric(m, today=TODAY).run(from_="1990-01-01", to="2010-12-31", group_by="nation", limit=50)["groups"]


for unit, label in (("day", "strftime(o_orderdate, '%Y-%m-%d')"), ("week", "strftime(o_orderdate, '%G-W%V')"), ("month", "strftime(o_orderdate, '%Y-%m')"), ("year", "strftime(o_orderdate, '%Y')")):

    def series(spark: SparkSession, d: str, unit: str = unit) -> DataFrame:
        return ask(spark, d, from_="1996-11-01", to="1998-02-15", series=unit, measures=["orders", "customers", "revenue", "largest"])["series"]

    query(f"metric_series_{unit}", f"SELECT {label} AS bucket, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(coalesce(sum(o_totalprice), 0), 2) AS revenue, round(coalesce(max(o_totalprice), 0), 2) AS largest FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-11-01' AND TIMESTAMP '1998-02-15 23:59:59' GROUP BY 1")(series)

CHANGES = ", ".join(
    f"a.{m}, b.{m} AS {m}_before, {'a.{0} - b.{0}' if m in ('orders', 'customers') else 'round(a.{0} - b.{0}, 2)'} AS {m}_change, CASE WHEN b.{{0}} <> 0 THEN round((a.{{0}} - b.{{0}}) / abs(b.{{0}}) * 100, 1) END AS {m}_percent".replace("{0}", m)
    for m in ("orders", "customers", "revenue", "average", "smallest", "largest")
)


def compared(a: tuple[str, str], b: tuple[str, str]) -> str:
    one = lambda p: f"SELECT {SHOWN} FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{p[0]} 00:00:00' AND TIMESTAMP '{p[1]} 23:59:59'"
    return f"SELECT {CHANGES} FROM ({one(a)}) a, ({one(b)}) b"


@query("metric_compare_previous_period", compared(("1998-03-01", "1998-03-18"), ("1998-02-01", "1998-02-18")))
def metric_compare_previous_period(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "this_month", compare="previous_period")["totals"]


@query("metric_compare_previous_year", compared(("1998-02-01", "1998-02-28"), ("1997-02-01", "1997-02-28")))
def metric_compare_previous_year(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_month", compare="previous_year")["totals"]


@query(
    "metric_compare_groups",
    f"WITH a AS (SELECT c_mktsegment AS segment, count(*) AS orders FROM {JOINED} WHERE {IN_1997} GROUP BY 1 ORDER BY orders DESC, segment LIMIT 3), b AS (SELECT c_mktsegment AS segment, count(*) AS orders FROM {JOINED} WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59' GROUP BY 1) "
    "SELECT a.segment, a.orders, coalesce(b.orders, 0) AS orders_before, a.orders - coalesce(b.orders, 0) AS orders_change, CASE WHEN coalesce(b.orders, 0) <> 0 THEN round((a.orders - b.orders) / abs(b.orders) * 100, 1) END AS orders_percent FROM a LEFT JOIN b ON a.segment = b.segment",
)
def metric_compare_groups(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year", compare="previous_period", group_by="segment", measures=["orders"], limit=3)["groups"]


@query("metric_filtered", f"SELECT o_orderpriority AS priority, {SHOWN} FROM orders WHERE {IN_1997} AND o_orderstatus = 'F' GROUP BY 1 ORDER BY orders DESC, priority LIMIT 10")
def metric_filtered(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "last_year", group_by="priority", status="F")["groups"]


@query("metric_named_period", f"SELECT {SHOWN} FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1997-08-31 23:59:59'")
def metric_named_period(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "summer_1997")["totals"]


# --- filters and listings ----------------------------------------------------------------------------------------------------------------

KIT = S.FilterSet(
    (
        S.Filter.ids("id", "p_partkey"), S.Filter.one_of("brand", {}, "p_brand"), S.Filter.range("size", "p_size"), S.Filter.like("name", "p_name"), S.Filter.equals("type", "p_type"),
        S.Filter.callback("cheap", lambda df, v: df.where(F.col("p_retailprice") < float(v))),
    )
)
PART = "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE "


def parts(spark: SparkSession, d: str, **values: object) -> DataFrame:
    return KIT.apply(table(spark, d, "part"), values).select("p_partkey", "p_name", "p_brand", "p_size")


for name, values, where in (
    ("ids", {"id": "1, 2 ,3,77"}, "p_partkey IN (1, 2, 3, 77)"),
    ("in", {"brand": ["Brand#12", "Brand#23"]}, "p_brand IN ('Brand#12', 'Brand#23')"),
    ("range", {"size": "10-20"}, "p_size BETWEEN 10 AND 20"),
    ("range_open", {"size": {"from": 40, "to": None}}, "p_size >= 40"),
    ("like", {"name": "an"}, "p_name LIKE '%an%'"),
    ("callback", {"cheap": "1000"}, "p_retailprice < 1000"),
    ("empty_list", {"id": ","}, "1 = 0"),
    ("blank", {"id": "", "brand": []}, "1 = 1"),
    ("combined", {"size": "1..25", "cheap": 1500}, "p_size BETWEEN 1 AND 25 AND p_retailprice < 1500"),
):

    def filtered(spark: SparkSession, d: str, values: dict = values) -> DataFrame:
        return parts(spark, d, **values)

    query(f"filter_{name}", PART + where)(filtered)


@query("filter_equals", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def filter_equals(spark: SparkSession, d: str) -> DataFrame:
    return S.FilterSet((S.Filter.equals("status", "o_orderstatus"),)).apply(table(spark, d, "orders"), {"status": "P"}).select("o_orderkey", "o_orderstatus")


@query("filter_date_range", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    return S.FilterSet((S.Filter.date_range("ts"),)).apply(table(spark, d, "events"), {"ts": "2024-01-05..2024-01-07"}).select("event_id", "event_type")


@query("filter_boolean", "SELECT event_id, event_type = 'error' AS failed FROM events WHERE NOT (event_type = 'error')")
def filter_boolean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("failed"))
    return S.FilterSet((S.Filter.boolean("failed"),)).apply(e)


@query("filter_is_null", "SELECT c.doc_id FROM documents c LEFT JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality IS NULL")
def filter_is_null(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return S.FilterSet((S.Filter.is_null("unlabelled", "quality"),)).apply(labelled, {"unlabelled": "true"}).select("doc_id")


@query("filter_user_scope", "SELECT doc_id, source FROM documents WHERE (source = 'src1' AND lang = 'en') OR source = 'src2'")
def filter_user_scope(spark: SparkSession, d: str) -> DataFrame:
    def broken(_: DataFrame):  # noqa: ANN202
        raise RuntimeError("a scope that can't say what is allowed")

    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return S.user_scope(docs, {"src1": lambda _: F.col("lang") == "en", "src2": None, "src3": broken}, "source").select("doc_id", "source")


@query("filter_source_narrowing", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src2', 'src5') GROUP BY source")
def filter_source_narrowing(spark: SparkSession, d: str) -> DataFrame:
    allowed = S.narrow(["src1", "src2", "src5"], ["src2", "src5", "src9"])
    return table(spark, d, "documents").where(S.any_of(F.col("source"), allowed)).groupBy("source").agg(F.count("*").alias("n"))


@query("filter_table_mapping", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand = 'Brand#12'")
def filter_table_mapping(spark: SparkSession, d: str) -> DataFrame:
    kit = S.table_filters({"brand": {"kind": "select", "column": "p_brand", "options": {"Brand#12": "Twelve"}}, "size": {"kind": "number", "column": "p_size"}, "sort": {"kind": "string"}})
    return kit.apply(table(spark, d, "part"), {"brand": "Brand#12", "size": "5-9"}).select("p_partkey")


@query("position_overlap", "SELECT conv_id, min(turn) AS position_start, max(turn) AS position_end FROM conversations GROUP BY conv_id HAVING max(turn) >= 4 AND min(turn) <= 5")
def position_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("position_start"), F.max("turn").alias("position_end"))
    return c.where(S.overlaps(F.col("position_start"), F.col("position_end"), 4, 5))


@query("search_records", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%' OR p_type ILIKE '%RE%'")
def search_records(spark: SparkSession, d: str) -> DataFrame:
    return listing.search(table(spark, d, "part"), "RE", ["p_name", "p_type", "no_such_column"]).select("p_partkey", "p_name")


@query("search_escaped", "SELECT doc_id FROM documents WHERE contains(lower(text), '&&') OR contains(text, '%%%')")
def search_escaped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(S.contains_text(F.col("text"), "&&") | S.contains_text(F.col("text"), "%%%")).select("doc_id")


@query("search_related", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%99%' OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name ILIKE '%an%')")
def search_related(spark: SparkSession, d: str) -> DataFrame:
    r = {"nation": Relation(table(spark, d, "nation"), "c_nationkey", "n_nationkey")}
    found = listing.search(table(spark, d, "customer"), "an", ["nation.n_name"], r).select("c_custkey", "c_name")
    return found.unionByName(listing.search(table(spark, d, "customer"), "99", ["c_name"]).select("c_custkey", "c_name")).distinct()


@query("list_page", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 15 OFFSET 30")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = listing.list_records(table(spark, d, "orders"), "o_orderkey", filters=S.FilterSet((S.Filter.equals("status", "o_orderstatus"),)), values={"status": "F"}, sort="o_orderpriority", direction="desc", number=3)
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("list_total", "SELECT count(*) AS total FROM orders WHERE CAST(o_orderkey AS VARCHAR) ILIKE '%12%'")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_records(table(spark, d, "orders"), "o_orderkey", text="12", search_columns=["o_orderkey"])[1]


@query("view_record", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 7")
def view_record(spark: SparkSession, d: str) -> DataFrame:
    return listing.present(listing.view(table(spark, d, "customer"), "c_custkey", "7"), "c_custkey", "c_name")


@query("format_values", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Failure' ELSE event_type END AS kind, CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END AS high, strftime(ts, '%Y-%m-%d') AS day FROM events")
def format_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", listing.shown(F.col("event_type"), options={"error": "Failure"}).alias("kind"), listing.shown(F.col("value") > 50, "boolean").alias("high"), listing.shown(F.col("ts"), "date").alias("day"))


@query("semi_join_failed", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join_failed(spark: SparkSession, d: str) -> DataFrame:
    return listing.semi(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@query("anti_join_orphans", "SELECT d.source AS source_key, CAST(d.doc_id AS VARCHAR) AS external_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"))
    source = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("external_id")).join(stored, "external_id").select("source_key", "external_id")
    return ingest.orphans(stored, source)


@query("with_count_exists", "SELECT c_custkey, count(o_orderkey) AS n_children, coalesce(bool_or(o_orderstatus = 'P'), false) AS has_flagged FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def with_count_exists(spark: SparkSession, d: str) -> DataFrame:
    return listing.with_counts(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", F.col("o_orderstatus") == "P").select("c_custkey", "n_children", "has_flagged")


# --- sources -----------------------------------------------------------------------------------------------------------------------------


def documents_source(spark: SparkSession, d: str) -> TableSource:
    return TableSource("documents", table(spark, d, "documents"), "doc_id", SegmentMap.column("text"), metadata={"lang": "lang"}, filters=S.FilterSet((S.Filter.equals("lang"),)))


def conversations_source(spark: SparkSession, d: str) -> TableSource:
    c = table(spark, d, "conversations")
    parents = c.select("conv_id").distinct().withColumn("title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    return TableSource("conversations", parents, "conv_id", SegmentMap.relation(c, "conv_id", "text", "turn"), title="title")


def letters_source(spark: SparkSession, d: str) -> GroupedSource:
    return GroupedSource("parts", table(spark, d, "part"), "upper(substr(p_name, 1, 1))", "p_name", title="Parts - :group", filters=S.FilterSet((S.Filter.like("name", "p_name"),)))


@query("source_table", "SELECT 'documents' AS source_key, CAST(doc_id AS VARCHAR) AS external_id, lang FROM documents WHERE lang = 'de'")
def source_table(spark: SparkSession, d: str) -> DataFrame:
    return documents_source(spark, d).documents({"lang": "de"}).select("source_key", "external_id", F.col("metadata")["lang"].alias("lang"))


@query("source_count", "SELECT count(*) AS documents FROM documents WHERE lang = 'de'")
def source_count(spark: SparkSession, d: str) -> DataFrame:
    return documents_source(spark, d).count_documents({"lang": "de"})


@query("source_find", "SELECT CAST(doc_id AS VARCHAR) AS external_id FROM documents WHERE doc_id = 17")
def source_find(spark: SparkSession, d: str) -> DataFrame:
    registry = SourceRegistry()
    registry.extend("documents", lambda: documents_source(spark, d))
    return registry.get("documents").find_document("17").select("external_id")


@query("source_column_segments", "SELECT CAST(doc_id AS VARCHAR) AS external_id, 1 AS position, length(text) AS chars FROM documents WHERE text <> ''")
def source_column_segments(spark: SparkSession, d: str) -> DataFrame:
    return documents_source(spark, d).segments().select("external_id", "position", F.length("text").cast("long").alias("chars"))


@query("source_relation_segments", "SELECT CAST(conv_id AS VARCHAR) AS external_id, CAST(turn AS INTEGER) AS position, text FROM conversations")
def source_relation_segments(spark: SparkSession, d: str) -> DataFrame:
    return conversations_source(spark, d).segments().select("external_id", "position", "text")


@query("source_grouped", "SELECT upper(substr(p_name, 1, 1)) AS external_id, 'Parts - ' || upper(substr(p_name, 1, 1)) AS title, CAST(count(*) AS VARCHAR) AS entries FROM part GROUP BY 1, 2")
def source_grouped(spark: SparkSession, d: str) -> DataFrame:
    return letters_source(spark, d).documents().select("external_id", "title", F.col("metadata")["entries"].alias("entries"))


@query("source_grouped_count", "SELECT count(DISTINCT upper(substr(p_name, 1, 1))) AS documents FROM part WHERE p_name LIKE '%an%'")
def source_grouped_count(spark: SparkSession, d: str) -> DataFrame:
    return letters_source(spark, d).count_documents({"name": "an"})


@query("source_grouped_segments", "WITH g AS (SELECT DISTINCT upper(substr(p_name, 1, 1)) AS g FROM part WHERE p_name LIKE '%an%'), r AS (SELECT upper(substr(p_name, 1, 1)) AS g, row_number() OVER (PARTITION BY upper(substr(p_name, 1, 1)) ORDER BY p_name) AS position, p_name AS text FROM part) SELECT g AS external_id, position, text FROM r WHERE g IN (SELECT g FROM g)")
def source_grouped_segments(spark: SparkSession, d: str) -> DataFrame:
    return letters_source(spark, d).segments({"name": "an"}).select("external_id", "position", "text")


# --- dashboards --------------------------------------------------------------------------------------------------------------------------


@query("coverage_by_source", "SELECT source AS source_key, count(*) AS chunks, count(quality) AS embedded, count(*) - count(quality) AS pending, CAST(round(count(quality) * 100 / count(*)) AS INTEGER) AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_key")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("embedded_at")), "doc_id", "left")
    return dashboards.coverage(c)


@query(
    "corpus_stats",
    "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM conversations WHERE role <> 'user') AS embedded, (SELECT count(*) FROM conversations WHERE role = 'user') AS pending, (SELECT count(*) FROM conversations WHERE role = 'system') AS stale, "
    "(SELECT CAST(round(count(*) FILTER (role <> 'user') * 100 / count(*)) AS INTEGER) FROM conversations) AS coverage, (SELECT CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) FROM orders) + (SELECT CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) FROM events) AS spend_micros, (SELECT round(avg(value), 2) FROM events) AS avg_latency_ms",
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").select("role", F.when(F.col("role") != "user", F.col("turn")).alias("embedded_at"))
    runs = table(spark, d, "orders").select(F.round("o_totalprice").cast("long").alias("cost_micros"))
    asked = table(spark, d, "events").select(F.round("value").cast("long").alias("cost_micros"), F.col("value").alias("latency_ms"))
    return dashboards.corpus_stats(table(spark, d, "documents"), chunks, runs, asked, F.col("role") == "system")


NOW = datetime(2024, 1, 20, 15, 30)


@query(
    "throughput_hourly",
    "WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-19 16:00:00', TIMESTAMP '2024-01-20 15:00:00', INTERVAL 1 HOUR)) AS bucket), c AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-19 16:00:00' AND TIMESTAMP '2024-01-20 15:30:00' GROUP BY 1) "
    "SELECT s.bucket, coalesce(n, 0) AS n, CAST(CASE WHEN max(coalesce(n, 0)) OVER () > 0 THEN round(coalesce(n, 0) * 100 / max(coalesce(n, 0)) OVER ()) ELSE 0 END AS INTEGER) AS percent FROM s LEFT JOIN c ON s.bucket = c.bucket",
)
def throughput_hourly(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.throughput(table(spark, d, "events"), "ts", NOW)


@query(
    "volume_daily",
    "WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-22', TIMESTAMP '2024-01-20', INTERVAL 1 DAY)) AS bucket), c AS (SELECT date_trunc('day', ts) AS bucket, count(*) FILTER (event_type <> 'error') AS answered, count(*) FILTER (event_type = 'error') AS refused FROM events WHERE ts >= TIMESTAMP '2023-12-22' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1) "
    "SELECT CAST(s.bucket AS TIMESTAMP) AS bucket, coalesce(answered, 0) AS answered, coalesce(refused, 0) AS refused FROM s LEFT JOIN c ON s.bucket = c.bucket",
)
def volume_daily(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.volume(table(spark, d, "events"), "ts", F.col("event_type") == "error", NOW)


@query("latest_runs", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.latest(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


@query("document_list", "SELECT source AS source_key, CAST(doc_id AS VARCHAR) AS external_id FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 0 ORDER BY source, CAST(doc_id AS VARCHAR) LIMIT 500")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"), F.lit("").alias("title"), F.col("n_chars").alias("chunk_count"))
    return dashboards.document_list(docs, ["src1", "src2"]).select("source_key", "external_id")


@query("run_progress", "SELECT o_custkey AS run_id, count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS documents_done, count(*) FILTER (o_orderstatus = 'F' AND false) AS documents_failed, CAST(sum(1) AS BIGINT) AS tokens, round(0.3 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.7 / 3, 4) AS progress FROM orders GROUP BY o_custkey")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "chunked").otherwise("pending").alias("status"), F.lit(3).alias("chunks_created"), F.lit(0).alias("chunks_reused"), F.lit(0).alias("chunks_deleted"), F.lit(1).alias("chunks_embedded"), F.lit(1).alias("tokens")
    )
    return ingest.run_totals(items).select("run_id", "documents", "documents_done", "documents_failed", "tokens", "progress")


# --- vectors -----------------------------------------------------------------------------------------------------------------------------

QUERY_VECTOR = [((i * 7) % 13 - 6) / 10 for i in range(64)]
QV = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
NEAR = f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {QV}), 6) AS score FROM embeddings"


@query("vector_topk", f"{NEAR} ORDER BY list_cosine_similarity(embedding::DOUBLE[], {QV}) DESC, vec_id LIMIT 60")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(table(spark, d, "embeddings"), QUERY_VECTOR, 60, id_col="vec_id").withColumn("score", F.round("score", 6))


@query("vector_topk_filtered", f"{NEAR} WHERE label IN (1, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], {QV}) DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.base_scan(table(spark, d, "embeddings"), constrain=lambda df: df.where(F.col("label").isin(1, 3)))
    return retrieval.vector_search(c, QUERY_VECTOR, 10, id_col="vec_id").withColumn("score", F.round("score", 6))


@query("vector_min_score", f"SELECT * FROM ({NEAR}) WHERE score >= 0.15 ORDER BY score DESC, vec_id LIMIT 60")
def vector_min_score(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(table(spark, d, "embeddings"), QUERY_VECTOR, 60, 0.15, id_col="vec_id").withColumn("score", F.round("score", 6))


@query("vector_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 4 * x * x))), 5) AS before, 1.0::DOUBLE AS after FROM embeddings")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    double = F.transform(V.vector("embedding"), lambda x: x * 2)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(double), 5).alias("before"), F.round(V.norm(V.normalize(double)), 5).alias("after"))


@query("vector_literal", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def vector_literal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size(V.from_literal(V.to_literal("embedding"))).cast("long").alias("n"))


@query(
    "knn_join",
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM q, embeddings WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) "
    "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE rank <= 10",
)
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    # the stated query set of a search: every id divisible by 100, against all rows
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn_join(q, e, 10, id_col="vec_id", exclude_self=True).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


# --- keyword search and fusion -----------------------------------------------------------------------------------------------------------

LEX = "list_distinct(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+'))"
O = RetrievalOptions()


@query("lexical_df", f"SELECT term, count(*) AS df FROM (SELECT unnest({LEX}) AS term FROM documents) GROUP BY term")
def lexical_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_frequencies(retrieval.postings(table(spark, d, "documents"), "text", "doc_id"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query("query_terms", "SELECT item_id AS query_id, term FROM (SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda t: length(t) >= 2)) AS term FROM benchmark)")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.explode(T.terms("question", 1_000_000)).alias("term"))


@query(
    "lexical_idf_topk",
    f"""WITH p AS MATERIALIZED (SELECT doc_id, unnest({LEX}) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2) AS ts FROM benchmark),
q0 AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM raw) GROUP BY item_id, term),
q1 AS (SELECT item_id, term FROM q0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= {O.max_query_words}),
q AS (SELECT DISTINCT item_id, strip_accents(term) AS term FROM q1),
t AS (SELECT item_id, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN f ON q.term = f.term, n WHERE n < {O.common_from} OR df <= ceil({O.common_share} * n)),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY idf DESC, term) <= {O.max_terms}),
s AS (SELECT item_id AS query_id, doc_id, sum(idf) AS score FROM k JOIN p ON k.term = p.term GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= {O.lexical_candidates}""",
)
def lexical_idf_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    index, frequencies = retrieval.matching(docs, questions(spark, d), O, text_col="text", id_col="doc_id")
    hits = retrieval.lexical_search(questions(spark, d), index, frequencies, docs.count(), O, id_col="doc_id")
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


LEGS = """WITH a AS (SELECT l_suppkey AS query_id, l_partkey AS chunk_id, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS query_id, l_partkey AS chunk_id, max(l_discount) AS s FROM lineitem GROUP BY 1, 2),
ra AS (SELECT query_id, chunk_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a), rb AS (SELECT query_id, chunk_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM b),
legs AS (SELECT *, 0 AS leg, 0.6 AS weight FROM ra WHERE rank <= 60 UNION ALL SELECT *, 1 AS leg, 0.4 AS weight FROM rb WHERE rank <= 100)"""


def legs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    lines = table(spark, d, "lineitem")

    def leg(column: str, number: int, weight: float, most: int) -> DataFrame:
        s = lines.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id")).agg(F.max(column).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumns({"leg": F.lit(number), "weight": F.lit(weight)})

    return leg("l_quantity", 0, 0.6, 60).unionByName(leg("l_discount", 1, 0.4, 100))


@query("rrf_fusion", LEGS + " SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 6) AS fused FROM legs GROUP BY 1, 2")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(legs(spark, d)).select("query_id", "chunk_id", F.round("fused", 6).alias("fused"))


@query("rrf_relevance", LEGS + ", f AS (SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS f FROM legs GROUP BY 1, 2) SELECT query_id, chunk_id, round(f / max(f) OVER (PARTITION BY query_id), 6) AS relevance FROM f")
def rrf_relevance(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.relevance(retrieval.fuse(legs(spark, d))).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query("hybrid_pool_best", LEGS + " SELECT query_id, chunk_id, round(max(score), 6) AS score FROM legs GROUP BY 1, 2")
def hybrid_pool_best(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.best_of_legs(legs(spark, d)).withColumn("score", F.round("score", 6))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.col("text").alias("content"), "role")


@query(
    "neighbor_expand",
    "WITH h AS (SELECT 0 AS query_id, conv_id, turn, CAST(1.0 / (1 + conv_id) AS DOUBLE) AS score FROM conversations WHERE turn = 2), n AS (SELECT DISTINCT h.query_id, c.conv_id, c.turn, h.score FROM h JOIN conversations c ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) BETWEEN 1 AND 1) "
    "SELECT query_id, conv_id * 100 + turn AS chunk_id, round(score, 6) AS score, false AS neighbour FROM h UNION ALL SELECT query_id, conv_id * 100 + turn, round(score * 0.99, 6), true FROM n",
)
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d)
    hits = c.where("ordinal = 2").select(F.lit(0).alias("query_id"), "chunk_id", (1.0 / (1 + F.col("document_id"))).alias("score"), F.col("document_id").cast("int").alias("rank"))
    return retrieval.expand_neighbours(hits, c, 1).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "neighbour")


@query("dedupe_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"))


# Greedy choices as recursions in SQL: d has what stays of the k nearest vectors of each query, in order, after de-duplication; the next recursion takes one vector a step, with the nearest chosen one of each that is left.
DEDUPED = (
    "WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, e.v, list_cosine_similarity(e.v, q.v) AS s FROM e q, e WHERE q.vec_id % 100 = 0), "
    "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS p FROM s) WHERE p <= {k}), "
    "near AS (SELECT a.query_id, a.p, list(b.p) FILTER (b.p < a.p AND list_inner_product(a.v, b.v) >= {threshold}) AS near FROM c a JOIN c b USING (query_id) GROUP BY 1, 2), "
    "kept AS (SELECT query_id, p, [p] AS kept FROM near WHERE p = 1 UNION ALL SELECT k.query_id, n.p, CASE WHEN list_has_any(k.kept, coalesce(n.near, [])) THEN k.kept ELSE list_append(k.kept, n.p) END FROM kept k JOIN near n ON n.query_id = k.query_id AND n.p = k.p + 1), "
    "last AS (SELECT query_id, arg_max(kept, p) AS kept FROM kept GROUP BY 1), d AS (SELECT c.*, list_position(kept, p) AS rank FROM c JOIN last USING (query_id) WHERE list_contains(kept, p)) "
)


def nearest_60(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, d, "embeddings")
    near = retrieval.knn_join(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 60, id_col="vec_id")
    return near.join(e, "vec_id").select("query_id", "vec_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("position"), F.lit(None).cast("string").alias("content_hash"), "embedding")


@query(
    "mmr_rerank",
    DEDUPED.format(k=60, threshold=O.dedupe_threshold)
    + ", dots AS (SELECT a.query_id, a.rank, any_value(a.vec_id) AS vec_id, any_value(a.s) AS s, list(list_inner_product(a.v, b.v) ORDER BY b.rank) AS dots FROM d a JOIN d b USING (query_id) GROUP BY 1, 2), "
    "m AS (SELECT query_id, list(vec_id ORDER BY rank) AS ids, list(s ORDER BY rank) AS s, list(dots ORDER BY rank) AS dots FROM dots GROUP BY 1), "
    "g AS (SELECT query_id, 0 AS rank, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS best, list_transform(s, lambda x: 0.0::DOUBLE) AS nearest FROM m "
    "UNION ALL SELECT query_id, rank + 1, list_append(chosen, pick), pick, list_transform(range(1, len(ids) + 1), lambda i: greatest(nearest[i], dots[i][pick])) FROM ("
    f"SELECT *, list_position(vals, list_max(vals)) AS pick FROM (SELECT g.*, ids, dots, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE {O.mmr_lambda} * m.s[i] - (1 - {O.mmr_lambda}) * nearest[i] END) AS vals "
    f"FROM g JOIN m USING (query_id) WHERE rank < least({O.top_k}, len(ids))))) SELECT query_id, ids[best] AS vec_id, CAST(rank AS INTEGER) AS rank FROM g JOIN m USING (query_id) WHERE rank > 0",
)
def mmr_rerank(spark: SparkSession, d: str) -> DataFrame:
    """De-duplication and MMR on the 60 nearest vectors of each query of the stated set."""
    return retrieval.select_diverse(nearest_60(spark, d), O, id_col="vec_id").select("query_id", "vec_id", "rank")


@query("hybrid_search")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: every benchmark text as a question to all documents, with hashed vectors."""
    embed = ingest.HashingEmbedder(64)

    def vectors(column: str):  # noqa: ANN202
        @F.arrow_udf("array<double>")
        def f(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.float64())
            return by_slices(lambda some: pa.array(embed([t or "" for t in some.to_pylist()]), kind), kind, 128, texts)

        return f(column)

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), vectors("text").alias("embedding"))
    q = questions(spark, d).withColumn("embedding", vectors("question"))
    return retrieval.search(q, docs, O).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


# --- ingestion and text ------------------------------------------------------------------------------------------------------------------

SMALL = ChunkingOptions(target_tokens=120, max_tokens=200, min_tokens=24, overlap_tokens=24)


@query(
    "chunk_diff",
    """WITH o AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations), n AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN sha256(upper(text)) ELSE sha256(text) END AS h FROM conversations WHERE turn < 6),
ro AS (SELECT *, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn) AS k FROM o), rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn) AS k FROM n)
SELECT coalesce(ro.conv_id, rn.conv_id) AS conv_id, count(*) FILTER (ro.k IS NULL) AS created, count(*) FILTER (ro.k IS NOT NULL AND rn.k IS NOT NULL) AS reused, count(*) FILTER (rn.k IS NULL) AS deleted FROM ro FULL JOIN rn ON ro.conv_id = rn.conv_id AND ro.h = rn.h AND ro.k = rn.k GROUP BY 1""",
)
def chunk_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.lit(1).alias("token_count"), "text")
    old = c.withColumn("content_hash", F.sha2("text", 256))
    new = c.where("ordinal < 6").withColumn("content_hash", F.sha2(F.when(F.col("ordinal") % 3 == 1, F.upper("text")).otherwise(F.col("text")), 256))
    return ingest.diff_summary(ingest.diff_chunks(old, new, ["conv_id"]), ["conv_id"]).select("conv_id", "created", "reused", "deleted")


@query("content_checksum", "SELECT CAST(conv_id AS VARCHAR) AS external_id, sha256(string_agg(turn || ':' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10), '' ORDER BY turn)) AS content_checksum, count(*) AS segments FROM conversations GROUP BY conv_id")
def content_checksum(spark: SparkSession, d: str) -> DataFrame:
    return chunking.content_checksums(conversations_source(spark, d).segments(), T.collapse_whitespace("text")).select("external_id", "content_checksum", "segments")


@query("token_estimate", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.7::DOUBLE)) END AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query(
    "estimate_ingestion",
    "WITH s AS (SELECT avg(length(text)) AS chars FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 5)), n AS (SELECT count(*) AS n FROM documents), t AS (SELECT n, CAST(ceil(chars * n / 3.7::DOUBLE) AS BIGINT) AS tokens FROM s, n), c AS (SELECT *, CAST(ceil(tokens / 432) AS BIGINT) AS chunks FROM t) "
    "SELECT n AS documents, tokens, chunks, chunks * 512 AS embedded_tokens, CAST(round(chunks * 512 * 0.02::DOUBLE) AS BIGINT) AS cost_micros FROM c",
)
def estimate_ingestion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return ingest.estimate(docs, docs.orderBy("doc_id").limit(5).select(F.length("text").alias("chars")), ChunkingOptions(), 0.02)


@query(
    "cost_longest_prefix",
    "WITH p(model, micros_per_token) AS (VALUES ('Brand#1', 0.01::DOUBLE), ('Brand#12', 0.02::DOUBLE), ('Brand#2', 0.03::DOUBLE)) SELECT p_partkey, CAST(round(p_size * coalesce((SELECT micros_per_token FROM p WHERE starts_with(p_brand, p.model) ORDER BY length(p.model) DESC LIMIT 1), 0) * 1000) AS BIGINT) AS cost FROM part",
)
def cost_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("Brand#1", 0.01), ("Brand#12", 0.02), ("Brand#2", 0.03)], "model string, micros_per_token double")
    p = ingest.price(table(spark, d, "part").select("p_partkey", "p_size", F.col("p_brand").alias("model")), prices)
    return p.select("p_partkey", ingest.cost_micros(F.col("p_size"), F.col("micros_per_token") * 1000).alias("cost"))


@query("normalize_text", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.collapse_whitespace("text"), 256).alias("h"))


def _normalized_sql(c: str) -> str:
    """The normalisers in order, with the classes of the regular expressions written out."""
    out = f"regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{FFFD}}]', '', 'g')"
    for a, b in (T.TO_ASCII | T.LIGATURES).items():
        out = f"replace({out}, chr({ord(a)}), '{b.replace(chr(39), chr(39) * 2)}')"
    space, line = "[ \\t-\\r]", "(?:\\r\\n|[\\n-\\r\\x{85}\\x{2028}\\x{2029}])"
    out = f"regexp_replace({out}, '(\\p{{Ll}})-{space}*{line}{space}*(\\p{{Ll}})', '\\1\\2', 'g')"
    return f"trim(regexp_replace({out}, '[\\t-\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


@query("normalize_pipeline", f"SELECT doc_id, sha256({_normalized_sql('text')}) AS h FROM documents")
def normalize_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize("text"), 256).alias("h"))


@query("snippet", "SELECT doc_id, CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE regexp_replace(substr(trim(text), 1, 80), '[\\s.,;:\\-]+$', '') || '...' END AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet("text", 80).alias("snippet"))


@query("position_label", "SELECT conv_id, CASE WHEN min(turn) = max(turn) THEN 'Page ' || min(turn) ELSE 'Pages ' || min(turn) || '-' || max(turn) END AS label FROM conversations GROUP BY conv_id")
def position_label(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    return c.select("conv_id", T.position_label("a", "b").alias("label"))


@query("title_from_text", "SELECT item_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 60)) || '…' END AS title FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)")
def title_from_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.title_of("text").alias("title"))


# the references that the pages have, named ones with or without a semicolon
@query(
    "html_to_text",
    "WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:" + "|".join(f"{t}\\b[^>]*>.*?</{t}" for t in ("script", "style", "noscript", "svg", "template")) + ")\\s*>', '', 'g') AS t FROM pages), "
    "b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6])\\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a), "
    "c AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g') AS t FROM b) "
    "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*\\n\\s*', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM c",
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.readable_html("html", None).alias("text"))


@query("public_urls", "SELECT page_id, page_id % 8 IN (0, 5) AS allowed FROM pages")
def public_urls(spark: SparkSession, d: str) -> DataFrame:
    """The pages' own URLs, and others made of them that must be refused: local names, literal addresses of closed networks, other schemes."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    hosts = (None, "http://localhost", "http://192.168.1.5", "https://127.0.0.1", "ftp://example.com", "https://example.com", "http://printer.local", "https://[::1]")
    made = F.element_at(F.array(*[F.col("url") if h is None else F.concat(F.lit(h), path) for h in hosts]), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.is_public_url(made).alias("allowed"))


@query("sentence_split")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_sentences(conversations_source(spark, d).segments(), SMALL)


@query("chunk_documents")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    s = conversations_source(spark, d)
    return chunking.chunk_documents(s.segments(), SMALL, s.documents())


@query("excerpt")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Each document's part that has most terms of the next one; the last one has no question."""
    docs = table(spark, d, "documents")
    asked = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("question"))
    return docs.join(asked, "doc_id", "left").select("doc_id", T.excerpt("text", "question", 400).alias("excerpt"))


@query("embed_stale", "SELECT conv_id, turn, role <> 'user' AS was_fresh, true AS is_fresh FROM conversations")
def embed_stale(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("embedding_input"), (F.col("role") != "user").alias("was_fresh"))
    old = F.col("was_fresh")
    c = c.withColumns({"embedding": F.when(old, F.array(F.lit(1.0).cast("float"))), "embedding_model": F.when(old, "hashing"), "embedding_dimensions": F.when(old, 16), "embedded_at": F.when(old, F.lit("2024-01-01").cast("timestamp_ntz"))})
    done = ingest.embed_chunks(c, ingest.HashingEmbedder(16), "hashing", 16)
    return done.select("conv_id", "turn", "was_fresh", (~ingest.is_stale("hashing", 16)).alias("is_fresh"))


@query("refresh_counts", "SELECT CAST(conv_id AS VARCHAR) AS external_id, count(*) AS chunk_count, count(*) FILTER (role <> 'system') AS embedded_chunk_count, CASE WHEN count(*) = count(*) FILTER (role <> 'system') THEN 'embedded' ELSE 'chunked' END AS status FROM conversations GROUP BY conv_id")
def refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").select(F.lit("c").alias("source_key"), F.col("conv_id").cast("string").alias("external_id"), F.when(F.col("role") != "system", F.col("turn")).alias("embedded_at"))
    docs = chunks.select("source_key", "external_id").distinct().withColumns({"chunk_count": F.lit(0), "embedded_chunk_count": F.lit(0), "status": F.lit("pending")})
    return ingest.refresh_counts(docs, chunks).select("external_id", "chunk_count", "embedded_chunk_count", "status")


@query("put_vectors", "SELECT vec_id AS chunk_id, CASE WHEN label < 5 THEN 'new' ELSE 'old' END AS embedding_model FROM embeddings")
def put_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    chunks = e.withColumns({"embedding_model": F.lit("old"), "embedding_dimensions": F.lit(64), "embedded_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    return ingest.put_vectors(chunks, e.where("label < 5"), "new", 64).select("chunk_id", "embedding_model")


@query("purge_source", "SELECT count(*) AS n FROM documents WHERE source <> 'src0'")
def purge_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"))
    return ingest.purge_source(docs, docs, "src0")[0].agg(F.count("*").alias("n"))


# --- answering and evaluation ------------------------------------------------------------------------------------------------------------


@query("context_budget", "WITH r AS (SELECT conv_id AS query_id, turn AS rank, length(text) AS token_count, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS marker, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT query_id, rank, CAST(marker AS INTEGER) AS marker FROM r WHERE marker = 1 OR used <= 1500")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.length("text").alias("token_count"))
    return answering.budget(hits, 1500).select("query_id", "rank", "marker")


@query("fetch_document", "WITH r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id AS document_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (used <= 3000), '') AS content, count(*) FILTER (used <= 3000) AS chunks, bool_or(used > 3000) AS truncated FROM r GROUP BY conv_id")
def fetch_document(spark: SparkSession, d: str) -> DataFrame:
    return answering.fetch_document(turns(spark, d), 3000)


@query("last_turns", "SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") != "user").alias("refused"), F.col("text").alias("answer"))
    return answering.last_turns(log, 2, "conv_id", "turn", "turn").select("conv_id", "turn")


@query("conversation_recent", "SELECT c_custkey AS id FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_custkey DESC LIMIT 20")
def conversation_recent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("pinned"), F.col("c_acctbal").alias("last_message_at"))
    return answering.recent_conversations(c, 20).select("id")


@query("recent_with_pinned", "WITH r AS (SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20) SELECT id FROM r UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def recent_with_pinned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("last_message_at"))
    return answering.recent_with_pinned(c, 20, c.where("c_nationkey = 3")).select("id")


@query("citation_markers", "SELECT p_partkey, list_max(list_transform(regexp_extract_all(a, '\\[#(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER))) AS largest, len(list_distinct(regexp_extract_all(a, '\\[#(\\d+)\\]', 1))) AS n FROM (SELECT p_partkey, 'x [#' || p_size || '] y [#' || p_size || '] z [#' || (p_partkey % 7) || ']' AS a FROM part)")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit("x [#"), F.col("p_size").cast("string"), F.lit("] y [#"), F.col("p_size").cast("string"), F.lit("] z [#"), (F.col("p_partkey") % 7).cast("string"), F.lit("]"))
    m = answering.markers(a)
    return table(spark, d, "part").select("p_partkey", F.array_max(m).alias("largest"), F.size(m).cast("long").alias("n"))


@query("judge_answers", "SELECT p_partkey AS query_id, p_size > 3 AS refused, CASE WHEN p_size > 3 THEN 'See.' ELSE 'See [#' || p_size || '].' END AS answer FROM part")
def judge_answers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    answers = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("See [#"), F.col("p_size").cast("string"), F.lit("].")).alias("answer"))
    given = p.select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("marker"))
    return answering.judge_answers(answers, given).select("query_id", "refused", "answer")


@query("query_log", "SELECT item_id, sha256(lower(trim(text))) AS question_hash FROM benchmark")
def query_log(spark: SparkSession, d: str) -> DataFrame:
    return answering.query_log(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))).select("item_id", "question_hash")


@query(
    "eval_recall_mrr",
    """WITH r AS (SELECT l_orderkey AS case_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem),
e AS (SELECT l_orderkey AS case_id, min(l_partkey) FILTER (l_returnflag = 'R') AS part FROM lineitem GROUP BY 1),
f AS (SELECT e.case_id, min(rank) AS fr FROM e LEFT JOIN r ON r.case_id = e.case_id AND r.l_partkey = e.part GROUP BY 1),
g AS (SELECT o_orderpriority AS category, fr FROM f JOIN orders ON case_id = o_orderkey)
SELECT coalesce(category, 'all') AS category, count(*) AS cases, round(avg(CASE WHEN fr <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN fr <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_5, round(avg(CASE WHEN fr <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_10, round(avg(coalesce(1 / fr::DOUBLE, 0)), 4) AS mrr FROM g GROUP BY ROLLUP (category)""",
)
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    # every order is a case: its lines by price are the ranking, and its smallest part that came back is what should be found (none: a miss)
    lines, source = table(spark, d, "lineitem"), F.lit("lines").alias("source")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    results = lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").cast("string").alias("external_id"), F.row_number().over(w).alias("rank"), F.lit("lines").alias("source_key"), F.lit(1).alias("position_start"), F.lit(3).alias("position_end"))
    none = F.lit(None).cast("int")
    back = F.min(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).cast("string").alias("document_id")
    expected = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(back).select("case_id", "document_id", source, F.lit(2).alias("page"), none.alias("page_from"), none.alias("page_to"))
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("category"), F.lit(1.0).alias("ms"))
    return evaluation.report(evaluation.relevant_ranks(results, expected), cases).drop("avg_ms")


@query("interval_join", "SELECT a.conv_id, count(*) AS n FROM (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1) a JOIN (VALUES (0, 1), (3, 4), (6, 9)) r(f, t) ON a.hi >= r.f AND a.lo <= r.t GROUP BY 1")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    ranges = spark.createDataFrame([(0, 1), (3, 4), (6, 9)], "f int, t int")
    return overlap_join(c, ranges, ("lo", "hi"), ("f", "t")).groupBy("conv_id").agg(F.count("*").alias("n"))


# --- sets and scalars --------------------------------------------------------------------------------------------------------------------


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("distinct_terms", "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark")
def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term")).distinct()


@query("first_spelling", "SELECT arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY lower(event_type)")
def first_spelling(spark: SparkSession, d: str) -> DataFrame:
    return answering.first_spelling(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("stream_hourly_counts", "SELECT strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming extension: the same transformation, on a frame that ends."""
    from lodeweave.streaming.streams import hourly_counts

    counted = hourly_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return counted.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "n")


# --- more of ingestion, ranking and answering --------------------------------------------------------------------------------------------


@query("upsert_documents", "SELECT CAST(d.doc_id AS VARCHAR) AS external_id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS title, CASE WHEN d.lang = 'en' THEN 'embedded' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' OR l.doc_id IS NOT NULL")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    key = [F.lit("documents").alias("source_key"), F.col("doc_id").cast("string").alias("external_id")]
    empty = F.create_map().cast("map<string,string>").alias("metadata")
    stored = table(spark, d, "documents").where("lang = 'en'").select(*key, F.lit("old").alias("title"), empty, F.lit("embedded").alias("status"))
    drafts = table(spark, d, "labels").select(*key, F.lit("new").alias("title"), empty)
    return ingest.upsert_documents(stored, drafts).select("external_id", "title", "status")


@query("pending_documents", "SELECT CAST(doc_id AS VARCHAR) AS external_id FROM documents WHERE NOT (lang = 'en' AND n_chars > 500 AND source <> 'src1')")
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    key = [F.lit("documents").alias("source_key"), F.col("doc_id").cast("string").alias("external_id")]
    docs = table(spark, d, "documents")
    now = docs.select(*key, F.sha2("text", 256).alias("content_checksum"))
    was = docs.select(
        *key, F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise("other").alias("content_checksum"), F.lit("params").alias("params_checksum"),
        F.lit(3).alias("chunk_count"), F.when((F.col("n_chars") > 500) & (F.col("source") != "src1"), 3).otherwise(2).alias("embedded_chunk_count"),
    )
    return ingest.pending_documents(now, was, "params").select("external_id")


@query("forget_document", "SELECT count(*) AS n FROM documents WHERE doc_id <> 5")
def forget_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"))
    return ingest.forget_document(docs, docs, "documents", "5")[0].agg(F.count("*").alias("n"))


@query("rerank_head", "WITH h AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_tax AS new, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS p FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY query_id) >= 2 AND max(new) OVER (PARTITION BY query_id) - min(new) OVER (PARTITION BY query_id) >= 1e-6 AS ok FROM h WHERE p <= 30) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN new END DESC NULLS LAST, p) AS INTEGER) AS position FROM k")
def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "o", "n")
    hits = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_tax")
    return retrieval.rerank(hits.withColumn("position", F.row_number().over(w)), F.col("l_tax"), O).select("query_id", "chunk_id", "position")


@query("yes_probability", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_tax + l_discount)), 6) AS p FROM lineitem")
def yes_probability(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.yes_probability(F.col("l_tax"), F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


@query("prompt_context", "SELECT conv_id AS query_id, string_agg('[#' || (turn + 1) || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("marker"), F.col("role").alias("label"), F.col("text").alias("content"))
    return answering.context(c)


@query("parse_passages", "SELECT conv_id AS query_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def parse_passages(spark: SparkSession, d: str) -> DataFrame:
    p = answering.parse_passages(F.col("context"))
    total = F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    return prompt_context(spark, d).select("query_id", F.size(p).cast("long").alias("n"), total.alias("chars"))


@query("renumbered_chunks", "SELECT conv_id, turn AS ordinal, role = 'user' AS fresh FROM conversations")
def renumbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a diff: what is new has no vector, what is kept has its own."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "role", F.sha2(F.concat("text", F.col("turn").cast("string")), 256).alias("content_hash"))
    old = c.where("role <> 'user'").withColumn("embedded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    after = ingest.apply_diff(ingest.diff_chunks(old, c, ["conv_id"]), ["embedded_at"])
    return after.select("conv_id", "ordinal", F.col("embedded_at").isNull().alias("fresh"))


@query(
    "ivf_search_exhaustive",
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) "
    "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE rank <= 10",
)
def ivf_search_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """The inverted-file index with as many probes as lists, which is exact."""
    from lodeweave.operators import ann

    e = table(spark, d, "embeddings")
    centroids = ann.fit_centroids(e, 8)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = ann.search_index(q, ann.build_index(e, centroids), centroids, 10, 8, id_col="vec_id")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("ivf_search")
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """The inverted-file index with as many of its lists probed as a recall of 0.95 takes on a sample; tests hold its recall against the exact search."""
    from lodeweave.operators import ann

    e = table(spark, d, "embeddings")
    centroids = ann.fit_centroids(e, 16)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ann.build_index(e, centroids)
    return ann.search_index(q, index, centroids, 10, ann.fit_probes(index, centroids, 10, id_col="vec_id"), id_col="vec_id").select("query_id", "vec_id", "rank")
