"""Every operator as a named query over one folder of parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.config import Settings
from shelfwatch.functions.skew import heavy_keys, union_all
from shelfwatch.functions.text import file_in_message
from shelfwatch.operators import anomalies, checks, cube, history, lineage, profile, sketches, triage
from shelfwatch.plans import dashboard, models
from shelfwatch.plans.dashboard import Filters
from shelfwatch.plans.models import Warehouse
from shelfwatch.session import scratch_path
from shelfwatch.sources import artefacts, faults
from shelfwatch.sources import tables as storage
from shelfwatch.sources.retail import RawTables
from shelfwatch.streaming import jobs

#: Parameters that suit the dates of the given tables.
SETTINGS = Settings(exclude_confirmed_from=date(2000, 1, 1), recent_start=date(2001, 7, 1))
WITHOUT_EXCLUSION = Settings(exclude_confirmed_from=None, recent_start=SETTINGS.recent_start)

ALL_DATES = Filters(date(1995, 1, 1), date(2001, 12, 31))
FILTERED = Filters(
    date(1996, 1, 1), date(1999, 12, 31), ("NATION_1", "NATION_2", "NATION_3"), ("web", "store")
)
EMPTY_RANGE = Filters(date(1980, 1, 1), date(1980, 12, 31))
CHANNELS = ("web", "mobile", "store")
WINDOW = (date(1996, 1, 1), date(1998, 12, 31))
UNIQUE_BEFORE = date(2001, 1, 1)
ONE_DAY = date(1997, 5, 28)
OUTLIER_LIMIT = 1000.0
#: Last time of the first of two deliveries.
SECOND_LOAD = "2024-01-16 12:00:00"
#: Bytes of stored orders for each bucket of the facts. One task stores or merges a bucket and reads some five times
#: as many shuffled bytes; a month's file of a bucket has a small part of them.
BUCKET_BYTES = 32 << 20


class Tables:
    """The tables of one folder, with what queries share within a session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._hot: dict[tuple[str, str], list[Any]] = {}

    def table(self, name: str) -> DataFrame:
        return storage.read_table(self.spark, self.folder, name)

    def hot(self, table: str, column: str) -> list[Any]:
        """Hot keys of a column, looked up once per session."""
        if (table, column) not in self._hot:
            self._hot[table, column] = heavy_keys(self.table(table), column)
        return self._hot[table, column]

    @property
    def hot_orders(self) -> list[Any]:
        return self.hot("orders", "o_orderkey")

    @property
    def hot_products(self) -> list[Any]:
        return self.hot("lineitem", "l_partkey")

    @cached_property
    def raw(self) -> RawTables:
        return RawTables(self.spark, self.folder)

    def warehouse(self, settings: Settings = SETTINGS, **replaced: DataFrame) -> Warehouse:
        raw = self.raw.with_tables(**replaced) if replaced else self.raw
        return Warehouse(raw, settings, lambda: self.hot_orders)

    @cached_property
    def marts(self) -> Warehouse:
        """Warehouse whose order facts are stored, as dashboards read them."""
        return self.warehouse().use_stored_facts(scratch_path(self.spark, "fct_orders"))

    def with_null_customers(self) -> DataFrame:
        return models.stg_orders(faults.null_customers(self.raw.orders))

    def with_duplicates(self) -> DataFrame:
        return models.stg_orders(faults.duplicate_orders(self.raw.orders))

    def with_bad_channels(self) -> DataFrame:
        return models.stg_orders(faults.bad_channels(self.raw.orders))

    def with_orphans(self) -> DataFrame:
        return models.stg_order_items(faults.orphan_products(self.raw.order_items))

    def versions(self) -> DataFrame:
        base = self.warehouse()
        return history.customer_versions(base.stg_customers, base.stg_orders, SETTINGS.recent_start)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def failures(self) -> DataFrame:
        return triage.failed_nodes(artefacts.run_results(self.events))

    @property
    def incidents(self) -> DataFrame:
        return artefacts.incidents(self.events)

    @cached_property
    def nodes(self) -> DataFrame:
        return artefacts.lineage_nodes(self.table("customer"))

    @property
    def failed_ids(self) -> DataFrame:
        return artefacts.failed_lineage_nodes(self.table("customer"))


_OPEN: dict[tuple[str, str], tuple[list, Tables]] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """Tables of a folder, shared by the queries of one Spark application until a file changes."""
    key = (spark.sparkContext.applicationId, folder)
    state = [storage.table_state(spark, folder, name) for name in storage.SCHEMAS]
    if key not in _OPEN or _OPEN[key][0] != state:
        _OPEN[key] = state, Tables(spark, folder)
    return _OPEN[key][1]


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _model(name: str) -> None:
    def build(t: Tables) -> DataFrame:
        return getattr(t.warehouse(), name)

    QUERIES[name] = build


for _name in (*Warehouse.VIEWS, *Warehouse.MARTS):
    _model(_name)


# -- models and materialisation --------------------------------------------


@query
def int_order_revenue_no_bug(t: Tables) -> DataFrame:
    return t.warehouse(WITHOUT_EXCLUSION).int_order_revenue


@query
def int_order_revenue_duplicates(t: Tables) -> DataFrame:
    """Copies of an order count its revenue once per copy."""
    return t.warehouse(orders=faults.duplicate_orders(t.raw.orders)).int_order_revenue


@query
def order_revenue_positive(t: Tables) -> DataFrame:
    base = t.warehouse()
    return models.order_revenue_positive(base.stg_orders, base.stg_order_items, SETTINGS, t.hot_orders)


@query
def revenue_expression(t: Tables) -> DataFrame:
    value = models.revenue_expression(F.col("line_amount"), F.col("quantity"))
    return t.warehouse().stg_order_items.select("order_item_id", "order_id", value.alias("line_value"))


@query
def cast_tolerant(t: Tables) -> DataFrame:
    """Dates from text in which some values are not dates."""
    text = F.when(F.col("order_id") % 10 == 0, "not-a-date").otherwise(F.col("order_date").cast("string"))
    return t.warehouse().stg_orders.select("order_id", text.try_cast("date").alias("parsed_date"))


@query
def mart_write_roundtrip(t: Tables) -> DataFrame:
    written = t.warehouse().write_marts(scratch_path(t.spark, "marts"))
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("mart"), "row_count")
        for name, df in written.items()
    ]
    return union_all(counts)


@query
def fct_orders_full_refresh(t: Tables) -> DataFrame:
    return history.full_refresh(t.warehouse().int_order_revenue, t.versions())


def _merged(t: Tables, versions: DataFrame, repair: bool) -> DataFrame:
    """Facts built without exclusion and stored by month, then the recent orders merged into their months."""
    tag = uuid.uuid4().hex
    state = storage.table_state(t.spark, t.folder, "orders")
    buckets = 1 + (state[1] if state else 0) // BUCKET_BYTES
    store = history.FactStore(t.spark, f"facts_{tag}", scratch_path(t.spark, "facts"), buckets)
    store.create(t.warehouse(WITHOUT_EXCLUSION).fct_orders)
    try:
        history.stored_merge(
            store, t.warehouse().int_order_revenue, versions, SETTINGS.recent_start, f"recent_{tag}", repair
        )
    finally:
        merged = store.forget(f"recent_{tag}")
    return merged


@query
def fct_orders_incremental_merge(t: Tables) -> DataFrame:
    """Recent orders, one version each, merged into facts built without exclusion."""
    return _merged(t, t.versions(), repair=True)


@query
def fct_orders_incremental_guarded(t: Tables) -> DataFrame:
    """The same merge on closed versions, which the duplicate guard lets pass."""
    return _merged(t, history.close_versions(t.versions()), repair=False)


@query
def fact_grain_regression(t: Tables) -> DataFrame:
    return faults.doubled(t.warehouse().fct_orders)


@query
def rows_as_json(t: Tables) -> DataFrame:
    rows = t.with_null_customers().select(
        "order_id", "customer_id", "order_status", "order_date", "order_timestamp"
    )
    return storage.rows_as_json(rows)


# -- customer versions -----------------------------------------------------


@query
def dim_customers_scd2(t: Tables) -> DataFrame:
    return t.versions()


@query
def scd2_overlaps(t: Tables) -> DataFrame:
    return history.overlapping_versions(t.versions())


@query
def scd2_closed(t: Tables) -> DataFrame:
    return history.close_versions(t.versions())


@query
def orders_temporal_join(t: Tables) -> DataFrame:
    joined = history.orders_with_versions(t.warehouse().int_order_revenue, t.versions())
    return joined.select("order_id", "customer_id", "order_date", "order_revenue", "valid_from", "valid_to")


@query
def merge_duplicate_guard(t: Tables) -> DataFrame:
    return history.merge_duplicate_guard(
        t.warehouse().int_order_revenue, t.versions(), SETTINGS.recent_start
    )


# -- dashboard -------------------------------------------------------------


@query
def kpis(t: Tables) -> DataFrame:
    return dashboard.kpis(t.marts.fct_orders, ALL_DATES)


@query
def kpis_filtered(t: Tables) -> DataFrame:
    return dashboard.kpis(t.marts.fct_orders, FILTERED)


@query
def kpis_empty_range(t: Tables) -> DataFrame:
    return dashboard.kpis(t.marts.fct_orders, EMPTY_RANGE)


@query
def kpis_unfiltered_nulls(t: Tables) -> DataFrame:
    """No channel list keeps orders without a channel, a full list drops them."""
    facts = t.warehouse(orders=faults.bad_channels(t.raw.orders)).fct_orders
    full = Filters(ALL_DATES.start, ALL_DATES.end, (), (*CHANNELS, "marketplace"))
    return union_all(
        [
            dashboard.kpis(facts, filters).withColumn("channel_list", F.lit(label))
            for label, filters in (("none", ALL_DATES), ("all", full))
        ]
    )


@query
def daily_trends(t: Tables) -> DataFrame:
    return dashboard.daily_trends(t.marts.fct_orders, FILTERED)


@query
def by_country(t: Tables) -> DataFrame:
    return dashboard.breakdown(t.marts.fct_orders, "country_code", ALL_DATES)


@query
def by_channel(t: Tables) -> DataFrame:
    return dashboard.breakdown(t.marts.fct_orders, "channel", FILTERED)


@query
def top_products(t: Tables) -> DataFrame:
    return dashboard.top_products(
        t.marts.fct_orders, t.marts.stg_order_items, t.marts.dim_products, ALL_DATES
    )


@query
def top_stores(t: Tables) -> DataFrame:
    return dashboard.top_stores(t.marts.fct_orders, t.marts.dim_stores, ALL_DATES)


@query
def filter_bounds(t: Tables) -> DataFrame:
    return dashboard.filter_bounds(t.marts.fct_orders, t.marts.fct_daily_sales)


@query
def filter_countries(t: Tables) -> DataFrame:
    return dashboard.filter_values(t.marts.fct_orders, "country_code")


@query
def filter_channels(t: Tables) -> DataFrame:
    return dashboard.filter_values(t.marts.fct_orders, "channel")


# -- profiling -------------------------------------------------------------


@query
def table_profile(t: Tables) -> DataFrame:
    return profile.table_profile(t.with_null_customers(), "customer_id")


@query
def table_profile_day(t: Tables) -> DataFrame:
    return profile.table_profile(t.with_null_customers(), "customer_id", ONE_DAY)


@query
def metric_history_rows(t: Tables) -> DataFrame:
    return profile.metric_history(t.warehouse().stg_orders, "row_count")


@query
def metric_history_revenue(t: Tables) -> DataFrame:
    return profile.metric_history(
        t.warehouse().stg_orders, "revenue", daily_sales=t.marts.fct_daily_sales
    )


@query
def metric_history_total(t: Tables) -> DataFrame:
    return profile.metric_history(t.warehouse().stg_orders, "anything else")


@query
def freshness(t: Tables) -> DataFrame:
    return profile.freshness(t.warehouse().stg_orders)


@query
def table_schema(t: Tables) -> DataFrame:
    return profile.describe_table(t.with_null_customers())


@query
def adhoc_capped(t: Tables) -> DataFrame:
    t.marts.fct_orders.createOrReplaceTempView("fct_orders")
    return profile.run_read_only(
        t.spark, "select order_id, order_date, order_revenue from fct_orders order by order_id;"
    )


@query
def query_log_readonly(t: Tables) -> DataFrame:
    statement = F.col("statement")
    return artefacts.query_log(t.events).select(
        "event_id", statement, profile.is_read_only(statement).alias("allowed")
    )


# -- checks ----------------------------------------------------------------


@query
def dq_not_null_customer(t: Tables) -> DataFrame:
    return checks.not_null(t.with_null_customers(), "customer_id", ["order_id"])


@query
def dq_not_null_customer_window(t: Tables) -> DataFrame:
    window = t.with_null_customers().where(F.col("order_date").between(*map(F.lit, WINDOW)))
    return checks.not_null(window, "customer_id", ["order_id"])


@query
def dq_unique_orders(t: Tables) -> DataFrame:
    return checks.unique(t.with_duplicates().where(F.col("order_date") < F.lit(UNIQUE_BEFORE)), ["order_id"])


@query
def dq_unique_orders_day(t: Tables) -> DataFrame:
    return checks.unique(t.with_duplicates().where(F.col("order_date") == F.lit(ONE_DAY)), ["order_id"])


@query
def dq_unique_order_items(t: Tables) -> DataFrame:
    return checks.unique(t.warehouse().stg_order_items, ["order_item_id"])


@query
def dq_relationships_product(t: Tables) -> DataFrame:
    return checks.relationships(
        t.with_orphans(), "product_id", t.warehouse().stg_products, "product_id",
        ["order_item_id", "product_id"], t.hot_products,
    )


@query
def orphans_in_window(t: Tables) -> DataFrame:
    base = t.warehouse()
    return checks.orphans_in_window(
        t.with_orphans(), base.stg_orders, base.stg_products, *WINDOW,
        t.hot_products, t.hot("lineitem", "l_orderkey"),
    )


@query
def dq_accepted_channel(t: Tables) -> DataFrame:
    return checks.accepted_values(t.with_bad_channels(), "channel", CHANNELS, ["order_id", "channel"])


@query
def dq_type_signup_date(t: Tables) -> DataFrame:
    """A sign-up date that became a timestamp violates the type test everywhere."""
    drifted = t.warehouse().stg_customers.withColumn(
        "signup_date", F.col("signup_date").cast("timestamp_ntz")
    )
    return checks.column_type(drifted, "signup_date", "DATE")


@query
def dq_not_empty(t: Tables) -> DataFrame:
    """The revenue model, as it is and after a constant-false filter."""
    revenue = t.warehouse().int_order_revenue
    cases = (("revenue", revenue), ("revenue_where_false", revenue.where(F.lit(False))))
    return union_all([checks.not_empty(df).withColumn("model", F.lit(name)) for name, df in cases])


@query
def dq_expression_price(t: Tables) -> DataFrame:
    """The inverted price rule: every product with a valid price is reported."""
    return checks.expression(t.warehouse().dim_products, F.col("unit_price") < 0, ["product_id"])


@query
def dq_fact_grain(t: Tables) -> DataFrame:
    return checks.unique(fact_grain_regression(t), ["order_id"])


@query
def dq_key_type_match(t: Tables) -> DataFrame:
    """Product keys that became text are cast back before they are compared."""
    products = t.warehouse().stg_products.withColumn("product_id", F.col("product_id").cast("string"))
    repaired = products.withColumn("product_id", F.col("product_id").cast("bigint"))
    items = t.with_orphans()
    checks.key_types_match(items, "product_id", repaired, "product_id")
    return checks.relationships(
        items, "product_id", repaired, "product_id", ["product_id"], t.hot_products
    )


@query
def dq_suite(t: Tables) -> DataFrame:
    """Nine tests in six passes: column faults share a load, clean orders are grouped once, references joined once."""
    base = t.warehouse()
    orders = faults.bad_channels(faults.null_customers(t.raw.orders))
    in_window = F.col("order_date").between(*map(F.lit, WINDOW))
    no_customer = F.col("customer_id").isNull()
    shared = {
        "column_faults": models.stg_orders(orders),
        "repeated_orders": t.with_duplicates(),
        "clean_orders": base.stg_orders,
        "items": t.with_orphans(),
        "products": base.stg_products,
        "window": base.stg_orders.where(in_window),
        "facts": faults.doubled(t.marts.fct_orders),
    }
    product = ("items", "product_id", "products", "product_id")
    return checks.fused_suite(
        shared,
        [
            checks.RowTest("dq_not_null_customer", "column_faults", no_customer),
            checks.RowTest("dq_not_null_customer_window", "column_faults", no_customer & in_window),
            checks.RowTest(
                "dq_accepted_channel", "column_faults",
                ~F.col("channel").isin(*CHANNELS) | F.col("channel").isNull(),
            ),
            checks.KeyTest(
                "dq_unique_orders", "repeated_orders", ("order_id",), F.col("order_date") < F.lit(UNIQUE_BEFORE)
            ),
            checks.KeyTest("clean_orders", "clean_orders", ("order_id",)),
            checks.RowTest("clean_customer", "clean_orders", no_customer),
            checks.ReferenceTest("dq_relationships_product", *product),
            checks.ReferenceTest("orphans_in_window", *product, "order_id", "window"),
            checks.KeyTest("dq_fact_grain", "facts", ("order_id",)),
        ],
    )


# -- anomalies -------------------------------------------------------------


@query
def anomaly_volume_drop(t: Tables) -> DataFrame:
    return anomalies.volume_drop(faults.volume_drop(t.events))


@query
def anomaly_freshness_gap(t: Tables) -> DataFrame:
    as_of = t.events.agg(F.max(F.col("ts").cast("date"))).scalar()
    return anomalies.freshness_gap(faults.load_stopped(t.events), as_of)


@query
def anomaly_null_rate(t: Tables) -> DataFrame:
    return anomalies.null_rate_spike(faults.null_spike(t.events), "user_id")


@query
def anomaly_duplicates(t: Tables) -> DataFrame:
    return anomalies.duplicates(faults.replayed(t.events), "event_id")


@query
def anomaly_distribution_shift(t: Tables) -> DataFrame:
    return anomalies.distribution_shift(faults.share_shift(t.events), "event_type")


@query
def anomaly_kpi_drop(t: Tables) -> DataFrame:
    return anomalies.kpi_drop(anomalies.daily_revenue(faults.all_event_faults(t.events), "value"))


@query
def anomaly_dimension_missing(t: Tables) -> DataFrame:
    return anomalies.dimension_missing(faults.missing_dimension(t.events), "event_type")


@query
def anomaly_outliers(t: Tables) -> DataFrame:
    return anomalies.outliers(faults.outliers(t.events), "value", OUTLIER_LIMIT, ["event_id", "ts", "value"])


@query
def anomaly_orphan_rate(t: Tables) -> DataFrame:
    base = t.warehouse()
    return anomalies.orphan_rate(
        t.with_orphans(), base.stg_orders, base.stg_products, 0.0, t.hot_products, t.hot_orders
    )


@query
def anomaly_missing_status(t: Tables) -> DataFrame:
    base = t.warehouse()
    return anomalies.missing_status(
        base.stg_orders, base.stg_order_items, t.marts.fct_orders,
        SETTINGS.accepted_statuses, t.hot_orders,
    )


def _event_cells(events: DataFrame) -> DataFrame:
    return cube.cells(events, "ts", "event_type", "user_id", "value", OUTLIER_LIMIT)


def _stored_cube(t: Tables, name: str, **loads: DataFrame) -> cube.DailyCube:
    held = cube.DailyCube(t.spark, scratch_path(t.spark, name))
    for load, events in loads.items():
        held.add(load, _event_cells(events))
    return held


def _cube_in_loads(t: Tables) -> cube.DailyCube:
    """The faulty load in two deliveries that cut a day in two, as a cube that was added to."""
    faulty = faults.all_event_faults(t.events)
    first = F.col("ts") <= F.lit(SECOND_LOAD).cast("timestamp_ntz")
    return _stored_cube(
        t, "daily_cube", first=faulty.where(first), second=faulty.where(~first | F.col("ts").isNull())
    )


@query
def cube_daily_profile(t: Tables) -> DataFrame:
    """Every day's profile from the stored cube of two loads."""
    return _cube_in_loads(t).profile()


#: Window of the sketch profile; it cuts both deliveries.
SKETCH_DAYS = (date(2024, 1, 5), date(2024, 1, 24))


@query
def sketch_profile(t: Tables) -> DataFrame:
    """A window's profile from stored day sketches of two loads, held against one exact pass over the window.

    Counts and extremes are exact; of the estimates (distinct values, quartiles) it is reported whether they keep their error.
    """
    columns = ["user_id", "event_type", "value"]
    faulty = faults.all_event_faults(t.events)
    first = F.col("ts") <= F.lit(SECOND_LOAD).cast("timestamp_ntz")
    held = sketches.SketchStore(t.spark, scratch_path(t.spark, "day_sketches"))
    for load, part in {"first": faulty.where(first), "second": faulty.where(~first | F.col("ts").isNull())}.items():
        held.add(load, sketches.day_sketches(part, "ts", columns))
    shares = (0.25, 0.5, 0.75)
    profiles = held.window(*SKETCH_DAYS, shares)
    inside = faulty.where(F.col("ts").cast("date").between(*map(F.lit, SKETCH_DAYS)))
    limits = {r["name"]: r["quantiles"] for r in profiles.collect()}  # one row per column
    checked = []
    for at, name in enumerate(columns):
        errors = [sketches.order_error(name, q, F.lit(v)) for q, v in zip(shares, limits.get(name) or (), strict=False)]
        checked.append(F.countDistinct(name).alias(f"distinct_{at}"))
        checked.append((F.greatest(*errors, F.lit(0.0)) if errors else F.lit(None).cast("double")).alias(f"error_{at}"))
    facts = [
        F.struct(F.lit(c).alias("name"), F.col(f"distinct_{at}").alias("n"), F.col(f"error_{at}").alias("error"))
        for at, c in enumerate(columns)
    ]
    exact = inside.agg(*checked).select(F.inline(F.array(*facts)))
    apart = F.abs(F.col("distinct_count") - F.col("n"))
    return profiles.join(exact, "name").select(
        "name",
        "row_count",
        "null_rate",
        "low",
        "high",
        (apart <= 4 * sketches.DISTINCT_ERROR * F.col("n")).alias("distinct_close"),
        (F.col("error") <= 2 * sketches.ORDER_ERROR).alias("quartiles_close"),
    )


@query
def cube_findings(t: Tables) -> DataFrame:
    """Days that each detector reports, all read from one stored cube."""
    held = _cube_in_loads(t)
    found = {
        "volume_drop": held.volume_drop(),
        "null_rate_spike": held.null_rate_spike(),
        "distribution_shift": held.distribution_shift(),
        "kpi_drop": held.kpi_drop(),
        "dimension_missing": held.dimension_missing(),
        "outliers": held.outlier_days(),
    }
    return union_all(
        [rows.select(F.lit(name).alias("detector"), "day").distinct() for name, rows in found.items()]
    )


@query
def detection_scores(t: Tables) -> DataFrame:
    """All detectors on one faulty load, freshness on the load that stopped; no row is left out.

    Six detectors read a stored daily cube of the faulty events and one a cube of the load that stopped.
    """
    faulty = faults.all_event_faults(t.events)
    held = _stored_cube(t, "faulty_cube", all=faulty)
    stopped = _stored_cube(t, "stopped_cube", all=faults.load_stopped(t.events))
    as_of = t.events.agg(F.max(F.col("ts").cast("date"))).scalar()
    findings = {
        "volume_drop": held.volume_drop(),
        "null_rate_spike": held.null_rate_spike(),
        "duplicates": anomalies.duplicates(faulty, "event_id"),
        "distribution_shift": held.distribution_shift(),
        "kpi_drop": held.kpi_drop(),
        "dimension_missing": held.dimension_missing(),
        "outliers": held.outlier_days(),
        "referential_integrity": anomaly_orphan_rate(t),
        "dbt_transformation_error": anomaly_missing_status(t),
        "freshness_gap": stopped.freshness_gap(as_of),
    }
    truth = t.spark.createDataFrame([(name,) for name in anomalies.ANOMALY_TYPES], "anomaly_type string")
    return anomalies.detection_scores(anomalies.detected_types(findings), truth)


# -- triage ----------------------------------------------------------------


@query
def failed_nodes(t: Tables) -> DataFrame:
    return t.failures


@query
def failed_nodes_from_json(t: Tables) -> DataFrame:
    """Run results that arrive as JSON text."""
    return triage.failed_nodes(triage.parsed_runs(artefacts.run_results_json(t.events), "document"))


@query
def failed_nodes_from_text(t: Tables) -> DataFrame:
    return triage.failed_nodes_from_text(artefacts.log_texts(t.table("documents")), "doc_id", "log_text")


@query
def failed_nodes_prioritised(t: Tables) -> DataFrame:
    return triage.prioritised(t.failures, artefacts.PATCHED_FILES).select(
        "run_id", "sort_priority", "unique_id", "position", "node_name", "file_path"
    )


@query
def error_categories(t: Tables) -> DataFrame:
    return triage.category_counts(t.failures)


@query
def auto_fixable(t: Tables) -> DataFrame:
    """Category of the first failure of every run, and whether a fix can be automatic."""
    return triage.run_categories(artefacts.run_results(t.events), t.failures, artefacts.PATCHED_FILES)


@query
def classifications_match(t: Tables) -> DataFrame:
    return triage.classifications_match(t.failures, artefacts.expected_failures(t.events))


@query
def eval_summary(t: Tables) -> DataFrame:
    return triage.eval_summary(classifications_match(t))


@query
def single_class_match(t: Tables) -> DataFrame:
    wanted = artefacts.expected_failures(t.events)
    return triage.single_class_matches(t.failures, wanted, t.hot("events", "event_id"))


@query
def run_evaluation(t: Tables) -> DataFrame:
    return triage.run_evaluation(t.failures, artefacts.expected_failures(t.events))


@query
def message_categories(t: Tables) -> DataFrame:
    """Categories of whole conversation turns."""
    turns = t.table("conversations").select("conv_id", "turn", F.col("text").alias("error_message"))
    return triage.classified(turns).select("conv_id", "turn", "error_category")


@query
def message_file_paths(t: Tables) -> DataFrame:
    message = artefacts.message_at(F.col("event_id"))
    return t.events.select("event_id", file_in_message(message).alias("file_path"))


@query
def normalized_error_types(t: Tables) -> DataFrame:
    wanted = artefacts.expected_failures(t.events)
    return wanted.groupBy(
        "error_type", triage.normalized_type(F.col("error_type")).alias("category")
    ).agg(F.count(F.lit(1)).alias("failures"))


@query
def fix_files_match(t: Tables) -> DataFrame:
    return t.incidents.select(
        "incident_id", triage.fix_files_match(F.col("expected_files")).alias("fix_files_match")
    )


@query
def root_cause_file_match(t: Tables) -> DataFrame:
    return t.incidents.select(
        "incident_id", triage.root_cause_file_match(F.col("expected_file")).alias("file_match")
    )


@query
def validation_passed(t: Tables) -> DataFrame:
    flag = F.col("validation_passed")
    return t.incidents.select("incident_id", triage.validation_passed(flag).alias("passed"))


@query
def report_confidence(t: Tables) -> DataFrame:
    report = F.col("report")
    rated = artefacts.reports(t.table("documents")).withColumn("confidence", triage.report_confidence(report))
    return rated.select(
        "doc_id", "confidence", triage.needs_human(report, F.col("confidence")).alias("needs_human")
    )


@query
def source_data_issue(t: Tables) -> DataFrame:
    reports = artefacts.reports(t.table("documents"))
    return reports.select("doc_id", triage.source_data_issue(F.col("report")).alias("source_data_issue"))


@query
def question_intents(t: Tables) -> DataFrame:
    intent, tools = triage.question_intent(F.col("text"))
    return t.table("conversations").select(
        "conv_id", "turn", intent.alias("intent"), F.array_join(tools, ",").alias("tools")
    )


@query
def incidents_normalised(t: Tables) -> DataFrame:
    node = F.get("diagnostic.failed_nodes", F.lit(0))
    return triage.incidents_normalised(t.incidents).select(
        "incident_id",
        "diagnostic.command_executed",
        "diagnostic.has_errors",
        *[
            node[field].alias(field)
            for field in ("node_type", "unique_id", "node_name", "file_path", "error_message")
        ],
    )


@query
def incidents_latest(t: Tables) -> DataFrame:
    return triage.incidents_latest(t.incidents.select("incident_id", "created_at", "scenario_id"))


# -- lineage ---------------------------------------------------------------


@query
def lineage_edges(t: Tables) -> DataFrame:
    return lineage.edges(t.nodes)


@query
def lineage_upstream(t: Tables) -> DataFrame:
    return lineage.closure(t.spark, lineage.edges(t.nodes), t.failed_ids, "upstream", t.nodes)


@query
def lineage_downstream(t: Tables) -> DataFrame:
    return lineage.closure(t.spark, lineage.edges(t.nodes), t.failed_ids, "downstream", t.nodes)


@query
def lineage_distance(t: Tables) -> DataFrame:
    return lineage.distances(t.spark, lineage.edges(t.nodes), t.failed_ids, t.nodes)


@query
def lineage_summary(t: Tables) -> DataFrame:
    return lineage.summary(t.spark, lineage.edges(t.nodes), t.failed_ids, t.nodes)


@query
def lineage_depth3(t: Tables) -> DataFrame:
    every = lineage.edges(t.nodes, known_only=False)
    return lineage.upstream_within(t.spark, every, t.failed_ids, t.nodes)


@query
def lineage_selected_nodes(t: Tables) -> DataFrame:
    """Failed nodes and all around them, one row per node."""
    chosen = lineage.selected_nodes(t.spark, lineage.edges(t.nodes), t.failed_ids, t.nodes)
    return chosen.select("unique_id", "resource_type", "name")


@query
def lineage_tests(t: Tables) -> DataFrame:
    return lineage.tests_of(t.nodes, t.nodes.where(F.col("resource_type") == "model"))


@query
def lineage_unknown_ids(t: Tables) -> DataFrame:
    """Named parents that are not nodes."""
    named = t.nodes.select(F.explode("parents").alias("unique_id"))
    return lineage.unknown_ids(named, t.nodes)


# -- streaming -------------------------------------------------------------


def _event_stream(t: Tables) -> DataFrame:
    return jobs.read_events(t.spark, t.folder)


@query
def dedup_events(t: Tables) -> DataFrame:
    return jobs.dedup_batch(faults.replayed_everywhere(t.events))


@query
def stream_dedup(t: Tables) -> DataFrame:
    return jobs.run_dedup(t.spark, faults.replayed_everywhere(_event_stream(t)))


@query
def stream_daily_volume(t: Tables) -> DataFrame:
    return jobs.run_daily_volume(t.spark, _event_stream(t))


@query
def stream_finished_days(t: Tables) -> DataFrame:
    """Days that the stream's watermark has passed, with the events that came in time and late."""
    return jobs.count_days(t.spark, _event_stream(t)).finished(t.spark)


@query
def stream_upsert(t: Tables) -> DataFrame:
    return jobs.run_upsert(t.spark, _event_stream(t))


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries as callables of (session, folder)."""

    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(tables(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}
