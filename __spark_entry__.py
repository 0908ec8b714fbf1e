
from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
from collections.abc import Callable
from datetime import date
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The packages next to this file, whatever directory it is loaded from.
ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from aftershock.functions.calendar import dated, phase_rank
from aftershock.operators import calendar, quality
from aftershock.operators.masks import activity_masks
from aftershock.pipeline import report_frames
from aftershock.plans import cities, cohorts, counted, daily, masked, monthly, phases, restaurants, weekly
from aftershock.refresh import update_marts
from aftershock.session import scratch
from aftershock.sinks.versions import MartStore
from aftershock.sinks.write import export_csv
from aftershock.sources.evolution import EvolvingTable
from aftershock.sources.star import AMOUNTS, Star
from aftershock.sources.tpch import COHORT, PHASES, read_star
from aftershock.specs import PhaseSpec
from checks import oracle

try:
    import corpus_pipeline
    from aftershock.llm import queries as llm
except ImportError:  # the subpackage and the pipeline can be left out
    corpus_pipeline = llm = None

# Phases of a calendar somebody has edited.
MOVED = PhaseSpec(date(1996, 1, 1), date(1997, 7, 1))
ENTRY_DATA = "/root/testdata/sf0.001"


class Tables:
    """The star, its dated orders and the phase and cohort settings of the given data."""

    def __init__(self, star: Star, phase_spec=PHASES, cohort_spec=COHORT):
        self.star = star
        self.phases = phase_spec
        self.cohort = cohort_spec

    @cached_property
    def orders(self) -> DataFrame:
        return dated(self.star.fact_orders, self.phases)

    @property
    def deliveries(self) -> DataFrame:
        return self.star.fact_delivery_performance

    @property
    def ratings(self) -> DataFrame:
        return self.star.fact_ratings

    @property
    def restaurants(self) -> DataFrame:
        return self.star.dim_restaurant

    @property
    def items(self) -> DataFrame:
        return self.star.fact_order_items

    @cached_property
    def orders_by_calendar(self) -> DataFrame:
        """Orders joined to a stored calendar whose phases have been moved."""
        stored = calendar.build_dim_date(self.star.fact_orders, MOVED).checkpoint()
        return calendar.dated_by(self.star.fact_orders, stored)

    def customer_masks(self) -> DataFrame:
        return activity_masks(self.orders, "customer_id")

    def restaurant_masks(self) -> DataFrame:
        return activity_masks(self.orders, "restaurant_id")

    def days(self) -> counted.DayStore:
        return counted.DayStore.of(self.orders, self.deliveries, self.ratings)

    def master(self) -> DataFrame:
        return monthly.monthly_master_summary(self.orders, self.deliveries, self.ratings, self.phases)

    def daily(self) -> DataFrame:
        return daily.daily_summary(self.orders, self.deliveries, self.ratings, self.phases)

    def weekly(self) -> DataFrame:
        return weekly.weekly_kpis(self.orders, self.deliveries, self.ratings)

    def city(self) -> DataFrame:
        return cities.city_revenue(self.orders, self.restaurants)

    def ops_retention(self) -> DataFrame:
        return cohorts.cohort_ops_retention(self.orders, self.deliveries, self.cohort)

    def rating_retention(self, **options) -> DataFrame:
        return cohorts.cohort_rating_retention(
            self.orders, self.deliveries, self.ratings, self.cohort, **options
        )


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round measures that add up inexact doubles: their last digits depend on the order of addition."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def grain_of_marts(t: Tables) -> DataFrame:
    keys = list(monthly.KEYS)
    churn = monthly.restaurant_churn_rate(monthly.monthly_rest_activity(t.orders))
    return quality.grain_check(churn, keys).unionByName(quality.grain_check(t.master(), keys))


def export_and_read(t: Tables) -> DataFrame:
    """Export the four report frames as CSV to the shared folder and return what the files hold.

    The files are the point, so this writes and reads when called; then the folder goes. What
    has been read is checkpointed before that, so no rows pass through the driver.
    """
    frames = report_frames(t.star, t.phases, t.cohort)
    spark = t.star.fact_orders.sparkSession
    with scratch(spark, "export") as folder:
        paths = export_csv(frames, folder)
        held = [
            spark.read.schema(frames[name].schema).option("header", True).csv(path).select(F.lit(name).alias("frame"), "*")
            for name, path in paths.items()
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held).checkpoint()


def amounts_of_changed_type(t: Tables) -> DataFrame:
    """The amounts of a stored table whose older half was written as doubles, before their type changed."""
    amounts = t.star.fact_orders.select("order_id", *AMOUNTS)
    spark = amounts.sparkSession
    older = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0
    doubles = amounts.filter(older).withColumns({c: F.col(c).cast("double") for c in AMOUNTS})
    with scratch(spark, "types") as folder:
        table = EvolvingTable(spark, folder)
        table.begin(doubles.schema)
        table.append(doubles)
        table.alter(**dict.fromkeys(AMOUNTS, "decimal(18,4)"))
        table.append(amounts.filter(~older))
        return table.read().checkpoint()


def refreshed_master(t: Tables) -> DataFrame:
    """The master from stored marts that were built without the last and the middle day and then brought up to date.

    Both deliveries are stored as files of base tables; the second one holds the orders of those two days and the
    ratings of their last day.
    """
    orders, ratings = t.star.fact_orders, t.ratings
    spark = orders.sparkSession
    day, rated = F.to_date("order_timestamp"), F.to_date("review_timestamp")
    first, last = orders.agg(F.min(day), F.max(day)).first()
    last_rated = ratings.agg(F.max(rated)).first()[0]
    middle = first + (last - first) / 2 if first else None
    late = F.coalesce(day.isin(middle, last), F.lit(False))
    late_rated = F.coalesce(rated == F.lit(last_rated), F.lit(False))
    typed = {
        "fact_orders": orders.withColumn("order_timestamp", F.col("order_timestamp").cast("timestamp")),
        "fact_ratings": ratings.withColumn("review_timestamp", F.col("review_timestamp").cast("timestamp")),
    }
    with scratch(spark, "refresh") as folder:
        base, store = f"{folder}/base", MartStore(spark, f"{folder}/marts")
        t.deliveries.write.parquet(f"{base}/fact_delivery_performance")
        t.restaurants.write.parquet(f"{base}/dim_restaurant")
        for part in (F.lit(False), F.lit(True)):
            typed["fact_orders"].filter(late == part).write.mode("append").parquet(f"{base}/fact_orders")
            typed["fact_ratings"].filter(late_rated == part).write.mode("append").parquet(f"{base}/fact_ratings")
            update_marts(store, base, t.phases)
        return store.read("monthly_master_summary").checkpoint()


PHASE_DOUBLES = (
    "retention_rate",
    "avg_rating",
    "late_rate",
    "avg_actual_time_min",
    "avg_expected_time_min",
    "diff_actual_expected_min",
    "avg_monthly_sentiment_score",
)

PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    "q01_null_key_audit": lambda t: quality.null_key_audit(t.star),
    "q02_clean_ratings": lambda t: quality.clean_ratings(t.ratings),
    "q03_normalize_amounts": lambda t: t.star.fact_orders.select("order_id", *AMOUNTS),
    "q03_amounts_of_changed_type": amounts_of_changed_type,
    "q04_build_dim_date": lambda t: calendar.build_dim_date(t.star.fact_orders, t.phases),
    "q05_scan_restaurants": lambda t: t.restaurants,
    "q06_ratings_by_sentiment": lambda t: quality.ratings_by_sentiment(t.ratings, 0.7),
    "q07_orders_with_date": lambda t: calendar.orders_with_date(t.star.fact_orders, t.phases),
    "q08_monthly_order": lambda t: monthly.monthly_order(monthly.order_base(t.orders)),
    "q08_on_given_calendar": lambda t: monthly.monthly_order(monthly.order_base(t.orders_by_calendar)),
    "q09_monthly_active_customer": lambda t: monthly.monthly_active_customer(monthly.customer_base(t.orders)),
    "q09_customers_of_bitmaps": lambda t: monthly.monthly_active_customer(counted.monthly_base(t.days())),
    "q10_delivery_performance_summary": lambda t: monthly.delivery_performance_summary(t.orders, t.deliveries),
    "q11_rating_summary": lambda t: rounded(monthly.rating_summary(t.orders, t.ratings), 10, "avg_sentiment"),
    "q12_restaurant_activity_summary": lambda t: monthly.restaurant_activity_summary(
        monthly.monthly_rest_activity(t.orders), t.restaurants
    ),
    "q13_cancellation_rate": lambda t: monthly.cancellation_rate(monthly.order_base(t.orders)),
    "q14_monthly_ordered_active_customer": lambda t: monthly.monthly_ordered_active_customer(
        monthly.monthly_base(t.orders)
    ),
    "q14_ordered_of_bitmaps": lambda t: monthly.monthly_ordered_active_customer(counted.monthly_base(t.days())),
    "q15_revenue_per_active_customer": lambda t: monthly.revenue_per_active_customer(
        monthly.monthly_base(t.orders)
    ),
    "q16_monthly_customer_activity": lambda t: monthly.monthly_customer_activity(t.orders),
    "q16_activity_of_masks": lambda t: masked.monthly_customer_activity(t.customer_masks()),
    "q17_preview": lambda t: quality.preview(
        monthly.monthly_customer_activity(t.orders), 10, *monthly.KEYS, "customer_id"
    ),
    "q18_returning_customer": lambda t: monthly.returning_customer(
        monthly.monthly_customer_activity(t.orders)
    ),
    "q19_returning_customer_rate": lambda t: monthly.returning_customer_rate(monthly.customer_base(t.orders)),
    "q18_returning_of_masks": lambda t: masked.returning_customer(t.customer_masks()),
    "q19_returning_rate_of_masks": lambda t: masked.returning_customer_rate(t.customer_masks()),
    "q20_monthly_rest_activity": lambda t: monthly.monthly_rest_activity(t.orders),
    "q21_monthly_active_res": lambda t: monthly.monthly_active_res(monthly.monthly_rest_activity(t.orders)),
    "q22_churn_restaurants": lambda t: monthly.churn_restaurants(monthly.monthly_rest_activity(t.orders)),
    "q23_restaurant_churn_rate": lambda t: monthly.restaurant_churn_rate(
        monthly.monthly_rest_activity(t.orders)
    ),
    "q20_activity_of_masks": lambda t: masked.monthly_rest_activity(t.restaurant_masks()),
    "q21_active_res_of_masks": lambda t: masked.monthly_active_res(t.restaurant_masks()),
    "q22_churn_of_masks": lambda t: masked.churn_restaurants(t.restaurant_masks()),
    "q23_churn_rate_of_masks": lambda t: masked.restaurant_churn_rate(t.restaurant_masks()),
    "q24_grain_check": grain_of_marts,
    "q24_grain_check_orders": lambda t: quality.grain_check(t.star.fact_orders, ["order_id"]),
    "q24_grain_check_deliveries": lambda t: quality.grain_check(t.deliveries, ["order_id"]),
    "q24_grain_check_ratings": lambda t: quality.grain_check(t.ratings, ["order_id"]),
    "q24_grain_check_restaurants": lambda t: quality.grain_check(t.restaurants, ["restaurant_id"]),
    "q24_grain_check_items": lambda t: quality.grain_check(t.items, ["order_id", "menu_item_id"]),
    "q26_monthly_master_summary": lambda t: rounded(t.master(), 10, "avg_sentiment"),
    "q27_mart_row_count": lambda t: quality.row_count(t.master(), "rows_in_master"),
    "q27_mart_dump": lambda t: PLANS["q26_monthly_master_summary"](t).orderBy(*monthly.KEYS),
    "q28a_daily_orders": lambda t: daily.daily_orders(t.star.fact_orders),
    "q28b_daily_ratings": lambda t: daily.daily_ratings(t.star.fact_orders, t.ratings),
    "q28c_daily_delivery": lambda t: daily.daily_delivery(t.star.fact_orders, t.deliveries),
    "q28_daily_summary": lambda t: t.daily(),
    "q29_orders_per_active_customer_day": lambda t: daily.orders_per_active_customer_day(t.daily()).orderBy("phase"),
    "q30_phase_revenue_decomposition": lambda t: phases.phase_revenue_decomposition(t.orders).orderBy("phase"),
    "q30_decomposition_of_bitmaps": lambda t: counted.phase_revenue_decomposition(t.days()).orderBy("phase"),
    "q31_phase_customer_overlap": lambda t: phases.phase_customer_overlap(t.orders, t.phases),
    "q32_weekly_kpis": lambda t: t.weekly().orderBy("week_start_date", "phase"),
    "q32_weekly_of_bitmaps": lambda t: counted.weekly_kpis(t.days()).orderBy("week_start_date", "phase"),
    "q32_on_given_calendar": lambda t: weekly.weekly_kpis(t.orders_by_calendar, t.deliveries, t.ratings).orderBy(
        "week_start_date", "phase"
    ),
    "q33_cohort_ops_retention": lambda t: t.ops_retention(),
    "q34_cohort_rating_retention": lambda t: t.rating_retention(),
    "q34_cohort_flag_retention": lambda t: t.rating_retention(group_by=cohorts.RATING_FLAGS),
    "q35_new_vs_returning": lambda t: phases.new_vs_returning(t.star.fact_orders, t.phases).orderBy("phase"),
    "q36_frequency_bucket_retention": lambda t: cohorts.frequency_bucket_retention(t.orders, t.cohort),
    "q37_restaurant_tier_by_phase": lambda t: restaurants.restaurant_tier_by_phase(t.orders),
    "q38_top_restaurants_pre": lambda t: restaurants.top_restaurants_pre(t.orders, t.restaurants, t.phases),
    "q39_top_restaurants_across_phases": lambda t: restaurants.top_restaurants_across_phases(
        t.orders, t.restaurants
    ),
    "q40_city_phase": lambda t: cities.city_phase(t.orders, t.restaurants),
    "q41_city_revenue": lambda t: t.city().orderBy("city", phase_rank(F.col("phase"))),
    "q42_city_revenue_wide": lambda t: cities.city_revenue_wide(t.orders, t.restaurants),
    "q43_phase_comparison": lambda t: rounded(phases.phase_comparison(t.master()), 9, *PHASE_DOUBLES),
    "q44_baseline_index": lambda t: rounded(weekly.baseline_index(t.weekly()), 6, *weekly.INDEXES),
    "q45_phase_spans": lambda t: weekly.phase_spans(t.weekly()),
    "q46_restaurant_coverage": lambda t: cities.restaurant_coverage(t.city()),
    "q47_revenue_share_pivot": lambda t: cities.revenue_share_pivot(t.city()),
    "q48_export_csv": export_and_read,
    "q49_cohort_retention_curve": lambda t: cohorts.cohort_retention_curve(t.orders, t.cohort),
    "q49_curve_of_masks": lambda t: masked.cohort_retention_curve(t.customer_masks(), t.cohort),
}


# Whole builds, of many jobs each.
BUILDS: dict[str, Callable[[Tables], DataFrame]] = {
    "q26_refreshed_master": lambda t: rounded(refreshed_master(t), 10, "avg_sentiment"),
}


def entry(spark: SparkSession) -> DataFrame:
    """The monthly master: every monthly KPI of orders, customers, deliveries, ratings and restaurants."""
    return queries()["q26_monthly_master_summary"](spark, ENTRY_DATA)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: plan(Tables(read_star(spark, sf_dir)))

    def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            set_local_folder(spark)
            # Python workers that are not started from here find the packages as well.
            spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
            return query(spark, sf_dir)

        return run

    plans = {name: bind(plan) for name, plan in (PLANS | BUILDS).items()}
    if llm is not None:
        plans |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: prepared(query) for name, query in plans.items()}


def set_local_folder(spark: SparkSession) -> None:
    """Give a local session without ``spark.checkpoint.dir`` a folder that goes with the process."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if context.master.startswith("local[") or context.master == "local":
        folder = tempfile.mkdtemp(prefix="aftershock-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def oracle_sql() -> dict[str, str]:
    statements = oracle.statements(PHASES, COHORT)
    moved = oracle.statements(MOVED, COHORT)
    statements |= {"q08_on_given_calendar": moved["q08_monthly_order"], "q32_on_given_calendar": moved["q32_weekly_kpis"]}
    if llm is not None:
        statements |= llm.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL is not None:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements
