"""Operators with a scale path of their own, sources, sinks and the pipeline."""

from __future__ import annotations

import random
import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aftershock.__main__ import main
from aftershock.functions.calendar import dated
from aftershock.operators import dimension, linked, quality
from aftershock.operators.ntile import global_ntile, tier_by_ntile
from aftershock.pipeline import build_checks, build_marts, build_reports, save_tables
from aftershock.plans import cities, cohorts, monthly, weekly
from aftershock.session import shared_dir
from aftershock.sinks.write import drop_mart, export_csv, save_bucketed, save_star
from aftershock.sources import jdbc, star as star_source, tpch
from aftershock.specs import INCIDENT_COHORT, INCIDENT_PHASES, PhaseSpec, cohort_of
from checks.compare import duck_rows, spark_rows
from checks.oracle import statements
from tests.conftest import arrow, star_of
from tests.test_definitions import SMALL, definitions, hostile


@pytest.mark.parametrize("rows,tiles", [(0, 10), (1, 10), (7, 10), (10, 10), (103, 10), (1000, 7), (999, 1)])
def test_ntile_equals_the_window_function(spark, rows, tiles):
    rnd = random.Random(rows)
    data = [(i, None if i == 5 else rnd.randrange(20)) for i in range(rows)]
    frame = spark.createDataFrame(data, "id long, revenue int").repartition(6)
    order = [F.desc("revenue"), F.asc_nulls_first("id")]
    expected = frame.withColumn("tile", F.ntile(tiles).over(Window.orderBy(*order)))
    assert spark_rows(global_ntile(frame, order, tiles)) == spark_rows(expected)


def test_ntile_where_one_value_owns_most_rows(spark):
    frame = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("revenue"))
    order = [F.desc("revenue"), F.asc("id")]
    expected = frame.withColumn("tile", F.ntile(10).over(Window.orderBy(*order)))
    tiled = global_ntile(frame, order, 10)
    assert spark_rows(tiled) == spark_rows(expected)


def test_tiers(spark):
    frame = spark.range(20).toDF("id")
    tiers = tier_by_ntile(frame, [F.asc("id")], ((1, "head"), (4, "tail")), "part_of")
    assert [r["count"] for r in tiers.groupBy("part_of").count().orderBy("part_of").collect()] == [5, 15]


def test_ntile_puts_no_rows_into_a_single_task(spark):
    plan = global_ntile(spark.range(100).toDF("id"), [F.asc("id")], 10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    single = text.split("Exchange SinglePartition")
    assert len(single) == 2 and "part" in single[1].splitlines()[1]


@pytest.fixture()
def facts(spark):
    """A restaurant that owns a third of the facts."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).cast("long").alias("restaurant_id"),
        F.col("id").alias("customer_id"),
    )


@pytest.fixture()
def places(spark):
    return spark.range(35).select(F.col("id").alias("restaurant_id"), F.concat(F.lit("c"), F.col("id") % 4).alias("city"))


def test_dimension_join_is_the_same_on_every_path(spark, facts, places):
    expected = spark_rows(facts.join(places, "restaurant_id"))
    spread = F.col("customer_id")
    for options in ({}, {"limit": 0}, {"limit": 0, "spread_by": spread}):
        joined = dimension.join_dimension(facts, places, "restaurant_id", **options)
        assert joined.columns == ["restaurant_id", "customer_id", "city"]
        assert spark_rows(joined) == expected


def test_dimension_join_spreads_a_hot_key(spark, facts, places):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        joined = dimension.join_dimension(
            facts, places, "restaurant_id", spread_by=F.col("customer_id"), limit=0
        )
        hot = joined.filter("restaurant_id = 1").groupBy(F.spark_partition_id().alias("p")).count()
        assert hot.count() >= 6
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_city_marts_with_a_dimension_too_big_to_broadcast(spark, monkeypatch):
    star = star_of(spark, arrow(**hostile(5)))
    orders = dated(star.fact_orders, INCIDENT_PHASES)
    expected = spark_rows(cities.city_revenue(orders, star.dim_restaurant))
    monkeypatch.setattr(dimension, "BROADCAST_BYTES", 0)
    assert spark_rows(cities.city_revenue(orders, star.dim_restaurant)) == expected


def test_scanned_bytes_adds_up_the_files(spark, tmp_path):
    frame = spark.range(1000)
    frame.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < dimension.scanned_bytes(back) < 100_000
    assert dimension.scanned_bytes(back.crossJoin(back)) < 200_000


def test_star_round_trip_through_files(spark, tmp_path):
    source = star_of(spark, arrow(**hostile(6)))
    for name in star_source.SCHEMAS:
        if name in ("dim_customer", "dim_menu_item"):
            continue
        frame = getattr(source, name)
        stamps = [c for c, t in frame.dtypes if t == "timestamp_ntz"]
        frame.withColumns({c: F.col(c).cast("timestamp") for c in stamps}).write.parquet(f"{tmp_path}/{name}")
    star = star_source.read_star(spark, str(tmp_path))
    mart = lambda s: monthly.monthly_order(monthly.order_base(dated(s.fact_orders, INCIDENT_PHASES)))
    assert spark_rows(mart(star)) == spark_rows(mart(source))
    with pytest.raises(AttributeError):
        star.no_such_table


def test_stored_orders_are_skipped_by_time(spark, tmp_path):
    source = tpch.read_star(spark, SMALL)
    save_star(source, str(tmp_path), files=12)
    star = star_source.read_star(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        mart = cohorts.frequency_bucket_retention(dated(star.fact_orders, tpch.PHASES), tpch.COHORT)
        frame = mart.orderBy("frequency_bucket")
        got = spark_rows(frame)
        scan = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() < 1500 * 0.5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plain = cohorts.frequency_bucket_retention(dated(source.fact_orders, tpch.PHASES), tpch.COHORT)
    assert got == spark_rows(plain)


def test_star_registers_for_sql(spark):
    tpch.read_star(spark, SMALL).register()
    assert spark.sql("SELECT COUNT(*) AS n FROM fact_orders WHERE restaurant_id IS NULL").collect()[0].n == 27
    assert spark.sql("SELECT COUNT(*) AS n FROM dim_customer").collect()[0].n == 150


def test_jdbc_reads_are_split_by_key():
    options = jdbc.table_options("fact_orders", jdbc.KeyRange("order_id", 0, 10**9, 400))
    assert options["partitionColumn"] == "order_id" and options["numPartitions"] == "400"
    assert "partitionColumn" not in jdbc.table_options("dim_restaurant", None)


def test_describe_columns(spark):
    frame = spark.range(1).select("id", F.lit("x").alias("label"))
    rows = [tuple(r) for r in quality.describe_columns(spark, frame).collect()]
    assert rows == [(1, "id", "bigint"), (2, "label", "string")]


def test_preview_without_order(spark):
    assert quality.preview(spark.range(50), 10).count() == 10


def test_pipeline_can_be_repeated_and_equals_the_definitions(spark):
    rows = hostile(7)
    star = star_of(spark, arrow(**rows))
    spark.sql("CREATE DATABASE IF NOT EXISTS marts")
    for _ in range(2):
        marts = build_marts(star, INCIDENT_PHASES, save_tables("marts"))
    con = definitions(rows)
    expected = statements(INCIDENT_PHASES, INCIDENT_COHORT, base="")
    definition = expected["q08_monthly_order"].rsplit("\n", 1)[0]
    inexact = ("avg_sentiment", *entry.PHASE_DOUBLES)
    for name, mart in marts.items():
        if name in ("monthly_base", "monthly_links", "linked_days"):
            continue
        wanted = con.sql(f"{definition} SELECT * FROM {name}").columns
        assert sorted(mart.columns) == sorted(wanted), name
        exact = [c for c in mart.columns if c not in inexact]
        sql = f"{definition} SELECT {', '.join(exact)} FROM {name}"
        assert spark_rows(mart.select(*exact)) == duck_rows(con, sql), name
    assert len(marts) == 24 and spark.catalog.tableExists("marts.daily_summary")
    drop_mart(spark, "marts.daily_summary")
    assert not spark.catalog.tableExists("marts.daily_summary")


def test_checks_and_reports_of_the_build_equal_the_definitions(spark):
    rows = hostile(8)
    star = star_of(spark, arrow(**rows))
    plans = {}

    def save(name, frame):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        frame.write.mode("overwrite").saveAsTable(f"checked_{name}")
        return spark.table(f"checked_{name}")

    marts = build_marts(star, INCIDENT_PHASES, save)
    # The only mart with a join on the order id is the one that all others read.
    joins = {n: len(re.findall(r"Join \w+, \(order_id", text)) for n, text in plans.items()}
    assert {n: c for n, c in joins.items() if c} == {"linked_days": 2}
    checks = build_checks(star, marts, save)
    con = definitions(rows)
    expected = statements(INCIDENT_PHASES, INCIDENT_COHORT, base="")
    assert spark_rows(checks["null_key_audit"]) == duck_rows(con, expected["q01_null_key_audit"])
    grain = {r.table_name: (r.repeated_keys, r.their_rows) for r in checks["grain_report"].collect()}
    for table, key in (("fact_orders", "order_id"), ("fact_ratings", "order_id"), ("dim_restaurant", "restaurant_id")):
        sql = f"SELECT COUNT(*), COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {key} HAVING COUNT(*) > 1)"
        assert grain[table] == tuple(con.execute(sql).fetchone())
    assert grain["dim_restaurant"][0] > 0 and grain["monthly_master_summary"] == (0, 0)
    counts = {r.table_name: r.row_count for r in checks["mart_row_counts"].collect()}
    assert counts == {n: m.count() for n, m in marts.items()}

    reports = build_reports(star, INCIDENT_PHASES, INCIDENT_COHORT, marts["linked_days"], save)
    by_name = {n.split("_", 1)[1]: n for n in expected}
    assert len(reports) == 19
    for name, report in reports.items():
        if name == "baseline_index":
            report = entry.rounded(report, 6, *weekly.INDEXES)
        assert spark_rows(report) == duck_rows(con, expected[by_name[name]]), name


def test_command_builds_checks_and_exports(spark, tmp_path, capsys):
    save_star(tpch.read_star(spark, SMALL), f"{tmp_path}/star", files=4)
    cuts = ["--crisis-start", "1998-01-01", "--post-start", "1999-01-01", "--database", "built", "--csv", f"{tmp_path}/csv"]
    windows = ["--cohort", "1997-07-01", "1998-01-01", "--experience", "1998-01-01", "1998-07-01"]
    windows += ["--outcome", "1998-07-01", "1999-01-01", "--cohort-name", "h2_1997"]
    main([f"{tmp_path}/star", "--normalized", "--buckets", "2", *cuts, *windows])
    assert spark.table("built.monthly_master_summary").count() == 80
    assert spark.table("built.city_revenue_wide").count() > 0
    assert "fact_orders" not in capsys.readouterr().out
    expected = entry.PLANS["q48_export_csv"](entry.Tables(tpch.read_star(spark, SMALL)))
    for name in ("weekly_df", "retention_df", "retention_rating_df", "city_revenue_df"):
        path = f"{tmp_path}/csv/{name}.csv"
        header = spark.read.option("header", True).csv(path).columns
        read = spark.read.schema(expected.select(*header).schema).option("header", True).csv(path)
        assert spark_rows(read) == spark_rows(expected.filter(F.col("frame") == name).select(*header)), name
        assert read.count() > 0


def test_command_derives_the_cohort_from_the_cuts_and_refuses_an_empty_one(spark, tmp_path):
    save_star(tpch.read_star(spark, SMALL), f"{tmp_path}/star", files=2)
    main([f"{tmp_path}/star", "--csv", f"{tmp_path}/csv", "--crisis-start", "1998-01-01", "--post-start", "1998-04-01"])
    phases = PhaseSpec(date(1998, 1, 1), date(1998, 4, 1))
    spec = cohort_of(phases, "1997-12-01")
    assert (spec.cohort.start, spec.outcome.end) == (date(1997, 12, 1), date(1998, 5, 1))
    star = tpch.read_star(spark, SMALL)
    want = cohorts.cohort_ops_retention(dated(star.fact_orders, phases), star.fact_delivery_performance, spec)
    read = spark.read.schema(want.schema).option("header", True).csv(f"{tmp_path}/csv/retention_df.csv")
    assert spark_rows(read) == spark_rows(want) and read.count() > 0
    with pytest.raises(SystemExit):
        main([f"{tmp_path}/star", "--csv", f"{tmp_path}/none"])


def test_incident_cohort_is_the_derived_one():
    assert cohort_of(INCIDENT_PHASES, "may_2025") == INCIDENT_COHORT


@pytest.fixture()
def sixteen_tasks(spark):
    settings = {"autoBroadcastJoinThreshold": -1, "adaptive.enabled": False, "shuffle.partitions": 16}
    for key, value in settings.items():
        spark.conf.set(f"spark.sql.{key}", value)
    yield
    for key in settings:
        spark.conf.unset(f"spark.sql.{key}")
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def balanced(frame) -> bool:
    """The largest task has at most three times the rows of the median one."""
    sizes = sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())
    return len(sizes) >= 12 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_an_order_id_on_a_third_of_the_orders_is_split(spark, sixteen_tasks):
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    orders = spark.range(30_000).select(
        hot.alias("order_id"),
        (F.col("id") % 9973).alias("customer_id"),
        F.timestamp_seconds(F.lit(1748736000) + (F.col("id") % 29) * 86400).alias("order_timestamp"),
        F.lit("N").alias("is_cancelled"),
    )
    orders = dated(orders, INCIDENT_PHASES)
    deliveries = spark.range(30_000).select(
        F.col("id").alias("order_id"), F.lit(20).alias("expected_delivery_time_mins"), F.lit(60).alias("actual_delivery_time_mins")
    )
    ratings = spark.range(10).select(
        F.col("id").alias("order_id"), F.lit(1.0).alias("rating"), F.lit(0.5).alias("sentiment_score")
    )
    keys = ["month_start_date", "phase"]
    linked_rows = linked.linked_orders(orders, keys, deliveries, ratings)
    assert balanced(linked_rows)
    assert linked_rows.agg(F.sum("orders")).first()[0] == 30_000
    assert balanced(linked.counted(orders, keys).join(linked.delivery_sums(deliveries), "order_id"))
    assert linked.delivery_measures(orders, deliveries, keys).agg(F.sum("deliveries")).first()[0] == 30_000
    late = {"late": linked.actual_minutes() > linked.expected_minutes()}
    evidence = cohorts.delivery_evidence(orders, deliveries, INCIDENT_COHORT, late)
    assert balanced(evidence) and evidence.select("customer_id").distinct().count() == 9973


def test_unknown_customers_of_a_hot_restaurant_are_split(spark, sixteen_tasks, monkeypatch):
    monkeypatch.setattr(dimension, "BROADCAST_BYTES", 0)
    orders = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 40).alias("restaurant_id"),
        F.when(F.col("id") % 2 == 1, F.col("id")).alias("customer_id"),
        F.lit("pre").alias("phase"),
    )
    places = spark.range(40).select(F.col("id").alias("restaurant_id"), F.lit("Pune").alias("city"))
    visitors = cities.visitors(orders, places)
    assert balanced(visitors) and visitors.count() == 10_001


def test_jdbc_columns_get_the_types_of_the_file_source(spark):
    raw = spark.sql("SELECT CAST(1 AS INT) AS restaurant_id, 'x' AS restaurant_name, 'c' AS city, 'p' AS partner_type,"
                    " CAST(1 AS BOOLEAN) AS is_active, 7 AS avg_prep_time_min, 'more' AS other")
    typed = jdbc.typed(raw, "dim_restaurant")
    assert typed.schema.simpleString() == star_source.SCHEMAS["dim_restaurant"].simpleString()


def test_flags_of_normalized_tables_are_filtered_in_the_scan(spark, tmp_path):
    save_star(tpch.read_star(spark, SMALL), str(tmp_path), files=2)
    star = star_source.read_star(spark, str(tmp_path), normalized=True)
    mart = monthly.monthly_rest_activity(dated(star.fact_orders, tpch.PHASES))
    assert "EqualTo(is_cancelled,N)" in mart._jdf.queryExecution().executedPlan().toString()


def test_no_folder_is_left_by_exports(spark):
    root = shared_dir(spark)
    entry.queries()["q48_export_csv"](spark, SMALL).count()
    left = [p for p in Path(root.removeprefix("file:")).glob("*") if p.name.startswith("export")]
    assert left == []


def test_csv_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    paths = export_csv({"frame": frame}, str(tmp_path))
    back = spark.read.option("header", True).schema("n int, s string").csv(paths["frame"])
    assert spark_rows(back) == spark_rows(frame)
    parts = export_csv({"frame": frame.repartition(2)}, f"{tmp_path}/parts", single=False)
    assert spark_rows(spark.read.option("header", True).schema("n int, s string").csv(parts["frame"])) == spark_rows(frame)


def test_csv_export_gives_one_ordered_file_per_frame_and_replaces_it(spark, tmp_path):
    numbers = spark.range(2000, numPartitions=7).withColumn("half", F.col("id") / 2)
    for rows in (numbers.orderBy(F.desc("id")), numbers.filter("id < 3").orderBy("half"), numbers.limit(0)):
        paths = export_csv({"numbers": rows, "other": numbers}, str(tmp_path))
        lines = (tmp_path / "numbers.csv").read_text().splitlines()
        assert lines == ["id,half", *(f"{r.id},{r.half}" for r in rows.collect())]
    assert paths == {"numbers": f"{tmp_path}/numbers.csv", "other": f"{tmp_path}/other.csv"}
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"numbers.csv", "other.csv"}


def test_bucketed_facts_join_without_shuffle(spark):
    star = tpch.read_star(spark, SMALL)
    orders = save_bucketed(star.fact_orders, "bucketed_orders", "order_id", 4)
    deliveries = save_bucketed(star.fact_delivery_performance, "bucketed_deliveries", "order_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        mart = monthly.delivery_performance_summary(dated(orders, tpch.PHASES), deliveries)
        text = mart._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "SortMergeJoin" in text
        plain = monthly.delivery_performance_summary(
            dated(star.fact_orders, tpch.PHASES), star.fact_delivery_performance
        )
        assert spark_rows(mart) == spark_rows(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_exported_frames_do_not_pass_through_the_driver(spark, monkeypatch):
    def refused(self):
        raise AssertionError("collected")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark.range(1)), "collect", refused)
        exported = entry.queries()["q48_export_csv"](spark, SMALL)
    assert exported.count() > 0 and exported.select("frame").distinct().count() == 4
