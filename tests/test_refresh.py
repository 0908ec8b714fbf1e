"""Stored marts: period refresh after appended rows, and builds that appear at once or not at all."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aftershock import refresh
from aftershock.refresh import Update, spans_of, update_marts
from aftershock.sinks.files import FileSystem
from aftershock.sinks.versions import MartStore
from aftershock.sources.star import SCHEMAS
from aftershock.specs import INCIDENT_COHORT, INCIDENT_PHASES, PhaseSpec, Span
from checks.compare import duck_rows, spark_rows
from checks.oracle import statements
from tests.conftest import arrow, delivery, order, rating, star_of
from tests.test_definitions import definitions, hostile

INEXACT = ("avg_sentiment", *entry.PHASE_DOUBLES)
# Marts that only other marts read.
BASES = {"monthly_base", "monthly_links", "linked_days"}


def append(spark, root, rows):
    """One more file per table that has rows."""
    star = star_of(spark, arrow(**rows))
    for name in rows:
        if rows[name]:
            frame = getattr(star, name)
            frame.coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def together(*parts):
    return {name: [row for part in parts for row in part.get(name, [])] for name in SCHEMAS if any(name in p for p in parts)}


def assert_marts_equal_definitions(store, rows):
    con = definitions(rows)
    definition = statements(INCIDENT_PHASES, INCIDENT_COHORT, base="")["q08_monthly_order"].rsplit("\n", 1)[0]
    names = store.names()
    assert len(names) == 25
    for name in names:
        mart = store.read(name)
        exact = [c for c in mart.columns if c not in INEXACT]
        if name not in BASES:
            sql = f"{definition} SELECT {', '.join(exact)} FROM {name}"
            assert spark_rows(mart.select(*exact)) == duck_rows(con, sql), name


def folders(store):
    return {name: mart["folders"] for name, mart in store.state()["marts"].items()}


def changed(before, after):
    """Periods of each mart that have another folder, or lost theirs."""
    return {
        name: {p for p in before[name].keys() | after[name].keys() if before[name].get(p) != after[name].get(p)}
        for name in after
    }


@pytest.fixture
def place(tmp_path):
    return f"{tmp_path}/base", f"{tmp_path}/marts"


def test_a_new_day_and_late_rows_rewrite_their_periods_only(spark, place):
    root, marts = place
    store = MartStore(spark, marts)
    first = hostile(2)
    # Orders of the future and the past of July, and no order in the middle of August.
    first["fact_orders"] = [o for o in first["fact_orders"] if o["order_timestamp"] is None or o["order_timestamp"].month != 8]
    append(spark, root, first)
    assert update_marts(store, root, INCIDENT_PHASES) == Update(None, True)
    assert_marts_equal_definitions(store, first)

    before, listed = folders(store), FileSystem(spark).files(marts)
    assert update_marts(store, root, INCIDENT_PHASES) == Update([], False)
    assert folders(store) == before

    day = {
        "fact_orders": [order(5000 + i, customer=i % 9, restaurant=i % 5, at="2025-08-12") for i in range(30)],
        "fact_delivery_performance": [delivery(5000 + i, 30, 30 + i) for i in range(20)],
        "fact_ratings": [rating(5000 + i, 1.0 + i % 5) for i in range(15)],
    }
    append(spark, root, day)
    assert update_marts(store, root, INCIDENT_PHASES) == Update([date(2025, 8, 12)], True)
    so_far = together(first, day)
    assert_marts_equal_definitions(store, so_far)
    after = folders(store)
    august, with_september = {"2025-08-01"}, {"2025-08-01", "2025-09-01"}
    moved = changed(before, after)
    assert moved["daily_summary"] == moved["linked_days"] == moved["monthly_customer_activity"] == august
    assert moved["dim_date"] == moved["weekly_kpis"] == moved["monthly_links"] == august
    assert moved["restaurant_churn_rate"] == with_september
    assert moved["monthly_master_summary"] <= with_september and moved["returning_customer"] <= with_september
    # What was written before stands as it was.
    now = FileSystem(spark).files(marts)
    assert all(now[path] == facts for path, facts in listed.items() if not path.endswith(".json"))

    late = {
        "fact_orders": [order(6000, customer=3, at="2025-03-31"), order(6001, customer=3, at=None)],
        "fact_ratings": [rating(5001, 2.0), rating(999_999, 5.0), rating(None, None, None, None, None)],
    }
    append(spark, root, late)
    assert update_marts(store, root, INCIDENT_PHASES).days == [date(2025, 3, 31), date(2025, 8, 12)]
    assert_marts_equal_definitions(store, together(so_far, late))
    months = {"2025-03-01", "2025-04-01", "2025-08-01", "2025-09-01"}
    assert changed(after, folders(store))["monthly_order"] <= months
    assert store.read("daily_summary", {"2025-03-01"}).filter("date = '2025-03-31'").count() == 1


def test_rewritten_tables_and_other_cuts_are_built_anew(spark, place):
    root, marts = place
    store = MartStore(spark, marts)
    rows = hostile(1)
    append(spark, root, rows)
    update_marts(store, root, INCIDENT_PHASES)
    frame = star_of(spark, arrow(**rows)).fact_orders.limit(40).cache()
    fewer = {**rows, "fact_orders": [r.asDict() for r in frame.collect()]}
    frame.write.mode("overwrite").parquet(f"{root}/fact_orders")
    assert update_marts(store, root, INCIDENT_PHASES).days is None
    assert_marts_equal_definitions(store, fewer)
    other = PhaseSpec(date(2025, 5, 1), date(2025, 7, 1))
    assert update_marts(store, root, other).days is None
    assert store.read("phase_comparison").filter("phase = 'pre'").first().months_in_phase <= 3
    # A changed dimension touches the mart that reads it, and no other.
    before = folders(store)
    append(spark, root, {"dim_restaurant": rows["dim_restaurant"][:3]})
    assert update_marts(store, root, other) == Update([], True)
    moved = {name for name, periods in changed(before, folders(store)).items() if periods}
    assert moved == {"restaurant_activity_summary"}


def test_a_failing_build_leaves_every_mart_readable(spark, place, monkeypatch):
    root, marts = place
    store = MartStore(spark, marts)
    rows = hostile(3)
    append(spark, root, rows)
    update_marts(store, root, INCIDENT_PHASES)
    before, held = folders(store), {n: store.read(n) for n in store.names()}
    contents = {n: spark_rows(f) for n, f in held.items()}
    append(spark, root, {"fact_orders": [order(7000, at="2025-06-03")]})

    def broken(*_):
        raise RuntimeError("no master today")

    with monkeypatch.context() as patched:
        patched.setattr(refresh.monthly, "master_from", broken)
        with pytest.raises(RuntimeError, match="no master"):
            update_marts(store, root, INCIDENT_PHASES)
    assert folders(store) == before
    assert {n: spark_rows(store.read(n)) for n in store.names()} == contents
    # The next update finds the same new rows, and readers of old frames go on reading them.
    assert update_marts(store, root, INCIDENT_PHASES).days == [date(2025, 6, 3)]
    assert {n: spark_rows(f) for n, f in held.items()} == contents
    assert_marts_equal_definitions(store, together(rows, {"fact_orders": [order(7000, at="2025-06-03")]}))
    gone = store.vacuum()
    assert any("/2025-06-01" in g or "=2025-06-01" in g for g in gone)
    assert_marts_equal_definitions(store, together(rows, {"fact_orders": [order(7000, at="2025-06-03")]}))
    assert store.vacuum() == []


def test_builds_side_by_side_are_refused(spark, place):
    store = MartStore(spark, place[1])
    frame = spark.createDataFrame([("2025-01-01", 1), ("2025-02-01", 2)], "month string, n int")
    one, two = store.begin(), store.begin()
    one.refresh("m", frame, F.col("month"), None)
    two.replace("m", frame.limit(1))
    assert store.names() == []
    one.publish()
    with pytest.raises(RuntimeError, match="meanwhile"):
        two.publish()
    assert store.read("m").count() == 2
    third = store.begin()
    third.refresh("m", frame.filter("n > 5"), F.col("month"), {"2025-02-01"})
    third.refresh("empty", frame.limit(0), F.col("month"), None)
    third.publish()
    assert [r.n for r in store.read("m").collect()] == [1]
    assert store.read("empty").count() == 0 and store.read("m", {"2025-02-01"}).count() == 0


def test_neighbouring_months_are_one_span():
    months = {date(2025, 12, 1), date(2026, 1, 1), date(2025, 3, 1)}
    assert spans_of(months) == [Span(date(2025, 3, 1), date(2025, 4, 1)), Span(date(2025, 12, 1), date(2026, 2, 1))]
