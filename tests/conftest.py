from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from aftershock.session import build_session
from aftershock.sources.star import Star, normalize_orders

MONEY = pa.decimal128(18, 4)
SCHEMAS = {
    "fact_orders": pa.schema(
        [
            ("order_id", pa.int64()),
            ("customer_id", pa.int64()),
            ("restaurant_id", pa.int64()),
            ("order_timestamp", pa.timestamp("us")),
            ("subtotal_amount", MONEY),
            ("discount_amount", MONEY),
            ("delivery_fee", MONEY),
            ("total_amount", MONEY),
            ("is_cancelled", pa.string()),
        ]
    ),
    "fact_order_items": pa.schema([("order_id", pa.int64()), ("menu_item_id", pa.int64())]),
    "fact_delivery_performance": pa.schema(
        [
            ("order_id", pa.int64()),
            ("expected_delivery_time_mins", pa.int32()),
            ("actual_delivery_time_mins", pa.int32()),
        ]
    ),
    "fact_ratings": pa.schema(
        [
            ("order_id", pa.int64()),
            ("customer_id", pa.int64()),
            ("rating", pa.float64()),
            ("sentiment_score", pa.float64()),
            ("review_timestamp", pa.timestamp("us")),
        ]
    ),
    "dim_restaurant": pa.schema(
        [
            ("restaurant_id", pa.int64()),
            ("restaurant_name", pa.string()),
            ("city", pa.string()),
            ("partner_type", pa.string()),
            ("is_active", pa.int32()),
            ("avg_prep_time_min", pa.string()),
        ]
    ),
}


def order(order_id, customer=1, restaurant=1, at="2025-05-10", amount="10", flag="N"):
    moment = datetime.fromisoformat(at) if at else None
    money = None if amount is None else Decimal(amount)
    return {
        "order_id": order_id,
        "customer_id": customer,
        "restaurant_id": restaurant,
        "order_timestamp": moment,
        "subtotal_amount": money,
        "discount_amount": Decimal(0),
        "delivery_fee": Decimal(0),
        "total_amount": money,
        "is_cancelled": flag,
    }


def delivery(order_id, expected, actual):
    return {
        "order_id": order_id,
        "expected_delivery_time_mins": expected,
        "actual_delivery_time_mins": actual,
    }


def rating(order_id, value, sentiment=0.5, customer=1, at="2025-06-15"):
    moment = datetime.fromisoformat(at) if at else None
    return {
        "order_id": order_id,
        "customer_id": customer,
        "rating": value,
        "sentiment_score": sentiment,
        "review_timestamp": moment,
    }


def restaurant(restaurant_id, city="Pune", partner="cloud", active=1, prep="0-15"):
    return {
        "restaurant_id": restaurant_id,
        "restaurant_name": f"R{restaurant_id}",
        "city": city,
        "partner_type": partner,
        "is_active": active,
        "avg_prep_time_min": prep,
    }


def arrow(**rows) -> dict[str, pa.Table]:
    """Base tables from lists of rows; tables not named are empty."""
    return {name: pa.Table.from_pylist(rows.get(name, []), schema=s) for name, s in SCHEMAS.items()}


def star_of(spark, tables: dict[str, pa.Table]) -> Star:
    frames = {name: spark.createDataFrame(table) for name, table in tables.items()}
    frames["fact_orders"] = normalize_orders(frames["fact_orders"])
    return Star.of(**frames)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(folder / "checkpoints"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_star(spark):
    return lambda **rows: star_of(spark, arrow(**rows))


def rows_of(frame, *columns) -> list[tuple]:
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def day(text: str) -> date:
    return date.fromisoformat(text)
