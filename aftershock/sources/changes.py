"""What has been added to stored base tables since a former look at them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.sinks.files import FileSystem
from aftershock.sources.star import SCHEMAS, Star

Listing = dict[str, dict[str, list[int]]]


def listing(spark: SparkSession, root: str) -> Listing:
    """Data files of every base table under ``root``, with size and time of change."""
    files = FileSystem(spark)
    return {name: {path: [*facts] for path, facts in files.files(f"{root}/{name}").items()} for name in SCHEMAS}


@dataclass(frozen=True)
class Changes:
    """New files by table, and the tables of which known files have changed or gone."""

    added: dict[str, list[str]]
    rewritten: frozenset[str]

    @classmethod
    def between(cls, before: Listing, now: Listing) -> Changes:
        added, rewritten = {}, set()
        for name, files in now.items():
            known = before.get(name, {})
            if any(files.get(path) != facts for path, facts in known.items()):
                rewritten.add(name)
            new = sorted(path for path in files if path not in known)
            if new:
                added[name] = new
        return cls(added, frozenset(rewritten))

    def touch(self, name: str) -> bool:
        return name in self.added or name in self.rewritten


def touched_days(star: Star, added: Star, names: set[str]) -> list[date]:
    """Days of the added orders, and of the orders that added deliveries and ratings belong to.

    ``added`` gives the new rows of the tables in ``names``. At most a row per calendar day
    comes to the driver. A satellite without an order touches no day.
    """
    day = F.to_date("order_timestamp").alias("date")
    parts: list[DataFrame] = []
    if "fact_orders" in names:
        parts.append(added.fact_orders.select(day))
    for name in ("fact_delivery_performance", "fact_ratings"):
        if name in names:
            ids = getattr(added, name).select("order_id").filter("order_id IS NOT NULL").distinct()
            parts.append(star.fact_orders.join(ids, "order_id", "left_semi").select(day))
    found: set[date] = set()
    for part in parts:
        found |= {row.date for row in part.distinct().filter("date IS NOT NULL").collect()}
    return sorted(found)
