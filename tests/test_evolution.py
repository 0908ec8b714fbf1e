"""Tables with columns of changed type."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.sinks.files import FileSystem
from aftershock.sources.evolution import EvolvingTable
from aftershock.sources.star import AMOUNTS, normalize_amounts
from tests.conftest import rows_of

MONEY = "decimal(18,4)"


def table(spark, path, frame):
    evolving = EvolvingTable(spark, str(path))
    evolving.begin(T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema]))
    evolving.append(frame)
    return evolving


def test_amounts_of_old_and_new_type_are_read_together(spark, tmp_path):
    old = spark.range(300).select("id", *[(F.col("id") * 1.1 + i).alias(a) for i, a in enumerate(AMOUNTS)])
    old = old.withColumn(AMOUNTS[0], F.when(F.col("id") % 9 != 0, F.col(AMOUNTS[0])))
    evolving = table(spark, tmp_path / "orders", old)
    before = FileSystem(spark).files(str(tmp_path / "orders"))
    evolving.alter(**dict.fromkeys(AMOUNTS, MONEY))
    new = normalize_amounts(old.withColumn("id", F.col("id") + 1000))
    evolving.append(new)
    after = FileSystem(spark).files(str(tmp_path / "orders"))
    assert before.items() <= after.items()
    assert rows_of(evolving.read()) == rows_of(normalize_amounts(old).unionByName(new))
    assert {r.column: (r.old_type, r["values"], r.misfits) for r in evolving.misfits().collect()} == {
        a: ("double", 300 if i else 266, 0) for i, a in enumerate(AMOUNTS)
    }
    # A second change, of another column.
    evolving.alter(id="string")
    evolving.append(new.withColumn("id", F.lit("last")))
    read = evolving.read()
    assert read.schema["id"].dataType == T.StringType() and read.count() == 900
    assert read.filter("id = '7'").first()[AMOUNTS[1]] == Decimal("8.7000")
    plan = evolving.read().select(AMOUNTS[3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"ReadSchema: struct<{AMOUNTS[3]}:") == 3


def test_values_that_do_not_fit_are_found_and_refused(spark, tmp_path):
    evolving = table(spark, tmp_path / "t", spark.createDataFrame([("1",), ("x",), (None,), ("3.7",)], "n string"))
    evolving.alter(n="decimal(3,1)")
    assert [tuple(r) for r in evolving.misfits().collect()] == [("n", "string", "decimal(3,1)", 3, 1)]
    with pytest.raises(Exception, match="n does not fit decimal"):
        evolving.read().collect()
    with pytest.raises(ValueError, match="no such columns"):
        evolving.alter(m="int")
    with pytest.raises(ValueError, match="the rows have"):
        evolving.append(spark.createDataFrame([("1",)], "n string"))


def test_an_empty_table(spark, tmp_path):
    evolving = EvolvingTable(spark, str(tmp_path / "none"))
    evolving.begin(T.StructType([T.StructField("a", T.LongType())]))
    evolving.alter(a="string")
    assert evolving.read().collect() == [] and evolving.misfits().collect() == []
    assert evolving.schema["a"].dataType == T.StringType()
