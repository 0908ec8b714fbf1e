"""Crisis-impact and recovery analytics over a food-delivery star schema, on Spark.

Layers, lowest first:

* ``specs``     – phase cuts and cohort windows (plain values, no Spark)
* ``sources``   – where the star schema comes from (Parquet, JDBC, TPC-H-shaped tables)
* ``functions`` – column expressions
* ``operators`` – reusable DataFrame -> DataFrame building blocks
* ``plans``     – the named marts and diagnostics
* ``sinks``     – tables, bucketed tables and CSV exports

Every operator and plan is lazy, except the exact distributed ``ntile``, which
has to materialise its sorted input once.
"""

from aftershock.specs import CohortSpec, PhaseSpec, Span
from aftershock.sources.star import Star

__all__ = ["CohortSpec", "PhaseSpec", "Span", "Star"]
