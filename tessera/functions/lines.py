"""Column-expression helpers for parsing and value maps.

Everything here returns a ``Column``: the work runs JVM-side inside
whole-stage codegen or as a higher-order function, never as a Python UDF.

* F1 -- math: use ``pyspark.sql.functions`` directly (``abs``, ``pow``,
  ``sqrt``, ``greatest``, ``least``, ``ceil``, ``round``).
* F2 -- line parsing: :func:`split_ws`, :func:`to_long`, :func:`to_double`.
* F3 -- pluggable row parser ``Column(ARRAY<STRING>) -> Column(ARRAY<DOUBLE>)``:
  :func:`parse_doubles` (default), :func:`parse_genotypes`.
* F4 -- value maps: :func:`tessera.operators.elementwise.map_values`.
* F5 -- user partitioner: :func:`tessera.operators.reshape.partition_by_expression`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_ws(c: Column | str) -> Column:
    """Split on runs of whitespace after trimming."""
    col = F.col(c) if isinstance(c, str) else c
    return F.split(F.trim(col), r"\s+")


def to_long(c: Column) -> Column:
    """Parse to BIGINT; malformed text becomes NULL (ANSI-safe)."""
    return c.try_cast("long")


def to_double(c: Column) -> Column:
    """Parse to DOUBLE; malformed text and ``NaN`` become NULL (never NaN)."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def parse_doubles(fields: Column) -> Column:
    """F3 default: every field to DOUBLE (``NaN``/garbage -> NULL)."""
    return F.transform(fields, lambda x: to_double(x))


def parse_genotypes(fields: Column, missing: str = "zero") -> Column:
    """Genotype fields; ``NaN`` or ``-1`` is a missing call, coded 0
    (``missing='zero'``, the original's behaviour, R16) or NULL
    (``missing='null'``)."""
    return F.transform(fields, lambda x: genotype(x, missing))


def genotype(field: Column, missing: str = "zero") -> Column:
    """One field of :func:`parse_genotypes`."""
    fill = F.lit(0.0) if missing == "zero" else F.lit(None).cast("double")
    d = to_double(field)
    return F.when(d.isNull() | (d == -1.0), fill).otherwise(d)
