"""Scans of panels whose parts differ in their columns and types."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cleaned(df: DataFrame, name: str, kind: str) -> Column:
    """A column of ``df`` as ``kind``: null where the table doesn't have it, and where a number is not finite.

    Booleans become 0 and 1 in a numeric column; texts that are no number become null; as a boolean, a number counts as
    true unless it is zero.
    """
    if name not in df.columns:
        return F.lit(None).cast(kind).alias(name)
    x, own, wanted = F.col(f"`{name}`"), df.schema[name].dataType, T.DataType.fromDDL(kind)
    if isinstance(wanted, (T.DoubleType, T.FloatType)):
        x = F.expr(f"try_cast(`{name}` as double)") if isinstance(own, T.StringType) else x.cast("double")
        x = F.when(F.abs(x) < float("inf"), x)  # neither infinite nor NaN
    elif isinstance(wanted, T.IntegralType) and isinstance(own, (T.FractionalType, T.StringType)):
        number = F.expr(f"try_cast(`{name}` as double)")
        x = F.when(F.abs(number) < float("inf"), F.expr(f"try_cast(try_cast(`{name}` as double) as {kind})"))
    elif isinstance(wanted, T.BooleanType) and isinstance(own, T.NumericType):
        x = x != 0
    elif not isinstance(wanted, T.StringType):
        return F.expr(f"try_cast(`{name}` as {kind})").alias(name)
    return x.cast(kind).alias(name)


def scan_parts(spark: SparkSession, paths: list[str], wanted: dict[str, str]) -> DataFrame:
    """The ``wanted`` columns (name: type) of all parts, as one table.

    Each part is read by its own footer's schema: columns that it lacks are null, others are cast as ``cleaned`` says.
    Parts of one schema are read together, and only their wanted columns are. Without paths the table is empty; a part without
    any wanted column gives its rows as nulls.
    """
    by_schema: dict[str, list[str]] = {}
    for path in paths:
        by_schema.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    out = spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in wanted.items()))
    for schema, group in by_schema.items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*group)
        out = out.unionByName(df.select(*[cleaned(df, c, kind) for c, kind in wanted.items()]))
    return out


def available(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """The required columns and those optional ones that the table has; ValueError names what is missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"panel without columns {missing}")
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])
