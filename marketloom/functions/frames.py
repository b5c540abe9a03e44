"""Small DataFrame helpers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE = "_one"


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate (exactly one row) to every row."""
    return df.withColumn(ONE, F.lit(1)).join(F.broadcast(row.withColumn(ONE, F.lit(1))), ONE).drop(ONE)


SHARE = "_share"


def attach_by_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", shares: int = 32) -> DataFrame:
    """Join a table of one row per key, dealing the rows of each key over `shares` tasks.

    A key may hold a third of all rows: rows go by (key, hash of the row), and the table has every key once
    per share.  Where Spark knows the table to be small it broadcasts it, and nothing moves.
    """
    hashed = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    dealt = df.withColumn(SHARE, F.pmod(F.xxhash64(*hashed), F.lit(shares)).cast("int"))
    table = per_key.withColumn(SHARE, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.join(table, [*keys, SHARE], how).drop(SHARE)


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column) with the value as double."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    )
    return df.select(*keep, cells.alias("_cell")).select(*keep, f"_cell.{name}", f"_cell.{value}")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    from pyspark.sql import types as T

    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
