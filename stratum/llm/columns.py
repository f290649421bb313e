"""Users' columns, held together so that no name of theirs meets one of the operators' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, whatever marks that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """docs' columns as one struct called row, without those named in ``but`` (in any case)."""
    return F.struct(*[col(c) for c in docs.columns if c.lower() not in but]).alias("row")


def opened(rows: DataFrame, *more: Column) -> DataFrame:
    """The fields of row as columns again, and more."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names], *more)
