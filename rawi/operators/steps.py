"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rawi.functions.text import pairs, verses


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added, each evaluated once per row.

    Higher-order functions have no common-subexpression elimination, and the
    optimiser inlines projections into the filters above them, so a costly array
    that several expressions read would be made again for each.  Handing it out
    of a one-row generator stops that without a shuffle.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(made)))


def with_pairs(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``verses`` (lines that are not blank) and ``pairs`` of a text, in time linear in its lines."""
    return once(once(df, keep, verses=verses(F.col(text))), [*keep, "verses"], pairs=pairs(F.col("verses")))


def pair_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each pair of lines: key, pair_no, first, second."""
    rows = with_pairs(df, [key], text).select(key, F.posexplode("pairs").alias("pair_no", "pair"))
    return rows.select(key, F.col("pair_no").cast("long").alias("pair_no"), F.col("pair.first").alias("first"), F.col("pair.second").alias("second"))
