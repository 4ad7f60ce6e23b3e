"""The current row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str | list[str], version: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each key: the one with the greatest version.

    Of rows with equal versions the one with the greatest remaining values counts, column
    by column; repeated rows collapse.  A null version is older than any other.  Rows with a
    null in the key are left out.  ``columns`` names what to keep besides the key (all by
    default).  One shuffle, with partial aggregation, so a hot key costs one row a task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (columns or df.columns) if c not in keys]
    quoted = lambda c: F.col(f"`{c}`")
    for c in keys:
        df = df.filter(quoted(c).isNotNull())
    newest = F.max(F.struct(quoted(version).alias("_v"), *[quoted(c).alias(f"_c{i}") for i, c in enumerate(rest)]))
    grouped = df.groupBy(*[quoted(c) for c in keys]).agg(newest.alias("_row"))
    return grouped.select(*[quoted(c) for c in keys], *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(rest)])
