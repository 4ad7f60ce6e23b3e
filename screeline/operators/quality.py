"""Checks of tables: contracts, missing values, flags, duplicates, and keys against keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, example): how many rows break each rule and the least key among them.

    A rule is a condition that must hold; null counts as broken.  One pass over the table.
    """
    broken = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    one = df.agg(*[F.struct(F.count_if(b).alias("rows"), F.min(F.when(b, F.col(key).cast("string"))).alias("example")).alias(n) for n, b in broken.items()])
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`.rows").alias("rows"), F.col(f"`{n}`.example").alias("example")) for n in rules]))
    return one.select(parts.alias("r")).select("r.rule", "r.rows", "r.example").filter("rows > 0")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) of the keys that more than one row has."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, nulls, rows) for each column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_n{i}").alias("nulls"), F.col("_all").alias("rows")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def flags(rules: dict[str, Column], ignored: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(flags, passed): the names of the rules that hold, joined by a bar in the rules' order,
    and whether none but ignored ones hold.  Null conditions don't hold."""
    held = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return F.array_join(held, "|"), F.size(F.array_except(held, F.array(*[F.lit(i) for i in ignored]).cast("array<string>"))) == 0


def flag_counts(df: DataFrame, column: str) -> DataFrame:
    """(flag, rows) of the flags in a bar-joined column."""
    one = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"\|")).alias("flag")).filter("flag <> ''")
    return one.groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))


def released(df: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """The table with the columns null wherever the condition doesn't hold."""
    return df.select(*[F.when(condition, F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def duplicate_groups(df: DataFrame, item: str, value: str) -> DataFrame:
    """(value, items, first): the values that several items hold; nulls are no values."""
    g = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("items"), F.min(item).alias("first"))
    return g.filter("items > 1")


def key_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one of two tables has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").otherwise("right")
    return a.join(b, key, "full_outer").filter("_l is null or _r is null").select(key, side.alias("side"))


def overlay(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the new values where there are any; every key of either table."""
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.select(key, *columns).join(n, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])
