"""Merges of new rows into stored rows, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], always: list[str], on_insert: list[str]) -> DataFrame:
    """`always` columns come from the new row where there is one, `on_insert` columns only with a new key.
    Adds `change`: inserted, modified or kept."""
    a, b = old.withColumn("__old", F.lit(True)), new.select(*keys, *[F.col(c).alias(f"__{c}") for c in always + on_insert], F.lit(True).alias("__new"))
    both = a.join(b, keys, "full")
    columns = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in always] + [F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in on_insert]
    change = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new"), "modified").otherwise("kept")
    return both.select(*keys, *columns, change.alias("change"))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds; adds `modified`."""
    fits = F.coalesce(condition, F.lit(False))
    return df.withColumns({**{c: F.when(fits, x).otherwise(F.col(c)) for c, x in values.items()}, "modified": fits})


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of a parent that has new ones are replaced by these."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_of_key(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Idempotent append: of rows with the same key the first counts."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r"))
    return first.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
