"""Aggregations of service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spent_credits(credits: str = "credits_used", tokens: str = "tokens_used") -> Column:
    """Credits of a request: those booked, else one for each started thousand of tokens, at least one."""
    return F.when(F.col(credits) > 0, F.col(credits)).otherwise(F.greatest(F.ceil(F.col(tokens) / 1000), F.lit(1))).cast("long")


def chargeable(credits: str = "credits_used", tokens: str = "tokens_used") -> Column:
    return (F.col(credits) > 0) | (F.col(tokens) > 0)


def total(column: Column | str) -> Column:
    """Sum, 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0))


def day(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def daily(df: DataFrame, *measures: Column) -> DataFrame:
    return df.groupBy(day().alias("day")).agg(*measures)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; the order must end in a unique key."""
    return df.orderBy(*order).limit(n)


def calendar(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row `day` for each date from `first` to `last`."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def fill_days(by_day: DataFrame, first: str, last: str, **defaults: object) -> DataFrame:
    """Left join of a dense calendar with daily rows; measures without a row take their default."""
    filled = calendar(by_day, first, last).join(by_day, "day", "left")
    return filled.select("day", *[F.coalesce(name, F.lit(value)).alias(name) for name, value in defaults.items()])


def weighted(value: str, weight: str, default: float) -> Column:
    """Mean of `value` weighted by `weight`, `default` without weight."""
    return F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(default))
