"""Ranking, running and gap-and-island windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def run_length(df: DataFrame, keys: list[str], order: list[str], broken: Column, name: str) -> DataFrame:
    """Adds the number of rows since the last broken one, itself 0."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("__island", F.sum(broken.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum((~broken).cast("int")).over(within)).drop("__island")


def fitting_suffix(df: DataFrame, keys: list[str], newest_first: list[Column], cost: Column, budget: int) -> DataFrame:
    """The newest rows of a key whose costs fit a budget; costs are positive, so the running sum tells."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__used", running).where(F.col("__used") <= budget).withColumnRenamed("__used", "used")


def reached(df: DataFrame, keys: list[str], at: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds for each name whether at least n of a key's rows lie in the `length` units before a row's moment, those of the moment left out.

    They do if the n-th row before the moment is no older, so nothing is counted and time grows with the rows, not with a frame's. Of
    the rows of one moment the first decides: it looks back furthest. Rows without a moment see each other, as in a range frame."""
    by_key, peers = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys, at)
    looked = df.withColumns({name: F.coalesce(F.lag(at, n).over(by_key) >= F.col(at) - length, F.lit(False)) for name, (length, n) in windows.items()})
    return looked.withColumns({name: F.when(F.col(at).isNull(), F.count("*").over(peers) >= n).otherwise(F.bool_and(name).over(peers)) for name, (_, n) in windows.items()})


def trailing(df: DataFrame, keys: list[str], at: str, length: int, count: str, sums: dict[str, str]) -> DataFrame:
    """Adds the count of a key's rows in the `length` units before a row's moment, those of the moment left out, and sums of columns (name -> column).

    A sliding frame is summed anew for each row. Here each row stands at its moment and, taken back, where it has left the window, so one
    running sum serves all and time grows with the rows. Rows without a moment come last, when all others have left, and see each other."""
    turns = df.withColumn("__sign", F.explode(F.array(F.lit(1), F.lit(-1)))).where(F.col(at).isNotNull() | (F.col("__sign") > 0))
    # at odd places rows come, at the even ones before them others have left
    turns = turns.withColumn("__at", F.when(F.col("__sign") > 0, 2 * F.col(at) + 1).otherwise(2 * (F.col(at) + length + 1)))
    running = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__at")).rangeBetween(Window.unboundedPreceding, -1)
    added = {count: F.sum("__sign"), **{name: F.sum(F.col("__sign") * F.col(c)) for name, c in sums.items()}}
    summed = turns.withColumns({name: F.coalesce(x.over(running), F.lit(0)) for name, x in added.items()})
    return summed.where("__sign > 0").drop("__sign", "__at")


def kept_of(n: Column, cap: int, keep: int) -> Column:
    """How many of n rows are left, if only the last `keep` stay whenever there are more than `cap`."""
    return F.when(n <= cap, n).otherwise(keep + (n - cap - 1) % (cap - keep + 1))


def capped(df: DataFrame, keys: list[str], newest_first: list[Column], cap: int, keep: int) -> DataFrame:
    """What is left of each key's rows, in order of arrival, if only the last `keep` stay whenever there are more than `cap`.

    Ranks above `cap` are cut before the shuffle (a group limit), so a hot key sends at most `cap` rows a task."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).where(F.col("__rank") <= cap)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return ranked.join(counts, keys).where(F.col("__rank") <= kept_of(F.col("__n"), cap, keep)).drop("__rank", "__n")


def quantile_bucket(df: DataFrame, order: str, buckets: int) -> Column:
    """The number of a row's bucket: how many of the column's approximate quantiles, kept as literals, are not above its value."""
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b <= F.col(order)))


def numbered(df: DataFrame, order: str, name: str, buckets: int = 200) -> DataFrame:
    """Adds 1, 2, ... in the order of an integer column without repeats.

    Rows are dealt to buckets between quantiles of the column, so that outliers leave them equally full, numbered there, and
    lifted by the counts of the buckets before. The quantiles are found once and kept, so a row's bucket follows from the row
    alone, and counting and numbering agree whatever partitions Spark makes; only the quantiles and the count of each bucket
    meet in one place."""
    dealt = df.withColumn("__bucket", quantile_bucket(df, order, buckets))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(order))
    lifted = dealt.withColumn("__k", within).join(F.broadcast(sizes.select("__bucket", before.alias("__before"))), "__bucket")
    return lifted.withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).drop("__bucket", "__k", "__before")
