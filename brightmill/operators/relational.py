"""Filters, joins, pages and set operations used by the service's document queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters for the parameters that are present."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, x) for k, x in wanted.items() if x is not None), df)


def clamp(value: object, least: int, most: int, default: int) -> int:
    """An integer parameter within bounds; anything that isn't a number takes the default."""
    try:
        number = int(str(value))
    except ValueError:
        number = default
    return max(least, min(most, number))


def or_default(column: str, default: str) -> Column:
    """The default replaces null and the empty string."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default))


def contains_text(column: Column | str, search: str) -> Column:
    """Case-insensitive literal search; a blank search fits everything."""
    return F.lit(True) if not search.strip() else F.contains(F.lower(column), F.lit(search.strip().lower()))


def lookup(df: DataFrame, dimension: DataFrame, keys: list[str], **defaults: object) -> DataFrame:
    """Left join; the dimension's columns take a default where nothing fits."""
    joined = df.join(dimension, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in defaults.items()})


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a total order, with the total on every row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(page * size).limit(size).join(F.broadcast(total))


def keyset_page(df: DataFrame, column: str, cursor: Column | None, size: int, tie: str) -> DataFrame:
    """The next page below a cursor, newest first. One row more is read, to tell whether there is a next page;
    rows that tie with the cursor are skipped, as a strict comparison does."""
    rows = df if cursor is None else df.where(F.col(column) < cursor)
    ahead = rows.orderBy(F.desc(column), F.asc(tie)).limit(size + 1)
    more = ahead.agg((F.count("*") > size).alias("has_more"))
    return ahead.orderBy(F.desc(column), F.asc(tie)).limit(size).join(F.broadcast(more))


def ordered_children(parents: DataFrame, children: DataFrame, key: str, *order: str, columns: list[str]) -> DataFrame:
    """Each parent with its children as an ordered array; without children an empty one."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return parents.join(lists, key, "left")
