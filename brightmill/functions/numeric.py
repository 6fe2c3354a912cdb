"""Numeric, date and conditional scalars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, digits: int = 0) -> Column:
    """Half to even, as document databases round."""
    return F.bround(x, digits)


def round_up(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity, as ECMAScript rounds."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def rounded_ms(ts: Column) -> Column:
    """Milliseconds since 1970, halves away from zero, as DuckDB's epoch_ms; unix_millis cuts off instead."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("long")


def message_tokens(text: Column) -> Column:
    """Estimated tokens of a chat message with its overhead."""
    return estimate_tokens(text) + 4


def credits_from_tokens(total: Column, system: Column | None = None, multiplier: Column | None = None) -> Column:
    billed = F.greatest(F.lit(0), total - (system if system is not None else F.lit(0)))
    return F.greatest(F.ceil(billed / 1000 * (multiplier if multiplier is not None else F.lit(1.0))), F.lit(1)).cast("long")


def credits_from_minutes(minutes: Column, price: Column, multiplier: Column | None = None) -> Column:
    """Two roundings up, the first kept a double."""
    base = F.ceil(minutes * price * 1000).cast("double")
    return F.greatest(F.ceil(base * (multiplier if multiplier is not None else F.lit(1.0))), F.lit(1)).cast("long")


def free_saving(tokens_in: Column, tokens_out: Column) -> Column:
    """What a free request would have cost at 2.50 and 10 a million tokens."""
    return tokens_in * 2.5 / 1e6 + tokens_out * 10 / 1e6


def days_remaining(balance: Column, spend: Column, refresh: Column) -> Column:
    """0 without balance, 999 while the daily refresh covers the spend, else balance over the daily deficit."""
    return F.when(balance <= 0, 0.0).when(spend <= refresh, 999.0).otherwise(round_up(F.try_divide(balance, spend - refresh), 1))


def anomaly_level(today: Column, history_days: Column, average: Column, days_left: Column) -> Column:
    ratio = F.try_divide(today, average)
    return (
        F.when(today == 0, "none").when(history_days == 0, F.when(days_left <= 1, "critical").otherwise("none")).when(average < 5, "none")
        .when(ratio >= 3, "critical").when(ratio >= 2, "warning").otherwise("none")
    )


def duration_text(seconds: Column) -> Column:
    """`45s`, `3m 5s` or `1h 2m`."""
    whole = seconds.cast("long")
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60) % 60
    return F.when(whole < 60, F.format_string("%ds", whole)).when(whole < 3600, F.format_string("%dm %ds", minutes, whole % 60)).otherwise(F.format_string("%dh %dm", hours, minutes))


def ago_text(seconds: Column) -> Column:
    """`Just now`, `5m ago`, `3h ago` or `2d ago`."""
    whole = seconds.cast("long")
    return (
        F.when(whole < 60, "Just now").when(whole < 3600, F.format_string("%dm ago", F.floor(whole / 60))).when(whole < 86400, F.format_string("%dh ago", F.floor(whole / 3600)))
        .otherwise(F.format_string("%dd ago", F.floor(whole / 86400)))
    )


def relative_time(seconds: Column) -> Column:
    """`just now`, then minutes, hours and days in words; null from a week on, where a date is shown."""
    whole = seconds.cast("long")
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = F.floor(whole / 60), F.floor(whole / 3600), F.floor(whole / 86400)
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).when(days < 7, said(days, "day"))


def size_text(size: Column) -> Column:
    """Bytes in the largest unit below, with up to two decimals."""
    power = reduce(lambda out, i: F.when(size >= 1024**i, i).otherwise(out), (1, 2, 3), F.lit(0))
    value = round_up(size / F.pow(F.lit(1024.0), power), 2)
    number = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.concat(F.when(size == 0, "0").otherwise(number), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1))


def clamp_column(text: Column, least: int, most: int, default: int) -> Column:
    """A parameter's leading integer within bounds; without one, or 0, the default."""
    number = F.regexp_extract(F.trim(text), r"^[+-]?[0-9]+", 0).try_cast("long")
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.nullif(number, F.lit(0)), F.lit(default)))).cast("long")


def backoff_ms(attempt: Column, base: float = 1000, most: float = 30000) -> Column:
    """Exponential delay without jitter."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def cooldown_ms(failures: Column) -> Column:
    """30 s doubled with each failure, at most 5 min; the count is one ahead, so the first failure waits 60 s."""
    return F.least(F.lit(300000.0), 30000 * F.pow(F.lit(2.0), failures)).cast("long")


def key_cooldown(reason: Column, streak: Column, retry_after: Column, reset: Column) -> Column:
    """Milliseconds that a failed key waits, after `streak` failures in a row; null after a time-out."""
    limited = F.rlike(reason, F.lit(r"(?i)rate.?limit|429|RESOURCE_EXHAUSTED|quota"))
    return (
        F.when(F.rlike(reason, F.lit("(?i)timeout|timed out")), F.lit(None)).when(retry_after > 0, retry_after).when(limited, F.coalesce(reset, F.lit(60000))).otherwise(cooldown_ms(streak)).cast("long")
    )


def tool_budget(context: Column) -> Column:
    """Characters for a tool result: 30 % of the context at 4 characters a token, 2000 to 20000."""
    return F.greatest(F.lit(2000), F.least(F.floor(context * 0.3 * 4), F.lit(20000))).cast("long")
