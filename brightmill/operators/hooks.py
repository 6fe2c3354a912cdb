"""Extension points: hooks over a DataFrame in order of priority, and tools that a plan and a model's capabilities allow."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of plans; others are 0.
PLAN_LEVELS = {"free": 0, "pro": 1, "business": 2}


@dataclass(frozen=True)
class Hook:
    name: str
    transform: Callable[[DataFrame], DataFrame]
    priority: int = 100


def run_hooks(df: DataFrame, hooks: Iterable[Hook]) -> DataFrame:
    """The hooks one after the other, lowest priority first, equal ones as given. A hook whose plan Spark refuses is logged and left out."""
    for hook in sorted(hooks, key=lambda h: h.priority):
        try:
            df = df.transform(hook.transform)
        except PySparkException:
            logging.getLogger(__name__).exception("hook %s", hook.name)
    return df


@dataclass(frozen=True)
class Tool:
    """`factory` marks tools that are made for each request."""

    name: str
    plan: str | None = None
    capabilities: tuple[str, ...] = ()
    enabled: bool = True
    factory: bool = False


def register(tools: Iterable[Tool]) -> dict[str, Tool]:
    """Tools by name; a later one replaces an earlier one of its name, in its place."""
    return {t.name: t for t in tools}


def plan_level(plan: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for item in PLAN_LEVELS.items() for x in item])
    return F.coalesce(F.try_element_at(levels, plan), F.lit(0))


def allowed(tools: dict[str, Tool], plan: Column, capabilities: Column, factory: bool = False) -> Column:
    """Names of the enabled tools, in order of registration, that a plan's level reaches and whose capabilities are all there.
    A null plan is level 0, null capabilities are none."""
    have = F.coalesce(capabilities, F.array().cast("array<string>"))
    names = []
    for tool in tools.values():
        if tool.enabled and tool.factory == factory:
            missing = F.array_except(F.array(*map(F.lit, tool.capabilities)).cast("array<string>"), have)
            names.append(F.when((plan_level(plan) >= PLAN_LEVELS.get(tool.plan, 0)) & (F.size(missing) == 0), tool.name))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
