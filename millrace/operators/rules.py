"""Declarative rules: the first that fits names a row's class; rules that go on only set a flag of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """A name, a condition, and whether later rules are still tried after it."""

    name: str
    condition: Column
    goes_on: bool = False


def apply_rules(df: DataFrame, rules: list[Rule], default: str, column: str = "class") -> DataFrame:
    """Adds the class in one ordered conditional, and a boolean for each rule that goes on. Unknown counts as not met."""
    chosen = F
    for r in rules:
        if not r.goes_on:
            chosen = chosen.when(r.condition, F.lit(r.name))
    named = F.lit(default) if chosen is F else chosen.otherwise(default)
    return df.withColumns({column: named} | {r.name: F.coalesce(r.condition, F.lit(False)) for r in rules if r.goes_on})
