"""A book of priority, cap and placement rules that compile to column expressions.

Rules are code, their parameters are rows: ``with_parameters`` joins a rules table to the
options, so that a kind gets another rule or other numbers without code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Make = Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    """Functions without arguments that give a Column over the option's row; without a cap there is no limit, without a place there is the base."""

    priority: Make
    cap: Make | None = None
    place: Make | None = None


class RuleBook:
    """Rules by family name."""

    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}

    def register(self, name: str, rule: Make, cap: Make | None = None, place: Make | None = None) -> RuleBook:
        self._rules[name] = Rule(rule, cap, place)
        return self

    def _chain(self, family: str, part: Callable[[Rule], Make | None], fallback: Column) -> Column:
        chain = F
        for name, rule in sorted(self._rules.items()):
            if (make := part(rule)) is not None:
                chain = chain.when(F.col(family) == name, make())
        return fallback if chain is F else chain.otherwise(fallback)

    def priority(self, family: str = "family", fallback: Column | None = None) -> Column:
        """One chain of cases; families without a rule get minus the number owned."""
        return self._chain(family, lambda r: r.priority, -F.col("owned").cast("double") if fallback is None else fallback)

    def max_count(self, family: str = "family") -> Column:
        """How many of an option there may be; null without limit."""
        return self._chain(family, lambda r: r.cap, F.lit(None).cast("long"))

    def placement(self, family: str = "family") -> Column:
        """Where an option is wanted, as ``struct<x, y>``: the base, unless a rule says otherwise."""
        return self._chain(family, lambda r: r.place, base_place())


def with_parameters(options: DataFrame, rules: DataFrame) -> DataFrame:
    """Options with the parameters of their item from a rules table ``(item, family, ..)``; without a row the family is ``other``."""
    return options.join(rules, "item", "left").withColumn("family", F.coalesce("family", F.lit("other")))


def base_place() -> Column:
    return F.struct(F.col("base_x").alias("x"), F.col("base_y").alias("y"))


def front_place() -> Column:
    """A quarter of the way from the base to the front, in whole cells (halves up)."""
    step = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) / 4 + 0.5).cast("int")
    return F.struct(step("base_x", "front_x").alias("x"), step("base_y", "front_y").alias("y"))


def column_cap() -> Column:
    return F.col("cap").cast("long")


def threat_cap() -> Column:
    """One more for each time the threat exceeds the own strength, up to the cap."""
    return F.least(F.col("cap"), 1 + F.floor(F.col("threat") / F.greatest(F.lit(1.0), F.col("strength")))).cast("long")


def basic_rule() -> Column:
    """Falls in proportion to what is owned, -100 at the cap, scaled by credits below a floor."""
    fall = F.col("base") * (1 - F.col("owned") / F.nullif(F.col("cap"), F.lit(0)))
    scaled = F.when(F.col("credits") < F.col("credit_floor"), fall * F.col("credits") / F.nullif(F.col("credit_floor"), F.lit(0.0))).otherwise(fall)
    return F.when(F.col("owned") >= F.col("cap"), -100.0).otherwise(scaled)


def power_rule() -> Column:
    """100 when short of power, 20 when nearly so, else 0."""
    return F.when(F.col("power") < F.col("drain"), 100.0).when(F.col("power") < F.col("drain") + F.col("gain") / 2, 20.0).otherwise(0.0)


def threat_rule() -> Column:
    """In proportion to a threat more than a tenth above own strength, else 0; 0 at the cap."""
    own = F.col("strength")
    rises = F.when(F.col("threat") > own * 1.1, F.col("base") * F.col("threat") / F.greatest(F.lit(1.0), own)).otherwise(0.0)
    return F.when(F.col("owned") >= F.col("cap"), 0.0).otherwise(rises)


def threat_or_cost_rule() -> Column:
    """``threat_rule``; where no threat is known, strength per cost, falling to nothing at ``amount`` owned (and negative beyond)."""
    per_cost = F.col("strength") / F.nullif(F.col("cost"), F.lit(0.0)) * 1000
    usual = F.col("base") * (1 - F.col("owned") / F.nullif(F.col("amount"), F.lit(0))) * per_cost
    return F.when((F.col("owned") < F.col("cap")) & F.col("threat").isNull(), usual).otherwise(threat_rule())


def standard_rules(unknown_threat: bool = False) -> RuleBook:
    """The usual rules; with ``unknown_threat`` options also have ``amount`` and ``cost``, which count where the threat is null."""
    threat = threat_or_cost_rule if unknown_threat else threat_rule
    return RuleBook().register("basic", basic_rule, column_cap).register("power", power_rule).register("threat", threat, threat_cap, front_place)
