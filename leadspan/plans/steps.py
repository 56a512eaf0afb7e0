"""Declared steps over DataFrames: each step reads an earlier result, may be gated by a condition, maps its fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from leadspan.functions.conditions import where_condition
from leadspan.operators.filters import map_fields


@dataclass(frozen=True)
class RunStep:
    name: str
    run: Callable[[DataFrame], DataFrame]
    source: str | None = None
    condition: str | None = None
    fields: Mapping[str, str] = field(default_factory=dict)
    target: Sequence[str] = ()
    literals: Mapping[str, object] = field(default_factory=dict)


def run_steps(start: DataFrame, steps: Sequence[RunStep]) -> dict[str, DataFrame]:
    """Results by step name. Nothing runs here: the steps compose one lazy plan, which Spark optimises as a whole."""
    results: dict[str, DataFrame] = {"start": start}
    last = "start"
    for step in steps:
        rows = results[step.source or last]
        if step.condition:
            rows = where_condition(rows, step.condition)
        if step.fields or step.target or step.literals:
            rows = map_fields(rows, step.fields, step.target, step.literals)
        results[step.name] = step.run(rows)
        last = step.name
    return results
