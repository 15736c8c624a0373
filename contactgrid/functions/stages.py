"""Named intermediate values for long row-local derivations.

A derivation such as address parsing needs dozens of intermediate values. It is written once as a
list of stages; each stage maps a getter (`name -> Column`) to new named columns. The same stages
run over plain columns (`run_on_columns`: one projection per stage, all in generated code, every
value computed once) or over the elements of an array column (`array_derivation`: one `transform`
per stage, so that the work stays inside the row and nothing is exploded or shuffled).

Building large column trees is slow on the Python side, so finished trees are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Getter = Callable[[str], Column]
Stage = Callable[[Getter], dict[str, Column]]
_PREFIX = "__stage_"
ELEMENTS = "__elements"


@lru_cache(maxsize=None)
def _projection(stage: Stage) -> dict[str, Column]:
    values = stage(lambda name: F.col(_PREFIX + name))
    return {_PREFIX + name: value for name, value in values.items()}


def run_on_columns(
    df: DataFrame,
    inputs: dict[str, Column],
    stages: Sequence[Stage],
    outputs: Sequence[str],
) -> DataFrame:
    """Add the stage values named in `outputs` to `df`.

    The results pass through a one-row `inline`: filters above stay above it instead of being
    rewritten into copies of the whole derivation.
    """
    kept = df.columns
    df = df.withColumns({_PREFIX + name: value for name, value in inputs.items()})
    for stage in stages:
        df = df.withColumns(_projection(stage))
    row = F.struct(*[F.col(_PREFIX + name).alias(name) for name in outputs])
    return df.select(*kept, F.inline(F.array(row)))


@lru_cache(maxsize=None)
def array_derivation(inputs: tuple[str, ...], stages: tuple[Stage, ...]) -> Column:
    """Array of structs with the fields of column `ELEMENTS` and every stage value added."""
    names = list(inputs)

    def extend_with(stage: Stage) -> Callable[[Column], Column]:
        def extend(element: Column) -> Column:
            values = stage(lambda name: element[name])
            kept = [element[n].alias(n) for n in names if n not in values]
            added = [v.alias(n) for n, v in values.items()]
            names[:] = [n for n in names if n not in values] + list(values)
            return F.struct(*kept, *added)

        return extend

    array = F.col(ELEMENTS)
    for stage in stages:
        array = F.transform(array, extend_with(stage))
    return array


def run_on_elements(
    df: DataFrame, elements: Column, inputs: Sequence[str], stages: Sequence[Stage], name: str
) -> DataFrame:
    """Add column `name`: the structs of `elements` with all stage values."""
    derived = array_derivation(tuple(inputs), tuple(stages))
    return df.withColumn(ELEMENTS, elements).withColumn(name, derived).drop(ELEMENTS)
