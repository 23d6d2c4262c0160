"""A small expression language over signals, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compile_lens(node: object, by: Sequence[str] = (), order: Sequence[str] = ()) -> Column:
    """A column from a nested list ["op", ...]; a number stands for itself.

    Division by 0 is 0; log1p and sqrt read negatives as 0; threshold gives 0 or 1; blend is a weighted
    mean (0 for no weight); mask keeps its value where the other is not 0; smooth is a trailing mean of
    a width over by and order."""
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    op, *args = node
    if op == "signal":
        return F.col(args[0]).cast("double")
    if op == "const":
        return F.lit(float(args[0]))
    sub = lambda x: compile_lens(x, by, order)
    if op in ("add", "mul"):
        out = sub(args[0])
        for x in args[1:]:
            out = out + sub(x) if op == "add" else out * sub(x)
        return out
    if op == "sub":
        return sub(args[0]) - sub(args[1])
    if op == "div":
        a, b = sub(args[0]), sub(args[1])
        return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))
    if op == "clamp":
        return F.greatest(F.lit(float(args[1])), F.least(F.lit(float(args[2])), sub(args[0])))
    if op == "abs":
        return F.abs(sub(args[0]))
    if op in ("log1p", "sqrt"):
        return getattr(F, op)(F.greatest(F.lit(0.0), sub(args[0])))
    if op == "threshold":
        return F.when(sub(args[0]) >= float(args[1]), 1.0).otherwise(0.0)
    if op == "blend":
        total = float(sum(w for _, w in args[0]))
        if not total:
            return F.lit(0.0)
        return sum((sub(x) * float(w) for x, w in args[0]), F.lit(0.0)) / total
    if op == "mask":
        return F.when(sub(args[1]) != 0, sub(args[0])).otherwise(0.0)
    if op == "smooth":
        return F.avg(sub(args[0])).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - int(args[1]), 0))
    raise ValueError(f"unknown operation {op!r}")


def density(node: object, by: Sequence[str] = (), order: Sequence[str] = ()) -> Column:
    """A lens's value, not below 0."""
    return F.greatest(F.lit(0.0), compile_lens(node, by, order))
