"""Column expressions.

Expressions that are made for many columns at once are written as SQL text: one parsed
string per column instead of a chain of calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: float) -> str:
    """A double literal in SQL text."""
    return f"{float(value)!r}D"


def replace_columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Replace columns in place by SQL text; names that are absent are ignored."""
    return df.selectExpr(*[f"{exprs[c]} as `{c}`" if c in exprs else f"`{c}`" for c in df.columns])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return replace_columns(df, {c: f"round(`{c}`, {digits})" for c, t in df.dtypes if t == "double"})


def signed_log(column: str) -> str:
    return f"signum(`{column}`) * log1p(abs(`{column}`))"


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, where x/0 is 0 and 0/0 is NULL."""
    return F.when(den != 0, num / den).when(num != 0, 0.0)


def clip(column: str, low: float, high: float) -> str:
    """Clip that keeps NULL (greatest and least would replace it by a bound)."""
    low, high = number(low), number(high)
    return f"case when `{column}` < {low} then {low} when `{column}` > {high} then {high} else `{column}` end"


def right_closed_bin(column: str, edges: Sequence[float], *, lowest: bool = True,
                     open_ends: bool = False) -> str:
    """Index of the bin (edge[i], edge[i+1]] that holds the value.

    ``lowest`` puts a value at edge[0] into bin 0. Outside values give NULL, unless
    ``open_ends`` extends the outer bins to infinity.
    """
    outside = f"`{column}` is null"
    if not open_ends:
        outside += (f" or `{column}` {'<' if lowest else '<='} {number(edges[0])}"
                    f" or `{column}` > {number(edges[-1])}")
    inner = edges[1:-1]
    steps = "".join(f" when `{column}` <= {number(e)} then {i}L" for i, e in enumerate(inner))
    return f"case when {outside} then null{steps} else {len(inner)}L end"


def above(prob: Column, threshold: float) -> Column:
    return (prob > threshold).cast("long")


def inverse_power(base: float, exponent: float) -> str:
    return f"power({number(base)}, {number(-exponent)})"
