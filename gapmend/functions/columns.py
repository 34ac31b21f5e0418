"""Column helpers shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SERIES = ["dataset", "series_id"]
BIG = 1.7976931348623157e308


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, NULL where b is 0 (ANSI division would raise)."""
    return as_col(a).cast("double") / F.nullif(as_col(b).cast("double"), F.lit(0.0))


def r6(c) -> Column:
    """Round to 6 digits and fold -0.0 into 0.0, for comparable output."""
    return F.round(as_col(c).cast("double"), 6) + F.lit(0.0)


def scatter(id_col, salt: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 10007) drawn from an integer id.

    Plain integer arithmetic, so that any engine gives the same order.
    """
    base = F.pmod(as_col(id_col).cast("bigint"), F.lit(10007))
    return F.pmod(base * F.lit(7919) + F.lit(104729 + 31 * salt), F.lit(10007))


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson correlation from power sums; NULL when a side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def student_two_sided(t_abs: Column, df: Column) -> Column:
    """Two-sided Student p-value for an integer number of degrees of freedom.

    With theta = atan(t / sqrt(df)) the CDF is a finite sum of powers of
    cos(theta) (Abramowitz & Stegun 26.7.3-4), folded here with a higher-order
    function, so no table or UDF is needed.
    """
    theta = F.atan(t_abs / F.sqrt(df.cast("double")))
    sin, cos = F.sin(theta), F.cos(theta)
    odd = F.pmod(df, F.lit(2)) == 1
    first = F.when(odd, 3).otherwise(2)
    last = (df - 2).cast("int")
    steps = F.when(last >= first, F.sequence(first, last, F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    lead = F.when(odd, cos).otherwise(1.0)
    head = F.when(odd & (df == 1), 0.0).otherwise(lead)

    def fold(s, k):
        term = s["term"] * cos * cos * ((k - 1) / k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(steps, F.struct(lead.alias("term"), head.alias("total")), fold,
                        lambda s: s["total"])
    inside = F.when(odd, (theta + sin * total) * (2.0 / math.pi)).otherwise(sin * total)
    return F.greatest(F.lit(0.0), F.lit(1.0) - inside)
