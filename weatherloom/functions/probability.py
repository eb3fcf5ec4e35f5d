"""Tail probabilities as Spark expressions, so p-values stay inside the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0: Stirling's series at z + 12, stepped back by twelve factors."""
    far = z + 12.0
    inverse = 1.0 / far
    series = inverse * (1.0 / 12 - inverse * inverse * (1.0 / 360 - inverse * inverse * (1.0 / 1260 - inverse * inverse * (1.0 / 1680 - inverse * inverse / 1188))))
    back = sum((F.log(z + float(k)) for k in range(1, 12)), F.log(z))
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - back


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for a chi-square variable with ``dof`` degrees of freedom.

    With a = dof / 2 and z = statistic / 2 this is the upper incomplete gamma function Q(a, z). Below a + 1 it is one
    minus the series of the lower function, whose terms are all positive; above, its continued fraction, which keeps small
    tails exact. Both need a number of steps that grows with the root of a.
    """
    a, z = dof / 2.0, statistic / 2.0
    front = F.exp(a * F.log(z) - z - log_gamma(a))
    steps = F.sequence(F.lit(1), (F.ceil(F.sqrt(a) * 10) + 200).cast("int"))

    def grow(acc, n):
        term = acc["term"] * z / (a + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    lower = front / a * F.aggregate(steps, one, grow, lambda acc: acc["total"])

    def refine(acc, n):
        # a step of the fraction z + 1 - a - 1 (1 - a) / (z + 3 - a - 2 (2 - a) / ...), from both of its ends
        top = n * (a - n)
        bottom = z + 1.0 - a + 2 * n
        below = 1.0 / (top * acc["below"] + bottom)
        above = bottom + top / acc["above"]
        return F.struct(below.alias("below"), above.alias("above"), (acc["value"] * below * above).alias("value"))

    first = 1.0 / (z + 1.0 - a)
    begin = F.struct(first.alias("below"), F.lit(1e300).alias("above"), first.alias("value"))
    upper = front * F.aggregate(steps, begin, refine, lambda acc: acc["value"])
    tail = F.when(z < a + 1.0, 1.0 - lower).otherwise(upper)
    return F.when(statistic <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def student_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's t for whole ``dof``, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    cos2 = F.pow(F.cos(theta), F.lit(2))
    odd = dof % 2 == 1
    # even: 1 + 1/2 c^2 + (1*3)/(2*4) c^4 ...   odd: 1 + 2/3 c^2 + (2*4)/(3*5) c^4 ...
    count = F.when(odd, (dof - 3) / 2).otherwise((dof - 2) / 2).cast("int")
    steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def grow(acc, k):
        ratio = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, start, grow, lambda acc: acc["total"])
    inner_odd = F.when(dof == 1, theta).otherwise(theta + F.sin(theta) * F.cos(theta) * series)
    inside = F.when(odd, inner_odd * 2 / math.pi).otherwise(F.sin(theta) * series)
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1.0 - inside))
