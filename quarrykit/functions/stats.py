"""Formulas of evaluation as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least standard deviation of paired differences on the 0-100 scale.
SD_FLOOR = 15.0
#: Count at which density saturates, and the least confidence that it counts.
SATURATION, CONFIDENT = 40, 0.7


def t_critical(n: Column) -> Column:
    """Two-sided bound of about 5 % for n pairs."""
    return 1.96 + 2.4 / (n - 1)


def least_delta(n: Column) -> Column:
    return F.when(n <= 0, 100.0).otherwise(F.round(2 * SD_FLOOR / F.sqrt(n), 2))


def paired_test(delta: Column, floor: float = SD_FLOOR) -> dict[str, Column]:
    """Aggregates over paired differences: n, mean, sd (at least floor), t, significant; nulls below two pairs."""
    n, mean = F.count(delta), F.avg(delta)
    sd = F.greatest(F.stddev_samp(delta), F.lit(float(floor)))
    t = mean / (sd / F.sqrt(n))
    enough = n >= 2
    return {"n": n, "mean_delta": mean, "sd": F.when(enough, sd), "t": F.when(enough & (sd > 0), t), "significant": F.when(enough, F.when(sd == 0, mean != 0).otherwise(F.abs(t) >= t_critical(n)))}


def density(n: Column) -> Column:
    """0 to 100, logarithmic up to SATURATION."""
    return F.least(F.lit(100.0), F.log1p(n) / math.log(1 + SATURATION) * 100)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def precision_at_k(relevant: Column) -> Column:
    """Mean precision at the relevant places of an array of booleans: null if empty, 0 if none is relevant."""
    step = lambda s, x: F.struct((s["k"] + 1).alias("k"), (s["hits"] + F.when(x, 1).otherwise(0)).alias("hits"), (s["total"] + F.when(x, (s["hits"] + 1) / (s["k"] + 1)).otherwise(0.0)).alias("total"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))
    out = F.aggregate(relevant, start, step)
    return F.when(F.size(relevant) == 0, None).when(out["hits"] == 0, 0.0).otherwise(out["total"] / out["hits"])
