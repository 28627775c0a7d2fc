"""Amount Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_amount(a) -> Column:
    return F.log1p(F.greatest(_c(a), F.lit(0.0)))


def is_multiple(a, n: int) -> Column:
    return ((_c(a) % F.lit(float(n))) == 0).cast("int")


def right_closed_bin(x, edges) -> Column:
    """pd.cut(x, edges, labels=False): (e0,e1] -> 0, …; outside -> null."""
    x = _c(x)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = x > F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (x <= F.lit(float(hi)))
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


# fixed values: bin edges
ADVANCED_AMOUNT_EDGES = [0, 50, 100, 500, 1000, 5000, 10000, float("inf")]
ANALYTIC_AMOUNT_EDGES = [0, 100, 500, 1000, 5000, 50000, float("inf")]


def decimal_places(a) -> Column:
    """Digits after the point in the shortest printed form of a money amount
    (``25.0`` -> 1, ``6.55`` -> 2); printed through decimal(38,10)."""
    txt = _c(a).cast("decimal(38,10)").cast("string")
    frac = F.rtrim(F.substring_index(txt, ".", -1))
    frac = F.regexp_replace(frac, "0+$", "")
    return F.greatest(F.length(frac), F.lit(1))


def safe_div(num, den, default=None) -> Column:
    num, den = _c(num), _c(den)
    d = F.lit(default) if default is not None else F.lit(None)
    return F.when(den != 0, num / den).otherwise(d)


def float_div(num, den) -> Column:
    """Floating-point division, as numpy and the oracle do it: a zero
    denominator gives an infinity, 0 / 0 gives NaN (never an error)."""
    num, den = _c(num), _c(den)
    by_zero = F.when((num == 0) | F.isnan(num), float("nan")).otherwise(F.signum(num) * float("inf"))
    return F.when(den != 0, num / den).when(den == 0, by_zero)


def clamp(x, lo=0.0, hi=1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def future_value(a, years: float, rate: float = 0.12) -> Column:
    return _c(a) * F.pow(F.lit(1.0 + rate), F.lit(float(years)))
