"""Probability laws as column expressions: log densities, means, variances, links and
inverse distribution functions, and a variate that is a hash of its key.

Spark has neither the gamma nor the error function. lgamma() is Stirling's series
after a shift by eight; normal_cdf() is the sum of its power series near zero and its
continued fraction beyond. Both are as exact as doubles allow, within 1e-12.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Number) -> Column:
    """Log of the gamma function for x > 0."""
    x, shifted = _c(x), _c(x)
    for k in range(1, 8):
        shifted = shifted * (x + k)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shifted)


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once: as a plain tree, steps upon steps grow without end."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normal_cdf(x: Number) -> Column:
    odd, whole = F.array(*[F.lit(float(2 * k + 1)) for k in range(60, -1, -1)]), F.array(*[F.lit(float(k)) for k in range(60, 0, -1)])

    def of(x):
        a = F.abs(x)
        beyond = F.greatest(a, F.lit(1.0))
        near = F.aggregate(odd, F.lit(0.0), lambda total, k: (total * a * a + 1) / k)  # 1 + a^2 / 3 + a^4 / 15 + ...
        far = F.aggregate(whole, F.lit(0.0), lambda total, k: k / (beyond + total))
        density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        upper = F.when(a < 4, 0.5 - density * a * near).otherwise(density / (beyond + far))
        return F.when(x > 0, 1 - upper).otherwise(upper)

    return _with(_c(x), of)


def normal_quantile(p: Number) -> Column:
    """Inverse of normal_cdf: a start good to 0.003 and two steps of Halley's rule."""

    def start(p):
        t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
        x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
        return F.when(p < 0.5, -x).otherwise(x)

    def step(x, p):
        return _with((normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda e: x - e / (1 + x * e / 2))

    return _with(_c(p), lambda p: _with(_with(start(p), lambda x: step(x, p)), lambda x: step(x, p)))


def sigmoid(x: Number) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softplus(x: Number) -> Column:
    """log(1 + exp(x)) without overflow."""
    x = _c(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def hill(dose: Number, emax: Number, ec50: Number, n: Number) -> Column:
    """Saturating response to a dose that isn't negative."""
    powered = F.pow(F.greatest(_c(dose), F.lit(0.0)), _c(n))
    return _c(emax) * powered / (F.pow(_c(ec50), _c(n)) + powered + 1e-12)


def restoring_force(x: Number, center: Number, stiffness: Number, quartic: Number = 0.0) -> Column:
    d = _c(x) - _c(center)
    return -_c(stiffness) * d - _c(quartic) * d * d * d


def restoring_potential(x: Number, center: Number, stiffness: Number, quartic: Number = 0.0) -> Column:
    d = _c(x) - _c(center)
    return _c(stiffness) * d * d / 2 + _c(quartic) * d * d * d * d / 4


def ordered_probabilities(predictor: Number, cutpoints: list[Number]) -> list[Column]:
    """Of each level between rising cutpoints."""
    below = [sigmoid(_c(c) - _c(predictor)) for c in cutpoints]
    edges = [F.lit(0.0), *below, F.lit(1.0)]
    return [b - a for a, b in zip(edges, edges[1:])]


def category_probabilities(logits: list[Number]) -> list[Column]:
    top = F.greatest(*map(_c, logits)) if len(logits) > 1 else _c(logits[0])
    weights = [F.exp(_c(x) - top) for x in logits]
    return [w / sum(weights[1:], weights[0]) for w in weights]


#: From the predictor to the law's mean.
LINKS: dict[str, Callable[[Number], Column]] = {
    "identity": _c,
    "log": lambda x: F.exp(_c(x)),
    "inverse": lambda x: 1 / _c(x),
    "logit": sigmoid,
    "probit": normal_cdf,
}


def _choose(levels: list[Column], value: Column) -> Column:
    return F.get(F.array(*levels), value.cast("int"))


def log_density(law: str, x: Number, **p: Number | list[Number]) -> Column:
    """Log density or log probability of x; -infinity outside the law's support."""
    x = _c(x)
    q = {k: v if isinstance(v, list) else _c(v) for k, v in p.items()}
    whole = (x >= 0) & (x == F.floor(x))
    outside = F.lit(float("-inf"))
    if law == "Delta":
        return F.when(x == q["v"], 0.0).otherwise(outside)
    if law == "Normal":
        z = (x - q["loc"]) / q["scale"]
        return -0.5 * z * z - F.log(q["scale"]) - 0.5 * math.log(2 * math.pi)
    if law == "StudentT":
        z, df = (x - q["loc"]) / q["scale"], q["df"]
        return lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * F.log(df * math.pi) - F.log(q["scale"]) - (df + 1) / 2 * F.log1p(z * z / df)
    if law == "Poisson":
        return F.when(whole, x * F.log(q["rate"]) - q["rate"] - lgamma(F.when(whole, x + 1))).otherwise(outside)
    if law == "Gamma":
        a, b = q["concentration"], q["rate"]
        inside = x > 0
        return F.when(inside, a * F.log(b) + (a - 1) * F.log(F.when(inside, x)) - b * x - lgamma(a)).otherwise(outside)
    if law == "BernoulliLogits":
        return F.when(x.isin(0.0, 1.0), x * q["logits"] - softplus(q["logits"])).otherwise(outside)
    if law == "BernoulliProbs":
        return F.when(x == 1, F.log(q["probs"])).when(x == 0, F.log1p(-q["probs"])).otherwise(outside)
    if law == "NegativeBinomial2":
        m, k = q["mean"], q["concentration"]
        n = F.when(whole, x)
        return F.when(whole, lgamma(n + k) - lgamma(k) - lgamma(n + 1) + k * F.log(k / (k + m)) + n * F.log(m / (k + m))).otherwise(outside)
    if law == "Beta":
        a, b = q["concentration1"], q["concentration0"]
        inside = (x > 0) & (x < 1)
        y = F.when(inside, x)
        return F.when(inside, (a - 1) * F.log(y) + (b - 1) * F.log1p(-y) + lgamma(a + b) - lgamma(a) - lgamma(b)).otherwise(outside)
    if law in ("OrderedLogistic", "Categorical"):
        levels = ordered_probabilities(q["predictor"], q["cutpoints"]) if law == "OrderedLogistic" else category_probabilities(q["logits"])
        inside = whole & (x < len(levels))
        return F.when(inside, F.log(_choose(levels, F.when(inside, x)))).otherwise(outside)
    raise ValueError(f"unknown law: {law}")


def mean_variance(law: str, **p: Number) -> tuple[Column, Column]:
    """Null where the moment doesn't exist."""
    q = {k: _c(v) for k, v in p.items()}
    if law == "Delta":
        return q["v"], F.lit(0.0)
    if law == "Normal":
        return q["loc"], q["scale"] * q["scale"]
    if law == "StudentT":
        df = q["df"]
        return F.when(df > 1, q["loc"]), F.when(df > 2, q["scale"] * q["scale"] * df / F.when(df > 2, df - 2))
    if law == "Poisson":
        return q["rate"], q["rate"]
    if law == "Gamma":
        return q["concentration"] / q["rate"], q["concentration"] / (q["rate"] * q["rate"])
    if law in ("BernoulliLogits", "BernoulliProbs"):
        m = sigmoid(q["logits"]) if law == "BernoulliLogits" else q["probs"]
        return m, m * (1 - m)
    if law == "NegativeBinomial2":
        return q["mean"], q["mean"] + q["mean"] * q["mean"] / q["concentration"]
    if law == "Beta":
        a, b = q["concentration1"], q["concentration0"]
        return a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    raise ValueError(f"no scalar moments: {law}")


# ---- priors -----------------------------------------------------------------------


def prior_quantile(family: str, u: Number, **p: Number) -> Column:
    """The value below which a prior has the share u (0 < u < 1)."""
    u, q = _c(u), {k: _c(v) for k, v in p.items()}
    if family == "Normal":
        return q["mu"] + q["sigma"] * normal_quantile(u)
    if family == "HalfNormal":
        return q["sigma"] * normal_quantile((1 + u) / 2)
    if family == "LogNormal":
        return F.exp(q["mu"] + q["sigma"] * normal_quantile(u))
    if family == "Uniform":
        return q["lower"] + u * (q["upper"] - q["lower"])
    if family == "Exponential":
        return -F.log1p(-u) / q["rate"]
    if family == "TruncatedNormal":
        lo, hi = (normal_cdf((q[k] - q["mu"]) / q["sigma"]) for k in ("lower", "upper"))
        return q["mu"] + q["sigma"] * normal_quantile(lo + u * (hi - lo))
    raise ValueError(f"no closed inverse: {family}")


def persistence_to_decay(rho: Number, days: Number) -> Column:
    """The decay rate that keeps the share rho over so many days."""
    return -F.log(_c(rho)) / _c(days)


def interval_effect_to_rate(effect: Number, decay: Number, days: Number) -> Column:
    """The instantaneous rate whose effect over so many days, while it decays, is effect."""
    decay = _c(decay)
    return _c(effect) * decay / (1 - F.exp(-decay * _c(days)))


def variate(key: Column, draw: Column) -> Column:
    """A number in (0, 1) that is a hash of key and draw: the same on every run, in
    every partition, and in any order of rows."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), draw.cast("long")), 11)
    return (bits.cast("double") + 0.5) * 2.0**-53
