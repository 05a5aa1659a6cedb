"""Summaries and screens of long draw tables (chain, draw, param, value) and
(draw, time, value)."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.checks import ranked
from tideline.operators.histories import density_histogram


def _placed(rows: DataFrame) -> DataFrame:
    """(param, value, i, n): every draw with its place in its parameter's order."""
    counts = rows.filter("value IS NOT NULL").groupBy("param", "value").agg(F.count("*").alias("n"))
    r = ranked(counts, ["param"])
    return r.select("param", "value", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, "upto")).alias("i"), F.col("total").alias("n"))


def hdi(rows: DataFrame, mass: float = 0.94) -> DataFrame:
    """(param, low, high): the shortest interval that holds the mass."""
    r = _placed(rows)
    other = r.select("param", F.col("i").alias("j"), F.col("value").alias("high"))
    both = r.withColumn("j", F.col("i") + F.floor(F.lit(mass) * F.col("n"))).join(other, ["param", "j"])
    best = both.groupBy("param").agg(F.min_by(F.struct(F.col("value").alias("low"), "high"), F.struct(F.round(F.col("high") - F.col("value"), 9), "value")).alias("b"))
    return best.select("param", "b.low", "b.high")


def rank_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """(param, chain, bin, count) of ranks in the pooled draws; ties share the mean rank."""
    counts = rows.groupBy("param", "value", "chain").agg(F.count("*").alias("k"))
    pooled = ranked(counts.groupBy("param", "value").agg(F.sum("k").alias("n")), ["param"])
    rank = F.col("upto") - (F.col("n") - 1) / 2.0
    bin_ = F.least(F.floor((rank - 1) * bins / F.col("total")) + 1, F.lit(bins)).cast("int")
    return counts.join(pooled, ["param", "value"]).groupBy("param", "chain", bin_.alias("bin")).agg(F.sum("k").alias("count"))


def bfmi(rows: DataFrame) -> DataFrame:
    """(chain, bfmi) of energies: squared steps over squared deviations."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("chain").orderBy("draw"))
    e = rows.withColumn("d", step).groupBy("chain").agg(F.sum(F.col("d") * F.col("d")).alias("d"), (F.var_pop("value") * F.count("value")).alias("c"))
    return e.select("chain", (F.col("d") / F.col("c")).alias("bfmi"))


def traces(rows: DataFrame) -> DataFrame:
    """(param, chain, values): each chain's draws in order."""
    listed = F.sort_array(F.collect_list(F.struct("draw", "value"))).getField("value")
    return rows.groupBy("param", "chain").agg(listed.alias("values"))


def energy_histograms(rows: DataFrame, bins: int = 40) -> DataFrame:
    """(kind, center, density) of energies (chain, draw, value): `marginal`, of their
    deviations from the mean of all, and `transition`, of their steps within chains."""
    mean = rows.agg(F.avg("value").alias("m"))
    marginal = rows.join(F.broadcast(mean)).select(F.lit("marginal").alias("kind"), (F.col("value") - F.col("m")).alias("value"))  # one row
    step = F.col("value") - F.lag("value").over(Window.partitionBy("chain").orderBy("draw"))
    transition = rows.select(F.lit("transition").alias("kind"), step.alias("value")).filter("value IS NOT NULL")
    return density_histogram(marginal.union(transition), ["kind"], bins)


def rhat(rows: DataFrame) -> DataFrame:
    """(param, rhat): split R-hat."""
    w = Window.partitionBy("param", "chain")
    r = rows.withColumns({"i": F.row_number().over(w.orderBy("draw")), "n": F.count("*").over(w)})
    half = F.when(F.col("i") <= F.floor(F.col("n") / 2), 0).when(F.col("i") > F.ceil(F.col("n") / 2), 1)
    s = r.withColumn("half", half).filter("half IS NOT NULL").groupBy("param", "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("k"))
    t = s.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("k").alias("k"))
    return t.select("param", F.when(F.col("w") > 0, F.sqrt(((F.col("k") - 1) / F.col("k") * F.col("w") + F.col("b")) / F.when(F.col("w") > 0, F.col("w")))).alias("rhat"))


def _halves(pdf: pd.DataFrame, column: str = "value") -> list[np.ndarray]:
    """Each chain's draws, split at its own middle; all draws are in one half."""
    chains = [g.sort_values("draw")[column].to_numpy() for _, g in pdf.groupby("chain")]
    return [h for c in chains for h in (c[: len(c) // 2], c[len(c) // 2 :]) if len(h)]


def _variances(halves: list[np.ndarray]) -> tuple[float, float]:
    """Variance within halves, and all variance as an unbalanced analysis of variance has it."""
    sizes, m = np.array([len(h) for h in halves], float), len(halves)
    total, means = sizes.sum(), np.array([h.mean() for h in halves])
    within = sum(((h - k) ** 2).sum() for h, k in zip(halves, means)) / (total - m)
    if m == 1:
        return within, within * (total - 1) / total
    spread = (sizes * (means - (sizes * means).sum() / total) ** 2).sum() / (m - 1)
    return within, within + (spread - within) / ((total - (sizes**2).sum() / total) / (m - 1))


def _ess(halves: list[np.ndarray]) -> float:
    """Effective sample size of split chains by Geyer's initial monotone pairs.
    Halves may differ in length; their autocovariances are weighted by it."""
    m, total, n = len(halves), sum(map(len, halves)), max(map(len, halves))
    if total <= m:
        return 0.0
    acov = np.zeros(n)
    for h in halves:
        size = 1 << (2 * len(h) - 1).bit_length()
        f = np.fft.rfft(h - h.mean(), size)
        acov[: len(h)] += np.fft.irfft(f * np.conj(f), size)[: len(h)].real / (total - m)
    within, var = _variances(halves)
    if not var > 0:
        return 0.0
    rho = 1 - (within - acov) / var
    rho[0] = 1
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0] if len(stop) else len(pairs)])
    return float(total / max(2 * pairs.sum() - 1, 1 / np.log10(total)))


def ess(rows: DataFrame) -> DataFrame:
    """(param, ess, mcse): one task handles one parameter's draws; a chain of more
    than one draw that never moves gives 0. Chains may differ in length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        value = 0.0 if _frozen(pdf) else _ess(_halves(pdf))
        sd = pdf["value"].std()
        return pd.DataFrame({"param": [pdf["param"].iloc[0]], "ess": [value], "mcse": [sd / np.sqrt(value) if value > 0 else None]})

    return rows.select("param", "chain", "draw", "value").groupBy("param").applyInPandas(one, "param string, ess double, mcse double")


def _frozen(pdf: pd.DataFrame) -> bool:
    return any(len(g) > 1 and np.ptp(g.to_numpy()) == 0 for _, g in pdf.groupby("chain")["value"])


def _normal_scores(halves: list[np.ndarray]) -> list[np.ndarray]:
    """Normal quantiles of the draws' mean ranks among all draws."""
    _, at, n = np.unique(np.concatenate(halves), return_inverse=True, return_counts=True)
    rank = np.cumsum(n) - (n - 1) / 2
    score = np.fromiter(map(NormalDist().inv_cdf, (rank - 0.375) / (n.sum() + 0.25)), float, len(n))
    return np.split(score[at], np.cumsum([len(h) for h in halves])[:-1])


def _rhat(halves: list[np.ndarray]) -> float:
    if sum(map(len, halves)) <= len(halves):
        return np.nan
    within, var = _variances(halves)
    return float(np.sqrt(max(var, 0.0) / within)) if within > 0 else np.nan


def rank_diagnostics(rows: DataFrame) -> DataFrame:
    """(param, rhat, ess_bulk, ess_tail): the greater split R-hat of ranked and of
    folded ranked draws, the effective sample size of ranked draws, and the lesser
    one of the 5 and 95 % quantiles. Every draw of ragged chains counts; a chain of
    more than one draw that never moves gives sizes of 0. One task per parameter."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        halves = _halves(pdf)
        whole = np.concatenate(halves)
        ranked, folded = _normal_scores(halves), _normal_scores([np.abs(h - np.median(whole)) for h in halves])
        both = [x for x in (_rhat(ranked), _rhat(folded)) if np.isfinite(x)]
        bulk = tail = 0.0
        if not _frozen(pdf):
            bulk, below = _ess(ranked), [[(h <= q).astype(float) for h in halves] for q in np.quantile(whole, (0.05, 0.95))]
            # All draws at or under a quantile are no estimate of it: the other one decides.
            tail = min(float(len(whole)) if np.ptp(np.concatenate(x)) == 0 else _ess(x) for x in below)
        return pd.DataFrame({"param": [pdf["param"].iloc[0]], "rhat": [max(both, default=None)], "ess_bulk": [bulk], "ess_tail": [tail]})

    return rows.select("param", "chain", "draw", "value").groupBy("param").applyInPandas(one, "param string, rhat double, ess_bulk double, ess_tail double")


def verdicts(diagnostics: DataFrame, chains: int) -> DataFrame:
    """(param, outcome) of (param, rhat, ess); ess: the least that has to suffice."""
    r, e = F.col("rhat"), F.col("ess")
    return diagnostics.select("param", F.when(r.isNull() | e.isNull(), "not_evaluated").when((r >= 1.05) | (e < 100 * chains), "failed").when(r >= 1.01, "warned").otherwise("passed").alias("outcome"))


def marginals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))


def marginal_summaries(rows: DataFrame, bins: int = 50) -> DataFrame:
    """(param, mean, sd, n, low, high, density): marginals with their 94 % interval and
    the densities of even bins, from the least value to the greatest."""
    points = F.sort_array(F.collect_list(F.struct("center", "density"))).alias("density")
    density = density_histogram(rows, ["param"], bins).groupBy("param").agg(points)
    return marginals(rows).join(hdi(rows), "param", "left").join(density, "param", "left")


def _pareto(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto tail by the profile posterior mean."""
    n = len(x)
    x = np.sort(x)
    m = 30 + int(n**0.5)
    b = 1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    b = b / (3 * x[int(n / 4 + 0.5) - 1]) + 1 / x[-1]
    k = np.log1p(-b[:, None] * x).mean(1)
    score = n * (np.log(-b / k) - k - 1)
    w = 1 / np.exp(score - score[:, None]).sum(1)
    b = (b * w).sum() / w.sum()
    shape = np.log1p(-b * x).mean()
    return float((n * shape + 5) / (n + 10)), float(-shape / b)


def _loo_points(rows: DataFrame) -> DataFrame:
    """(point, elpd, pareto_k, lppd) of (point, draw, log_lik)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ll = pdf.sort_values("draw")["log_lik"].to_numpy()
        lw = -ll - (-ll).max()
        n = len(lw)
        tail = int(min(0.2 * n, 3 * np.sqrt(n)))
        k = np.nan
        if tail >= 5:
            order = np.argsort(lw)
            cut = np.exp(lw[order[-tail - 1]])
            x = np.exp(lw[order[-tail:]]) - cut
            if x[-1] > 0 and x[0] > 0:
                k, sigma = _pareto(x)
                p = (np.arange(1, tail + 1) - 0.5) / tail
                q = sigma * (np.expm1(-k * np.log1p(-p)) / k if abs(k) > 1e-9 else -np.log1p(-p))
                lw[order[-tail:]] = np.minimum(np.log(q + cut), 0)
        lw = lw - np.log(np.exp(lw).sum())
        return pd.DataFrame({"point": [pdf["point"].iloc[0]], "elpd": [float(np.log(np.exp(lw + ll).sum()))], "pareto_k": [k], "lppd": [float(np.log(np.exp(ll - ll.max()).mean()) + ll.max())]})

    return rows.groupBy("point").applyInPandas(one, "point long, elpd double, pareto_k double, lppd double")


def psis_loo(rows: DataFrame) -> DataFrame:
    """(point, elpd, pareto_k, outcome) of (point, draw, log_lik): smoothed
    importance sampling, one task per point."""
    out = _loo_points(rows).drop("lppd")
    k = F.col("pareto_k")
    return out.withColumn("outcome", F.when(F.isnan(k) | k.isNull(), "not_evaluated").when(k > 0.7, "failed").when(k > 0.5, "warned").otherwise("passed"))


def loo_totals(rows: DataFrame) -> DataFrame:
    """One row (n, elpd_loo, p_loo, se, n_bad_k, n_warn_k) of (point, draw, log_lik)."""
    k = F.col("pareto_k")
    known = k.isNotNull() & ~F.isnan(k)
    return _loo_points(rows).agg(
        F.count("*").alias("n"),
        F.sum("elpd").alias("elpd_loo"),
        F.sum(F.col("lppd") - F.col("elpd")).alias("p_loo"),
        F.sqrt(F.count("*") * F.var_pop("elpd")).alias("se"),
        F.count_if(known & (k > 0.7)).alias("n_bad_k"),
        F.count_if(known & (k > 0.5) & (k <= 0.7)).alias("n_warn_k"),
    )


def weight_ess(rows: DataFrame) -> DataFrame:
    """(step, ess, entropy) of particle log weights (step, log_weight)."""
    top = rows.groupBy("step").agg(F.max("log_weight").alias("top"))
    x = F.col("log_weight") - F.col("top")
    w = F.exp(x)
    sums = rows.join(top, "step").groupBy("step").agg(F.sum(w).alias("s"), F.sum(w * w).alias("q"), F.sum(F.when(w > 0, w * x).otherwise(0.0)).alias("e"))
    return sums.select("step", (F.col("s") * F.col("s") / F.col("q")).alias("ess"), (F.log("s") - F.col("e") / F.col("s")).alias("entropy"))


# ---- screens of draw ensembles (draw, time, value) -------------------------------


def confinement(rows: DataFrame) -> DataFrame:
    """(nonfinite_share, escaped_share, onset): the share of cells that are no finite
    number; the share of draws that grow more than fivefold, which a draw with such a
    cell does; the median time at which such draws have their first. Growth is the
    largest |x| of the last n // 4 places over the 95 % point of the second n // 4.
    Draws of fewer than four times aren't judged for growth."""
    w = Window.partitionBy("draw")
    value = F.col("value")
    r = rows.withColumns({"i": F.row_number().over(w.orderBy("time")) - 1, "n": F.count("*").over(w), "a": F.abs(value), "bad": value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))})
    q = F.floor(F.col("n") / 4)
    fine = F.when(~F.col("bad"), F.col("a"))
    d = r.groupBy("draw").agg(
        F.count("*").alias("n"),
        F.count_if("bad").alias("bad"),
        F.min(F.when(F.col("bad"), F.col("time"))).alias("onset"),
        F.percentile(F.when((F.col("i") >= q) & (F.col("i") < 2 * q), fine), F.lit(0.95)).alias("early"),
        F.max(F.when(F.col("i") >= F.col("n") - q, fine)).alias("late"),
    )
    escaped = F.when(F.col("n") >= 4, ((F.col("bad") > 0) | (F.col("late") / (F.col("early") + 1e-9) > 5)).cast("double"))
    return d.agg((F.sum("bad") / F.sum("n")).alias("nonfinite_share"), F.avg(escaped).alias("escaped_share"), F.median("onset").alias("onset"))


def latent_scale(rows: DataFrame) -> DataFrame:
    """One row: the median over the second half of times of IQR / 1.349 across draws."""
    half = rows.agg(F.median("time").alias("mid"))
    late = rows.join(F.broadcast(half), F.col("time") >= F.col("mid"))
    per = late.groupBy("time").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return per.agg(F.median((F.col("q")[1] - F.col("q")[0]) / 1.349).alias("scale"))


def resolvability(taus: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: the share of time constants tau that at least half of the gaps and
    the whole span resolve. The gaps are reduced to their exact median first, so
    no tau meets every gap."""
    g = gaps.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("mid"), F.sum("gap").alias("span"))
    ok = (F.col("mid") <= 3 * F.col("tau")) & (F.col("span") >= 4 * F.col("tau"))
    return taus.join(F.broadcast(g)).agg(F.avg(ok.cast("double")).alias("resolved_share"))


def saturation(rows: DataFrame) -> DataFrame:
    """One row (active_share) of doses (draw, time, value, ec50, hill), each draw with
    parameters of its own: the share of draws that spend a tenth of their times at 0.1
    to 0.9 occupancy. Doses under zero count as zero."""
    x = F.when(F.col("value") > 0, F.log(F.when(F.col("value") > 0, F.col("value"))))
    o = F.coalesce(1 / (1 + F.exp(-F.col("hill") * (x - F.log("ec50")))), F.lit(0.0))
    d = rows.groupBy("draw").agg(F.avg(((o >= 0.1) & (o <= 0.9)).cast("double")).alias("s"))
    return d.agg(F.avg((F.col("s") >= 0.1).cast("double")).alias("active_share"))


def edge_overwhelm(on: DataFrame, off: DataFrame) -> DataFrame:
    """One row: median over draws of the edge's robust scale over the state's; a state
    that doesn't move while the edge does counts as infinite, if neither does as 0."""
    both = on.select("draw", "time", F.col("value").alias("x")).join(off.select("draw", "time", F.col("value").alias("y")), ["draw", "time"])
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    d = both.groupBy("draw").agg(q(F.col("x") - F.col("y")).alias("e"), q(F.col("x")).alias("s"))
    width, moved = F.col("s")[1] - F.col("s")[0], F.col("e")[1] - F.col("e")[0]
    share = F.when(width > 0, moved / F.when(width > 0, width)).when(moved > 0, F.lit(float("inf"))).otherwise(0.0)
    return d.agg(F.median(share).alias("share"))


def reach(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, location, scale): where the observed median and robust scale
    lie in the draws' 1 to 99 % envelope (below, inside, above)."""
    def two(df, by):
        q = df.groupBy(*by).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        return q.select(*by, F.col("q")[1].alias("location"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("scale"))

    d = two(draws, ["indicator_id", "draw"])
    ends = F.array(F.lit(0.01), F.lit(0.99))
    env = d.groupBy("indicator_id").agg(F.percentile("location", ends).alias("l"), F.percentile("scale", ends).alias("s"))
    where = lambda c, e: F.when(F.col(c) < F.col(e)[0], "below").when(F.col(c) > F.col(e)[1], "above").otherwise("inside")
    return two(observed, ["indicator_id"]).join(env, "indicator_id").select("indicator_id", where("location", "l").alias("location"), where("scale", "s").alias("scale"))


def transmission(rows: DataFrame) -> DataFrame:
    """(indicator_id, share): median over draws of signal variance over all variance,
    from (indicator_id, draw, time, signal, variance)."""
    d = rows.groupBy("indicator_id", "draw").agg(F.var_pop("signal").alias("v"), F.avg("variance").alias("c"))
    total = F.col("v") + F.col("c")
    return d.groupBy("indicator_id").agg(F.median(F.col("v") / F.when(total > 0, total)).alias("share"))


# ---- reach and transmission of coded and counted values, and outcomes ---------------


def _envelope(draws: DataFrame, observed: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    """(indicator_id, statistic, observed, low, high, outcome): where each statistic of
    observed lies among that of the draws, between two of their percentiles."""
    ends = {k: F.percentile(k, F.array(F.lit(a), F.lit(b))) for k, (a, b) in statistics.items()}
    env = draws.groupBy("indicator_id").agg(*[e.alias(k) for k, e in ends.items()])
    both = observed.join(env.withColumnsRenamed({k: f"__{k}" for k in statistics}), "indicator_id")
    low = lambda k, a: F.col(f"__{k}")[0] if a > 0 else F.lit(0.0)
    parts = [F.struct(F.lit(k).alias("statistic"), F.col(k).alias("observed"), low(k, a).alias("low"), F.col(f"__{k}")[1].alias("high")) for k, (a, _) in statistics.items()]
    out = both.select("indicator_id", F.inline(F.array(*parts)))
    inside = (F.col("observed") >= F.col("low")) & (F.col("observed") <= F.col("high"))
    return out.withColumn("outcome", F.when(inside, "passed").otherwise("failed"))


def count_reach(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """Of counts: mean, variance and share of zeros against the draws' 1 to 99 %."""

    def three(df, by):
        return df.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.avg((F.col("value") == 0).cast("double")).alias("zeros"))

    return _envelope(three(draws, ["indicator_id", "draw"]), three(observed, ["indicator_id"]), dict.fromkeys(("mean", "variance", "zeros"), (0.01, 0.99)))


def code_reach(observed: DataFrame, draws: DataFrame, levels: int) -> DataFrame:
    """Of coded values: the total variation distance of level shares from the draws'
    mean shares, against their 99 %; the entropy of shares against their 1 to 99 %."""

    def shares(df, by):
        return df.groupBy(*by).agg(F.array(*[F.avg((F.col("value") == k).cast("double")) for k in range(levels)]).alias("p"))

    def two(df, centre):
        both = df.join(centre, "indicator_id")
        away = F.aggregate(F.zip_with("p", "c", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 2
        entropy = -F.aggregate(F.transform("p", lambda a: a * F.log(a + 1e-12)), F.lit(0.0), lambda a, x: a + x)
        return both.withColumns({"distance": away, "entropy": entropy})

    drawn = shares(draws, ["indicator_id", "draw"])
    centre = drawn.groupBy("indicator_id").agg(F.array(*[F.avg(F.col("p")[k]) for k in range(levels)]).alias("c"))
    return _envelope(two(drawn, centre), two(shares(observed, ["indicator_id"]), centre).drop("p", "c"), {"distance": (0.0, 0.99), "entropy": (0.01, 0.99)})


def code_transmission(rows: DataFrame) -> DataFrame:
    """(indicator_id, share) of (indicator_id, draw, time, level, probability): the
    variance of level probabilities over time over it and the mean Gini index,
    median over draws."""
    p = F.col("probability")
    level = rows.groupBy("indicator_id", "draw", "level").agg(F.var_pop(p).alias("v"), F.avg(p * p).alias("q"))
    d = level.groupBy("indicator_id", "draw").agg(F.sum("v").alias("v"), (1 - F.sum("q")).alias("g"))
    total = F.col("v") + F.col("g")
    return d.groupBy("indicator_id").agg(F.median(F.col("v") / F.when(total > 0, total)).alias("share"))


#: What a screen's statistic has to keep: least and greatest value.
LIMITS = {
    "nonfinite_share": (None, 0.0),
    "escaped_share": (None, 0.01),
    "scale_over_anchor": (1 / 3, 3.0),
    "resolved_share": (0.8, None),
    "overwhelm": (None, 0.95),
    "active_share": (0.8, None),
    "transmission": (0.04, None),
}


def screen_outcomes(statistics: DataFrame) -> DataFrame:
    """(subject, statistic, value, outcome) of (subject, statistic, value)."""
    edge = lambda i: F.create_map(*[F.lit(x) for k, v in LIMITS.items() for x in (k, v[i])])[F.col("statistic")].cast("double")
    v = F.col("value")
    low, high = F.coalesce(edge(0), F.lit(float("-inf"))), F.coalesce(edge(1), F.lit(float("inf")))
    outcome = F.when(v.isNull() | F.isnan(v), "not_evaluated").when((v < low) | (v > high), "failed").otherwise("passed")
    return statistics.select("subject", "statistic", "value", outcome.alias("outcome"))


def screens(states: DataFrame, anchors: DataFrame, taus: DataFrame, gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, statistic, value, outcome) of all screens that apply: of each state of
    states (state, draw, time, value) finiteness, confinement and, where anchors
    (state, anchor) has one, scale; of each state of taus (state, tau) resolvability;
    of each edge of edges (edge, draw, time, value_on, value_off) how far it overwhelms."""
    parts = []

    def add(df, subject, **columns):
        parts.extend(df.select(F.lit(subject).alias("subject"), F.lit(k).alias("statistic"), c.cast("double").alias("value")) for k, c in columns.items())

    # One plan per state or edge: a model has a few dozen of them.
    anchor = {r.state: r.anchor for r in anchors.collect()}
    for (state,) in sorted(states.select("state").distinct().collect()):
        mine = states.filter(F.col("state") == state)
        add(confinement(mine), state, nonfinite_share=F.col("nonfinite_share"), escaped_share=F.col("escaped_share"))
        if state in anchor:
            add(latent_scale(mine), state, scale_over_anchor=F.col("scale") / F.lit(float(anchor[state])))
    for (state,) in sorted(taus.select("state").distinct().collect()):
        add(resolvability(taus.filter(F.col("state") == state), gaps), state, resolved_share=F.col("resolved_share"))
    for (edge,) in sorted(edges.select("edge").distinct().collect()):
        mine = edges.filter(F.col("edge") == edge)
        on, off = (mine.select("draw", "time", F.col(c).alias("value")) for c in ("value_on", "value_off"))
        add(edge_overwhelm(on, off), edge, overwhelm=F.col("share"))
    return screen_outcomes(reduce(DataFrame.unionByName, parts))


# ---- latent paths and equivalence -----------------------------------------------------


def latent_worst(paths: DataFrame) -> DataFrame:
    """(state, coordinates, rhat, ess_bulk, ess_tail) of (state, time, chain, draw,
    value): the worst over times; a chain that never moves at any time makes the
    sizes 0 and R-hat null."""
    one = paths.withColumn("param", F.to_json(F.struct("state", "time")))
    each = rank_diagnostics(one).withColumn("state", F.get_json_object("param", "$.state"))
    still = paths.groupBy("state", "time", "chain").agg(((F.min("value") == F.max("value")) & (F.count("*") > 1)).alias("still")).groupBy("state").agg(F.bool_or("still").alias("frozen"))
    r = F.when(F.count(F.when(F.col("rhat").isNull() | F.isnan("rhat"), 1)) == 0, F.max("rhat"))
    worst = each.groupBy("state").agg(F.count("*").alias("coordinates"), r.alias("rhat"), F.min("ess_bulk").alias("ess_bulk"), F.min("ess_tail").alias("ess_tail"))
    out = worst.join(still.withColumn("state", F.col("state").cast("string")), "state")
    return out.select("state", "coordinates", F.when(~F.col("frozen"), F.col("rhat")).alias("rhat"), *[F.when(F.col("frozen"), 0.0).otherwise(F.col(c)).alias(c) for c in ("ess_bulk", "ess_tail")])


def equivalent(left: DataFrame, right: DataFrame, mean_sd: float = 0.1, sd_relative: float = 0.1, mcse_multiplier: float = 2.0) -> DataFrame:
    """One row (equivalent, max_mean_bound, max_sd_error, fixed_equal) of marginals
    (param, mean, sd, mcse): means within mean_sd of the right side's sd, widened by
    the Monte Carlo error of both, and sds within sd_relative; parameters that are
    fixed on the right must be so, and equal, on the left."""
    b = right.select("param", *[F.col(c).alias(f"{c}_") for c in ("mean", "sd", "mcse")])
    both = left.join(b, "param", "full")
    free = F.col("sd_") > 0
    error = mcse_multiplier * F.sqrt(F.col("mcse") * F.col("mcse") + F.col("mcse_") * F.col("mcse_"))
    bound = F.when(free, (F.abs(F.col("mean") - F.col("mean_")) + error) / F.when(free, F.col("sd_")))
    spread = F.when(free, F.abs(F.col("sd") / F.when(free, F.col("sd_")) - 1))
    same = F.when(~free, (F.col("mean") == F.col("mean_")) & (F.col("sd") == 0))
    unread = F.count_if(F.coalesce(free, F.lit(True)) & (bound.isNull() | F.isnan(bound) | spread.isNull() | F.isnan(spread)))
    out = both.agg(unread.alias("unread"), F.max(bound).alias("max_mean_bound"), F.max(spread).alias("max_sd_error"), F.coalesce(F.bool_and(same), F.lit(True)).alias("fixed_equal"))
    within = (F.col("unread") == 0) & F.col("fixed_equal") & (F.coalesce("max_mean_bound", F.lit(0.0)) <= mean_sd) & (F.coalesce("max_sd_error", F.lit(0.0)) <= sd_relative)
    return out.select(within.alias("equivalent"), "max_mean_bound", "max_sd_error", "fixed_equal")


def start_scores(starts: DataFrame, reference: DataFrame) -> DataFrame:
    """(start, rms, furthest) of (start, param, value) against reference draws
    (param, value): distances in the reference's standard deviations."""
    ref = reference.groupBy("param").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).filter("s > 0")
    z = (F.col("value") - F.col("m")) / F.col("s")
    return starts.join(ref, "param").groupBy("start").agg(F.sqrt(F.avg(z * z)).alias("rms"), F.max(F.abs(z)).alias("furthest"))


def influence_order(points: DataFrame) -> DataFrame:
    """(point, pareto_k, place): points by falling Pareto k, unknown ones first."""
    k = F.col("pareto_k")
    unknown = k.isNull() | F.isnan(k)
    return points.select("point", "pareto_k", F.row_number().over(Window.orderBy(F.when(unknown, 0).otherwise(1), k.desc(), "point")).alias("place"))
