"""Grouped statistics: outcome counts, Bayesian summaries, tails, entropy, regression."""

from __future__ import annotations

from collections.abc import Sequence
from math import erf, lgamma, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, stored

#: Keys by which single persons could be told apart; grouping by them must be asked for.
INDIVIDUAL = frozenset({"judge_id", "user_id", "person_id"})


def guard(group_by: Sequence[str], declared: Sequence[str], allow_individual: bool = False) -> None:
    """A slice must be declared as it is grouped, and individual keys need consent."""
    if list(group_by) != list(declared):
        raise ValueError(f"declared slice {list(declared)} isn't the grouping {list(group_by)}")
    if not allow_individual and (found := INDIVIDUAL.intersection(group_by)):
        raise ValueError(f"grouping by individual keys: {sorted(found)}")


def outcome_counts(rows: DataFrame, group_by: Sequence[str], outcome: str, declared: Sequence[str], allow_individual: bool = False) -> DataFrame:
    """group keys (null: empty), outcome, n."""
    guard(group_by, declared, allow_individual)
    return rows.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group_by], outcome).agg(F.count("*").alias("n"))


def _prior(x: Column) -> Column:
    """A zero prior parameter counts as 1."""
    return F.when(x == 0, 1.0).otherwise(x)


def beta_binomial(rows: DataFrame, group_by: Sequence[str], baseline_by: Sequence[str], success: Column, kappa: float = 40.0) -> DataFrame:
    """group keys, n, y, mu and posterior mean under a Beta prior of strength kappa around the baseline's mean."""
    g = rows.groupBy(*group_by).agg(F.count("*").alias("n"), F.sum(success.cast("long")).alias("y"))
    base = g.groupBy(*baseline_by).agg((F.sum("y") / F.sum("n")).alias("mu"))  # baselines are sums of the groups
    a, b = _prior(F.col("mu") * kappa), _prior((1 - F.col("mu")) * kappa)
    return g.join(base, list(baseline_by)).select(*group_by, "n", "y", "mu", ((a + F.col("y")) / (a + b + F.col("n"))).alias("mean"))


def gamma_poisson(rows: DataFrame, group_by: Sequence[str], baseline_by: Sequence[str], events: Column, kappa: float = 40.0) -> DataFrame:
    """group keys, exposure, y, mu and posterior mean rate under a Gamma prior worth kappa cases."""
    g = rows.groupBy(*group_by).agg(F.count("*").alias("exposure"), F.sum(events).alias("y"))
    base = g.groupBy(*baseline_by).agg((F.sum("y") / F.sum("exposure")).alias("mu"))
    return g.join(base, list(baseline_by)).select(*group_by, "exposure", "y", "mu", ((_prior(F.col("mu") * kappa) + F.col("y")) / (_prior(F.lit(kappa)) + F.col("exposure"))).alias("mean"))


def beta_cdf(x, a, b):
    """The regularised incomplete beta integral for numpy arrays, by its continued fraction (evaluated from the inside out)."""
    import numpy as np

    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    turn = x > (a + 1) / (a + b + 2)  # where the fraction for the other tail converges fast
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    terms = int(60 + 6 * np.sqrt(np.max(p + q * y, initial=1.0)))
    f = np.ones_like(y)
    for m in range(terms, 0, -1):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        f = 1 + even / (1 + odd / f)
    first = -(p + q) * y / (p + 1)
    f = 1 + first / f
    gammas = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gammas(p + q) - gammas(p) - gammas(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front / f)
    return np.where(turn, 1 - out, out)


def credible_interval(summary: DataFrame, kappa: float = 40.0, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """beta_binomial()'s rows with the posterior's quantiles, by Newton steps on the incomplete beta integral, for a whole batch of groups at once."""
    import pandas as pd

    @F.pandas_udf("low double, high double")
    def quantiles(mu, n, y):
        import numpy as np

        m, c, s = (v.to_numpy(float) for v in (mu, n, y))
        a, b = np.where(m * kappa == 0, 1.0, m * kappa) + s, np.where((1 - m) * kappa == 0, 1.0, (1 - m) * kappa) + c - s
        out = []
        scale = np.array([lgamma(i) + lgamma(j) - lgamma(i + j) for i, j in zip(a, b, strict=True)])
        for q in (low, high):
            # Newton steps from the middle, kept inside a bracket that each of them narrows.
            mean, spread = a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
            left, right, x = np.maximum(0.0, mean - 40 * spread), np.minimum(1.0, mean + 40 * spread), mean
            for _ in range(40):
                off = beta_cdf(x, a, b) - q
                left, right = np.where(off < 0, x, left), np.where(off < 0, right, x)
                with np.errstate(all="ignore"):
                    step = x - off / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - scale)
                new = np.where((step > left) & (step < right), step, (left + right) / 2)
                done = np.abs(new - x) <= 1e-13 * spread + 1e-16
                x = new
                if done.all():
                    break
            out.append(x)
        return pd.DataFrame({"low": out[0], "high": out[1]})

    keep = summary.columns
    return summary.withColumn("_q", quantiles("mu", "n", "y")).select(*keep, "_q.low", "_q.high")


def log_normal_tail(rows: DataFrame, group_by: Sequence[str], value: str, threshold: float) -> DataFrame:
    """group keys, n, mu, sigma (population) of positive values' logs, and the fitted share above a threshold; fewer than two: null."""
    g = rows.filter((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf"))).groupBy(*group_by).agg(F.count("*").alias("n"), F.avg(F.ln(value)).alias("mu"), F.stddev_pop(F.ln(value)).alias("sigma"))

    @F.pandas_udf("double")
    def above(z):
        return z.map(lambda x: min(1.0, max(0.0, 0.5 * (1 - erf(x / sqrt(2))))))

    z = (F.ln(F.lit(threshold)) - F.col("mu")) / F.col("sigma")
    step = F.when(F.ln(F.lit(threshold)) < F.col("mu"), 1.0).otherwise(0.0)
    tail = F.when(F.col("n") < 2, None).when(F.col("sigma") == 0, step).otherwise(above(F.when(F.col("sigma") > 0, z).otherwise(0.0)))
    return g.select(*group_by, "n", F.when(F.col("n") >= 2, F.col("mu")).alias("mu"), F.when(F.col("n") >= 2, F.col("sigma")).alias("sigma"), tail.alias("tail"))


def ridge_logistic(rows: DataFrame, group_by: Sequence[str], features: Sequence[str], label: str, ridge: float = 1.0, steps: int = 25) -> DataFrame:
    """group keys, n, intercept and a weight for each feature: the penalised maximum, by Newton steps.

    A step is one grouped sum over the rows: gradients and Hessians are combined before the shuffle, and
    only a few numbers for each group meet, so a group may be of any size."""
    import numpy as np

    names = ["_one", *features]
    k = len(names)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group_by).schema)
    data = stored(rows.select(*group_by, F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")), "logistic")
    keys = [tuple(r) for r in data.select(*group_by).distinct().limit(10_001).collect()]
    if len(keys) > 10_000:
        raise ValueError("more than 10,000 groups")
    theta = {g: np.zeros(k) for g in keys}
    counts: dict = {}
    for _ in range(steps):
        now = rows.sparkSession.createDataFrame([(*g, [float(x) for x in t]) for g, t in theta.items()], f"{spec}, _t array<double>")
        z = sum((F.col(c) * F.get("_t", F.lit(i)) for i, c in enumerate(names)), F.lit(0.0))
        p = data.join(F.broadcast(now), list(group_by)).withColumn("_p", 1 / (1 + F.exp(-z)))
        sums = [F.sum((F.col("_y") - F.col("_p")) * F.col(c)).alias(f"_g{i}") for i, c in enumerate(names)]
        sums += [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(a) * F.col(b)).alias(f"_h{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
        largest = 0.0
        for r in p.groupBy(*group_by).agg(F.count("*").alias("_n"), *sums).collect():
            g = tuple(r[c] for c in group_by)
            penalty = np.diag([0.0] + [ridge] * (k - 1))
            h = np.array([[r[f"_h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + penalty + 1e-9 * np.eye(k)
            step = np.linalg.solve(h, np.array([r[f"_g{i}"] for i in range(k)]) - penalty @ theta[g])
            theta[g] = theta[g] + step
            counts[g] = r["_n"]
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-9:
            break
    discard(data)
    out = [(*g, int(counts[g]), *[float(x) for x in t]) for g, t in theta.items()]
    return rows.sparkSession.createDataFrame(out, f"{spec}, n long, intercept double, " + ", ".join(f"`{c}` double" for c in features))


def entropy(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, entropy in bits of the value's distribution."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    # -sum p log p = log N - (sum n log n) / N: one pass over the counts.
    return n.groupBy(*by).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias("entropy"))


def slots(rows: DataFrame, slot: Sequence[str], evidence: Column, tau: Column, value: Column, signature: Column) -> DataFrame:
    """slot, sum_e, tau, conflict, n_values, entropy: evidence, agreement, distinct values and entropy of signatures."""
    r = rows.select(*slot, evidence.alias("_e"), tau.alias("_t"), value.alias("_v"), signature.alias("_s"))
    g = r.groupBy(*slot).agg(F.sum("_e").alias("sum_e"), F.max("_t").alias("_hi"), F.min("_t").alias("_lo"), F.countDistinct("_v").alias("n_values"))
    both = (F.col("_hi") == 1) & (F.col("_lo") == -1)
    state = F.when(F.col("_lo") == 1, 1).when(F.col("_hi") == -1, -1).otherwise(0)
    return g.join(entropy(r, slot, "_s"), list(slot)).select(*slot, "sum_e", state.alias("tau"), both.cast("int").alias("conflict"), "n_values", "entropy")
