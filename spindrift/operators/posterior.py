"""Priors, parameter and feature tables, conditional density, posterior summaries.

Long tables: theta(trial, param, value), posterior(cond, sample, param, value), bounds(param, low, high).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boxes of the ten coefficients (recurrent weight, input, coupling, noise; each on myelin, gradient, 1),
# one for drawing and a narrower one for checking draws.
PRIOR_BOX = [
    ("w_a", 0.3, 0.7), ("w_b", -0.3, -0.04), ("w_c", 0.0, 0.06), ("i_a", 0.2, 0.32), ("i_b", -0.006, 0.02), ("i_c", -0.02, -0.003), ("g", 1.0, 10.0), ("s_a", 0.004, 0.006), ("s_b", -0.001, 0.001), ("s_c", 0.0, 0.0008),
]
CHECK_BOX = [(n, *{"g": (5.0, 7.0), "s_b": (-0.001, 0.0001)}.get(n, (low, high))) for n, low, high in PRIOR_BOX]


def bounds_table(spark, box: list[tuple[str, float, float]]) -> DataFrame:
    """(param, low, high)"""
    return spark.createDataFrame(box, "param string, low double, high double")


def draws_at(u: DataFrame, box: list[tuple[str, float, float]]) -> DataFrame:
    """A column for each parameter of the box, at the share ``u`` of its width, for a table with u."""
    return u.select("*", *[(low + (high - low) * F.col("u")).alias(n) for n, low, high in box])


def finite(*columns: str) -> Column:
    """Whether all are numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(finite(*columns))


def theta_features_join(theta: DataFrame, features: DataFrame, on: str = "trial") -> DataFrame:
    """Inner join by trial; a trial without its partner on either side is an error."""
    missing = theta.select(on).subtract(features.select(on)).unionByName(features.select(on).subtract(theta.select(on)))
    if missing.take(1):
        raise ValueError("parameters and features must have the same trials")
    return theta.join(features, on)


def feature_stats(features: DataFrame) -> DataFrame:
    """(label, mean, scale, std): what standardising and dropping need, from (trial, label, value)."""
    return features.groupBy("label").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"), F.stddev_samp("value").alias("std"))


def standardize(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Apply training statistics; a label that they lack goes, one without spread becomes 0."""
    return features.join(stats, "label").select("trial", "label", F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.col("scale")), F.lit(0.0)).alias("value"))


def low_variance_drop(features: DataFrame, stats: DataFrame, eps: float = 1e-5) -> DataFrame:
    return features.join(stats.filter(F.col("std") > eps), "label", "left_semi")


def slice_features(features: DataFrame, names: list[str]) -> DataFrame:
    """(trial, feature, label, value, position) of the named features, positions in the order of the names; an unknown name is an error."""
    order = features.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, at int")
    if order.join(features.select("feature").distinct(), "feature", "left_anti").take(1):
        raise ValueError("unknown feature")
    return features.join(F.broadcast(order), "feature").select("trial", "feature", "label", "value", F.col("at").alias("position"))


def prior_sample(spark, bounds: list[tuple[str, float, float]], n: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """(trial, one column a parameter): uniform draws; the number of partitions is fixed, so a seed repeats."""
    for name, low, high in bounds:
        if not low < high:
            raise ValueError(f"{name}: low must lie below high")
    draws = [(low + (high - low) * F.rand(seed + j)).alias(name) for j, (name, low, high) in enumerate(bounds)]
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("trial"), *draws)


def log_volume(bounds: list[tuple[str, float, float]]) -> float:
    return sum(math.log(high - low) for _, low, high in bounds)


def inside(bounds: list[tuple[str, float, float]]) -> Column:
    ok = F.lit(True)
    for name, low, high in bounds:
        ok = ok & F.col(name).between(low, high)
    return ok


def prior_logprob(theta: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    return theta.withColumn("log_prob", F.when(inside(bounds), -log_volume(bounds)).otherwise(F.lit(-math.inf)))


def prior_cdf(theta: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    p = F.lit(1.0)
    for name, low, high in bounds:
        p = p * F.least(F.greatest((F.col(name) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return theta.withColumn("cdf", p)


def prior_moments(bounds: DataFrame) -> DataFrame:
    """(param, mean, variance, std, width) of a table (param, low, high)."""
    width = F.col("high") - F.col("low")
    return bounds.select("param", ((F.col("low") + F.col("high")) / 2).alias("mean"), (width * width / 12).alias("variance"), (width / math.sqrt(12)).alias("std"), width.alias("width"))


def rejection(samples: DataFrame, threshold: float, most: int) -> DataFrame:
    """(cond, sample, value..., rank): the first ``most`` samples per condition with log_p above threshold."""
    rank = F.row_number().over(Window.partitionBy("cond").orderBy("sample"))
    return samples.filter(F.col("log_p") > threshold).withColumn("rank", rank).filter(F.col("rank") <= most)


def padded(kept: DataFrame, conditions: DataFrame, most: int) -> DataFrame:
    """(cond, rank, value): short conditions repeat their last valid sample; those with none take ``fallback`` of conditions (cond, fallback)."""
    last = kept.groupBy("cond").agg(F.max_by("value", "rank").alias("last"))
    grid = conditions.select("cond", "fallback", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank"))
    full = grid.join(kept.select("cond", "rank", "value"), ["cond", "rank"], "left").join(last, "cond", "left")
    return full.select("cond", "rank", F.coalesce("value", "last", "fallback").alias("value"))


def split(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``held_out``: by a hash of the key and the seed, so it never depends on order or partitioning."""
    return df.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def shrinkage(prior: DataFrame, posterior: DataFrame, ddof: int = 0) -> DataFrame:
    """(cond, param, value): 1 - variance after over variance before; 0 where the prior has none."""
    var = F.var_pop if ddof == 0 else F.var_samp
    before = prior.groupBy("param").agg(var("value").alias("before"))
    after = posterior.groupBy("cond", "param").agg(var("value").alias("after"))
    return after.join(before, "param").select("cond", "param", F.when(F.col("before") == 0, 0.0).otherwise(1 - F.try_divide("after", "before")).alias("value"))


def zscores(posterior: DataFrame, truth: DataFrame, ddof: int = 0) -> DataFrame:
    """(cond, param, value): distance of the posterior mean to (param, truth) in posterior deviations; infinite without spread."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    found = posterior.groupBy("cond", "param").agg(F.avg("value").alias("m"), std("value").alias("s")).join(truth, "param")
    gap = F.abs(F.col("m") - F.col("truth"))
    return found.select("cond", "param", F.when(F.col("s") == 0, F.lit(math.inf)).otherwise(F.try_divide(gap, F.col("s"))).alias("value"))


def limits(*tables: DataFrame, pad: float = 0.0) -> DataFrame:
    """(param, low, high) over all tables, padded by a share of the width."""
    both = tables[0].select("param", "value")
    for t in tables[1:]:
        both = both.unionByName(t.select("param", "value"))
    found = both.groupBy("param").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    by = pad * (F.col("high") - F.col("low"))
    return found.select("param", (F.col("low") - by).alias("low"), (F.col("high") + by).alias("high"))


def _grid_sums(rows: DataFrame, keys: list[str], cells: int, of: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """(keys, cell, e): ``of`` turns rows of one key into a sum for each of a fixed number of cells. Sums are made where the rows are, a batch at a time, and added up."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby(keys, sort=False, dropna=False):
                sums = sum(of(part.iloc[at : at + 2000]) for at in range(0, len(part), 2000))
                yield pd.DataFrame(dict(zip(keys, [[k] * cells for k in key])) | {"cell": np.arange(cells, dtype=np.int32), "e": sums})

    return rows.mapInPandas(run, f"{types}, cell int, e double").groupBy(*keys, "cell").agg(F.sum("e").alias("e"))


def kde(posterior: DataFrame, points: int = 100, rule: str = "scott") -> DataFrame:
    """(cond, param, g, x, density) on a grid of ``points`` between the extremes; bandwidth n ** -0.2 (Scott) or (3n/4) ** -0.2 (Silverman) deviations."""
    factor = F.pow(F.col("n") * (1.0 if rule == "scott" else 0.75), F.lit(-0.2))
    base = posterior.groupBy("cond", "param").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("s"), F.min("value").alias("low"), F.max("value").alias("high")).filter("n >= 2 and s > 0")
    base = base.select("cond", "param", "n", "low", "high", (F.col("s") * factor).alias("h"))

    def sums(part: pd.DataFrame) -> np.ndarray:
        low, high, h = part[["low", "high", "h"]].iloc[0]
        x = low + (high - low) * np.arange(points) / (points - 1)
        return np.exp(-0.5 * ((x[:, None] - part["value"].to_numpy()) / h) ** 2).sum(axis=1)

    summed = _grid_sums(posterior.join(base, ["cond", "param"]).select("cond", "param", F.col("value").cast("double").alias("value"), "low", "high", "h"), ["cond", "param"], points, sums)
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("g") / (points - 1)
    return summed.withColumnRenamed("cell", "g").join(base, ["cond", "param"]).select("cond", "param", "g", x.alias("x"), (F.col("e") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def peaks(density: DataFrame) -> DataFrame:
    """(cond, param, value): the grid point of the highest density, the first on a tie."""
    return density.groupBy("cond", "param").agg(F.max_by("x", F.struct("density", -F.col("g"))).alias("value"))


def hist_1d(posterior: DataFrame, bins: int | None = None) -> DataFrame:
    """(cond, param, bin, n): equal bins between the extremes, the last closed; without a number, of width 2 IQR / n ** (1/3)."""
    base = posterior.groupBy("cond", "param").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    width = 2 * F.col("iqr") / F.pow(F.col("n"), F.lit(1 / 3))
    count = F.lit(bins) if bins else F.greatest(F.coalesce(F.ceil(F.try_divide(F.col("high") - F.col("low"), width)), F.lit(1)), F.lit(1))
    placed = posterior.join(base.withColumn("bins", count), ["cond", "param"])
    bin_ = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("bins")), F.col("bins") - 1)
    return placed.groupBy("cond", "param", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pairs(posterior: DataFrame) -> DataFrame:
    """(cond, sample, p, q, x, y) for each parameter pair p < q."""
    a = posterior.select("cond", "sample", F.col("param").alias("p"), F.col("value").alias("x"))
    b = posterior.select("cond", "sample", F.col("param").alias("q"), F.col("value").alias("y"))
    return a.join(b, ["cond", "sample"]).filter("p < q")


def hist_2d(posterior: DataFrame, bins: int = 50) -> DataFrame:
    """(cond, p, q, bx, by, n): joint histogram of each pair between the extremes, last edges closed."""
    ends = posterior.groupBy("cond", "param").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    placed = posterior.join(ends, ["cond", "param"]).select("cond", "sample", "param", place.alias("value"))
    return pairs(placed).groupBy("cond", "p", "q", F.col("x").alias("bx"), F.col("y").alias("by")).agg(F.count("*").alias("n"))


def kde_2d(posterior: DataFrame, points: int = 20) -> DataFrame:
    """(cond, p, q, gx, gy, density): Gaussian kernel density of each pair on a grid, scaled to 0..1; bandwidth n ** (-1/6) times the covariance's root."""
    both = pairs(posterior)
    base = both.groupBy("cond", "p", "q").agg(F.count("*").alias("n"), *[f("x").alias(f"{k}x") for k, f in (("lo", F.min), ("hi", F.max), ("v", F.var_samp))], *[f("y").alias(f"{k}y") for k, f in (("lo", F.min), ("hi", F.max), ("v", F.var_samp))], F.covar_samp("x", "y").alias("c"))
    base = base.withColumn("f", F.pow("n", F.lit(-1 / 3))).withColumn("det", (F.col("vx") * F.col("vy") - F.col("c") * F.col("c")) * F.col("f")).filter("det > 0")

    def sums(part: pd.DataFrame) -> np.ndarray:
        one = part.iloc[0]
        gx, gy = (one[f"lo{a}"] + (one[f"hi{a}"] - one[f"lo{a}"]) * np.arange(points) / (points - 1) for a in "xy")
        dx, dy = np.repeat(gx, points)[:, None] - part["x"].to_numpy(), np.tile(gy, points)[:, None] - part["y"].to_numpy()
        return np.exp(-0.5 * (one["vy"] * dx * dx - 2 * one["c"] * dx * dy + one["vx"] * dy * dy) / one["det"]).sum(axis=1)

    keys = ["cond", "p", "q"]
    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "y", "lox", "hix", "loy", "hiy", "vx", "vy", "c", "det")]
    summed = _grid_sums(both.join(base, keys).select(*keys, *numbers), keys, points * points, sums)
    raw = summed.select(*keys, F.floor(F.col("cell") / points).cast("int").alias("gx"), (F.col("cell") % points).alias("gy"), "e")
    per = Window.partitionBy("cond", "p", "q")
    low, high = F.min("e").over(per), F.max("e").over(per)
    return raw.select("cond", "p", "q", "gx", "gy", F.coalesce(F.try_divide(F.col("e") - low, high - low), F.lit(0.0)).alias("density"))


def credible_levels(density: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Add ``mass``: the share of the total that cells of at least this density hold, ties in the order of the cell."""
    per = Window.partitionBy(*keys)
    order = per.orderBy(F.desc("density"), *cell)
    return density.withColumn("mass", F.try_divide(F.sum("density").over(order), F.sum("density").over(per)))


def node_param_expand(draws: DataFrame, regions: DataFrame) -> DataFrame:
    """(trial, region, value): a * myelin + b * gradient + c of each draw (trial, a, b, c) and region; regions are few, so they are sent to the draws."""
    return draws.crossJoin(F.broadcast(regions)).select("trial", "region", (F.col("a") * F.col("myelin") + F.col("b") * F.col("gradient") + F.col("c")).alias("value"))


def node_param_fit(nodes: DataFrame) -> DataFrame:
    """(a, b, c): least squares of value on myelin and gradient, by centred sums."""
    x, y, v = F.col("myelin"), F.col("gradient"), F.col("value")
    sums = nodes.agg(F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"))
    det = F.expr("xx * yy - xy * xy")
    a, b = F.try_divide(F.expr("yy * xv - xy * yv"), det), F.try_divide(F.expr("xx * yv - xy * xv"), det)
    return sums.select(a.alias("a"), b.alias("b"), (F.col("mv") - a * F.col("mx") - b * F.col("my")).alias("c"))


def node_poly_fit(nodes: DataFrame, order: int = 3) -> DataFrame:
    """(term, power, coef): least squares of value on the powers 1 to order of myelin and of gradient and a constant (term one, power 0).

    One pass sums the products of all pairs of basis columns, which tasks do for their rows first; the system, whose size is that of the
    basis, is solved where its one row is. Columns that depend on others, as a constant myelin, share the solution of least norm
    (in columns scaled to equal length). Rows with a null or a value that is not finite are left out; without rows, coefficients are null.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    names = [("one", 0), *[("myelin", i) for i in range(1, order + 1)], *[("gradient", i) for i in range(1, order + 1)]]
    basis, m = [F.lit(1.0), *[F.pow(name, F.lit(i)) for name, i in names[1:]]], len(names)
    whole = nodes.filter(finite("myelin", "gradient", "value"))
    gram = F.array(*[F.sum(basis[i] * basis[j]) for i in range(m) for j in range(i, m)])
    sums = whole.agg(gram.alias("gram"), F.array(*[F.sum(b * F.col("value")) for b in basis]).alias("rhs"), F.count("*").alias("n"))

    def solve(frames):
        for frame in frames:
            for row in frame.itertuples():
                coef = [None] * m
                if row.n:
                    g = np.zeros((m, m))
                    g[np.triu_indices(m)] = row.gram
                    g = g + np.triu(g, 1).T
                    scale = np.sqrt(np.diag(g))
                    scale[scale == 0] = 1
                    coef = np.linalg.pinv(g / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (np.array(row.rhs) / scale) / scale
                yield pd.DataFrame({"term": [t for t, _ in names], "power": [p for _, p in names], "coef": coef}).astype({"coef": "Float64"})

    return sums.mapInPandas(solve, "term string, power int, coef double")


def param_broadcast(param: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, set_id, value): rows of (node, set_id, value), null for "all", spread over the grid; the most specific wins."""
    exact = param.filter("node is not null and set_id is not null").select("node", "set_id", F.col("value").alias("v0"))
    node = param.filter("node is not null and set_id is null").select("node", F.col("value").alias("v1"))
    of_set = param.filter("node is null and set_id is not null").select("set_id", F.col("value").alias("v2"))
    whole = param.filter("node is null and set_id is null").select(F.col("value").alias("v3")).limit(1)
    grid = nodes.crossJoin(F.broadcast(sets)).join(exact, ["node", "set_id"], "left").join(node, "node", "left").join(of_set, "set_id", "left").join(F.broadcast(whole), F.lit(True), "left")
    return grid.select("node", "set_id", F.coalesce("v0", "v1", "v2", "v3").alias("value"))


def sweep_grid(spark, axes: dict[str, list[float]], n_dup: int = 1) -> DataFrame:
    """(set_id, dup, one column a parameter): the Cartesian grid, the last axis fastest."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    position = F.lit(0)
    for name, values in axes.items():
        position = position * len(values) + F.array_position(F.array(*map(F.lit, values)), F.col(name)) - 1
    return grid.select(position.cast("long").alias("set_id"), *axes).withColumn("dup", F.explode(F.sequence(F.lit(0), F.lit(n_dup - 1))))


def mixture_fit(joint: DataFrame, theta: list[str], x: list[str], k: int = 3, seed: int = 1, rounds: int = 50):
    """Gaussian mixture of (theta, x) by Spark ML: a list of (weight, mean, covariance), of k small arrays."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=[*theta, *x], outputCol="features").transform(finite_rows(joint, [*theta, *x]))
    model = GaussianMixture(k=k, seed=seed, maxIter=rounds).fit(ready)
    return [(w, g.mean.toArray(), g.cov.toArray()) for w, g in zip(model.weights, model.gaussians)]


def conditional(mixture, n_theta: int) -> list[dict]:
    """What p(theta | x) needs of each component: slope, residual covariance, the marginal of x."""
    out = []
    for w, mean, cov in mixture:
        a, b = slice(0, n_theta), slice(n_theta, None)
        slope = cov[a, b] @ np.linalg.inv(cov[b, b])
        out.append({"w": float(w), "mt": mean[a], "mx": mean[b], "slope": slope, "cov": cov[a, a] - slope @ cov[b, a], "prec": np.linalg.inv(cov[b, b]), "logdet": float(np.linalg.slogdet(cov[b, b])[1])})
    return out


def _component_logits(parts: list[dict], x: list[str]) -> list[Column]:
    """Log weight of each component at x, up to a constant."""
    logits = []
    for p in parts:
        d = [F.col(c) - float(m) for c, m in zip(x, p["mx"])]
        form = sum((float(p["prec"][i, j]) * d[i] * d[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
        logits.append(math.log(p["w"]) - 0.5 * (p["logdet"] + form))
    return logits


def cond_log_prob(df: DataFrame, mixture, theta: list[str], x: list[str]) -> DataFrame:
    """Add ``log_prob`` of theta given x, by log-sum-exp over the components."""
    parts = conditional(mixture, len(theta))
    logits, joint = _component_logits(parts, x), []
    for p, logit in zip(parts, logits):
        prec, logdet = np.linalg.inv(p["cov"]), float(np.linalg.slogdet(p["cov"])[1])
        r = [F.col(t) - float(p["mt"][i]) - sum((float(p["slope"][i, j]) * (F.col(c) - float(p["mx"][j])) for j, c in enumerate(x)), F.lit(0.0)) for i, t in enumerate(theta)]
        form = sum((float(prec[i, j]) * r[i] * r[j] for i in range(len(theta)) for j in range(len(theta))), F.lit(0.0))
        joint.append(logit - 0.5 * (logdet + form + len(theta) * math.log(2 * math.pi)))

    def lse(terms: list[Column]) -> Column:
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        return top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0)))

    return df.withColumn("log_prob", lse(joint) - lse(logits))


def cond_sample(conditions: DataFrame, mixture, theta: list[str], x: list[str], n: int, seed: int = 0) -> DataFrame:
    """(cond, sample, one column a parameter): component by the largest Gumbel-shifted log weight, then a Gaussian draw."""
    parts = conditional(mixture, len(theta))
    rows = conditions.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    gumbel = [logit - F.log(-F.log(F.rand(seed + i) * (1 - 2e-12) + 1e-12)) for i, logit in enumerate(_component_logits(parts, x))]
    rows = rows.withColumn("_g", F.array(*gumbel)).withColumn("_k", F.array_position("_g", F.array_max("_g")))
    rows = rows.withColumns({f"_z{i}": F.randn(seed + 100 + i) for i in range(len(theta))})
    for i, t in enumerate(theta):
        value = F.lit(None).cast("double")
        for k, p in enumerate(parts):
            root = np.linalg.cholesky(p["cov"])
            draw = float(p["mt"][i]) + sum((float(p["slope"][i, j]) * (F.col(c) - float(p["mx"][j])) for j, c in enumerate(x)), F.lit(0.0)) + sum((float(root[i, j]) * F.col(f"_z{j}") for j in range(i + 1)), F.lit(0.0))
            value = F.when(F.col("_k") == k + 1, draw).otherwise(value)
        rows = rows.withColumn(t, value)
    return rows.select("cond", "sample", *theta)


def pca_embed(features: DataFrame, columns: list[str], dims: int) -> DataFrame:
    """(trial, pc ARRAY<DOUBLE>): standardised features on their first components, by Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    steps = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=dims, inputCol="scaled", outputCol="pc")]
    clean = finite_rows(features, columns)
    return Pipeline(stages=steps).fit(clean).transform(clean).select("trial", vector_to_array("pc").alias("pc"))
