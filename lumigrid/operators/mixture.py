"""Single steps of clustering and mixture fitting as plans, and the loops as kernels of one image.

``iterated`` has the loops as plans over all images; both use the steps below.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.functions.distributions import Gaussian, Watson, log_kummer, watson_statistic
from lumigrid.model import COLOUR, NORMAL, POSITION, DiametricalConfig, MixtureConfig, WatsonConfig


def joint_distance(c: dict[str, float]) -> Column:
    """Colour distance plus position distance plus one minus the normals' cosine to a centre."""
    far = lambda names: F.sqrt(sum(((F.col(n) - c[n]) * (F.col(n) - c[n]) for n in names), F.lit(0.0)))
    dot = sum((F.col(n) * c[n] for n in NORMAL), F.lit(0.0))
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in NORMAL), F.lit(0.0))) * float(np.sqrt(sum(c[n] ** 2 for n in NORMAL)))
    return far(COLOUR) + far(POSITION) + (1 - dot / length)


def assigned(df: DataFrame, centres: list[dict[str, float]]) -> DataFrame:
    """Each pixel's nearest centre (the first of equal ones) and its distance; no shuffle."""
    df = df.withColumns({f"_d{j}": joint_distance(c) for j, c in enumerate(centres)})
    names = [f"_d{j}" for j in range(len(centres))]
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    which = F.coalesce(*[F.when(F.col(n) == least, F.lit(j)) for j, n in enumerate(names)])
    return df.withColumns({"cluster": which.cast("int"), "distance": least}).drop(*names)


def centres_of(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean colour and position and the summed normals' direction by cluster; clusters without direction go."""
    length = F.sqrt(sum((F.sum(n) * F.sum(n) for n in NORMAL), F.lit(0.0)))
    out = df.groupBy("image_id", cluster).agg(F.count("*").alias("cnt"), *[F.avg(c).alias(c) for c in (*COLOUR, *POSITION)], *[(F.sum(n) / F.when(length != 0, length)).alias(n) for n in NORMAL])
    return out.where("nx is not null and not isnan(nx)")


def log_densities(df: DataFrame, parts: list[dict]) -> DataFrame:
    """``l0``, ``l1`` ..: log of weight times density of each component (literal parameters)."""
    from lumigrid.functions.distributions import gaussian_logpdf, watson_logpdf

    return df.withColumns({
        f"l{j}": F.lit(float(np.log(p["weight"]))) + gaussian_logpdf(COLOUR, p["mu_c"], p["cov_c"]) + gaussian_logpdf(POSITION, p["mu_p"], p["cov_p"]) + watson_logpdf(NORMAL, p["axis"], p["kappa"])
        for j, p in enumerate(parts)
    })


def responsibilities(df: DataFrame, parts: list[dict]) -> DataFrame:
    """E-step: ``p0``, ``p1`` .. by a shifted exponential, and the log likelihood ``ll`` of the pixel."""
    n = len(parts)
    df = log_densities(df, parts)
    top = F.greatest(*[f"l{j}" for j in range(n)]) if n > 1 else F.col("l0")
    df = df.withColumn("_top", top)
    total = reduce(lambda a, b: a + b, [F.exp(F.col(f"l{j}") - F.col("_top")) for j in range(n)])
    df = df.withColumn("_sum", total)
    out = {f"p{j}": F.exp(F.col(f"l{j}") - F.col("_top")) / F.col("_sum") for j in range(n)}
    return df.withColumns({**out, "ll": F.col("_top") + F.log("_sum")}).drop("_top", "_sum", *[f"l{j}" for j in range(n)])


def maximised(df: DataFrame, n: int) -> DataFrame:
    """M-step: weight, weighted means and mean squares by component, in one aggregation of the rows."""
    from lumigrid.operators.projections import watson_statistic as statistic

    rows = df.select("image_id", *COLOUR, *POSITION, *NORMAL, F.posexplode(F.array(*[f"p{j}" for j in range(n)])).alias("comp", "p"))
    total = F.sum("p")
    squares = [(F.sum(F.col("p") * F.col(a) * F.col(b)) / total).alias(f"{a}_{b}") for g in (COLOUR, POSITION) for i, a in enumerate(g) for b in g[i:]]
    means = [(F.sum(F.col("p") * F.col(c)) / total).alias(c) for c in (*COLOUR, *POSITION)]
    t = [(F.sum(F.col("p") * x) / total).alias(f"t{i + 1}") for i, x in enumerate(statistic(*[F.col(c) for c in NORMAL]))]
    size = Window.partitionBy("image_id")
    out = rows.groupBy("image_id", "comp").agg(total.alias("_p"), *means, *squares, *t)
    return out.withColumn("weight", F.col("_p") / F.sum("_p").over(size)).drop("_p")


def negative_log_likelihood(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((-F.sum("ll")).alias("nll"))


def hard(df: DataFrame, n: int) -> DataFrame:
    """The component of greatest responsibility, the first of equal ones."""
    top = F.greatest(*[f"p{j}" for j in range(n)]) if n > 1 else F.col("p0")
    return df.withColumn("cluster", F.coalesce(*[F.when(F.col(f"p{j}") == top, F.lit(j)) for j in range(n)]).cast("int"))


def objective(df: DataFrame, distance: str = "distance") -> DataFrame:
    """The sum of all distances to the nearest centre."""
    return df.groupBy("image_id").agg(F.sum(distance).alias("objective"))


def clustering_error(df: DataFrame, axes: list[list[float]], cluster: str = "cluster") -> DataFrame:
    """By cluster (0..) its pixels and the sum of their normals' squared cosines to its axis."""
    cosine = F.coalesce(*[F.when(F.col(cluster) == j, sum((F.col(n) * float(a) for n, a in zip(NORMAL, axis)), F.lit(0.0))) for j, axis in enumerate(axes)])
    return df.groupBy("image_id", cluster).agg(F.count("*").alias("n"), F.sum(cosine * cosine).alias("error"))


def watson_loss(df: DataFrame, parts: list[dict]) -> DataFrame:
    """Log of minus the sum of all components' log densities over all pixels (null where that sum is not negative)."""
    from lumigrid.functions.distributions import watson_logpdf

    total = sum((watson_logpdf(NORMAL, p["axis"], p["kappa"]) for p in parts), F.lit(0.0))
    out = df.groupBy("image_id").agg((-F.sum(total)).alias("_s"))
    return out.select("image_id", F.when(F.col("_s") > 0, F.log(F.when(F.col("_s") > 0, F.col("_s")))).alias("loss"))


#: Pixels that starts are drawn from, about; turns of the joint start; numbers that a component's statistics have.
SEEDS, JOINT_TURNS, WIDE = 4096, 49, 25
#: Colour, position and normal in a row of channels.
MODES = (slice(0, 3), slice(3, 6), slice(6, 9))


def spaced(x: np.ndarray) -> np.ndarray:
    """Evenly spaced rows, ``SEEDS`` to twice as many at most; all of few."""
    step = -(-len(x) // SEEDS)
    return x[step - 1 :: step] if step else x


def seeded(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starts by k-means++."""
    rng, n = np.random.default_rng(seed), len(x)
    centres = [x[rng.integers(n)]]
    d = np.full(n, np.inf)
    for _ in range(1, min(k, n)):
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[rng.choice(n, p=d / d.sum())] if d.sum() > 0 else x[rng.integers(n)])
    return np.array(centres)


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T).argmin(axis=1)


def cluster_sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """By cluster the sum of its rows, and their number in the last column."""
    return np.column_stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])] + [np.bincount(own, minlength=k)])


def moved(c: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The clusters' means; an empty one keeps its centre."""
    return np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), c)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's iterations from k-means++ starts; centres and assignments."""
    c, own = seeded(spaced(x), k, seed), None
    for _ in range(rounds):
        new = nearest_centre(x, c)
        if own is not None and (new == own).all():
            break
        own = new
        c = moved(c, cluster_sums(x, own, len(c)))
    return c, own


def joined_centres(parts: np.ndarray) -> np.ndarray:
    """Centres of all channels from those of colour, position and normal, each scaled to length 1."""
    return np.hstack([c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) for c in parts])


def joint_assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row by the joint distance, and that distance."""
    d = sum(np.linalg.norm(x[:, None, s] - centres[None, :, s], axis=2) for s in MODES[:2])
    lengths = [np.maximum(np.linalg.norm(y[:, 6:], axis=1), 1e-12) for y in (x, centres)]
    d = d + 1 - (x[:, 6:] @ centres[:, 6:].T) / lengths[0][:, None] / lengths[1]
    return d.argmin(axis=1), d.min(axis=1)


def joint_centres(sums: np.ndarray) -> np.ndarray:
    """Mean colour and position and the direction of the summed normals; clusters without direction go."""
    size = np.linalg.norm(sums[:, 6:9], axis=1)
    some = (sums[:, 9] > 0) & (size > 0)
    return np.hstack([sums[some, :6] / sums[some, 9:], sums[some, 6:9] / size[some, None]])


def joint_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Assignments by the joint distance, from one k-means per modality whose centres are scaled to length 1."""
    centres, before, own = joined_centres([kmeans(x[:, s], k, seed)[0] for s in MODES]), 100.0, None
    for _ in range(JOINT_TURNS):
        own, least = joint_assigned(x, centres)
        value = float(least.sum())
        if abs(value - before) <= 0.1:
            break
        centres, before = joint_centres(cluster_sums(x, own, len(centres))), value
    return own


def statistics(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By component the sums of weights, and of weighted channels, their products and the normals' statistic: (k, WIDE)."""
    i, j = np.triu_indices(3)
    parts = [np.ones((len(x), 1))]
    for s in MODES[:2]:
        parts += [x[:, s], x[:, s][:, i] * x[:, s][:, j]]
    return p.T @ np.hstack([*parts, watson_statistic(x[:, 6:])])


def components_of(sums: np.ndarray) -> list[tuple[float, Gaussian, Gaussian, Watson]]:
    """Log weight, colour, position and normal of each component; those that cannot be fitted are dropped."""
    return _components(np.ascontiguousarray(sums, float).tobytes())


@lru_cache(maxsize=64)
def _components(data: bytes) -> list[tuple[float, Gaussian, Gaussian, Watson]]:
    sums = np.frombuffer(data).reshape(-1, WIDE)
    n, out = sums[:, 0].sum(), []
    i, j = np.triu_indices(3)
    for s in sums:
        total = s[0]
        if total < 4:
            continue
        try:
            pair = []
            for at in (1, 10):
                mu, square = s[at : at + 3] / total, np.zeros((3, 3))
                square[i, j] = square[j, i] = s[at + 3 : at + 9] / total
                cov = square - np.outer(mu, mu) + 1e-9 * np.eye(3)
                if np.linalg.det(cov) <= 0:
                    raise np.linalg.LinAlgError
                pair.append(Gaussian(mu, -(cov + np.outer(mu, mu))))
            out.append((float(np.log(total / n)), *pair, Watson(s[19:] / total)))
        except (np.linalg.LinAlgError, ValueError):
            continue
    return out


def posterior(x: np.ndarray, components: list) -> tuple[float, np.ndarray | None]:
    """Negative log likelihood of the rows and the components' shares in each; None without components."""
    logs = []
    for weight, colour, position, normal in components:
        logs.append(weight + colour.logpdf(x[:, MODES[0]]) + position.logpdf(x[:, MODES[1]]) + normal.logpdf(x[:, MODES[2]]))
    if not logs:
        return np.nan, None
    l = np.stack(logs, axis=1)
    top = l.max(axis=1)
    p = np.exp(l - top[:, None])
    total = p.sum(axis=1)
    return -float((top + np.log(total)).sum()), p / total[:, None]


def joint_em(x: np.ndarray, config: MixtureConfig, start: np.ndarray | None = None) -> np.ndarray:
    """Responsibilities of the joint mixture of two Gaussians and a Watson per component, from ``start``
    (labels 0..) or the joint start.

    Components whose parameters cannot be fitted are dropped; iteration goes on for
    ``min_iterations`` and then while the likelihood rises.  Rows that no component fits are one.
    """
    own = joint_start(x, config.k, config.seed) if start is None else start
    sums, best, result = statistics(x, np.eye(own.max() + 1)[own]), np.inf, np.ones((len(x), 1))
    for turn in range(max(config.max_iterations, 1)):
        nll, p = posterior(x, components_of(sums))
        if p is None or (turn >= config.min_iterations and not nll < best):
            break
        best, result, sums = nll, p, statistics(x, p)
    return result


def first_axes(mean: np.ndarray, config: DiametricalConfig) -> np.ndarray:
    rng = np.random.default_rng(config.seed)
    axes = mean / max(np.linalg.norm(mean), 1e-12) + rng.uniform(-0.1, 0.1, (config.k, len(mean)))
    return axes / np.linalg.norm(axes, axis=1, keepdims=True)


def axis_assigned(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, float]:
    s = (x @ axes.T) ** 2
    return s.argmax(axis=1), float(s.max(axis=1).sum())


def axis_scatter(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    return np.stack([x[own == j].T @ x[own == j] for j in range(k)])


def moved_axes(axes: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """The leading direction of each cluster; an empty one keeps its axis.  Normals that are not finite are an error."""
    if not np.isfinite(scatter).all():
        raise np.linalg.LinAlgError("normals are not finite")
    return np.array([np.linalg.eigh(s)[1][:, -1] if np.trace(s) > 0 else a for a, s in zip(axes, scatter)])


def diametrical(x: np.ndarray, config: DiametricalConfig) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of directions up to sign: axes and assignments."""
    axes, old = first_axes(x.mean(axis=0), config), -np.inf
    for _ in range(config.max_iterations):
        own, value = axis_assigned(x, axes)
        if value - old <= config.threshold:
            break
        axes, old = moved_axes(axes, axis_scatter(x, own, config.k)), value
    return axes, axis_assigned(x, axes)[0]


def average_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """Clusters of rows of a distance matrix: the closest two merge until k are left."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        pairs = [(float(np.mean([d[i, j] for i in a for j in b])), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        _, x, y = min(pairs)
        groups[x] += groups.pop(y)
    out = np.zeros(len(d), int)
    for g, members in enumerate(groups):
        out[members] = g
    return out


def watson_sums(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By component the sum of weights and of the weighted statistic."""
    return p.T @ np.hstack([np.ones((len(x), 1)), watson_statistic(x)])


def watson_parts(sums: np.ndarray, hard: bool = False) -> np.ndarray:
    """Weight and mean statistic of each component; of ``hard`` clusters the empty ones go."""
    sums = sums[sums[:, 0] > 0] if hard else sums
    total = sums[:, :1] + (0 if hard else np.finfo(float).eps)
    return np.hstack([total / sums[:, 0].sum(), sums[:, 1:] / total])


def watson_logs(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    theta, constant = _natural(np.ascontiguousarray(parts[:, 1:], float).tobytes())
    return np.log(parts[:, 0] + 1e-300) + watson_statistic(x) @ theta.T - constant


@lru_cache(maxsize=64)
def _natural(means: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = [Watson(m) for m in np.frombuffer(means).reshape(-1, 6)]
    return np.array([w.theta for w in found]), np.array([w.log_normaliser() for w in found])


def watson_posterior(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    l = watson_logs(x, parts)
    p = np.exp(l - l.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def watson_reduced(parts: np.ndarray, k: int) -> np.ndarray:
    """``k`` components at most: those of least divergence, weighted, become one."""
    weight, mean = parts[:, 0], parts[:, 1:]
    found = [Watson(m) for m in mean]
    d = np.array([[wi * wj * (a.mean @ a.theta - log_kummer(0.5, 1.5, a.kappa) + log_kummer(0.5, 1.5, b.kappa) - a.mean @ b.theta) for wj, b in zip(weight, found)] for wi, a in zip(weight, found)])
    group = average_linkage(np.triu(d) + np.triu(d, 1).T, min(k, len(found)))
    pi = np.bincount(group, weight)
    eta = np.array([(mean[group == g] * weight[group == g][:, None]).sum(axis=0) / max(pi[g], 1e-300) for g in range(len(pi))])
    return np.column_stack([pi, eta])


def watson_mixture(x: np.ndarray, config: WatsonConfig) -> np.ndarray:
    """Labels of a Watson mixture of directions, reduced from ``k_init`` to ``k`` components by divergence."""
    _, own = diametrical(x, DiametricalConfig(k=config.k_init, seed=config.seed))
    parts = watson_parts(watson_sums(x, np.eye(config.k_init)[own]), hard=True)
    for _ in range(config.iterations):
        parts = watson_parts(watson_sums(x, watson_posterior(x, parts)))
    return watson_logs(x, watson_reduced(parts, config.k)).argmax(axis=1)
