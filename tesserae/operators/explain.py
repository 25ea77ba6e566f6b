"""Why a model says what it says: importance, dependence, attribution, learning curves, tuning, sensitivity, cluster counts.

A model is a function DataFrame -> DataFrame that adds `prediction`. Rows with a missing feature are
left out. Changed copies of rows are made by exploding short literal arrays, so that a model is
applied once to all of them; only grids, backgrounds of a stated size and metrics reach the driver.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import clustering as K
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import clean
from tesserae.operators.clusters import clustering_metrics
from tesserae.operators.kernels import quantiles
from tesserae.operators.models import _solve, by_fold, cross_validate, fit, fold_of, fold_table, vectors
from tesserae.sources.written import written


def _complete(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    return df.select(*keep, *[clean(c).alias(c) for c in features]).dropna(subset=features)


def permutation_importance(df: DataFrame, model: Callable, features: list[str], target: str, key: list[str], repeats: int = 3, rows_a_bucket: int = 10_000) -> DataFrame:
    """(variable, rmse, increase, sd): how much the error grows when one feature comes from another row.

    Rows are dealt to buckets by a hash and each takes the values of the next one in its bucket, the
    last those of the first: a permutation by one shuffle, whatever the number of rows.
    """
    x = _complete(df, features, *key, F.col(target).cast("double").alias("_y"))
    buckets = max(1, math.ceil(x.count() / rows_a_bucket))
    base = model(x).agg(F.sqrt(F.avg((F.col("prediction") - F.col("_y")) ** 2))).first()[0]
    got = None
    for r in range(repeats):
        b, o = F.pmod(F.xxhash64(*key, F.lit(2 * r)), F.lit(buckets)), F.xxhash64(*key, F.lit(2 * r + 1))
        own = F.struct(*features)
        w = Window.partitionBy("_b").orderBy("_o", *key)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        other = F.coalesce(F.lead(own).over(w), F.first(own).over(whole))
        p = x.withColumns({"_b": b, "_o": o}).withColumn("_other", other)
        variants = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"_other.{f}" if f == c else f).alias(f) for f in features]) for c in features])
        m = model(p.select("_y", F.inline(variants))).groupBy("variable").agg(F.sqrt(F.avg((F.col("prediction") - F.col("_y")) ** 2)).alias("rmse"))
        got = m if got is None else got.unionAll(m)
    out = got.groupBy("variable").agg(F.avg("rmse").alias("rmse"), F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("sd"))
    return out.select("variable", "rmse", (F.col("rmse") - F.lit(base)).alias("increase"), "sd")


def _trend(grid: np.ndarray, values: np.ndarray) -> str:
    """The shape of a dependence curve; curved: over 0.15 of its variance is not a line's."""
    if len(grid) < 3:
        return "too few points"
    if np.ptp(values) <= 1e-12 * max(1.0, float(np.abs(values).max())):
        return "no effect"
    line = np.polyfit(grid, values, 1)
    left = float(np.mean((values - np.polyval(line, grid)) ** 2)) / float(np.var(values))
    return ("rising" if line[0] > 0 else "falling") + (" along a curve" if left > 0.15 else " in a line")


def dependence_grid(df: DataFrame, feature: str, points: int = 20) -> list[float]:
    """The different values if there are at most `points`, else even steps from the 2nd to the 98th percentile."""
    few = df.select(clean(feature).alias("v")).where("v is not null").distinct().limit(points + 1).collect()
    if len(few) <= points:
        return sorted(float(r["v"]) for r in few)
    low, high = quantiles(df, [feature], [0.02, 0.98])[feature]
    return np.linspace(low, high, points).tolist()


def partial_dependence(df: DataFrame, model: Callable, features: list[str], feature: str, points: int = 20) -> DataFrame:
    """(variable, value, mean, sd, trend): the predictions over all rows with the feature held at each grid value."""
    grid = dependence_grid(df, feature, points)
    if not grid:
        return df.sparkSession.createDataFrame([], "variable string, value double, mean double, sd double, trend string")
    rest = [c for c in features if c != feature]
    held = _complete(df, features).select(*rest, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias(feature))
    rows = model(held).groupBy(F.col(feature).alias("value")).agg(F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("sd")).sort("value").collect()
    trend = _trend(np.array([r["value"] for r in rows]), np.array([r["mean"] for r in rows]))
    return df.sparkSession.createDataFrame([(feature, r["value"], r["mean"], r["sd"], trend) for r in rows], "variable string, value double, mean double, sd double, trend string")


def explain_rows(df: DataFrame, model: Callable, features: list[str], key: list[str], background: DataFrame, most: int = 50) -> DataFrame:
    """(key, variable, effect, rank): the prediction less its mean with the feature taken from background rows.

    background: at most `most` rows are used, the first by key, so that a row has a bounded number of copies.
    """
    back = _complete(background, features, *key).orderBy(*key).limit(most).select(*features).collect()
    x = _complete(df, features, *key)
    if not back:
        return x.select(*key, F.lit("").alias("variable"), F.lit(0.0).alias("effect"), F.lit(0).alias("rank")).limit(0)
    own = F.struct(F.lit("").alias("variable"), *features)

    def variants(c):
        """Copies of the row with c from each background row."""
        values = F.array(*[F.lit(float(r[c])) for r in back])
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("variable"), *[(v if f == c else F.col(f)).alias(f) for f in features]))

    changed = [variants(c) for c in features]
    # effects hang on the features alone: copies are made of each different row, and the effects joined back
    got = model(x.select(*features).distinct().select(F.struct(*features).alias("_row"), F.inline(F.concat(F.array(own), *changed))))
    mean = lambda c: F.avg(F.when(F.col("variable") == c, F.col("prediction")))
    effects = F.array(*[F.struct(F.lit(c).alias("variable"), (mean("") - mean(c)).alias("effect")) for c in features])
    ranked = F.array_sort("_e", lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1).when(F.abs(a["effect"]) < F.abs(b["effect"]), 1).when(a["variable"] < b["variable"], -1).otherwise(1))
    learned = written(got.groupBy("_row").agg(effects.alias("_e")).select(*[F.col(f"_row.{c}").alias(f"_f{i}") for i, c in enumerate(features)], ranked.alias("_e")))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_f{i}") for i, c in enumerate(features)])
    return x.join(learned, same).select(*key, F.posexplode("_e").alias("rank", "_e")).select(*key, "_e.variable", "_e.effect", (F.col("rank") + 1).alias("rank"))


def _r2(df: DataFrame, target: str) -> float:
    y = F.col(target).cast("double")
    a = df.agg(F.avg((F.col("prediction") - y) ** 2).alias("e"), F.var_pop(y).alias("v")).first()
    return 1.0 - a["e"] / a["v"] if a["v"] else float("nan")


def learning_curve(df: DataFrame, name: str, features: list[str], target: str, key: list[str], shares=(0.2, 0.4, 0.6, 0.8, 1.0), **options) -> DataFrame:
    """(share, n, train_r2, test_r2, verdict): fits on growing nested shares, tried on one held-out fifth."""
    fold = fold_of(key, 5)
    test, rest = df.where(fold == 0), df.where(fold != 0)
    u = F.pmod(F.xxhash64(*key, F.lit("share")), F.lit(1000))
    rows = []
    for s in shares:
        part = rest.where(u < round(1000 * s))
        m = fit(name, part, features, target, **options)
        rows.append((float(s), part.count(), _r2(m(part), target), _r2(m(test), target)))
    gain = rows[-1][3] - rows[-2][3] if len(rows) > 1 else 0.0
    gap = rows[-1][2] - rows[-1][3]
    verdict = "still improving" if gain > 0.02 else "overfitting" if gap > 0.15 else "plateaued"
    return df.sparkSession.createDataFrame([(*r, verdict) for r in rows], "share double, n long, train_r2 double, test_r2 double, verdict string")


def drawn(space: dict, draws: int, seed: int = 0) -> list[dict]:
    """That many different points of a space, the same for one seed: a list is drawn from, (low, high) is uniform, (low, high, "log") is so in its logarithm.

    With lists only, no more points than there are.
    """
    rng = random.Random(seed)
    most = math.prod(len(v) for v in space.values()) if all(isinstance(v, list) for v in space.values()) else draws

    def one(v):
        if isinstance(v, list):
            return v[rng.randrange(len(v))]
        low, high, *log = v
        return math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)

    out: list[dict] = []
    while len(out) < min(draws, most):
        point = {c: one(v) for c, v in space.items()}
        if point not in out:
            out.append(point)
    return out


def tune(df: DataFrame, name: str, features: list[str], target: str, key: list[str], space: dict, k: int = 3, draws: int | None = None, seed: int = 0, at_once: int = 4) -> DataFrame:
    """(options, rmse, rank): points of a space by out-of-fold error; every combination of its lists, or so many draws (see drawn).

    All fits read one written table of folds, at_once of them at a time; ties in the order of the points.
    """
    points = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())] if draws is None else drawn(space, draws, seed)
    x = fold_table(df.withColumn("fold", fold_of(key, k)), features, target, key, {})

    def error(options: dict) -> float | None:
        got = by_fold(x, name, features, target, key, k, **options)
        return got.agg(F.sqrt(F.avg((F.col("prediction") - F.col("actual")) ** 2))).first()[0]

    with ThreadPool(at_once) as pool:
        errors = pool.map(inheritable_thread_target(df.sparkSession)(error), points)
    said = lambda v: f"{v:.6g}" if isinstance(v, float) and draws is not None else f"{v}"
    rows = [(", ".join(f"{c}={said(v)}" for c, v in o.items()), e) for o, e in zip(points, errors, strict=True)]
    ranked = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0))
    return df.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(ranked)], "options string, rmse double, rank int")


def sensitivity_run(df: DataFrame, features: list[str], target: str, key: list[str]) -> DataFrame:
    """(spec, driver, coefficient, r2, agreement, verdict): does the strongest driver stay the same?

    Specifications: all rows, each feature left out, middle 98 % of the target, logarithm of the
    target (positive rows), two halves by hash. The driver has the largest standardised coefficient.
    Agreement is the share of specifications that have the first one's driver among their features
    and name it; from 0.8 stable, from 0.5 partly stable.
    """
    low, high = quantiles(df, [target], [0.01, 0.99])[target]
    half = F.pmod(F.xxhash64(*key, F.lit("half")), F.lit(2))
    y = F.col(target)
    specs = [("all rows", df, features)]
    specs += [(f"without {c}", df, [f for f in features if f != c]) for c in features if len(features) > 1]
    specs += [("trimmed target", df.where(y.between(low, high)), features), ("log target", df.where(y > 0).withColumn(target, F.log(y)), features)]
    specs += [(f"half {i + 1}", df.where(half == i), features) for i in (0, 1)]
    rows = []
    for spec, x, own in specs:
        n, _, s, w, _ = _solve(x, own, target, 1e-9)
        p = len(own)
        sd = np.sqrt(np.diag(s) / max(n, 1))
        beta = w * sd[:p] / (sd[p] or 1.0)
        top = int(np.argmax(np.abs(beta)))
        rows.append((spec, own[top], float(beta[top]), float(w @ s[:p, p] / (s[p, p] or 1.0))))
    first = rows[0][1]
    asked = [r[1] for r, (_, _, own) in zip(rows, specs, strict=True) if first in own]
    agreement = asked.count(first) / len(asked)
    verdict = "stable" if agreement >= 0.8 else "partly stable" if agreement >= 0.5 else "unstable"
    return df.sparkSession.createDataFrame([(*r, agreement, verdict) for r in rows], "spec string, driver string, coefficient double, r2 double, agreement double, verdict string")


def davies_bouldin(df: DataFrame, cluster: str, cols: list[str]) -> float:
    """Mean over clusters of the worst (spread + spread) / distance of centres; k * p numbers reach the driver."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    dist = F.sqrt(sum(((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in cols), F.lit(0.0)))
    rows = df.join(centres, cluster).groupBy(cluster, *[f"_m_{c}" for c in cols]).agg(F.avg(dist).alias("_s")).collect()
    at, s = np.array([[r[f"_m_{c}"] for c in cols] for r in rows]), np.array([r["_s"] for r in rows])
    if len(rows) < 2:
        return float("nan")
    far = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    return float(((s[:, None] + s[None, :]) / far).max(axis=1).mean())


def _elbow(ks: list[int], inertia: list[float]) -> int:
    """The count farthest below the chord between the first and the last, both axes scaled to one."""
    x, y = np.array(ks, dtype=float), np.array(inertia)
    x, y = (x - x[0]) / (np.ptp(x) or 1.0), (y - y.min()) / (np.ptp(y) or 1.0)
    return ks[int(np.argmax(np.abs((y[-1] - y[0]) * x - (x[-1] - x[0]) * (y - y[0]))))]


def cluster_count_sweep(df: DataFrame, features: list[str], counts=range(2, 11)) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, davies_bouldin, recommended, votes) for each number of clusters.

    Silhouettes are of squared Euclidean distances, which need no pairs. The measures and the elbow
    vote; of counts with equally many votes the least is recommended.
    """
    x = vectors(_complete(df, features), features).cache()
    rows = []
    try:
        for k in counts:
            m = K.KMeans(k=k, seed=1).fit(x)
            got = m.transform(x)
            rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(got)), clustering_metrics(got, "prediction", features).first()["calinski_harabasz"], davies_bouldin(got, "prediction", features)))
    finally:
        x.unpersist()
    best = [max(rows, key=lambda r: r[2])[0], max(rows, key=lambda r: r[3])[0], min(rows, key=lambda r: r[4])[0]]
    if len(rows) > 2:
        best.append(_elbow([r[0] for r in rows], [r[1] for r in rows]))
    chosen = min(best, key=lambda k: (-best.count(k), k))
    return df.sparkSession.createDataFrame([(*r, r[0] == chosen, best.count(r[0])) for r in rows], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double, recommended boolean, votes int")
