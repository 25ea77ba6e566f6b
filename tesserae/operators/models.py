"""Models: MLlib where it has them, closed forms from one Gram pass where that is enough, EM loops otherwise.

fit(name, df, features, target, **options) gives a function DataFrame -> DataFrame that adds
`prediction` (and `probability` where there is one). register_model adds a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import special
from tesserae.functions.scalar import clean
from tesserae.operators.kernels import gram, gram_by, quantiles
from tesserae.operators.neighbours import mean_of, mode_of, with_nearest
from tesserae.sources.written import written

MODELS: dict[str, Callable] = {}


def register_model(name: str, fit: Callable) -> None:
    MODELS[name] = fit


def fit(name: str, df: DataFrame, features: list[str], target: str | None = None, **options) -> Callable:
    return MODELS[name](df, features, target, **options)


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


#: How many rows a row of a grouped table stands for.
TIMES = "_times"
#: Options by which a fit on rows differs from one on grouped rows: a draw, a count of rows, another loss, other weights.
BY_ROW = {"subsamplingRate", "minInstancesPerNode", "lossType", "weightCol", "validationIndicatorCol", "featureSubsetStrategy"}
#: Rows in one task of a fit that keeps all rows in memory.
TASK_ROWS = 500_000


def grouped(df: DataFrame, features: list[str], target: str | None = None, mean: bool = False) -> DataFrame:
    """The different rows of features and target (mean: of features, with the mean of the target) and TIMES, as a written table.

    A fit that only adds up over rows, or over squared errors (mean), is the same on it, and no round of it reads all rows again.
    """
    times = F.count(F.lit(1)).cast("double").alias(TIMES)
    if mean:  # a null target stays one
        return written(df.groupBy(*features).agg(times, F.when(F.count(target) == F.count(F.lit(1)), F.avg(F.col(target).cast("double"))).alias(target)))
    return written(df.groupBy(*dict.fromkeys([*features, *([target] if target else [])])).agg(times))


def groups(df: DataFrame, features: list[str], target: str | None, options: dict) -> bool:
    """Whether a fit can run on a grouped table."""
    plain = all(df.schema[c].dataType.typeName() not in ("udt", "array", "struct", "map") for c in features)
    return plain and target not in features and not BY_ROW & options.keys()


def dealt(x: DataFrame) -> DataFrame:
    """x in tasks of at most about TASK_ROWS rows."""
    parts = -(-x.count() // TASK_ROWS)
    return x.repartition(parts) if parts > x.rdd.getNumPartitions() else x


def _ml(make: Callable, label: bool = True, group: str | None = None) -> Callable:
    """A model of MLlib as a fit function. group: it is fitted on different rows ("rows"), or on different features and the targets' means ("mean")."""

    def run(df, features, target, **options):
        est = make(**options)
        if label:
            est = est.setLabelCol(target)
        if group and groups(df, features, target if label else None, options):
            est, df = est.setWeightCol(TIMES), grouped(df, features, target if label else None, group == "mean")
        x = vectors(df, features)
        if group is None and isinstance(est, (R.RandomForestRegressor, C.RandomForestClassifier)):
            x = dealt(x.select("features", target))
        model = est.setFeaturesCol("features").fit(x)
        return lambda x: model.transform(vectors(x, features)).drop("features", "rawPrediction")

    return run


register_model("linear_regression", _ml(lambda **o: R.LinearRegression(regParam=0.0, **o)))
register_model("lasso", _ml(lambda alpha=1.0, **o: R.LinearRegression(regParam=alpha, elasticNetParam=1.0, **o)))
register_model("elastic_net", _ml(lambda alpha=1.0, ratio=0.5, **o: R.LinearRegression(regParam=alpha, elasticNetParam=ratio, **o)))
register_model("huber", _ml(lambda **o: R.LinearRegression(loss="huber", **o)))
for _f, _link in (("poisson", "log"), ("gamma", "log")):
    register_model(_f, _ml(lambda f=_f, k=_link, **o: R.GeneralizedLinearRegression(family=f, link=k, **o)))
register_model("tweedie", _ml(lambda power=1.5, **o: R.GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, **o)))
register_model("decision_tree_regression", _ml(lambda **o: R.DecisionTreeRegressor(seed=1, **o), group="mean"))
register_model("random_forest_regression", _ml(lambda **o: R.RandomForestRegressor(seed=1, **o)))
register_model("gbt_regression", _ml(lambda **o: R.GBTRegressor(seed=1, **o), group="mean"))
register_model("decision_tree", _ml(lambda **o: C.DecisionTreeClassifier(seed=1, **o), group="rows"))
register_model("random_forest", _ml(lambda **o: C.RandomForestClassifier(seed=1, **o)))
register_model("logistic", _ml(lambda **o: C.LogisticRegression(**o), group="rows"))
register_model("naive_bayes", _ml(lambda kind="gaussian", **o: C.NaiveBayes(modelType=kind, **o)))
register_model("mlp_classifier", _ml(lambda layers=None, **o: C.MultilayerPerceptronClassifier(layers=layers, seed=1, **o)))


def _one_vs_rest(make: Callable) -> Callable:
    """A binary classifier of MLlib; with more classes, numbered from 0, one fit for each against the rest."""

    def run(df, features, target, **options):
        est = make(**options)
        if groups(df, features, target, options):
            est, df = est.setWeightCol(TIMES), grouped(df, features, target)
        if df.where(F.col(target).isNotNull()).select(target).distinct().limit(3).count() > 2:
            est = C.OneVsRest(classifier=est)
            if TIMES in df.columns:
                est = est.setWeightCol(TIMES)
        model = est.setLabelCol(target).setFeaturesCol("features").fit(vectors(df, features))
        if isinstance(model, C.OneVsRestModel):
            return lambda x: _greatest_margin(model.models, vectors(x, features)).drop("features")
        return lambda x: model.transform(vectors(x, features)).drop("features", "rawPrediction")

    return run


def _greatest_margin(models: list, x: DataFrame) -> DataFrame:
    """x with the class whose model has the greatest margin, the first at a tie: what OneVsRest returns, without a map a row and model."""
    names = [f"_m{i}" for i in range(len(models))]
    for m, name in zip(models, names, strict=True):
        m = m.copy().setRawPredictionCol(name).setPredictionCol("").setFeaturesCol("features")
        x = (m.setProbabilityCol("") if m.hasParam("probabilityCol") else m).transform(x).withColumn(name, vector_to_array(name)[1])
    return x.withColumn("prediction", _argmax(F.array(*names))).drop(*names)


register_model("gbt", _one_vs_rest(lambda **o: C.GBTClassifier(seed=1, **o)))
register_model("linear_svc", _one_vs_rest(lambda **o: C.LinearSVC(**o)))
register_model("kmeans", _ml(lambda k=3, **o: K.KMeans(k=k, seed=1, **o), label=False))
register_model("bisecting", _ml(lambda k=3, **o: K.BisectingKMeans(k=k, seed=1, **o), label=False))
#: EM of a mixture goes on until a round adds less than this to the mean log-likelihood; least variance of a standardised column.
MIXTURE_GAIN, MIXTURE_FLOOR = 1e-6, 1e-6


@dataclass
class Mixture:
    """A fitted Gaussian mixture: columns are standardised by shift and scale, weights, means and covariances are of these."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -math.inf  # of all rows, in the columns' own units
    rounds: int = 0

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Matrices a for which (x - mean) @ a has unit covariance, and the logarithm of each density's factor and weight."""
        a = np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])
        with np.errstate(divide="ignore"):
            return a, np.log(self.weights) - self.means.shape[1] / 2 * math.log(2 * math.pi) + np.log(np.abs(np.linalg.det(a)))


def _mixture_sums(x: DataFrame, features: list[str], m: Mixture) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """One round over standardised different rows: log-likelihood, and by component the memberships' sum, first and second moments about its mean."""
    (k, p), (a, factor), means = m.means.shape, m.whitening(), m.means

    def run(batches):
        import pyarrow as pa

        out = np.zeros(1 + k * (1 + p + p * p))
        for batch in batches:
            z, times = np.stack([batch.column(c).to_numpy() for c in features], axis=1), batch.column(TIMES).to_numpy()
            d = z[:, None, :] - means
            log = factor - 0.5 * (np.einsum("nkp,kpq->nkq", d, a) ** 2).sum(axis=2)
            top = log.max(axis=1, keepdims=True)
            share = np.exp(log - top)
            total = share.sum(axis=1, keepdims=True)
            share *= times[:, None] / total
            second = np.stack([(share[:, j, None] * d[:, j]).T @ d[:, j] for j in range(k)])
            out += np.concatenate(([times @ (np.log(total) + top)[:, 0]], share.sum(axis=0), np.einsum("nk,nkp->kp", share, d).ravel(), second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["sums"])

    got = np.sum([r.sums for r in x.mapInArrow(run, "sums array<double>").collect()], axis=0)  # a row a task
    return float(got[0]), got[1 : 1 + k], got[1 + k : 1 + k + k * p].reshape(k, p), got[1 + k + k * p :].reshape(k, p, p)


def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """The different complete rows of features and their numbers."""
    return grouped(df.select(*[clean(c).alias(c) for c in features]).dropna(), features)


def gaussian_mixture(x: DataFrame, features: list[str], k: int = 3) -> Mixture:
    """Full covariances by EM on standardised columns, from the clusters of a k-means, until a round adds next to nothing. x: complete()."""
    w, n = F.col(TIMES), x.agg(F.sum(TIMES)).first()[0]
    if not n:
        raise ValueError("no complete rows")
    shift = np.array(x.agg(*[F.sum(w * F.col(c)) / n for c in features]).first(), dtype=float)
    scale = np.sqrt(np.array(x.agg(*[F.sum(w * (F.col(c) - v) ** 2) / n for c, v in zip(features, shift.tolist(), strict=True)]).first(), dtype=float))
    scale = np.where(scale > 0, scale, 1.0)
    x = written(x.select(*[((F.col(c) - v) / s).alias(c) for c, v, s in zip(features, shift.tolist(), scale.tolist(), strict=True)], TIMES))
    start = K.KMeans(k=k, seed=1, maxIter=300, weightCol=TIMES).fit(vectors(x, features)).transform(vectors(x, features))
    pairs = [(a, b) for a in range(len(features)) for b in range(a, len(features))]
    sums = [F.sum(w)] + [F.sum(w * F.col(c)) for c in features] + [F.sum(w * F.col(features[a]) * F.col(features[b])) for a, b in pairs]
    rows = np.array([list(r)[1:] for r in start.groupBy("prediction").agg(*sums).orderBy("prediction").collect()], dtype=float)  # a row a cluster
    times, p = rows[:, 0], len(features)
    first, second = rows[:, 1 : 1 + p], np.zeros((len(rows), p, p))
    for i, (a, b) in enumerate(pairs):
        second[:, a, b] = second[:, b, a] = rows[:, 1 + p + i]
    m = Mixture(shift, scale, *_maximised(times, np.zeros((len(rows), p)), first, second))
    while True:
        like, times, first, second = _mixture_sums(x, features, m)
        gain, m.log_likelihood = like - m.log_likelihood, like
        if not abs(gain) >= MIXTURE_GAIN * n:
            break
        m = Mixture(shift, scale, *_maximised(times, m.means, first, second), like, m.rounds + 1)
    m.log_likelihood = like - n * float(np.log(scale).sum())
    return m


def _maximised(times, about, first, second) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances from the memberships' sums and moments about some points."""
    times = np.maximum(times, 1e-300)
    off = first / times[:, None]
    covariances = second / times[:, None, None] - off[:, :, None] * off[:, None, :] + MIXTURE_FLOOR * np.eye(first.shape[1])
    return times / times.sum(), about + off, covariances


def fit_mixture(df, features, target=None, k=3, **options):
    """gaussian_mixture as a model with prediction and probability. Options are MLlib's, which then does the fit."""
    if options or not groups(df, features, None, {}):
        return _ml(lambda **o: K.GaussianMixture(seed=1, **o), label=False, group="rows")(df, features, target, k=k, **options)
    m = gaussian_mixture(complete(df, features), features, k)
    (a, factor), names = m.whitening(), [f"_l{j}" for j in range(len(m.weights))]

    def log(j):
        d = [(clean(c) - float(s)) / float(r) - float(v) for c, s, r, v in zip(features, m.shift, m.scale, m.means[j], strict=True)]
        return F.lit(float(factor[j])) - 0.5 * sum((sum((d[i] * float(a[j, i, q]) for i in range(q + 1)), F.lit(0.0)) ** 2 for q in range(len(d))), F.lit(0.0))

    def run(x):
        x = x.where(reduce(lambda u, v: u & v, [clean(c).isNotNull() for c in features]))
        x = x.withColumns({name: log(j) for j, name in enumerate(names)})
        x = x.withColumn("_top", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
        x = x.withColumns({name: F.exp(F.col(name) - F.col("_top")) for name in names})
        x = x.withColumn("_total", sum((F.col(name) for name in names), F.lit(0.0)))
        share = F.array(*[F.col(name) / F.col("_total") for name in names])
        return x.withColumn("probability", array_to_vector(share)).withColumn("prediction", _argmax(F.array(*names)).cast("int")).drop(*names, "_top", "_total")

    return run


register_model("gmm", fit_mixture)


def _linear(weights, bias, features):
    w = [float(x) for x in weights]
    return lambda x: x.withColumn("prediction", sum((clean(c) * a for c, a in zip(features, w, strict=True)), F.lit(float(bias))))


def _solve(df, features, target, ridge=0.0):
    n, mean, s = gram(df, [*features, target])
    p = len(features)
    w = np.linalg.solve(s[:p, :p] + ridge * np.eye(p), s[:p, p])
    return n, mean, s, w, float(mean[p] - w @ mean[:p])


def fit_gram_ridge(df, features, target, alpha=0.0):
    _, _, _, w, b = _solve(df, features, target, alpha)
    return _linear(w, b, features)


def fit_bayesian_ridge(df, features, target, rounds=50):
    """Evidence fixed point on the p x p Gram matrix."""
    n, mean, s = gram(df, [*features, target])
    p = len(features)
    xx, xy, yy = s[:p, :p], s[:p, p], s[p, p]
    values, vec = np.linalg.eigh(xx)
    alpha, beta = 1.0, n / yy
    for _ in range(rounds):
        w = vec @ ((vec.T @ xy) * beta / (alpha + beta * values))
        gamma = float((beta * values / (alpha + beta * values)).sum())
        rss = yy - 2 * w @ xy + w @ xx @ w
        alpha, beta = gamma / max(1e-12, w @ w), (n - gamma) / max(1e-12, rss)
    return _linear(w, mean[p] - w @ mean[:p], features)


def fit_pls(df, features, target, components=2):
    """NIPALS on the Gram blocks."""
    n, mean, s = gram(df, [*features, target])
    p = len(features)
    xx, xy = s[:p, :p].copy(), s[:p, p].copy()
    ws, ps, qs = [], [], []
    for _ in range(components):
        w = xy / max(1e-300, np.linalg.norm(xy))
        tt = w @ xx @ w
        load, q = xx @ w / tt, (xy @ w) / tt
        xx -= tt * np.outer(load, load)
        xy -= q * tt * load
        ws.append(w), ps.append(load), qs.append(q)
    w, load = np.array(ws).T, np.array(ps).T
    b = w @ np.linalg.solve(load.T @ w, np.array(qs))
    return _linear(b, mean[p] - b @ mean[:p], features)


def fit_quantile_regression(df, features, target, q=0.5, rounds=15):
    """Iteratively reweighted least squares, one weighted Gram aggregate a round."""
    x = df.select(*[clean(c).alias(c) for c in [*features, target]]).dropna()
    _, _, _, w, b = _solve(x, features, target)
    for _ in range(rounds):
        e = F.col(target) - sum((F.col(c) * float(a) for c, a in zip(features, w, strict=True)), F.lit(float(b)))
        weight = F.when(e >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / F.greatest(F.abs(e), F.lit(1e-6))
        cols = [F.lit(1.0), *[F.col(c) for c in features], F.col(target)]
        k = len(cols)
        row = x.withColumn("_w", weight).agg(*[F.sum(F.col("_w") * cols[i] * cols[j]) for i in range(k) for j in range(i, k)]).first()
        m = np.zeros((k, k))
        it = iter(row)
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = next(it)
        sol = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        b, w = float(sol[0]), sol[1:]
    return _linear(w, b, features)


def _residuals(df, features, target, w, b):
    """Complete rows with their residual."""
    x = df.select(*[clean(c).alias(c) for c in [*features, target]]).dropna()
    return x.withColumn("_e", F.col(target) - sum((F.col(c) * float(a) for c, a in zip(features, w, strict=True)), F.lit(float(b))))


def ols_robust_errors(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(term, coefficient, se_hc3): standard errors that hold where the residuals' spread differs (HC3), from a weighted Gram pass."""
    n, mean, s, w, b = _solve(df, features, target)
    p = len(features)
    inv = np.linalg.inv(s[:p, :p])
    x = _residuals(df, features, target, w, b)
    d = [F.col(c) - float(m) for c, m in zip(features, mean[:p], strict=True)]
    leverage = F.lit(1 / n) + sum((d[i] * d[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    weight = (F.col("_e") / (1 - leverage)) ** 2
    z = [F.lit(1.0), *d]  # centred, so that the inverse is a block of 1 / n and inv
    row = x.agg(*[F.sum(weight * z[i] * z[j]) for i in range(p + 1) for j in range(i, p + 1)]).first()
    meat, it = np.zeros((p + 1, p + 1)), iter(row)
    for i in range(p + 1):
        for j in range(i, p + 1):
            meat[i, j] = meat[j, i] = next(it)
    bread = np.zeros((p + 1, p + 1))
    bread[0, 0], bread[1:, 1:] = 1 / n, inv
    shift = np.eye(p + 1)
    shift[0, 1:] = -mean[:p]  # the intercept at zero instead of at the means
    cov = shift @ bread @ meat @ bread @ shift.T
    rows = [(t, float(c), float(math.sqrt(v))) for t, c, v in zip(["intercept", *features], [b, *w], np.diag(cov), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se_hc3 double")


def durbin_watson(df: DataFrame, features: list[str], target: str, order: list[str], parts: int | None = None) -> DataFrame:
    """(n, durbin_watson) of least-squares residuals in the order of some columns.

    Rows are dealt to ranges of that order; inside a range neighbours are compared, and the ends of
    neighbouring ranges on the driver (a row for each range).
    """
    _, _, _, w, b = _solve(df, features, target)
    e = clean(target) - sum((clean(c) * float(a) for c, a in zip(features, w, strict=True)), F.lit(float(b)))
    x = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], e.alias("e")).where("e is not null and not isnan(e)")
    keys = [f"_o{i}" for i in range(len(order))]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = last = None
        n, squares, steps = 0, 0.0, 0.0
        for batch in batches:
            v = batch.column("e").to_numpy()
            if not len(v):
                continue
            steps += float((np.diff(v, prepend=v[0] if last is None else last) ** 2).sum())
            first, last = v[0] if first is None else first, v[-1]
            n, squares = n + len(v), squares + float(v @ v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (TaskContext.get().partitionId(), n, float(first), float(last), squares, steps)], names=["part", "n", "first", "last", "squares", "steps"])

    parts = parts or max(8, x.rdd.getNumPartitions())
    rows = x.repartitionByRange(parts, *keys, "e").sortWithinPartitions(*keys, "e").select("e").mapInArrow(run, "part long, n long, first double, last double, squares double, steps double").collect()
    rows.sort(key=lambda r: r.part)
    steps = sum(r.steps for r in rows) + sum((b.first - a.last) ** 2 for a, b in zip(rows, rows[1:], strict=False))
    squares, n = sum(r.squares for r in rows), sum(r.n for r in rows)
    return df.sparkSession.createDataFrame([(n, steps / squares if squares else None)], "n long, durbin_watson double")


def ols_summary(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row on a least-squares fit: r2, F, log likelihood, AIC, BIC, and Jarque-Bera of its residuals."""
    n, _, s, w, b = _solve(df, features, target)
    p = len(features)
    tss, rss = s[p, p], s[p, p] - w @ s[:p, p]
    r2 = 1 - rss / tss
    f = (r2 / p) / ((1 - r2) / (n - p - 1))
    like = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    shape = _residuals(df, features, target, w, b).agg(F.skewness("_e"), F.kurtosis("_e")).first()
    jb = n / 6 * (shape[0] ** 2 + shape[1] ** 2 / 4)
    row = (int(n), float(r2), float(1 - (1 - r2) * (n - 1) / (n - p - 1)), float(f), float(special.f_upper(f, p, n - p - 1)), float(like), float(2 * (p + 1) - 2 * like), float(math.log(n) * (p + 1) - 2 * like), float(jb), float(math.exp(-jb / 2)))
    return df.sparkSession.createDataFrame([row], "n long, r2 double, adjusted_r2 double, f double, f_p double, log_likelihood double, aic double, bic double, jarque_bera double, jarque_bera_p double")


def ols_inference(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(term, coefficient, se, t, p, low, high, r2, n) of least squares, from one Gram pass."""
    n, mean, s, w, b = _solve(df, features, target)
    p = len(features)
    rss = s[p, p] - w @ s[:p, p]
    s2 = rss / (n - p - 1)
    inv = np.linalg.inv(s[:p, :p])
    se = [math.sqrt(s2 * (1 / n + mean[:p] @ inv @ mean[:p])), *np.sqrt(s2 * np.diag(inv))]
    q = special.t_quantile(0.975, n - p - 1)
    rows = []
    for term, c, e in zip(["intercept", *features], [b, *w], se, strict=True):
        rows.append((term, float(c), float(e), float(c / e), float(special.t_two_sided(c / e, n - p - 1)), float(c - q * e), float(c + q * e), float(1 - rss / s[p, p]), int(n)))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, se double, t double, p double, low double, high double, r2 double, n long")


def fit_ridge_classifier(df, features, target, alpha=1.0):
    """One least-squares fit to +1 and -1 for each class; the greatest wins."""
    classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]  # one row a class
    parts = []
    for c in classes:
        x = df.withColumn("_y", F.when(F.col(target) == c, 1.0).otherwise(-1.0))
        _, _, _, w, b = _solve(x, features, "_y", alpha)
        parts.append((c, w, b))
    score = lambda w, b: sum((clean(f) * float(a) for f, a in zip(features, w, strict=True)), F.lit(float(b)))
    return lambda x: x.withColumn("prediction", F.array_max(F.array(*[F.struct(score(w, b).alias("s"), F.lit(c).alias("c")) for c, w, b in parts]))["c"])


def fit_discriminant(df, features, target, quadratic=False):
    """Class means and covariances (pooled unless quadratic) as a score of each class."""
    got = gram_by(df, features, target)
    total, p = sum(n for _, n, _, _ in got), len(features)
    pooled = sum(s for *_, s in got) / (total - len(got))
    parts = []
    for c, n, m, s in got:
        cov = (s / (n - 1) if quadratic else pooled) + 1e-9 * np.eye(p)
        parts.append((c, m, np.linalg.inv(cov), math.log(n / total) - 0.5 * np.linalg.slogdet(cov)[1]))

    def score(m, inv, k):
        d = [clean(f) - float(x) for f, x in zip(features, m, strict=True)]
        return F.lit(float(k)) - 0.5 * sum((d[i] * d[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))

    return lambda x: x.withColumn("prediction", F.array_max(F.array(*[F.struct(score(m, i, k).alias("s"), F.lit(c).alias("c")) for c, m, i, k in parts]))["c"])


def fit_polynomial(df, features, target, degree=2, alpha=1e-6):
    from tesserae.operators.preprocess import fit_transform

    def make(x):
        return fit_transform("polynomial_features", x, features, degree=degree)

    full = make(df.select(*features, target))
    cols = [c for c in full.columns if c != target]
    wide = full.toDF(*[f"_p{i}" if c != target else target for i, c in enumerate(full.columns)])
    names = [f"_p{i}" for i, c in enumerate(full.columns) if c != target]
    _, _, _, w, b = _solve(wide, names, target, alpha)
    terms = dict(zip(cols, w, strict=True))

    def predict(x):
        value = F.lit(float(b))
        for c, a in terms.items():
            prod = F.lit(float(a))
            for part in c.split("*"):
                prod = prod * clean(part)
            value = value + prod
        return x.withColumn("prediction", value)

    return predict


def baseline_dummy(df, features, target, classify=False):
    value = df.agg(F.mode(target, True) if classify else F.avg(target)).first()[0]
    return lambda x: x.withColumn("prediction", F.lit(value))


def _classes(df: DataFrame, target: str) -> int:
    """Labels are 0 to this number less one."""
    return int(df.agg(F.max(F.col(target).cast("int"))).first()[0] or 0) + 1


def _argmax(scores):
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def fit_adaboost(df, features, target, rounds=10, depth=2):
    """Trees on reweighted rows, voting by their accuracy (SAMME); weights are a projection of the trees so far."""
    k = max(2, _classes(df, target))
    x = vectors(grouped(df, features, target), features).withColumn("_w", F.col(TIMES))
    trees = []
    for _ in range(rounds):
        m = C.DecisionTreeClassifier(labelCol=target, weightCol="_w", maxDepth=depth, seed=1).fit(x)
        got = m.transform(x)
        miss = (F.col("prediction") != F.col(target)).cast("double")
        err = got.agg(F.sum(F.col("_w") * miss) / F.sum("_w")).first()[0]
        if err is None or not 0 < err < 1 - 1 / k:
            if not trees:
                trees.append((m, 1.0))  # a perfect first tree, or one no better than chance
            break
        a = math.log((1 - err) / err) + math.log(k - 1)
        trees.append((m, a))
        x = written(got.withColumn("_w", F.col("_w") * F.exp(a * (miss - 0.5))).drop("prediction", "probability", "rawPrediction"))

    def predict(y):
        y = vectors(y, features)
        for t, (m, _) in enumerate(trees):  # a tree's class alone; no vectors of votes and shares beside it
            y = m.copy().setPredictionCol(f"_p{t}").setRawPredictionCol("").setProbabilityCol("").transform(y)
        own = [F.col(f"_p{t}") for t in range(len(trees))]
        votes = [sum((F.when(p == c, a).otherwise(0.0) for p, (_, a) in zip(own, trees, strict=True)), F.lit(0.0)) for c in range(k)]
        return y.withColumn("prediction", _argmax(F.array(*votes))).drop("features", *[f"_p{t}" for t in range(len(trees))])

    return predict


def fit_adaboost_regression(df, features, target, rounds=10, depth=3):
    """AdaBoost.R2 with linear loss: rows with large errors gain weight; the answer is the median of the trees, weighted by log(1 / beta)."""
    x = df.where(F.col(target).isNotNull()).groupBy(*dict.fromkeys([*features, target])).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    x = written(x.withColumn(target, F.col(target).cast("double")))
    trees = []
    for _ in range(rounds):
        # a tree of squared errors needs the weights and weighted means of different features only
        mean = x.groupBy(*features).agg(F.sum("_w").alias(TIMES), (F.sum(F.col("_w") * F.col(target)) / F.sum("_w")).alias("_y"))
        m = R.DecisionTreeRegressor(labelCol="_y", weightCol=TIMES, maxDepth=depth, seed=1).fit(vectors(written(mean), features))
        got = m.transform(vectors(x, features)).drop("features").withColumn("_a", F.abs(F.col("prediction") - F.col(target)))
        most, loss = got.agg(F.max("_a"), F.sum(F.col("_w") * F.col("_a")) / F.sum("_w")).first()
        loss = loss / most if most else 0.0
        if not 0 < loss < 0.5:
            if not trees or loss == 0:
                trees.append((m, 1.0 if loss else 50.0))
            break
        beta = loss / (1 - loss)
        trees.append((m, math.log(1 / beta)))
        x = written(got.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_a") / most)).drop("prediction", "_a"))

    def predict(y):
        y = vectors(y, features).withColumn("_v", F.array().cast("array<struct<p: double, w: double>>"))
        for m, w in trees:
            y = m.transform(y).withColumn("_v", F.array_append("_v", F.struct(F.col("prediction").alias("p"), F.lit(w).alias("w")))).drop("prediction")
        half = sum(w for _, w in trees) / 2
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))

        def step(s, e):
            total = s["w"] + e["w"]
            return F.struct(total.alias("w"), F.when(s["p"].isNotNull(), s["p"]).when(total >= half - 1e-12, e["p"]).alias("p"))

        return y.withColumn("prediction", F.aggregate(F.array_sort("_v"), start, step)["p"]).drop("_v", "features")

    return predict


def fit_average(names: list[str], classify: bool = False):
    """The mean of several models (voting); classify: of their class probabilities, the greatest of which decides."""

    def run(df, features, target, **options):
        models = [fit(n, df, features, target) for n in names]

        def predict(x):
            x = x.withColumn("_m", F.lit(None).cast("array<double>") if classify else F.lit(0.0))
            for m in models:
                x = m(x)
                own = vector_to_array("probability") if classify else F.col("prediction")
                both = F.when(F.col("_m").isNull(), own).otherwise(F.zip_with("_m", own, lambda a, b: a + b)) if classify else F.col("_m") + own / len(models)
                x = x.withColumn("_m", both).drop("prediction", "probability")
            if not classify:
                return x.withColumnRenamed("_m", "prediction")
            return x.withColumn("probability", F.transform("_m", lambda v: v / len(models))).withColumn("prediction", _argmax(F.col("_m"))).drop("_m")

        return predict

    return run


def fit_bagging(df, features, target, members=5, key=None, classes=False):
    """Trees on hashed Poisson weights; their mean, or (classes) the class with the greatest mean probability."""
    x = vectors(df, features)
    kind = C.DecisionTreeClassifier if classes else R.DecisionTreeRegressor
    models = []
    for i in range(members):
        u = F.pmod(F.xxhash64(*[F.col(c) for c in (key or features)], F.lit(i)), F.lit(10**6)) / 1e6
        weight = sum((F.when(u > t, 1.0).otherwise(0.0) for t in (0.3679, 0.7358, 0.9197, 0.981)), F.lit(0.0))  # Poisson(1) by its distribution
        models.append(kind(labelCol=target, weightCol="_w", seed=1).fit(x.withColumn("_w", weight).where("_w > 0")))
    k = _classes(df, target) if classes else 0

    def predict(y):
        y = vectors(y, features).withColumn("_m", F.array_repeat(F.lit(0.0), k) if classes else F.lit(0.0))
        for m in models:
            y = m.transform(y)
            # a member that has not seen the last classes has a shorter vector
            more = F.zip_with("_m", vector_to_array("probability"), lambda a, b: a + F.coalesce(b, F.lit(0.0)) / len(models)) if classes else F.col("_m") + F.col("prediction") / len(models)
            y = y.withColumn("_m", more).drop("prediction", "probability", "rawPrediction")
        if classes:
            return y.withColumn("prediction", _argmax(F.col("_m"))).withColumnRenamed("_m", "probability").drop("features")
        return y.drop("features").withColumnRenamed("_m", "prediction")

    return predict


def fold_of(key: list[str], k: int):
    return F.pmod(F.xxhash64(*key), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, key: list[str], by: str, k: int = 5, repeat: int = 0) -> DataFrame:
    """df with fold from 0 to k - 1, each with its share of every level of `by`, to a row: levels are ranked by a hash of the key.

    The ranks are counted in ranges of the hash, so a level that holds a third of all rows is no task of its own. repeat: another deal.
    """
    h = F.xxhash64(*key, F.lit(f"folds {repeat}"))
    x = df.withColumns({"_h": h, "_r": F.shiftrightunsigned(h, 52)})  # 4096 ranges
    part = x.groupBy(by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy("_r")  # over 4096 rows a level
    part = part.select(F.col(by).alias("_b"), F.col("_r").alias("_q"), (F.sum("_n").over(w) - F.col("_n")).alias("_o"))
    own = Window.partitionBy(by, "_r").orderBy("_h", *key)
    x = x.withColumn("_i", F.row_number().over(own) - 1)
    x = x.join(part, F.col(by).eqNullSafe(F.col("_b")) & (F.col("_r") == F.col("_q")))
    return x.withColumn("fold", ((F.col("_o") + F.col("_i")) % k).cast("int")).drop("_h", "_r", "_i", "_o", "_b", "_q")


def time_folds(df: DataFrame, t: str, k: int = 5) -> DataFrame:
    """df with fold from 0 to k by equal shares of the times; a model for fold i is fitted on the folds before it (0: on none)."""
    micros = F.unix_micros(F.col(t).cast("timestamp")).cast("double")
    cut = quantiles(df.select(micros.alias("t")), ["t"], [i / (k + 1) for i in range(1, k + 1)])["t"] or []
    return df.withColumn("fold", sum(((micros > F.lit(c)).cast("int") for c in cut), F.lit(0)))


def time_holdout(df: DataFrame, t: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The rows up to the time that leaves `share` of them behind it, and those."""
    micros = F.unix_micros(F.col(t).cast("timestamp")).cast("double")
    cut = (quantiles(df.select(micros.alias("t")), ["t"], [1 - share])["t"] or [0.0])[0]
    return df.where(micros <= cut), df.where(micros > cut)


def stratified_holdout(df: DataFrame, key: list[str], by: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """A held-out share of every level of `by`, to a row."""
    k = max(2, round(1 / share))
    x = stratified_folds(df, key, by, k)
    return x.where("fold > 0").drop("fold"), x.where("fold = 0").drop("fold")


def cross_validate(df, name, features, target, key: list[str], k: int = 5, stratify: str | None = None, time: str | None = None, **options) -> DataFrame:
    """Out-of-fold predictions: (key, fold, actual, prediction). stratify: folds with equal shares of its levels; time: folds that follow what they are fitted on."""
    if time:
        x, out = time_folds(df, time, k), None
        for i in range(1, k + 1):
            m = fit(name, x.where(F.col("fold") < i), features, target, **options)
            part = m(x.where(F.col("fold") == i)).select(*key, "fold", F.col(target).alias("actual"), "prediction")
            out = part if out is None else out.unionAll(part)
        return out
    x = stratified_folds(df, key, stratify, k) if stratify else df.withColumn("fold", fold_of(key, k))
    return by_fold(fold_table(x, features, target, key, options), name, features, target, key, k, **options)


def fold_table(x: DataFrame, features, target, key, options: dict) -> DataFrame:
    """The columns that fits need, written once, so that no fold reads the source again."""
    named = [v for o in options.values() for v in (o if isinstance(o, list) else [o]) if isinstance(v, str) and v in x.columns]
    return written(x.select(*dict.fromkeys([*key, *features, target, *named, "fold"])))


def by_fold(x: DataFrame, name, features, target, key, k: int, scores: bool = False, **options) -> DataFrame:
    """(key, fold, actual, prediction): each fold by a model of the others. scores: class probabilities, as an array, beside them."""
    out = None
    for i in range(k):
        m = fit(name, x.where(F.col("fold") != i), features, target, **options)
        got = m(x.where(F.col("fold") == i))
        part = got.select(*key, "fold", F.col(target).alias("actual"), "prediction", *([vector_to_array("probability").alias("probability")] if scores else []))
        out = part if out is None else out.unionAll(part)
    return out


def train_holdout(df, key: list[str], share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    u = F.pmod(F.xxhash64(*key, F.lit("holdout")), F.lit(1000))
    return df.where(u >= int(1000 * share)), df.where(u < int(1000 * share))


def fit_stacking(names: list[str], classify: bool = False, folds: int = 5):
    """A model of other models' out-of-fold predictions (classify: class probabilities, joined by logistic regression)."""

    def run(df, features, target, key=None, **options):
        x = fold_table(df.withColumn("fold", fold_of(key, folds)), features, target, key, {})
        k = _classes(df, target) if classify else 0
        own = [[f"_s{i}_{c}" for c in range(1, k)] if classify else [f"_s{i}"] for i in range(len(names))]

        def spread(y, i, score):
            return y.withColumns({c: F.coalesce(F.try_element_at(score, F.lit(j + 2)), F.lit(0.0)) if classify else score for j, c in enumerate(own[i])})

        cols = [c for o in own for c in o]
        meta_rows = None
        for f in range(folds):
            part = x.where(F.col("fold") == f)  # gets the columns of all models in one go, so that no rows are joined
            for i, n in enumerate(names):
                part = fit(n, x.where(F.col("fold") != f), features, target)(part)
                part = spread(part, i, vector_to_array("probability") if classify else F.col("prediction")).drop("prediction", "probability")
            part = part.select(target, *cols)
            meta_rows = part if meta_rows is None else meta_rows.unionAll(part)
        meta = fit("logistic" if classify else "linear_regression", written(meta_rows), cols, target)
        models = [fit(n, df, features, target) for n in names]

        def predict(y):
            for i, m in enumerate(models):
                y = m(y)
                y = spread(y, i, vector_to_array("probability") if classify else F.col("prediction")).drop("prediction", "probability")
            return meta(y).drop(*cols)

        return predict

    return run


def fit_knn(df, features, target, k=5, classes=False):
    """Mean (classes: most frequent value) of the k nearest training rows; ties in distance go to the lesser target."""

    def predict(x):
        got = with_nearest(x, df, features, target, k)
        return got.withColumn("prediction", (mode_of if classes else mean_of)(F.col("near"))).drop("near")

    return predict


for _n, _fit in (("gram_ridge", fit_gram_ridge), ("ridge", lambda df, features, target, alpha=1.0: fit_gram_ridge(df, features, target, alpha)), ("bayesian_ridge", fit_bayesian_ridge), ("pls", fit_pls), ("quantile_regression", fit_quantile_regression), ("ridge_classifier", fit_ridge_classifier), ("discriminant", fit_discriminant), ("polynomial", fit_polynomial), ("baseline_dummy", baseline_dummy), ("adaboost", fit_adaboost), ("bagging", fit_bagging), ("knn", fit_knn), ("voting", fit_average(["ridge", "random_forest_regression", "gbt_regression"])), ("stacking", fit_stacking(["ridge", "decision_tree_regression"])), ("adaboost_regression", fit_adaboost_regression), ("bagging_classes", lambda *a, **o: fit_bagging(*a, classes=True, **o)), ("voting_classes", fit_average(["logistic", "decision_tree", "naive_bayes"], classify=True)), ("stacking_classes", fit_stacking(["logistic", "decision_tree"], classify=True))):
    register_model(_n, _fit)


# ---------------------------------------------------------------- mixtures, projections, anomalies


def median_items(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers as items for latent_class: 1 above the median, 0 up to it."""
    q = quantiles(df, cols, [0.5])
    return df.withColumns({c: (clean(c) > F.lit(q[c][0] if q[c] else None)).cast("int") for c in cols})


#: Rounds of expectation and maximisation at most, starts of each, and the relative gain below which one ends.
EM_ROUNDS, EM_STARTS, EM_GAIN = 100, 5, 1e-9


def answer_patterns(df: DataFrame, items: list[str]) -> DataFrame:
    """(x, n): the different answers (0 or 1 to each item) of complete rows and how many rows give them, as a written table."""
    x = df.select(*[F.col(c).cast("tinyint").alias(f"i{k}") for k, c in enumerate(items)]).dropna()
    keys = [f"i{k}" for k in range(len(items))]
    return written(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.array(*keys).alias("x"), "n"))


def responsibilities(x: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of answers its log-likelihood and its share in each class."""
    logp = np.log(np.maximum(prior, 1e-300)) + x @ np.log(rate).T + (1 - x) @ np.log(1 - rate).T
    top = logp.max(axis=1, keepdims=True)
    r = np.exp(logp - top)
    total = r.sum(axis=1, keepdims=True)
    return (top + np.log(total))[:, 0], r / total


def _em(patterns: DataFrame, starts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log-likelihood, shares, item rates) that each start (shares, rates) leads to.

    One job a round serves all starts: every task adds up the responsibilities of its patterns, and only
    these sums, a number for each class and item, reach the driver.
    """
    done: dict[int, tuple] = {}
    now, last = dict(enumerate(starts)), {i: -math.inf for i in range(len(starts))}
    for _ in range(EM_ROUNDS):
        held = dict(now)

        def sums(batches, held=held):
            import pyarrow as pa

            total: dict[int, list] = {i: [0.0, np.zeros(p.shape), np.zeros(r.shape)] for i, (p, r) in held.items()}
            for batch in batches:
                n = batch.column("n").to_numpy().astype(float)
                if len(n):
                    x = batch.column("x").flatten().to_numpy().reshape(len(n), -1).astype(float)
                    for i, (p, r) in held.items():
                        like, share = responsibilities(x, p, r)
                        own, share = total[i], share * n[:, None]
                        own[0] += float(n @ like)
                        own[1] += share.sum(axis=0)
                        own[2] += share.T @ x
            rows = [(i, like, p.tolist(), r.ravel().tolist()) for i, (like, p, r) in total.items()]
            kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["i", "like", "prior", "rate"])

        got: dict[int, list] = {}
        for row in patterns.mapInArrow(sums, "i int, like double, prior array<double>, rate array<double>").collect():  # a row for each task and start
            k = len(row.prior)
            own = got.setdefault(row.i, [0.0, np.zeros(k), np.zeros((k, len(row.rate) // k))])
            own[0] += row.like
            own[1] += np.array(row.prior)
            own[2] += np.array(row.rate).reshape(k, -1)
        for i, (like, p, r) in got.items():
            done[i] = (like, *now[i])
            if like - last[i] <= EM_GAIN * abs(like):
                del now[i]
            else:
                last[i] = like
                now[i] = (p / p.sum(), np.clip(r / np.maximum(p, 1e-300)[:, None], 1e-6, 1 - 1e-6))
        if not now:
            break
    return [done[i] for i in range(len(starts))]


def _latent_classes(patterns: DataFrame, items: int, ks: list[int], seed: int = 1) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each number of classes the best of several starts, classes in order of their shares."""
    starts, of = [], []
    for k in ks:
        rng = np.random.default_rng(seed)
        for _ in range(EM_STARTS if k > 1 else 1):
            starts.append((np.full(k, 1 / k), rng.uniform(0.25, 0.75, (k, items))))
            of.append(k)
    best: dict[int, tuple] = {}
    for k, got in zip(of, _em(patterns, starts), strict=True):
        if k not in best or got[0] > best[k][0]:
            order = np.argsort(-got[1])
            best[k] = (got[0], got[1][order], got[2][order])
    return best


def latent_class(df: DataFrame, items: list[str], k: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shares and item rates of a Bernoulli mixture, by EM over the answer patterns of any number of items."""
    return _latent_classes(answer_patterns(df, items), len(items), [k], seed)[k][1:]


def latent_class_sweep(df: DataFrame, items: list[str], most: int = 4) -> DataFrame:
    """(k, log_likelihood, parameters, aic, bic, chosen) for 1 to most classes, all fitted together; the least BIC is chosen."""
    patterns = answer_patterns(df, items)
    n, rows = patterns.agg(F.sum("n")).first()[0], []
    for k, (like, _, _) in _latent_classes(patterns, len(items), list(range(1, most + 1))).items():
        free = k - 1 + k * len(items)
        rows.append((k, like, free, 2 * free - 2 * like, float(np.log(n) * free - 2 * like)))
    best = min(rows, key=lambda r: r[4])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, log_likelihood double, parameters int, aic double, bic double, chosen boolean")


def latent_class_members(df: DataFrame, items: list[str], prior: np.ndarray, rate: np.ndarray) -> DataFrame:
    """df with membership (a probability for each class) and class; null where an item is missing."""
    # each step is a column of its own: written out in one another, they would be worked out anew wherever they occur
    k = range(len(prior))
    x = df.withColumns({f"_i{j}": F.col(c).cast("int") for j, c in enumerate(items)})
    like = {}
    for i, p, r in zip(k, prior.tolist(), rate.tolist(), strict=True):
        like[f"_l{i}"] = sum((F.when(F.col(f"_i{j}") == 1, math.log(a)).when(F.col(f"_i{j}") == 0, math.log(1 - a)) for j, a in enumerate(r)), F.lit(math.log(max(p, 1e-300))))
    top = F.greatest(*like) if len(like) > 1 else F.col("_l0")
    x = x.withColumns(like).withColumn("_top", top).withColumns({f"_s{i}": F.exp(F.col(f"_l{i}") - F.col("_top")) for i in k})
    x = x.withColumn("_total", sum((F.col(f"_s{i}") for i in k), F.lit(0.0)))
    there = sum((F.col(c).isNull().cast("int") for c in items), F.lit(0)) == 0
    x = x.withColumn("membership", F.when(there, F.array(*[F.col(f"_s{i}") / F.col("_total") for i in k])))
    x = x.drop("_top", "_total", *like, *[f"_s{i}" for i in k], *[f"_i{j}" for j in range(len(items))])
    return x.withColumn("class", (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))


def fuzzy_members(df: DataFrame, features: list[str], centres: np.ndarray, m: float = 2.0) -> DataFrame:
    """df with membership (a share for each centre, summing to 1) and cluster, for centres of fuzzy_cmeans."""
    d = [sum(((clean(c) - float(v)) ** 2 for c, v in zip(features, row, strict=True)), F.lit(1e-12)) for row in centres]
    inv = [F.pow(v, F.lit(-1 / (m - 1))) for v in d]
    total = sum(inv, F.lit(0.0))
    got = df.withColumn("membership", F.array(*[v / total for v in inv]))
    return got.withColumn("cluster", (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))


def partition_coefficient(members: DataFrame) -> DataFrame:
    """Mean of the squared memberships: 1 where every row belongs to one cluster, 1 / k where none does."""
    return members.agg(F.avg(F.aggregate("membership", F.lit(0.0), lambda a, v: a + v * v)).alias("partition_coefficient"))


def gmm_sweep(df: DataFrame, features: list[str], most: int = 4) -> DataFrame:
    """(k, log_likelihood, bic, chosen) of Gaussian mixtures with 1 to most components; one is a plain normal, in closed form."""
    x, p = complete(df, features), len(features)
    rows = []
    n, _, s = gram(df, features)
    for k in range(1, most + 1):
        if k == 1:
            like = float(-n / 2 * (p * math.log(2 * math.pi) + np.linalg.slogdet(s / n)[1] + p))
        else:
            like = gaussian_mixture(x, features, k).log_likelihood
        free = k - 1 + k * p + k * p * (p + 1) // 2
        rows.append((k, like, math.log(n) * free - 2 * like))
    best = min(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, log_likelihood double, bic double, chosen boolean")


def fuzzy_cmeans(df: DataFrame, features: list[str], k: int = 3, m: float = 2.0, rounds: int = 15) -> np.ndarray:
    """Centres by alternating a projection (memberships) and one weighted aggregate."""
    x = df.select(*[clean(c).alias(c) for c in features]).dropna()
    q = quantiles(x, features, [(i + 0.5) / k for i in range(k)])
    centres = np.array([[q[c][i] for c in features] for i in range(k)])
    for _ in range(rounds):
        d = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(features, row, strict=True)), F.lit(1e-12)) for row in centres]
        inv = [F.pow(v, F.lit(-1 / (m - 1))) for v in d]
        total = sum(inv, F.lit(0.0))
        u = [F.pow(v / total, F.lit(m)) for v in inv]
        row = x.agg(*[F.sum(w * F.col(c)) / F.sum(w) for w in u for c in features]).first()
        new = np.array(row, dtype=float).reshape(k, -1)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-6:
            break
    return centres


def power_iteration(edges: DataFrame, k: int = 3) -> DataFrame:
    """(id, cluster) from (src, dst, weight)."""
    return K.PowerIterationClustering(k=k, maxIter=15, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges)


def principal_components(df: DataFrame, features: list[str], centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shares of variance, loadings by row), from one Gram pass."""
    n, mean, s = gram(df, features)
    if not centred:
        s = s + n * np.outer(mean, mean)
    values, vec = np.linalg.eigh(s)
    values, vec = values[::-1], vec[:, ::-1]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(len(features))])
    return values / values.sum(), vec.T


def factor_analysis(df: DataFrame, features: list[str], k: int = 1, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, noise) by EM on the covariance."""
    n, _, s = gram(df, features)
    s = s / n
    values, vec = np.linalg.eigh(s)
    load, noise = vec[:, -k:] * np.sqrt(values[-k:]), np.diag(s).copy() / 2
    for _ in range(rounds):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(noise))
        e = np.eye(k) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(e)
        noise = np.maximum(np.diag(s - load @ beta @ s), 1e-9)
    return load, noise


def lda_projection(df: DataFrame, features: list[str], target: str, k: int = 1) -> np.ndarray:
    _, mean, total = gram(df, features)
    within = sum((s for *_, s in gram_by(df, features, target)), np.zeros_like(total))
    values, vec = np.linalg.eig(np.linalg.solve(within + 1e-9 * np.eye(len(features)), total - within))
    return np.real(vec[:, np.argsort(-np.real(values))[:k]]).T


def nmf(entries: DataFrame, rank: int = 3) -> DataFrame:
    """Non-negative factors of a long table (row, column, value): (id, features) of the rows."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, nonnegative=True, userCol="row", itemCol="column", ratingCol="value", seed=1, maxIter=5).fit(entries).userFactors


def anomaly_zscore(df: DataFrame, features: list[str], limit: float = 3.0) -> DataFrame:
    row = df.agg(*[f(clean(c)).alias(f"{c}|{n}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    z = F.greatest(*[F.abs((clean(c) - row[f"{c}|m"]) / (row[f"{c}|s"] or 1.0)) for c in features], F.lit(0.0))
    return df.withColumn("score", z).withColumn("anomaly", z > limit)


def anomaly_iqr(df: DataFrame, features: list[str], k: float = 1.5) -> DataFrame:
    """score: the greatest excess over the quartiles in units of the range between them."""
    q = quantiles(df, features, [0.25, 0.75])
    over = [F.greatest((q[c][0] - clean(c)) / ((q[c][1] - q[c][0]) or 1.0), (clean(c) - q[c][1]) / ((q[c][1] - q[c][0]) or 1.0)) for c in features]
    worst = F.greatest(*over, F.lit(0.0))
    return df.withColumn("score", worst).withColumn("anomaly", worst > k)


def anomaly_mahalanobis(df: DataFrame, features: list[str], share: float = 0.01, rounds: int = 2) -> DataFrame:
    """Distances by mean and covariance, refitted on the nearer rows; the farthest share is flagged."""
    x = df
    for i in range(rounds + 1):
        n, mean, s = gram(x, features)
        inv = np.linalg.inv(s / (n - 1) + 1e-9 * np.eye(len(features)))
        d = [clean(c) - float(m) for c, m in zip(features, mean, strict=True)]
        dist = sum((d[a] * d[b] * float(inv[a, b]) for a in range(len(features)) for b in range(len(features))), F.lit(0.0))
        if i < rounds:
            x = df.where(dist <= quantiles(df.select(dist.alias("d")), ["d"], [0.75])["d"][0])
    cut = quantiles(df.select(dist.alias("d")), ["d"], [1 - share])["d"][0]
    return df.withColumn("score", dist).withColumn("anomaly", dist > cut)


def sample_limit(n: int, sample: int) -> int:
    """The greatest 64-bit hash that about twice sample of n rows do not exceed."""
    return min(2**63 - 1, 2**64 * 2 * sample // max(1, n) - 2**63)


def isolation_forest(df: DataFrame, features: list[str], trees: int = 50, sample: int = 256, key: list[str] | None = None) -> DataFrame:
    """Each tree on the rows with its least hashes (one group a tree), path lengths by Arrow batches on all rows."""
    n = df.count()
    own = lambda t: F.xxhash64(*(key or features), t)
    ids = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: own(t) <= F.lit(sample_limit(n, sample)))  # a row is copied only for the trees it is in
    part = df.select(*[clean(c).alias(c) for c in features], *[c for c in key or [] if c not in features]).withColumn("_t", F.explode(ids)).withColumn("_h", own(F.col("_t")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_t"].iloc[0])
        x = pdf.sort_values(["_h", *features])[features].dropna().to_numpy()[:sample]
        rng, rows = np.random.default_rng(tree), []

        def grow(members, depth, at):
            x0 = x[members]
            low, high = (x0.min(axis=0), x0.max(axis=0)) if len(members) else (np.zeros(len(features)),) * 2
            if len(members) <= 1 or depth >= 8 or (low == high).all():
                rows.append((tree, at, -1, 0.0, float(len(members))))
                return
            f = int(rng.choice(np.flatnonzero(low < high)))
            cut = float(rng.uniform(low[f], high[f]))
            rows.append((tree, at, f, cut, float(len(members))))
            grow(members[x0[:, f] < cut], depth + 1, 2 * at + 1)
            grow(members[x0[:, f] >= cut], depth + 1, 2 * at + 2)

        grow(np.arange(len(x)), 0, 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "size"])

    nodes = part.groupBy("_t").applyInPandas(build, "tree int, node int, feature int, cut double, size double").toPandas()  # trees * 511 rows at most
    table = np.zeros((trees, 1023, 3))
    table[:, :, 0] = -1
    table[nodes["tree"], nodes["node"]] = nodes[["feature", "cut", "size"]].to_numpy()

    def norm(size):
        return np.where(size > 2, 2 * (np.log(np.maximum(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        x = cols.to_numpy()
        total = np.zeros(len(x))
        for t in range(trees):
            at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
            for _ in range(9):
                f = table[t, at, 0].astype(int)
                go = f >= 0
                left = x[np.arange(len(x)), np.maximum(f, 0)] < table[t, at, 1]
                at = np.where(go, 2 * at + np.where(left, 1, 2), at)
                depth += go
            total += depth + norm(table[t, at, 2])
        return pd.Series(2 ** (-total / trees / float(norm(np.array(float(sample))))))

    return df.withColumn("score", score(F.struct(*[clean(c).alias(c) for c in features])))


def anomaly_reasons(df: DataFrame, flagged: DataFrame, key: list[str], features: list[str], most: int = 200) -> DataFrame:
    """For the worst flagged rows up to three features at least 1.5 deviations off, in words."""
    row = df.agg(*[f(clean(c)).alias(f"{c}|{n}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    top = flagged.orderBy(F.desc("score"), *key).limit(most)
    z = F.array(*[F.struct(((clean(c) - row[f"{c}|m"]) / (row[f"{c}|s"] or 1.0)).alias("z"), F.lit(c).alias("f")) for c in features])
    far = F.slice(F.array_sort(F.filter(z, lambda x: F.abs(x["z"]) >= 1.5), lambda a, b: F.signum(F.abs(b["z"]) - F.abs(a["z"])).cast("int")), 1, 3)
    words = F.transform(far, lambda x: F.concat(x["f"], F.when(x["z"] > 0, F.lit(" high")).otherwise(F.lit(" low"))))
    return top.select(*key, F.array_join(words, ", ").alias("reasons"))
