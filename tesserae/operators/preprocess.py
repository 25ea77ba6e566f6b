"""Preprocessing steps: fit (one aggregate, a few numbers) and transform (a projection).

A fitted step is a dict of what it learned; register_step adds a step. A pipeline fits its steps in
order, each on what the ones before it return.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scalar
from tesserae.functions.scalar import clean
from tesserae.operators import rows as R
from tesserae.operators.kernels import gram, gram_by, group_quantiles, long_form, places, quantiles, safe_corr, value_counts
from tesserae.operators.neighbours import mean_of, with_nearest
from tesserae.sources.written import written

STEPS: dict[str, tuple[Callable, Callable]] = {}


def register_step(name: str, fit: Callable, transform: Callable) -> None:
    STEPS[name] = (fit, transform)


def step(name: str):
    """Decorator on a function that returns (fit, transform)."""

    def add(make):
        register_step(name, *make())
        return make

    return add


def fit(name: str, df: DataFrame, cols: list[str] | None = None, **options) -> dict:
    return {"step": name, "cols": cols, "options": options, "learned": STEPS[name][0](df, cols, **options)}


def transform(df: DataFrame, fitted: dict) -> DataFrame:
    return STEPS[fitted["step"]][1](df, fitted["cols"], fitted["learned"], **fitted["options"])


def fit_transform(name: str, df: DataFrame, cols: list[str] | None = None, **options) -> DataFrame:
    return transform(df, fit(name, df, cols, **options))


def pipeline_apply(df: DataFrame, steps: list[tuple]) -> tuple[DataFrame, list[dict]]:
    """Fit all steps on df in order; the cleaned table and what each step learned."""
    fitted = []
    for name, cols, *options in steps:
        fitted.append(fit(name, df, cols, **(options[0] if options else {})))
        df = transform(df, fitted[-1])
    return df, fitted


#: What the simple steps learn: {step: {name: aggregate of a column}}.
SIMPLE: dict[str, dict] = {}


def fold_aggregates(df: DataFrame, cols: list[str], fold: str, what: dict) -> dict:
    """{fold: what _aggregates would learn from all other folds}: one grouped pass, then each fold's share is left out of the total."""
    asked = {n: f for n, f in what.items() if n not in ("mean", "std")}
    parts = [f(c).alias(f"{c}|{n}") for c in cols for n, f in asked.items()]
    parts += [F.struct(F.count(clean(c)), F.avg(clean(c)), F.var_pop(clean(c))).alias(f"{c}|moments") for c in cols]
    rows = {r[fold]: r for r in df.groupBy(fold).agg(*parts).collect()}  # one row a fold
    out = {}
    for i in rows:
        others = [r for j, r in rows.items() if j != i]
        out[i] = {}
        for c in cols:
            known = {n: [r[f"{c}|{n}"] for r in others if r[f"{c}|{n}"] is not None] for n in asked}
            learned = {n: (min if n == "min" else max)(v) if v else None for n, v in known.items()}
            n, mean, var = (np.array([r[f"{c}|moments"][k] or 0.0 for r in others], dtype=float) for k in range(3))
            total = n.sum()
            m = float((n * mean).sum() / total) if total else None
            learned |= {"mean": m, "std": math.sqrt(float((n * (var + (mean - m) ** 2)).sum() / total)) if total else None}
            out[i][c] = {k: learned[k] for k in what}
    return out


def _fold_simple(df: DataFrame, steps: list[tuple], fold: str, folds: list) -> DataFrame:
    """pipeline_fold_fit of simple steps: a pass for each step and none for each fold."""
    started: set[str] = set()
    for name, cols, *options in steps:
        o, what = options[0] if options else {}, SIMPLE[name]
        fresh = not started & set(cols)
        if fresh:
            learned = fold_aggregates(df, cols, fold, what)
        else:  # earlier steps have made each fold's training rows its own
            own = [f"{c}|{i}" for c in cols for i in range(len(folds))]
            for c in set(cols) - started:
                df = df.withColumns({f"{c}|{i}": F.col(c) for i in range(len(folds))})
            x = df.select(*[F.when(F.col(fold) != f, F.col(f"`{c}|{i}`")).alias(f"{c}_{i}") for c in cols for i, f in enumerate(folds)])
            got = _aggregates(x, [f"{c}_{i}" for c in cols for i in range(len(folds))], **what)
            learned = {f: {c: got[f"{c}_{i}"] for c in cols} for i, f in enumerate(folds)}
        if fresh:
            df = df.withColumns({f"{c}|{i}": F.col(c) for c in cols for i in range(len(folds))})
            own = [f"{c}|{i}" for c in cols for i in range(len(folds))]
        started |= set(cols)
        plain = df.withColumnsRenamed({k: k.replace("|", "__of_") for k in own})
        for i, f in enumerate(folds):
            names = [f"{c}__of_{i}" for c in cols]
            plain = STEPS[name][1](plain, names, {f"{c}__of_{i}": learned[f][c] for c in cols}, **o)
        df = plain.withColumnsRenamed({k.replace("|", "__of_"): k for k in own})
    chosen = {c: F.coalesce(*[F.when(F.col(fold) == f, F.col(f"`{c}|{i}`")) for i, f in enumerate(folds)]) for c in started}
    return df.withColumns(chosen).drop(*[f"{c}|{i}" for c in started for i in range(len(folds))])


def target_encode_folds(df: DataFrame, cols: list[str], target: str, fold: str = "fold", smoothing: float = 10.0) -> DataFrame:
    """target_encode of each fold by the targets of the others: sums by level less the fold's own; a level unseen there gets the mean."""
    y = F.col(target).cast("double")
    whole = df.groupBy(fold).agg(F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s")).collect()  # one row a fold
    n, s = sum(r["n"] for r in whole), sum(r["s"] for r in whole)
    mean = F.create_map(*[v for r in whole if r[fold] is not None for v in (F.lit(r[fold]), F.lit((s - r["s"]) / (n - r["n"]) if n > r["n"] else None).cast("double"))])[F.col(fold)]
    for c in cols:
        own = df.groupBy(F.col(fold).alias("_f"), F.col(c).cast("string").alias("_l")).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
        level = own.groupBy(F.col("_l").alias("_k")).agg(F.sum("n").alias("nn"), F.sum("s").alias("ss"))
        rest = own.join(level, F.col("_l") == F.col("_k")).select("_f", "_l", (F.col("nn") - F.col("n")).alias("_n"), (F.coalesce("ss", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("_s"))
        w = 1 / (1 + F.exp(-(F.col("_n") - 1) / smoothing))
        code = F.when(F.col("_n") > 0, mean * (1 - w) + F.col("_s") / F.col("_n") * w).otherwise(mean)
        df = df.join(rest, (F.col(fold) == F.col("_f")) & (F.col(c).cast("string") == F.col("_l")), "left").withColumn(f"{c}_target", code).drop("_f", "_l", "_n", "_s")
    return df


def pipeline_fold_fit(df: DataFrame, steps: list[tuple], fold: str = "fold") -> DataFrame:
    """Each fold transformed by steps fitted on the other folds only; rows without a fold go.

    Steps that learn aggregates take one pass each, and so does a target encoding of columns that no step
    before it changes; only pipelines with other steps (quantiles, levels) are fitted fold by fold.
    """
    df = df.where(F.col(fold).isNotNull())
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # one row a fold
    head, last = list(steps), None
    if head and head[-1][0] == "target_encode":
        *head, last = head
        changed = {c for _, cols, *_ in head for c in cols}
        if changed & {*last[1], last[2]["target"]}:
            head, last = list(steps), None
    if folds and all(name in SIMPLE and cols for name, cols, *_ in head):
        out = _fold_simple(df, head, fold, folds) if head else df
        return out if last is None else target_encode_folds(out, last[1], fold=fold, **last[2])
    parts = []
    for f in folds:
        train, held = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        for name, cols, *options in steps:
            fitted = fit(name, train, cols, **(options[0] if options else {}))
            train, held = transform(train, fitted), transform(held, fitted)
        parts.append(held)
    return R.union_tables(*parts) if parts else df


def learned_parameters(spark, fitted: list[dict]) -> DataFrame:
    rows = [(i, f["step"], str(k), str(v)) for i, f in enumerate(fitted) for k, v in (f["learned"] or {}).items()]
    return spark.createDataFrame(rows, "position int, step string, parameter string, value string")


def _each(df: DataFrame, cols, value: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({c: value(c) for c in cols})


def _aggregates(df: DataFrame, cols, **what) -> dict:
    """{column: {name: value}} of several aggregates of several columns in one pass."""
    row = df.agg(*[f(c).alias(f"{c}|{n}") for c in cols for n, f in what.items()]).first()
    return {c: {n: row[f"{c}|{n}"] for n in what} for c in cols}


def _simple(name: str, what: dict, value: Callable) -> None:
    """A step that learns aggregates and maps each column by value(column, learned)."""
    if set(what) <= {"mean", "std", "min", "max"}:  # what parts of a table add up to
        SIMPLE[name] = what
    register_step(name, lambda df, cols, **o: _aggregates(df, cols, **what), lambda df, cols, p, **o: _each(df, cols, lambda c: value(c, p[c], **o)))


def _by_quantiles(name: str, probs: list[float], value: Callable) -> None:
    """A step that learns quantiles."""
    register_step(name, lambda df, cols, **o: {c: {"q": q} for c, q in quantiles(df, cols, probs).items()}, lambda df, cols, p, **o: _each(df, cols, lambda c: value(c, p[c], **o)))


_mean, _std = (lambda c: F.avg(clean(c))), (lambda c: F.stddev_pop(clean(c)))
_min, _max = (lambda c: F.min(clean(c))), (lambda c: F.max(clean(c)))

_simple("impute_mean", {"mean": _mean}, lambda c, p: F.coalesce(clean(c), F.lit(p["mean"])))
_by_quantiles("impute_median", [0.5], lambda c, p: F.coalesce(clean(c), F.lit((p["q"] or [None])[0])))
_simple("impute_mode", {"mode": lambda c: F.mode(c, True)}, lambda c, p: F.coalesce(F.col(c), F.lit(p["mode"])))
_simple("standard_scale", {"mean": _mean, "std": _std}, lambda c, p: (clean(c) - p["mean"]) / (p["std"] or 1.0))
_simple("minmax_scale", {"min": _min, "max": _max}, lambda c, p, low=0.0, high=1.0: (clean(c) - p["min"]) / ((p["max"] - p["min"]) or 1.0) * (high - low) + low)
_by_quantiles("robust_scale", [0.25, 0.5, 0.75], lambda c, p: (clean(c) - p["q"][1]) / ((p["q"][2] - p["q"][0]) or 1.0) if p["q"] else clean(c))
_simple("maxabs_scale", {"max": lambda c: F.max(F.abs(clean(c)))}, lambda c, p: clean(c) / (p["max"] or 1.0))
_simple("log_transform", {"min": _min}, lambda c, p: F.log1p(clean(c) + max(0.0, 1e-6 - p["min"])))
register_step(
    "coerce_numeric",
    lambda df, cols: {c: {"q": q} for c, q in quantiles(df.select(*[F.col(c).try_cast("double").alias(c) for c in cols]), cols, [0.5]).items()},
    lambda df, cols, p: _each(df, cols, lambda c: F.coalesce(clean(F.col(c).try_cast("double")), F.lit((p[c]["q"] or [0.0])[0]))),
)


@step("winsorize")
def _():
    def fit(df, cols, low=0.01, high=0.99):
        return quantiles(df, cols, [low, high])

    return fit, lambda df, cols, p, **o: _each(df, cols, lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(clean(c), F.lit(p[c][0])), F.lit(p[c][1]))))


@step("clip_iqr")
def _():
    def fit(df, cols, k=1.5):
        q = quantiles(df, cols, [0.25, 0.75])
        return {c: [a - k * (b - a), b + k * (b - a)] for c, (a, b) in q.items()}

    return fit, lambda df, cols, p, **o: _each(df, cols, lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(clean(c), F.lit(p[c][0])), F.lit(p[c][1]))))


@step("impute_constant")
def _():
    return (lambda df, cols, value="__missing__": {"value": value}), (lambda df, cols, p, **o: _each(df, cols, lambda c: F.coalesce(F.col(c), F.lit(p["value"]))))


@step("impute_by_group")
def _():
    def fit(df, cols, group, how="median"):
        # what is learned is written, so that its size is known before the join: few groups are broadcast, and no task gets all rows of a group
        if how == "median":
            by = df.select(group).distinct()
            for c in cols:
                by = by.join(group_quantiles(df, [group], c, [0.5]).select(group, F.col("q")[0].alias(c)), group, "left")
            return {"by": written(by), "whole": {c: q and q[0] for c, q in quantiles(df, cols, [0.5]).items()}}
        f = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}[how]
        by = written(df.groupBy(group).agg(*[f(c).alias(c) for c in cols]))
        whole = df.agg(*[f(c).alias(c) for c in cols]).first()
        return {"by": by, "whole": {c: whole[c] for c in cols}}

    def transform(df, cols, p, group, how="median"):
        by = p["by"].select(F.col(group).alias("_g"), *[F.col(c).alias(f"_{c}") for c in cols])
        got = df.join(by, F.col(group) == F.col("_g"), "left")
        return _each(got, cols, lambda c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(p["whole"][c]))).select(*df.columns)

    return fit, transform


#: Columns with gaps up to which the moments of each pattern of gaps are kept, at most two to this power.
MOST_GAPS = 8


def _pooled(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred sums of products of all parts (level, n, means, centred sums) together."""
    total = sum(n for _, n, _, _ in parts)
    mean = sum(n * m for _, n, m, _ in parts) / total
    return mean, sum(s + n * np.outer(m - mean, m - mean) for _, n, m, s in parts)


def _filled(part: tuple, cols: list[str], gaps: list[str], models: dict) -> tuple:
    """The moments of rows of one pattern of gaps after a round of filling."""
    level, n, m, s = part
    a, b = np.eye(len(cols)), np.zeros(len(cols))
    for gap, c in zip(level, gaps, strict=True):
        if gap == "1":
            i = cols.index(c)
            b[i], ws = models[c]
            a[i] = [ws.get(k, 0.0) for k in cols]
    return level, n, a @ m + b, a @ s @ a.T


@step("impute_iterative")
def _():
    def fit(df, cols, rounds=5):
        """Coefficients of each gappy column on the others, refitted round by round on the filled table."""
        start = _aggregates(df, cols, mean=_mean, gaps=lambda c: F.count_if(clean(c).isNull()))
        learned, gaps = [], [c for c in cols if start[c]["gaps"]]
        flagged = _each(df.withColumns({f"_gap_{c}": clean(c).isNull() for c in gaps}), cols, lambda c: F.coalesce(clean(c), F.lit(start[c]["mean"])))
        # rows with the same gaps are filled by the same linear rule, so their moments follow from those of the first filling
        pattern = F.concat(F.lit(""), *[F.col(f"_gap_{c}").cast("int").cast("string") for c in gaps])
        parts = gram_by(flagged.withColumn("_pattern", pattern), cols, "_pattern") if len(gaps) <= MOST_GAPS else None
        for _ in range(rounds):
            mean, s = _pooled(parts) if parts else gram(flagged, cols)[1:]
            models = {}
            for c in gaps:
                i = cols.index(c)
                rest = [j for j in range(len(cols)) if j != i]
                w = np.linalg.lstsq(s[np.ix_(rest, rest)], s[rest, i], rcond=None)[0]
                models[c] = (float(mean[i] - w @ mean[rest]), {cols[j]: float(x) for j, x in zip(rest, w, strict=True)})
            learned.append(models)
            if parts:
                parts = [_filled(part, cols, gaps, models) for part in parts]
            else:
                flagged = _refill(flagged, models)
        return {"start": {c: start[c]["mean"] for c in cols}, "rounds": learned}

    def transform(df, cols, p, **o):
        gaps = list(p["rounds"][-1]) if p["rounds"] else []
        x = df.withColumns({f"_gap_{c}": clean(c).isNull() for c in gaps})
        x = _each(x, cols, lambda c: F.coalesce(clean(c), F.lit(p["start"][c])))
        for models in p["rounds"]:
            x = _refill(x, models)
        return x.drop(*[f"_gap_{c}" for c in gaps])

    return fit, transform


def _refill(df, models):
    new = {c: F.when(F.col(f"_gap_{c}"), sum((F.col(k) * w for k, w in ws.items()), F.lit(b))).otherwise(F.col(c)) for c, (b, ws) in models.items()}
    return df.withColumns(new)


@step("impute_knn")
def _():
    def fit(df, cols, k=5, observed=None):
        return {"k": k}

    def transform(df, cols, p, observed=None, k=5):
        """Gaps of each column take the mean of the k rows nearest in the observed columns that have it; rows with a gap there stay."""
        for c in cols:
            got = with_nearest(df.where(clean(c).isNull()), df.where(clean(c).isNotNull()), observed, c, p["k"])
            df = df.where(clean(c).isNotNull()).unionByName(got.withColumn(c, F.coalesce(mean_of(F.col("near")), clean(c)).cast(df.schema[c].dataType)).drop("near"))
        return df

    return fit, transform


@step("normalize_rows")
def _():
    def transform(df, cols, p, norm="l2"):
        a = F.array(*[clean(c) for c in cols])
        size = {"l1": F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)), "l2": F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)), "max": F.array_max(F.transform(a, F.abs))}[norm]
        # the norm is taken of the row as it was
        return df.withColumn("_n", F.when(size == 0, 1.0).otherwise(size)).withColumns({c: clean(c) / F.col("_n") for c in cols}).drop("_n")

    return (lambda df, cols, norm="l2": {}), transform


def _power(c, lam: float, kind: str) -> Column:
    """The Box-Cox or Yeo-Johnson transform at lam."""
    x = clean(c)
    if kind == "box_cox":
        return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _power_step(kind: str):
    def fit(df, cols, standardise=True):
        """The exponent of greatest likelihood: a grid in one pass, refined twice."""
        out = {}
        if kind == "box_cox" and any(v["min"] <= 0 for v in _aggregates(df, cols, min=_min).values()):
            raise ValueError("Box-Cox needs positive values")
        for c in cols:
            lo, hi = -3.0, 3.0
            for _ in range(3):
                grid = [lo + i * (hi - lo) / 12 for i in range(13)]
                x = clean(c)
                logs = F.log(x) if kind == "box_cox" else F.signum(x) * F.log1p(F.abs(x))
                row = df.agg(F.count(x), F.sum(logs), *[F.var_pop(_power(c, lam, kind)) for lam in grid]).first()
                n, s = row[0], row[1]
                like = [-n / 2 * math.log(v) + (lam - 1) * s if v else -math.inf for lam, v in zip(grid, row[2:], strict=True)]
                best = grid[int(np.argmax(like))]
                lo, hi = best - (hi - lo) / 12, best + (hi - lo) / 12
            m = df.agg(F.avg(_power(c, best, kind)), F.stddev_pop(_power(c, best, kind))).first()
            out[c] = {"lambda": best, "mean": m[0], "std": m[1]}
        return out

    def transform(df, cols, p, standardise=True):
        return _each(df, cols, lambda c: (_power(c, p[c]["lambda"], kind) - p[c]["mean"]) / (p[c]["std"] or 1.0) if standardise else _power(c, p[c]["lambda"], kind))

    return fit, transform


register_step("yeo_johnson", *_power_step("yeo_johnson"))
register_step("box_cox", *_power_step("box_cox"))


@step("quantile_normal")
def _():
    """Onto a normal distribution by rank: a value's share lies linearly between n quantiles (no more than rows), a value
    that several quantiles share takes the middle of theirs, the least and the greatest are held 1e-7 from the ends."""

    def fit(df, cols, n=1000):
        steps = max(1, min(n, df.count()) - 1)
        return {c: list(v or []) for c, v in quantiles(df, cols, [i / steps for i in range(steps + 1)]).items()}

    def transform(df, cols, p, n=1000):
        for c in cols:
            if not p[c]:
                continue
            q = np.maximum.accumulate(np.array(p[c], dtype=float))
            edges, first, times = np.unique(q, return_index=True, return_counts=True)
            low, high = first / max(1, len(q) - 1), (first + times - 1) / max(1, len(q) - 1)
            middle = (low + high) / 2
            if len(edges) > 1:
                middle[0], middle[-1] = 0, 1
            at = lambda v: F.element_at(F.lit(np.asarray(v, dtype=float)), F.col("_i"))
            x = F.greatest(F.least(clean(c), F.lit(float(edges[-1]))), F.lit(float(edges[0])))
            df = places(df.withColumn("_x", F.when(clean(c).isNotNull(), x)), F.col("_x"), edges.tolist(), "_i")
            slope = np.append((low[1:] - high[:-1]) / np.diff(edges), 0.0)
            share = F.when(F.col("_x") == at(edges), at(middle)).otherwise(at(high) + (F.col("_x") - at(edges)) * at(slope))
            held = F.when(F.col("_x").isNotNull(), F.greatest(F.least(share, F.lit(1 - 1e-7)), F.lit(1e-7)))
            df = scalar.with_normal_quantile(df, held, c).drop("_x", "_i")
        return df

    return fit, transform


@step("binning")
def _():
    def fit(df, cols, bins=5, how="quantile"):
        if how == "quantile":
            q = quantiles(df, cols, [i / bins for i in range(1, bins)])
            return {c: sorted(set(v)) for c, v in q.items()}
        if how == "uniform":
            a = _aggregates(df, cols, min=_min, max=_max)
            return {c: [v["min"] + i * (v["max"] - v["min"]) / bins for i in range(1, bins)] for c, v in a.items()}
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        out = {}
        for c in cols:
            x = VectorAssembler(inputCols=[c], outputCol="features").transform(df.select(clean(c).alias(c)).dropna())
            mid = sorted(float(v[0]) for v in KMeans(k=bins, seed=1).fit(x).clusterCenters())
            out[c] = [(a + b) / 2 for a, b in itertools.pairwise(mid)]
        return out

    return fit, lambda df, cols, p, **o: _each(df, cols, lambda c: F.when(F.col(c).isNotNull(), sum(((clean(c) >= F.lit(e)).cast("int") for e in p[c]), F.lit(0))))


@step("binarize")
def _():
    return (lambda df, cols, threshold=0.0: {}), (lambda df, cols, p, threshold=0.0: _each(df, cols, lambda c: (clean(c) > threshold).cast("int")))


#: Levels of all columns together that a step may learn by name; more are refused.
MOST_LEVELS = 10_000


def _levels(df, cols, least: float = 0.0) -> dict[str, list[str]]:
    """The levels of each column with a share of `least` or more, in order."""
    vc = value_counts(df, cols).where("value is not null")
    if least > 0:
        total = vc.groupBy("variable").agg(F.sum("n").alias("_t"))  # one row a column
        vc = vc.join(F.broadcast(total), "variable").where(F.col("n") >= least * F.col("_t"))
    found = vc.select("variable", "value").limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"over {MOST_LEVELS} levels; set a least share or use frequency or target encoding, which join")
    return {c: sorted(r["value"] for r in found if r["variable"] == c) for c in cols}


@step("one_hot_encode")
def _():
    def transform(df, cols, p, drop=None, least=0.0):
        new = {}
        for c in cols:
            levels = p[c][1:] if drop == "first" or drop == "if_binary" and len(p[c]) == 2 else p[c]
            new |= {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for v in levels}
        return df.withColumns(new).drop(*cols)

    return (lambda df, cols, drop=None, least=0.0: _levels(df, cols, least)), transform


@step("ordinal_encode")
def _():
    def fit(df, cols, orders=None):
        found = _levels(df, cols)
        return {c: (orders or {}).get(c) or found[c] for c in cols}

    return fit, lambda df, cols, p, **o: _each(df, cols, lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in p[c]]), F.col(c).cast("string")) - 1, F.lit(-1)).cast("int"))


def _mapped(df, c, table: DataFrame, default, name) -> DataFrame:
    """table: (level, code); a null matches nothing."""
    m = table.select(F.col("level").alias("_l"), F.col("code").alias("_c"))
    return df.join(m, F.col(c).cast("string") == F.col("_l"), "left").withColumn(name, F.coalesce("_c", F.lit(default))).drop("_l", "_c")


@step("frequency_encode")
def _():
    def fit(df, cols, count=False):
        vc = value_counts(df, cols).where("value is not null")
        n = {r["variable"]: r["n"] for r in vc.groupBy("variable").agg(F.sum("n").alias("n")).collect()}
        return {c: vc.where(F.col("variable") == c).select(F.col("value").alias("level"), (F.col("n") if count else F.col("n") / n[c]).cast("double").alias("code")) for c in cols}

    def transform(df, cols, p, count=False):
        for c in cols:
            df = _mapped(df, c, p[c], 0.0, f"{c}_freq")
        return df

    return fit, transform


@step("target_encode")
def _():
    def fit(df, cols, target, smoothing=10.0):
        x = long_form(df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *cols), cols, "_y").where("value is not null")
        whole = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
        g = x.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"))
        w = 1 / (1 + F.exp(-(F.col("n") - 1) / smoothing))
        g = g.select("variable", F.col("value").alias("level"), (whole * (1 - w) + F.col("m") * w).alias("code"))
        return {"whole": whole, "maps": {c: g.where(F.col("variable") == c).select("level", "code") for c in cols}}

    def transform(df, cols, p, target, smoothing=10.0):
        for c in cols:
            df = _mapped(df, c, p["maps"][c], p["whole"], f"{c}_target")
        return df

    return fit, transform


@step("group_rare_categories")
def _():
    def transform(df, cols, p, least=0.01, other="__other__"):
        return _each(df, cols, lambda c: F.when(F.col(c).cast("string").isin(p[c]), F.col(c).cast("string")).otherwise(F.lit(other)))

    return (lambda df, cols, least=0.01, other="__other__": _levels(df, cols, least)), transform


@step("datetime_features")
def _():
    return (lambda df, cols: {}), (lambda df, cols, p: df.withColumns({k: v for c in cols for k, v in scalar.datetime_features(c).items()}).drop(*cols))


@step("text_features")
def _():
    return (lambda df, cols: {}), (lambda df, cols, p: df.withColumns({k: v for c in cols for k, v in scalar.text_features(c).items()}).drop(*cols))


@step("polynomial_features")
def _():
    def transform(df, cols, p, degree=2, interactions=False):
        new = {}
        for d in range(2, degree + 1):
            for combo in itertools.combinations_with_replacement(cols, d):
                if not interactions or len(set(combo)) == d:
                    value = F.lit(1.0)
                    for c in combo:
                        value = value * clean(c)
                    new["*".join(combo)] = value
        return df.withColumns(new)

    return (lambda df, cols, degree=2, interactions=False: {}), transform


@step("interaction_features")
def _():
    def transform(df, cols, p, ratios=False, most=8):
        """most: columns that are paired, from the first; None: all."""
        new = {}
        for a, b in itertools.combinations(cols[:most], 2):
            new[f"{a}_x_{b}"] = clean(a) * clean(b)
            if ratios:
                new[f"{a}_per_{b}"] = F.coalesce(F.try_divide(clean(a), clean(b)), F.lit(0.0))
        return df.withColumns(new)

    return (lambda df, cols, ratios=False, most=8: {}), transform


@step("aggregation_features")
def _():
    return (lambda df, cols: {}), (lambda df, cols, p: df.withColumns(scalar.row_aggregates(cols)))


def _keep(df, cols, chosen):
    return df.drop(*[c for c in cols if c not in chosen])


def f_scores_regression(df, cols, target) -> dict[str, float]:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[safe_corr(clean(c), clean(target)).alias(c) for c in cols]).first()
    return {c: row[c] ** 2 / max(1e-300, 1 - row[c] ** 2) * (row["_n"] - 2) if row[c] is not None else 0.0 for c in cols}


def f_scores_classes(df, cols, target) -> dict[str, float]:
    """One-way F of every column by the classes, from one aggregate."""
    x = long_form(df.select(F.col(target).alias("_y"), *cols), cols, "_y", cast="double").where("value is not null")
    g = x.groupBy("variable", "_y").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    out, rows = {}, g.collect()  # one row a column and class
    for c in cols:
        s = [r for r in rows if r["variable"] == c]
        n, k = sum(r["n"] for r in s), len(s)
        grand = sum(r["n"] * r["m"] for r in s) / n
        between, within = sum(r["n"] * (r["m"] - grand) ** 2 for r in s), sum((r["n"] - 1) * (r["v"] or 0) for r in s)
        out[c] = between / (k - 1) / max(1e-300, within / (n - k))
    return out


def mutual_information(df, cols, target, bins=10) -> dict[str, float]:
    """From one table of counts (variable, bin, target bin); numeric columns in quantile bins."""
    numeric = [c for c in [*cols, target] if dict(df.dtypes)[c] not in ("string", "boolean")]
    binned = fit_transform("binning", df.select(*cols, target), numeric, bins=bins) if numeric else df.select(*cols, target)
    x = long_form(binned.select(F.col(target).cast("string").alias("_y"), *cols), cols, "_y")
    g = x.groupBy("variable", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    total, by_x, by_y = (F.sum("n").over(Window.partitionBy("variable", *k)) for k in ((), ("value",), ("_y",)))
    mi = g.withColumn("mi", F.col("n") / total * F.log(F.col("n") * total / (by_x * by_y))).groupBy("variable").agg(F.sum("mi").alias("mi"))
    return {r["variable"]: r["mi"] for r in mi.collect()}


def _select(scores):
    def fit(df, cols, target, k=5, **o):
        got = scores(df, cols, target, **o)
        return {"scores": got, "kept": sorted(cols, key=lambda c: (-got.get(c, 0.0), cols.index(c)))[:k]}

    return fit, lambda df, cols, p, **o: _keep(df, cols, p["kept"])


register_step("select_k_best_regression", *_select(f_scores_regression))
register_step("select_k_best_classification", *_select(f_scores_classes))
register_step("select_mutual_info", *_select(mutual_information))


@step("drop_correlated")
def _():
    def fit(df, cols, limit=0.95):
        _, _, s = gram(df, cols)
        d = np.sqrt(np.diag(s))
        r = np.abs(s / np.maximum(np.outer(d, d), 1e-300))
        gone: list[str] = []
        for j, c in enumerate(cols):
            if any(r[i, j] >= limit for i in range(j) if cols[i] not in gone):
                gone.append(c)
        return {"dropped": gone}

    return fit, lambda df, cols, p, **o: df.drop(*p["dropped"])


@step("pca_reduce")
def _():
    def fit(df, cols, k=None, share=0.95):
        n, mean, s = gram(df, cols)
        values, vectors = np.linalg.eigh(s / (n - 1))
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(cols))])  # the largest loading is positive
        k = k or int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
        return {"mean": mean.tolist(), "loadings": vectors[:, :k].T.tolist(), "explained": (values / values.sum())[:k].tolist()}

    def transform(df, cols, p, **o):
        new = {f"component_{i + 1}": sum(((clean(c) - m) * w for c, m, w in zip(cols, p["mean"], load, strict=True)), F.lit(0.0)) for i, load in enumerate(p["loadings"])}
        return df.withColumns(new).drop(*cols)

    return fit, transform


# row steps, in the same registry
register_step("drop_duplicates", lambda df, cols, **o: {}, lambda df, cols, p, order_by=None: R.drop_duplicates(df, cols or df.columns, order_by) if order_by else df.dropDuplicates(cols))
register_step("drop_rows_missing", lambda df, cols, **o: {}, lambda df, cols, p, share=None: R.drop_rows_missing(df, cols or df.columns, share))
register_step("drop_columns", lambda df, cols, **o: {}, lambda df, cols, p: df.drop(*cols))
register_step("drop_constant_columns", lambda df, cols, **o: {}, lambda df, cols, p, threshold=0.0: R.drop_constant_columns(df, threshold))
register_step("remove_outlier_rows", lambda df, cols, **o: {}, lambda df, cols, p, k=3.0: R.remove_outlier_rows(df, cols, k))
register_step("impute_forward_fill", lambda df, cols, **o: {}, lambda df, cols, p, key, t, back=False: R.forward_fill(df, key, t, cols[0], back))
