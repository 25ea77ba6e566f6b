"""Metrics, curves and diagnostics over a table of predictions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import chain, clean
from tesserae.operators.kernels import edges_below, global_ranks, quantiles, range_edges


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    a, p = clean(actual), clean(predicted)
    e = a - p
    df = df.where(a.isNotNull() & p.isNotNull())
    middle = quantiles(df.select(F.abs(e).alias("e")), ["e"], [0.5])["e"] or [None]
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.sum(e * e) / (F.var_pop(a) * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.lit(middle[0]).cast("double").alias("median_ae"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.when(a != 0, F.abs(e / a))).alias("mape"),
        F.avg(F.when(F.abs(a) + F.abs(p) > 0, 2 * F.abs(e) / (F.abs(a) + F.abs(p))).otherwise(0.0)).alias("smape"),
        (1 - F.var_pop(e) / F.var_pop(a)).alias("explained_variance"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_rates(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Each class against the rest: counts, sensitivity, specificity and the two error rates (null where nothing can be said)."""
    c = confusion_matrix(df, actual, predicted).where("actual is not null and predicted is not null")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    rows = c.select(F.inline(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("own"), zero.alias("said"), hit.alias("tp")), F.struct(F.col("predicted").alias("class"), zero.alias("own"), F.col("n").alias("said"), zero.alias("tp")))))
    g = rows.groupBy("class").agg(*[F.sum(k).alias(k) for k in ("own", "said", "tp")]).join(F.broadcast(c.agg(F.sum("n").alias("all"))))  # one row
    fn, fp = F.col("own") - F.col("tp"), F.col("said") - F.col("tp")
    tn = F.col("all") - F.col("own") - fp
    rate = lambda a, b: F.try_divide(a, a + b)
    return g.select("class", "tp", fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), rate(F.col("tp"), fn).alias("sensitivity"), rate(tn, fp).alias("specificity"), rate(fp, tn).alias("false_positive_rate"), rate(fn, F.col("tp")).alias("false_negative_rate"))


def per_class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    c = confusion_matrix(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = c.select(F.inline(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))))
    g = rows.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("hits", "predicted"), zero), F.coalesce(F.try_divide("hits", "support"), zero)
    return g.select("class", "support", "predicted", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"), (F.col("predicted") == 0).alias("ignored"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, score: str | None = None) -> DataFrame:
    """Binary: the greater class is positive. Everything from the confusion counts; scores add Brier and log loss."""
    cells = {(r["actual"], r["predicted"]): r["n"] for r in confusion_matrix(df, actual, predicted).collect()}  # classes squared
    classes = sorted({x for k in cells for x in k})
    n = sum(cells.values())
    row = {c: sum(v for (a, _), v in cells.items() if a == c) for c in classes}
    col = {c: sum(v for (_, p), v in cells.items() if p == c) for c in classes}
    hits = sum(cells.get((c, c), 0) for c in classes)
    expected = sum(row[c] * col[c] for c in classes) / n
    spread = math.sqrt((n * n - sum(v * v for v in col.values())) * (n * n - sum(v * v for v in row.values())))
    pr = {c: (cells.get((c, c), 0) / col[c] if col[c] else 0.0, cells.get((c, c), 0) / row[c] if row[c] else 0.0) for c in classes}
    f1 = {c: 2 * p * r / (p + r) if p + r else 0.0 for c, (p, r) in pr.items()}
    positive = [classes[-1]] if len(classes) == 2 else classes
    mean = lambda f: sum(f(c) for c in positive) / len(positive)
    out = {"n": n, "accuracy": hits / n, "balanced_accuracy": sum(pr[c][1] for c in classes if row[c]) / max(1, sum(1 for c in classes if row[c])), "mcc": (hits * n - sum(row[c] * col[c] for c in classes)) / spread if spread else 0.0, "kappa": (hits - expected) / (n - expected) if n != expected else 0.0, "precision": mean(lambda c: pr[c][0]), "recall": mean(lambda c: pr[c][1]), "f1": mean(lambda c: f1[c])}
    if score:
        s = F.least(F.greatest(F.col(score).cast("double"), F.lit(1e-15)), F.lit(1 - 1e-15))
        y = (F.col(actual) == F.lit(classes[-1])).cast("double")
        r = df.agg(F.avg((F.col(score) - y) ** 2).alias("b"), F.avg(-(y * F.log(s) + (1 - y) * F.log(1 - s))).alias("l")).first()
        out |= {"brier": r["b"], "log_loss": r["l"]}
    return df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in out))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area by rank sums; ties count half."""
    x = df.select(F.col(label).cast("int").alias("y"), clean(score).alias("s")).dropna()
    cells = x.groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("k"))
    r = cells.join(global_ranks(x.select("s"), "s").select("s", "rank"), "s").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("k").alias("n"))
    neg = F.col("n") - F.col("p")
    return r.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * neg).alias("roc_auc"), "n")


def threshold_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp, tp_all, fp_all): positives and negatives at or above each different score.

    Scores are counted first; the running sums go through the rank kernel's buckets.
    """
    x = df.select(F.col(label).cast("int").alias("y"), clean(score).alias("s")).dropna()
    cells = x.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("f"))
    cells = cells.withColumn("_b", edges_below(F.col("s"), range_edges(x, "s")))
    part = cells.groupBy("_b").agg(F.sum("p").alias("bp"), F.sum("f").alias("bf"))
    w = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    part = part.select("_b", (F.sum("bp").over(w) - F.col("bp")).alias("op"), (F.sum("bf").over(w) - F.col("bf")).alias("of"), F.sum("bp").over(every).alias("tp_all"), F.sum("bf").over(every).alias("fp_all"))
    own = Window.partitionBy("_b").orderBy(F.desc("s"))
    got = cells.withColumn("cp", F.sum("p").over(own)).withColumn("cf", F.sum("f").over(own)).join(part, "_b")
    return got.select(F.col("s").alias("score"), (F.col("op") + F.col("cp")).alias("tp"), (F.col("of") + F.col("cf")).alias("fp"), "p", "tp_all", "fp_all")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    return threshold_counts(df, label, score).select("score", (F.col("fp") / F.col("fp_all")).alias("fpr"), (F.col("tp") / F.col("tp_all")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    return threshold_counts(df, label, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("tp_all")).alias("recall"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: the step sum."""
    t = threshold_counts(df, label, score)
    return t.agg(F.sum(F.col("p") / F.col("tp_all") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, least: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("observed"))
    return g.where(F.col("n") >= least).withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def calibration_summary(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error over all bins, Brier score, its skill against the base rate, log loss."""
    x = df.select(F.col(label).cast("double").alias("y"), clean(score).alias("s")).dropna()
    b = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))
    p = F.least(F.greatest(F.col("s"), F.lit(1e-15)), F.lit(1 - 1e-15))
    y, s = F.col("y"), F.col("s")
    g = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.sum(y).alias("y"), F.sum((s - y) ** 2).alias("b"), F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("l"))
    n, base = F.sum("n"), F.sum("y") / F.sum("n")
    gap = F.abs(F.col("s") - F.col("y"))
    brier = F.sum("b") / n
    return g.agg(n.alias("n"), base.alias("base_rate"), (F.sum(gap) / n).alias("ece"), F.max(gap / F.col("n")).alias("mce"), brier.alias("brier"), (1 - F.try_divide(brier, base * (1 - base))).alias("skill"), (F.sum("l") / n).alias("log_loss"))


def threshold_costs(df: DataFrame, label: str, score: str, miss: float, alarm: float, act: float = 0.0, benefit: float = 0.0) -> DataFrame:
    """19 cut-offs from one histogram of score bucket by label; refuses under 30 rows or one class."""
    k = F.least(F.floor(F.round(F.col(score) * 20, 9)), F.lit(19)).cast("int")  # cut-offs i / 20 at or below the score
    h = df.groupBy(k.alias("k")).agg(F.sum(F.col(label)).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("q"))
    total = df.agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q")).first()
    if (total["p"] or 0) + (total["q"] or 0) < 30 or not total["p"] or not total["q"]:
        raise ValueError("30 rows and two classes are needed")
    cuts = df.sparkSession.range(1, 20).select(F.col("id").cast("int").alias("i"))
    g = cuts.join(F.broadcast(h), F.col("k") >= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("q"), F.lit(0)).alias("fp"))  # h has at most 20 rows
    fn, tn = F.lit(total["p"]) - F.col("tp"), F.lit(total["q"]) - F.col("fp")
    cost = fn * miss + F.col("fp") * alarm + (F.col("tp") + F.col("fp")) * act - F.col("tp") * benefit
    return g.select((F.col("i") / 20).alias("threshold"), "tp", "fp", tn.alias("tn"), fn.alias("fn"), cost.cast("double").alias("cost"))


def regression_diagnostics(df: DataFrame, order_by: list[str], actual: str = "actual", predicted: str = "predicted", group: str | None = None) -> DataFrame:
    """Bias, spread and shape of residuals, share beyond three deviations; Durbin-Watson within a group."""
    x = df.withColumn("_e", clean(actual) - clean(predicted))
    r = x.agg(F.avg("_e").alias("bias"), F.stddev_samp("_e").alias("std"), F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurtosis")).first()
    far = x.agg((F.count_if(F.abs((F.col("_e") - r["bias"]) / r["std"]) > 3) / F.count(F.lit(1))).alias("far"))
    out = far.select(F.lit(r["bias"]).alias("bias"), F.lit(r["std"]).alias("std"), F.lit(r["skew"]).alias("skew"), F.lit(r["kurtosis"]).alias("kurtosis"), "far")
    if group:
        w = Window.partitionBy(group).orderBy(*order_by)
        d = x.withColumn("_d", F.col("_e") - F.lag("_e").over(w)).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("_e") * F.col("_e"))).alias("durbin_watson"))
        out = out.crossJoin(d)  # one row each
    return out


def residual_checks(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Normality (Jarque-Bera) of the residuals, and whether their size goes with the prediction (Spearman)."""
    x = df.select((clean(actual) - clean(predicted)).alias("e"), clean(predicted).alias("p")).dropna()
    shape = x.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / 6 * (F.skewness("e") ** 2 + F.kurtosis("e") ** 2 / 4)).alias("jarque_bera"))
    r = x.select(F.abs("e").alias("a"), "p")
    for c in ("a", "p"):
        ranks = global_ranks(r.select(c), c).select(F.col(c).alias("_v"), F.col("rank").alias(f"r_{c}"))
        r = r.join(ranks, F.col(c) == F.col("_v")).drop("_v")
    return shape.crossJoin(r.agg(F.corr("r_a", "r_p").alias("spread_with_prediction")))  # one row each


def conformal_interval(df: DataFrame, actual: str, predicted: str, coverage: float = 0.9) -> DataFrame:
    """Half-width: the ceil((n + 1) c)-th least absolute residual, picked from counted values."""
    x = df.select(F.abs(clean(actual) - clean(predicted)).alias("r")).dropna()
    n = x.count()
    k = math.ceil((n + 1) * coverage)
    if n < 20 or k > n:
        raise ValueError("too few residuals for this coverage")
    near = global_ranks(x, "r")
    return near.where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select(F.lit(n).alias("n"), F.col("r").alias("half_width"))


def facets_of(df: DataFrame, numeric: list[str], categorical: list[str], top: int = 8) -> DataFrame:
    """Facets for subgroup_errors: thirds of numbers (low, middle, high), the most frequent levels and 'other'; a gap is 'missing'."""
    q = quantiles(df, numeric, [1 / 3, 2 / 3]) if numeric else {}
    new = {}
    for c in numeric:
        v = clean(c)
        a, b = q[c] or (0.0, 0.0)
        new[f"{c}_band"] = F.when(v.isNull(), "missing").when(v <= a, "low").when(v <= b, "middle").otherwise("high")
    for c in categorical:
        levels = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(top).collect()
        new[f"{c}_band"] = F.when(F.col(c).isNull(), "missing").when(F.col(c).cast("string").isin([r["v"] for r in levels]), F.col(c).cast("string")).otherwise("other")
    return df.withColumns(new)


def subgroup_errors(df: DataFrame, facets: list[str], actual: str = "actual", predicted: str = "predicted", least: int = 30) -> DataFrame:
    """Errors of all levels and pairs of levels in one aggregation: mean, ratio to the whole, z, notable."""
    x = df.withColumn("_e", F.abs(clean(actual) - clean(predicted)))
    sets = [(f,) for f in facets] + list(itertools.combinations(facets, 2))
    whole = x.agg(F.avg("_e").alias("m"), F.stddev_samp("_e").alias("s"), F.count(F.lit(1)).alias("n")).first()
    g = x.groupingSets([list(s) for s in sets], *facets).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("error"))
    g = g.where((F.col("n") >= least) & (F.col("n") < 0.95 * whole["n"]))
    z = (F.col("error") - whole["m"]) / (whole["s"] / F.sqrt("n"))
    ratio = F.col("error") / whole["m"]
    return g.select(*facets, "n", "error", ratio.alias("ratio"), z.alias("z"), ((F.abs(z) >= 3) & ((ratio >= 1.3) | (ratio <= 0.75))).alias("notable"))


def row_reliability(df: DataFrame, train: DataFrame, numeric: list[str], categorical: list[str], probability: str | None = None) -> DataFrame:
    """reliability (reliable, caution or abstained) and reasons: gaps, unseen levels, values beyond the training range, weak probabilities."""
    q = quantiles(train, numeric, [0.001, 0.999])
    cols = [*numeric, *categorical]
    gaps = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) / len(cols)
    far = F.lit(False)
    for c in numeric:
        lo, hi = q[c]
        far = far | F.coalesce((clean(c) < lo - (hi - lo)) | (clean(c) > hi + (hi - lo)), F.lit(False))
    unseen = F.lit(False)
    for c in categorical:
        known = train.where(F.col(c).isNotNull()).select(F.col(c).alias(f"_k_{c}")).distinct()
        df = df.join(known, F.col(c) == F.col(f"_k_{c}"), "left")
        unseen = unseen | (F.col(c).isNotNull() & F.col(f"_k_{c}").isNull())
    weak = F.col(probability) < 0.55 if probability else F.lit(False)
    state = chain([((gaps >= 0.5) | far, "abstained"), ((gaps > 0.2) | unseen | weak, "caution")], "reliable")
    said = [(gaps >= 0.5, "half the values are missing"), ((gaps > 0.2) & (gaps < 0.5), "values are missing"), (far, "beyond the training range"), (unseen, "unseen level"), (F.coalesce(weak, F.lit(False)), "weak probability")]
    reasons = F.array_compact(F.array(*[F.when(when, text) for when, text in said]))
    return df.withColumns({"reliability": state, "reasons": reasons}).drop(*[f"_k_{c}" for c in categorical])


def overfit_flags(results: DataFrame) -> DataFrame:
    """results: model, fold, train, held_out. The gap between the means, and the folds' variation over 0.3."""
    g = results.groupBy("model").agg(F.avg("train").alias("train"), F.avg("held_out").alias("held_out"), F.stddev_samp("held_out").alias("s"))
    cv = F.try_divide("s", F.abs("held_out"))
    return g.select("model", "train", "held_out", (F.col("train") - F.col("held_out")).alias("gap"), cv.alias("cv"), (F.col("train") - F.col("held_out") > 0.1).alias("overfit"), (cv > 0.3).alias("unstable"))


def tournament_rank(results: DataFrame, group: str = "segment") -> DataFrame:
    """Composite of performance, generalisation, stability, interpretability and efficiency; ranked in each group."""
    w = Window.partitionBy(group)
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(1.0))
    score = 0.5 * unit("performance") + 0.2 * F.col("generalisation") + 0.15 * F.col("stability") + 0.1 * F.col("interpretability") + 0.05 * F.col("efficiency")
    got = results.withColumn("composite", score)
    return got.withColumn("rank", F.row_number().over(w.orderBy(F.desc("composite"), "model")))


def tournament_roles(ranked: DataFrame, group: str = "segment", baseline: str | None = None, tolerance: float = 0.05) -> DataFrame:
    """(group, role, model): recommended (best composite), highest (best performance), simplest (most interpretable of those within tolerance of the best performance), and the baseline."""
    top = F.max("performance").over(Window.partitionBy(group))  # a row for each model
    ranked = ranked.withColumn("_fair", F.col("performance") >= top - tolerance * F.abs(top))
    best = lambda *by: F.min_by("model", F.struct(*by, "model"))
    g = ranked.groupBy(group).agg(best(-F.col("composite")).alias("recommended"), best(-F.col("performance")).alias("highest"), F.min_by("model", F.when(F.col("_fair"), F.struct(-F.col("interpretability"), -F.col("composite"), "model"))).alias("simplest"), F.max(F.when(F.col("model") == F.lit(baseline), F.col("model"))).alias("baseline"))
    return g.select(group, F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("model")) for r in ("recommended", "highest", "simplest", "baseline")]))).where("model is not null")


def rank_per_series(results: DataFrame, key: str = "series_key") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("composite"), "model")
    return results.withColumn("rank", F.row_number().over(w)).where("rank = 1")


def run_difference(old: DataFrame, new: DataFrame, key: str = "model", targets: tuple[str, str] | None = None) -> DataFrame:
    """Scores of two runs side by side: better, worse, or a tie where the folds spread more. Runs on different targets are refused."""
    if targets and targets[0] != targets[1]:
        raise ValueError(f"the runs predict {targets[0]} and {targets[1]}")
    x = old.select(key, F.col("score").alias("score_old"), F.col("spread").alias("s1")).join(new.select(key, F.col("score").alias("score_new"), F.col("spread").alias("s2")), key, "full_outer")
    d = F.col("score_new") - F.col("score_old")
    state = chain([(F.col("score_old").isNull(), "added"), (F.col("score_new").isNull(), "removed"), (F.abs(d) <= F.greatest("s1", "s2"), "tie"), (d > 0, "better")], "worse")
    return x.select(key, "score_old", "score_new", d.alias("difference"), state.alias("state"))


def forecast_metrics(train: DataFrame, test: DataFrame, key: str, t: str, season: int = 1) -> DataFrame:
    """train: key, t, y; test: key, t, y, predicted. Errors, r2, MASE against the (seasonal) naive and direction."""
    w = Window.partitionBy(key).orderBy(t)
    base = train.withColumn("_d", F.abs(F.col("y") - F.lag("y", season).over(w))).groupBy(key).agg(F.avg("_d").alias("naive"))
    x = test.withColumn("_a", F.signum(F.col("y") - F.lag("y").over(w))).withColumn("_p", F.signum(F.col("predicted") - F.lag("y").over(w)))
    e = F.col("y") - F.col("predicted")
    both = F.abs("y") + F.abs("predicted")
    g = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))).alias("mape"), F.avg(F.when(both > 0, 2 * F.abs(e) / both).otherwise(0.0)).alias("smape"), F.avg((F.col("_a") == F.col("_p")).cast("double")).alias("direction"),
    )
    return g.join(base, key).select(key, "n", "mae", "rmse", "r2", "mape", "smape", F.try_divide("mae", "naive").alias("mase"), "direction")
