"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed 3-, 4- and 5-grams of characters that a text (lower-cased) holds, each
counted once a document. From labelled rows, r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|), where
p and q count the toxic and the clean documents that hold a gram and |.| sums over all grams seen. A
logistic regression with an L2 penalty is fitted to r times presence of every gram that the labels
depend on by a likelihood-ratio test at a fixed level, however many these are.

The fit reads at most train_rows labelled rows (those with the least hash of doc_id). Grams are
counted by a grouped sum and the regression runs on sparse rows in Spark's ml library, so no task
holds more than its share of these rows. The model (at most 2**BITS weights) is sent to the tasks that
score; scoring covers every whole text.

Defined results: a null or empty text holds no gram and gets the score of the intercept; labels
that are null or whose document is missing are not used; without labels of both classes every
score is the share of toxic rows (0 without any); rows alike get one score; an empty table gives an
empty result; other columns are carried or ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import byte_slices, column_bytes, documents, materialize, release

#: Labelled rows that a fit reads at most, and bits of a feature's number.
TRAIN_ROWS, BITS = 12_000, 22
GRAMS = (3, 4, 5)
#: Level of the test: the likelihood ratio (chi-square, one degree) from which a gram is a feature.
LEAST_GAIN = 15.0
#: Weight of the L2 penalty, per row; the fit's tolerance, rounds and tasks a round.
PENALTY, TOLERANCE, ROUNDS = 1.0, 1e-5, 100
FIT_TASKS = 6
THRESHOLD = 0.3
#: Bytes of text in one step of the scoring, which holds some six 64-bit values for each.
STEP_BYTES = 500_000
_C, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_places(texts: list[bytes]):
    """For each gram length: (feature, place) of all grams in the joined texts, and each text's first place."""
    lower = [t.decode(errors="replace").lower() for t in texts]
    data = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", errors="replace"), dtype="<u4").astype(np.uint64)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in lower], out=first[1:])
    value, out = data, []
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            break
        value = value[:-1] * _R + data[n - 1 :]
        if n in GRAMS:
            mixed = value + np.uint64(n << 60)
            mixed ^= mixed >> np.uint64(31)
            out.append((n, (mixed * _C >> np.uint64(64 - BITS)).astype(np.int32)))
    return first, out


def features_of(text: bytes) -> np.ndarray:
    """The distinct features of one text."""
    first, grams = gram_places([text])
    own = [f[: max(0, int(first[1]) - n)] for n, f in grams]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.int32)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def labelled_features(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(y, f): label and distinct features of each row to learn from. labels: doc_id and toxic; rows held out are not read."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("_d"), F.col("toxic").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_d"), "_d", "_y").limit(train_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), text).join(F.broadcast(chosen), "_d")  # at most train_rows rows

    def run(batches):
        import pyarrow as pa

        release()
        for b in batches:
            f = [features_of(t) for t in column_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(b.column("_y"), pa.int32()), pa.array(f, pa.list_(pa.int32()))], names=["y", "f"])

    return rows.select("text", "_y").mapInArrow(run, "y int, f array<int>")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(f, pos, neg): toxic and clean rows that hold each gram; each task sends one row a gram."""

    def run(batches):
        import pyarrow as pa

        release()
        pos, neg = (np.zeros(1 << BITS, dtype=np.int32) for _ in range(2))
        for b in batches:
            grams, at = b.column("f").values.to_numpy(), b.column("f").offsets.to_numpy()
            for i, y in enumerate(b.column("y").to_pylist()):
                (pos if y > 0 else neg)[grams[at[i] : at[i + 1]]] += 1  # a row's grams are distinct
        seen = np.flatnonzero(pos + neg)
        for a in range(0, len(seen), 100_000):
            own = seen[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(pos[own].astype(np.int64)), pa.array(neg[own].astype(np.int64))], names=["f", "pos", "neg"])

    return rows.mapInArrow(run, "f int, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def gain(n1: int, n0: int):
    """Likelihood ratio of pos and neg against independence of gram and label, as a column."""
    n = n1 + n0

    def part(seen, margin, size):
        return F.when(seen > 0, seen * F.log(seen * n / (margin * size))).otherwise(0.0)

    p, q = F.col("pos"), F.col("neg")
    return 2 * (part(p, p + q, n1) + part(q, p + q, n0) + part(n1 - p, n - p - q, n1) + part(n0 - q, n - p - q, n0))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least_gain: float | None = LEAST_GAIN) -> tuple[list[int], list[float], float]:
    """The model: features, their weights, and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    rows = materialize(labelled_features(docs, labels, train_rows))
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    share = n1 / n if n else 0.0
    constant = ([], [], float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    if n1 in (0, n):
        return constant
    counts = materialize(gram_counts(rows))
    p1, q1 = counts.agg(F.sum(F.col("pos") + 1), F.sum(F.col("neg") + 1)).first()
    ratio = F.log((F.col("pos") + 1) / F.lit(p1)) - F.log((F.col("neg") + 1) / F.lit(q1))
    if least_gain is not None:
        counts = counts.where(gain(n1, n - n1) >= least_gain)
    kept = counts.select("f", ratio.alias("r")).orderBy("f").collect()  # at most 2**BITS rows
    if not kept:
        return constant
    f, r = [k.f for k in kept], [k.r for k in kept]
    feature = np.array(f, dtype=np.int32)

    def narrow(batches):
        import pyarrow as pa

        known = np.zeros(1 << BITS, dtype=bool)
        known[feature] = True
        for b in batches:
            own = [x[known[x]].astype(str).tolist() for x in np.split(b.column("f").flatten().to_numpy(), np.cumsum(np.diff(b.column("f").offsets.to_numpy()))[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(b.column("y").to_numpy() > 0).cast(pa.float64()), pa.array(own, pa.list_(pa.string()))], names=["y", "grams"])

    sparse = CountVectorizerModel.from_vocabulary([str(x) for x in f], "grams", "present").setBinary(True)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(r), inputCol="present", outputCol="features")
    narrowed = materialize(rows.mapInArrow(narrow, "y double, grams array<string>")).coalesce(FIT_TASKS)  # at most train_rows rows, read each round
    table = scale.transform(sparse.transform(narrowed))
    model = LogisticRegression(labelCol="y", regParam=PENALTY / n, standardization=False, tol=TOLERANCE, maxIter=ROUNDS).fit(table)
    return f, (model.coefficients.toArray() * np.array(r)).tolist(), float(model.intercept)


def scores_of(texts: list[bytes], features: np.ndarray, weights: np.ndarray, flags: np.ndarray, bias: float) -> np.ndarray:
    """Scores from 0 to 1; features: in ascending order, flags: of all numbers, which are features."""
    first, grams = gram_places(texts)
    keys = []
    for n, f in grams:
        at = np.flatnonzero(flags[f])
        doc = np.searchsorted(first, at, side="right") - 1
        own = at + n < first[doc + 1]  # a gram may not reach into the next text
        keys.append(doc[own] * (1 << BITS) + f[at[own]])
    z = np.full(len(texts), bias)
    if keys:
        keys = np.unique(np.concatenate(keys))
        z += np.bincount(keys >> BITS, weights[np.searchsorted(features, keys & ((1 << BITS) - 1))], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model, *more: str) -> DataFrame:
    """score beside the columns in more; a text column of strings that is among these goes to the tasks once."""
    features, weights, bias = model
    order = np.argsort(np.array(features, dtype=np.int64))
    features, weights = np.array(features, dtype=np.int64)[order], np.array(weights, dtype=np.float64)[order]
    own = "text" in more and docs.schema["text"].dataType.simpleString() == "string"
    texts = "text" if own else "_text"

    def run(batches):
        import pyarrow as pa

        release()
        flags = np.zeros(1 << BITS, dtype=bool)
        flags[features] = weights != 0
        for batch in batches:
            s = [scores_of(part, features, weights, flags, bias) for _, _, part in byte_slices(batch.column(texts).fill_null(""), STEP_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s) if s else np.zeros(0))] + [batch.column(c) for c in more], names=["score", *more])

    rows = docs.select(*more) if own else docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), *more)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(run, f"score double{fields}")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id")
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    names = docs.columns
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = [F.col(f"`{c}`") for c in names if c != "text"]
    row = docs.select(F.col("text").alias("text"), (F.struct(*rest) if rest else F.lit(0)).alias("_row"))  # beside the text, which is not sent twice
    kept = score(row, model, "text", "_row").where(F.col("score") < THRESHOLD)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in names])
