"""Statistics and learners: closed forms as one aggregation, the rest from Spark's own library."""

from __future__ import annotations

import numpy as np
from pyspark.ml import classification, clustering, recommendation, regression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_summary(df: DataFrame, *columns: str) -> DataFrame:
    """column, mean, variance, non-zeros, min, max."""
    rows = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.sum((F.col(c) != 0).cast("long")).alias("nonzeros"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def covariance(df: DataFrame, *columns: str) -> DataFrame:
    """a, b, cov for every pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov")) for a, b in pairs]).alias("r")).select(F.inline("r"))


def gramian(df: DataFrame, *columns: str, centre: list[float] | None = None) -> np.ndarray:
    """Sums of products of columns, less `centre` if given; rows with nulls are left out."""
    d = len(columns)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre or [0.0] * d, strict=True)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = df.select(*columns).na.drop().agg(*[F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)) for i, j in pairs]).first()
    out = np.zeros((d, d))
    for (i, j), v in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = v
    return out


def means(df: DataFrame, *columns: str) -> list[float]:
    return [float(x or 0.0) for x in df.select(*columns).na.drop().agg(*[F.avg(c) for c in columns]).first()]


def svd(df: DataFrame, columns: list[str], k: int, least: float = 1e-9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(U, s, V) of the matrix of these columns: U as a DataFrame with u0..; k singular values at most, those above `least` times the largest.

    One aggregation for the d x d products, whose eigenvectors come from the driver; U is one more pass.
    """
    values, vectors = np.linalg.eigh(gramian(df, *columns))
    s = np.sqrt(np.maximum(values[::-1], 0))
    keep = [i for i in range(min(k, len(columns))) if s[i] > least * max(s[0], 1e-300)]
    v = vectors[:, ::-1][:, keep]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(keep))] < 0, -1, 1)
    u = multiply(df, columns, v / s[keep], "u")
    return u, s[keep], v


def multiply(df: DataFrame, columns: list[str], matrix: np.ndarray, name: str = "c") -> DataFrame:
    """Rows times a small matrix: c0.. in place of the columns; other columns stay."""
    sums = [sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"{name}{j}") for j in range(matrix.shape[1])]
    return df.select(*[c for c in df.columns if c not in columns], *sums)


def linear_regression(df: DataFrame, target: str, columns: list[str], ridge: float = 0.0) -> dict[str, float]:
    """Least squares from the normal equations of centred columns: two aggregations, d * d sums."""
    x = df.select(*columns, F.col(target).alias("__y")).na.drop()
    m = means(x, *columns, "__y")
    g = gramian(x, *columns, "__y", centre=m)
    w = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(len(columns)), g[:-1, -1])
    return {"intercept": m[-1] - float(np.dot(w, m[:-1])), **dict(zip(columns, w.tolist(), strict=True))}


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


LEARNERS = {
    "linear": regression.LinearRegression, "ridge": lambda **k: regression.LinearRegression(elasticNetParam=0.0, **k), "lasso": lambda **k: regression.LinearRegression(elasticNetParam=1.0, **k),
    "logistic": classification.LogisticRegression, "svm": classification.LinearSVC, "bayes": classification.NaiveBayes, "tree": classification.DecisionTreeClassifier,
    "tree_regression": regression.DecisionTreeRegressor, "kmeans": clustering.KMeans, "als": recommendation.ALS,
}


def fit(kind: str, df: DataFrame, **options):
    return LEARNERS[kind](**options).fit(df)


def principal_components(df: DataFrame, columns: list[str], k: int):
    return PCA(k=k, inputCol="features", outputCol="pca").fit(assembled(df, columns))


def binary_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tp, fp, precision, recall, fpr. Counts by score first: the window then runs over distinct scores."""
    from pyspark.sql import Window

    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = by.agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    out = by.select("threshold", F.sum("p").over(w).alias("tp"), (F.sum("n").over(w) - F.sum("p").over(w)).alias("fp")).join(F.broadcast(total))
    return out.select("threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "__p").alias("recall"), F.try_divide(F.col("fp"), F.col("__n") - F.col("__p")).alias("fpr"))


def k_folds(df: DataFrame, k: int, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    placed = df.withColumn("__fold", F.floor(F.rand(seed) * k))
    return [(placed.where(F.col("__fold") != i).drop("__fold"), placed.where(F.col("__fold") == i).drop("__fold")) for i in range(k)]


def areas(curve: DataFrame) -> tuple[float, float]:
    """Areas under the ROC and the precision-recall curve of binary_curve(), by trapezoids; a row for each distinct score is summed in order."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("threshold"))
    c = curve.select("threshold", "recall", "fpr", "precision", F.lag("recall", 1, 0.0).over(w).alias("r0"), F.lag("fpr", 1, 0.0).over(w).alias("f0"), F.lag("precision").over(w).alias("p0"))
    roc = (F.col("fpr") - F.col("f0")) * (F.col("recall") + F.col("r0")) / 2
    pr = (F.col("recall") - F.col("r0")) * (F.col("precision") + F.coalesce("p0", "precision")) / 2
    return tuple(float(x or 0.0) for x in c.agg(F.sum(roc), F.sum(pr)).first())


def f_measures(curve: DataFrame, beta: float = 1.0) -> DataFrame:
    """threshold, f: the weighted harmonic mean of precision and recall."""
    b = beta * beta
    return curve.select("threshold", F.coalesce(F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f"))


#: loss -> (loss, its derivative by the margin x.w) for label y; labels are 0 and 1 for the last two
LOSSES = {
    "squared": (lambda z, y: 0.5 * (z - y) ** 2, lambda z, y: z - y),
    "logistic": (lambda z, y: np.logaddexp(0, z) - y * z, lambda z, y: 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y),
    "hinge": (lambda z, y: np.maximum(0, 1 - (2 * y - 1) * z), lambda z, y: np.where((2 * y - 1) * z < 1, -(2 * y - 1), 0.0)),
}


def loss_and_gradient(df: DataFrame, columns: list[str], label: str, weights: np.ndarray, loss: str, fraction: float = 1.0, seed: int = 42) -> tuple[float, np.ndarray, int]:
    """Sums over the rows (or a sample of them): partial sums by partition, then d + 2 numbers to the caller."""
    import pyarrow as pa

    value, slope = LOSSES[loss]

    def run(batches):
        total = np.zeros(len(weights) + 2)
        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) if b.num_rows else np.zeros((0, len(columns) + 1))
            x, y = m[:, :-1], m[:, -1]
            z = x @ weights
            total += np.concatenate([[value(z, y).sum(), len(y)], x.T @ slope(z, y)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = df if fraction >= 1 else df.sample(fraction, seed)
    sums = rows.select(*[F.col(c).cast("double") for c in [*columns, label]]).na.drop().mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(weights) + 2)
    for r in sums:
        out[r["i"]] = r["v"]
    return float(out[0]), out[2:], int(out[1])


def gradient_descent(df: DataFrame, columns: list[str], label: str, loss: str = "squared", step: float = 1.0, rounds: int = 100, penalty: str = "none", strength: float = 0.0, fraction: float = 1.0, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss before each round. Steps shrink with the root of the round; penalty: none, l1 (shrinkage) or l2."""
    w, past = np.zeros(len(columns)) if start is None else np.array(start, float), []
    for r in range(1, rounds + 1):
        value, g, n = loss_and_gradient(df, columns, label, w, loss, fraction, 42 + r)
        if not n:
            break
        size = step / np.sqrt(r)
        past.append(value / n + {"none": 0.0, "l1": strength * np.abs(w).sum(), "l2": 0.5 * strength * w @ w}[penalty])
        w = w * (1 - size * strength) - size * g / n if penalty == "l2" else w - size * g / n
        if penalty == "l1":
            w = np.sign(w) * np.maximum(0, np.abs(w) - size * strength)
    return w, past


def lbfgs(df: DataFrame, columns: list[str], label: str, loss: str = "squared", rounds: int = 50, memory: int = 10, strength: float = 0.0, tolerance: float = 1e-9, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss after each round, by limited-memory quasi-Newton steps with backtracking; l2 penalty."""
    kept = df.persist()
    try:
        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            value, g, n = loss_and_gradient(kept, columns, label, w, loss)
            return value / max(n, 1) + 0.5 * strength * w @ w, g / max(n, 1) + strength * w

        w = np.zeros(len(columns)) if start is None else np.array(start, float)
        (value, g), past, steps = at(w), [], []
        for _ in range(rounds):
            q, kept_a = g.copy(), []
            for s, y in reversed(steps):
                a = s @ q / (y @ s)
                kept_a.append(a)
                q -= a * y
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(g)))
            for (s, y), a in zip(steps, reversed(kept_a), strict=True):
                q += s * (a - y @ q / (y @ s))
            size = 1.0
            while size > 1e-10:
                new = w - size * q
                v, ng = at(new)
                if v <= value - 1e-4 * size * (g @ q):
                    break
                size /= 2
            else:
                break
            if (new - w) @ (ng - g) > 1e-12:
                steps = [*steps, (new - w, ng - g)][-memory:]
            gain, w, value, g = value - v, new, v, ng
            past.append(value)
            if gain <= tolerance * max(1.0, abs(value)):
                break
        return w, past
    finally:
        kept.unpersist()


def save_labelled(df: DataFrame, path: str, label: str, columns: list[str]) -> None:
    """Labelled rows as text: label and index:value of the values that aren't 0, indexes from 1."""
    parts = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i + 1}:"), F.col(c).cast("string"))) for i, c in enumerate(columns)]
    df.select(F.concat_ws(" ", F.col(label).cast("string"), *parts)).write.text(path)


def load_labelled(spark, path: str, columns: list[str]) -> DataFrame:
    """label and one column for each name, from text that save_labelled or others wrote."""
    pairs = F.expr("map_from_entries(transform(slice(split(value, ' '), 2, 1000000), x -> struct(cast(split(x, ':')[0] as int), cast(split(x, ':')[1] as double))))")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(F.split("value", " ")[0].cast("double").alias("label"), pairs.alias("m"))
    return rows.select("label", *[F.coalesce(F.try_element_at("m", F.lit(i + 1)), F.lit(0.0)).alias(c) for i, c in enumerate(columns)])
