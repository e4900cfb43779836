"""Linear and logistic regression by scaled conjugate gradients, and relative weights.

Linear regression works on one Gram matrix: gradients and losses need no further pass. The other tasks evaluate loss and
gradient together in one pass of partial sums; rows that fit one task (``local_cells``) are trained on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import activ, vec
from . import moments

EPS = 1e-15


def determine_task(df: DataFrame, y: str) -> str:
    """binary, multinomial or multilabel, of a one-hot or k-hot array column."""
    s = F.aggregate(F.transform(y, lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    r = df.agg(F.max(s).alias("most"), F.max(F.size(y)).alias("k"), F.max(F.array_max(y)).alias("hi"), F.min(F.array_min(y)).alias("lo")).first()
    if r["most"] is None or r["hi"] > 1 or r["lo"] < 0 or r["most"] < 1:
        raise ValueError("expects one-hot or k-hot arrays of 0 and 1")
    if r["most"] > 1:
        return "multilabel"
    return "binary" if r["k"] <= 2 else "multinomial"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _loss_grad(x: np.ndarray, y: np.ndarray, w: np.ndarray, task: str) -> tuple[float, np.ndarray]:
    """Summed cross-entropy and its gradient; x with intercept."""
    z = x @ w
    if task == "multinomial":
        top = z.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(z - top).sum(axis=1)) - ((z - top) * y).sum(axis=1)).sum())
        return loss, x.T @ (_softmax(z) - y)
    loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
    return loss, x.T @ (_sigmoid(z) - y)


def scaled_conjugate_gradient(f, w: np.ndarray, iterations: int, sigma0: float = 1e-6, tol: float = 1e-10) -> tuple[np.ndarray, list[float]]:
    """Moller's method. f(w) gives loss and gradient. Returns the best weights and the losses."""
    lam, bar, ok = 1e-6, 0.0, True
    value, grad = f(w)
    r = -grad
    p, losses = r.copy(), [value]
    delta = 0.0
    for k in range(1, iterations + 1):
        pp = float((p * p).sum())
        if pp < tol**2:
            break
        if ok:
            sigma = sigma0 / np.sqrt(pp)
            s = (f(w + sigma * p)[1] - grad) / sigma
            delta = float((p * s).sum())
        delta += (lam - bar) * pp
        if delta <= 0:
            bar = 2 * (lam - delta / pp)
            delta = lam * pp - delta
            lam = bar
        mu = float((p * r).sum())
        alpha = mu / delta
        trial = w + alpha * p
        new, new_grad = f(trial)
        gain = 2 * delta * (value - new) / mu**2 if mu else -1.0
        if gain >= 0 and np.isfinite(new):
            w, value, grad = trial, new, new_grad
            r_new = -grad
            bar, ok = 0.0, True
            p = r_new if k % max(1, w.size) == 0 else r_new + (float((r_new * r_new).sum()) - float((r_new * r).sum())) / mu * p
            r = r_new
            losses.append(value)
            if gain >= 0.75:
                lam = max(lam / 4, 1e-20)
            if float(np.abs(r).max()) < tol:
                break
        else:
            bar, ok = lam, False
        if gain < 0.25 and np.isfinite(gain):
            lam = min(lam + delta * (1 - gain) / pp, 1e24)
    return w, losses


@dataclass
class Regression:
    """task: regression, binary, multinomial or multilabel; the last three need y as an array column of 0 and 1
    (binary: one-hot of two, or a number column).

    ``reg_lambda`` weighs ``reg_alpha`` |W| + (1 - ``reg_alpha``) W^2 if ``use_elastic_reg``; the intercept is free.
    """

    task: str = "regression"
    reg_lambda: float = 0.1
    reg_alpha: float = 0.5
    use_elastic_reg: bool = False
    seed: int = 42
    local_cells: int = 5_000_000
    weights: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)
    r_square: float | None = None
    adjusted_r_square: float | None = None
    log_likelihood: float | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    n: int = 0

    def init_weights(self, d: int, k: int) -> np.ndarray:
        w = np.random.default_rng(self.seed).normal(0, np.sqrt(2 / d), (d + 1, k))
        w[0] = 0
        return w

    def elasticnet_loss(self, w: np.ndarray) -> float:
        return self.reg_lambda * float(self.reg_alpha * np.abs(w[1:]).sum() + (1 - self.reg_alpha) * (w[1:] ** 2).sum())

    def elasticnet_grad(self, w: np.ndarray) -> np.ndarray:
        out = self.reg_lambda * (self.reg_alpha * np.sign(w) + 2 * (1 - self.reg_alpha) * w)
        out[0] = 0
        return out

    def _penalised(self, f):
        if not self.use_elastic_reg:
            return f

        def g(w):
            loss, grad = f(w)
            return loss + self.elasticnet_loss(w), grad + self.elasticnet_grad(w)

        return g

    def fit(self, df: DataFrame, features: list[str] | str, y: str, iterations: int = 100) -> Regression:
        """features: number columns, or one array column; rows with a null or NaN in them or in y are left out."""
        self.features, self.y = features if isinstance(features, str) else list(features), y
        whole = isinstance(features, str)
        d = df.select(F.size(features)).first()[0] if whole else len(features)
        if whole and self.task == "regression":
            df = df.withColumns({f"__x{i}": F.col(features)[i] for i in range(d)})
            features = [f"__x{i}" for i in range(d)]
        if self.task == "regression":
            g = moments.gram(df, [*features, y])
            cov, mean, self.n = g.covariance(), g.mean, int(g.n)
            std = np.sqrt(np.maximum(np.diag(cov), 0))
            std[std == 0] = 1.0
            self.mean, self.std = mean, std
            z = cov / np.outer(std, std)
            G = np.zeros((d + 1, d + 1))
            G[0, 0], G[1:, 1:] = 1.0, z[:d, :d]
            c = np.r_[0.0, z[:d, d]][:, None]
            q = z[d, d]
            f = self._penalised(lambda w: (float((q - 2 * (w.T @ c) + w.T @ G @ w).item()) / 2, G @ w - c))
            self.weights, self.losses = scaled_conjugate_gradient(f, self.init_weights(d, 1), iterations)
            if not self.use_elastic_reg:
                # losses that differ by rounding only stop the search; a Newton step gives the last digits
                self.weights = self.weights - np.linalg.lstsq(G, f(self.weights)[1], rcond=None)[0]
            rss = float((q - 2 * (self.weights.T @ c) + self.weights.T @ G @ self.weights).item())
            self.r_square = 1 - rss / q if q > 0 else 0.0
            self.adjusted_r_square = 1 - (1 - self.r_square) * (self.n - 1) / max(1, self.n - d - 1)
            return self
        array = df.schema[y].dataType.simpleString().startswith("array")
        target = F.transform(y, lambda x: x.cast("double")) if array else F.array(F.col(y).cast("double"))
        x = F.col(features).cast("array<double>") if whole else F.array(*(moments.clean(F.col(f"`{c}`")) for c in features))
        rows = df.select(x.alias("x"), target.alias("y"))
        rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull() & F.forall("y", lambda v: v.isNotNull()))
        # every pass reads these narrow rows, not what they were made from
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        g = moments.vector_gram(rows, "x", d)
        self.n, self.mean = int(g.n), g.mean
        std = np.sqrt(np.maximum(np.diag(g.covariance()), 0))
        self.std = np.where(std > 0, std, 1.0)
        k = rows.select(F.size("y")).first()[0]
        task, mean, std = self.task, self.mean, self.std

        def flat(column):
            return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

        def parts(batch):
            x, t = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n) for c, n in ((flat(batch.column(0)), d), (flat(batch.column(1)), k)))
            return np.c_[np.ones(len(x)), (x - mean) / std], t

        if self.n * (d + k) <= self.local_cells:
            x, t = parts(rows.toArrow())
            f = lambda w: tuple(v / max(1, len(x)) for v in _loss_grad(x, t, w, task))
        else:
            def f(w):
                def run(batches):
                    loss, grad = 0.0, np.zeros_like(w)
                    for batch in batches:
                        if len(batch):
                            a, b = _loss_grad(*parts(batch), w, task)
                            loss, grad = loss + a, grad + b
                    yield pa.RecordBatch.from_pydict({"m": [np.r_[loss, grad.ravel()].tolist()]})

                s = rows.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
                return s[0] / self.n, s[1:].reshape(w.shape) / self.n

        self.weights, self.losses = scaled_conjugate_gradient(self._penalised(f), self.init_weights(d, k), iterations)
        final = f(self.weights)[0]
        share = np.array([v or 0.0 for v in rows.agg(*(F.avg(F.col("y")[i]) for i in range(k))).first()])
        p = np.clip(share, EPS, 1 - EPS)
        null = -float((share * np.log(p)).sum()) if task == "multinomial" else -float((share * np.log(p) + (1 - share) * np.log(1 - p)).sum())
        rows.unpersist()
        self.log_likelihood = -final
        self.r_square, self.adjusted_r_square = (1 - final / null if null > 0 else 0.0), -1.0
        return self

    def logits(self) -> list[Column]:
        """Of each output, for standardised inputs (and output, in regression)."""
        if isinstance(self.features, str):
            d = len(self.weights) - 1
            x, slopes = F.col(self.features).cast("array<double>"), self.weights[1:] / self.std[:d, None]
            return [vec.dot(x, F.array(*map(F.lit, col.tolist()))) + float(first - self.mean[:d] @ col) for col, first in zip(slopes.T, self.weights[0], strict=True)]
        x = [(moments.clean(F.col(f"`{c}`")) - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.std, strict=False)]
        out = []
        for col in self.weights.T:
            e: Column = F.lit(float(col[0]))
            for a, w in zip(x, col[1:], strict=True):
                e = e + a * float(w)
            out.append(e)
        return out

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the prediction: a number for regression, an array of probabilities otherwise. A projection."""
        z = self.logits()
        if self.task == "regression":
            d = len(self.weights) - 1
            return df.withColumn(output, z[0] * float(self.std[d]) + float(self.mean[d]))
        return df.withColumn(output, activ.softmax(F.array(*z)) if self.task == "multinomial" else F.array(*(activ.sigmoid(c) for c in z)))

    def fit_predict(self, df: DataFrame, features: list[str], y: str, **kw) -> DataFrame:
        return self.fit(df, features, y, **kw).predict(df)

    def get_weights(self) -> np.ndarray:
        return self.weights

    def get_residuals(self, df: DataFrame) -> DataFrame:
        """df with prediction and residual."""
        return self.predict(df).withColumn("residual", F.col(f"`{self.y}`") - F.col("prediction"))


def ols(df: DataFrame, features: list[str], y: str) -> np.ndarray:
    """Intercept and slopes by the normal equations of one Gram matrix."""
    g = moments.gram(df, [*features, y])
    c = g.covariance()
    slopes = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    return np.r_[g.mean[-1] - g.mean[:-1] @ slopes, slopes]


@dataclass
class RelativeWeights:
    raw: np.ndarray
    normalized: np.ndarray
    signed: np.ndarray
    betas: np.ndarray
    r2: float
    features: list[str]
    model: Regression | None = None


def relative_weights(df: DataFrame, features: list[str], y: str, logistic: bool = False) -> RelativeWeights:
    """Johnson's relative weights: the square root of the predictors' correlations carries the coefficients of y on
    orthogonal predictors back to the features. The raw weights of a linear fit add up to R^2.

    ``logistic``: y is 0 or 1; the coefficients are those of a logistic fit on the standardised predictors, scaled by
    sqrt(pseudo R^2) over the logits' standard deviation.
    """
    g = moments.gram(df, [*features, y])
    r = g.correlation()
    rxx, rxy = r[:-1, :-1], r[:-1, -1]
    values, vectors = np.linalg.eigh(rxx)
    values = np.maximum(values, 1e-12)
    root = vectors @ np.diag(np.sqrt(values)) @ vectors.T
    model = None
    if logistic:
        model = Regression("binary").fit(df, features, y)
        b = model.weights[1:, 0]
        spread = float(np.sqrt(max(b @ rxx @ b, 0.0)))
        beta = root @ b * np.sqrt(max(model.r_square, 0) + EPS) / (spread + EPS)
        signs, r2 = np.sign(b), model.r_square
    else:
        beta = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T @ rxy
        signs, r2 = np.sign(rxy), float(beta @ beta)
    raw = (root**2) @ (beta**2)
    span = raw.max() - raw.min()
    return RelativeWeights(raw, (raw - raw.min()) / span if span > 0 else np.zeros_like(raw), signs * raw, beta, r2, list(features), model)


def onehot_target(column: str, classes: int) -> Column:
    return vec.to_onehot(F.col(column), classes)
