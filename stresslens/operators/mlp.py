"""Small early-warning networks: features, forward pass, ensembles, sensitivity and training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.functions.scalars import sigmoid


def features(channels: list[str], scale: float = 100.0) -> Column:
    """Array of clipped channel scores (missing as 0), followed by a missing flag for each."""
    unit = [F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / scale)), F.lit(0.0)) for c in channels]
    values = [F.when(F.col(c).isNull(), 0.0).otherwise(u) for c, u in zip(channels, unit, strict=True)]
    return F.array(*values, *[F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in channels])


def dense(x: Column, weights: list[list[float]], bias: list[float], activation=F.tanh) -> Column:
    """One layer over an array column: weights[input][output]."""
    outs = []
    for k in range(len(bias)):
        terms = [F.get(x, F.lit(i)).cast("double") * float(row[k]) for i, row in enumerate(weights)]
        total = F.lit(float(bias[k]))
        for t in terms:
            total = total + t
        outs.append(activation(total))
    return F.array(*outs)


def forward(x: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Probability of a network: tanh layers, the last one logistic."""
    for weights, bias in layers[:-1]:
        x = dense(x, weights, bias)
    return F.get(dense(x, *layers[-1], activation=sigmoid), F.lit(0))


def ensemble(members: list[Column]) -> tuple[Column, Column]:
    """Mean and population deviation of several probabilities of a row."""
    mean = sum(members[1:], members[0]) / float(len(members))
    square = [(m - mean) * (m - mean) for m in members]
    return mean, F.sqrt(sum(square[1:], square[0]) / float(len(members)))


def sensitivity(rows: DataFrame, key: str, x: str, n: int, layers, limit: int = 6) -> DataFrame:
    """For each row the ``limit`` inputs (of the first n) whose removal changes the probability most."""
    from pyspark.sql import Window

    zeroed = rows.select(key, x, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("feature"))
    without = F.transform(F.col(x), lambda v, i: F.when(i == F.col("feature"), 0.0).otherwise(v.cast("double")))
    scored = zeroed.select(key, "feature", forward(F.col(x), layers).alias("p"), without.alias("z"))
    delta = scored.select(key, "feature", F.round(F.col("p") - forward(F.col("z"), layers), 6).alias("delta"))
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("delta")), "feature")
    return delta.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


#: Cells of the two hidden layers, epochs, epochs between validations, checks without gain before the end and before each decay.
HIDDEN, EPOCHS, EVERY, PATIENCE, STALE = (12, 6), 1400, 10, 35, 12


def _unpack(flat: np.ndarray, n_in: int, hidden: tuple[int, ...]) -> list[np.ndarray]:
    """The weights and biases of each layer, from one vector of them in order."""
    model, at, sizes = [], 0, (n_in, *hidden, 1)
    for a, b in zip(sizes, sizes[1:], strict=False):
        model += [flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]]
        at += a * b + b
    return model


def _forward(model: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives, the probabilities last."""
    outs = [x]
    for w, b in zip(model[:-2:2], model[1:-2:2], strict=True):
        outs.append(np.tanh(outs[-1] @ w + b))
    return [*outs, 1 / (1 + np.exp(-np.clip(outs[-1] @ model[-2] + model[-1], -35, 35).ravel()))]


def _loss(y: np.ndarray, p: np.ndarray, heavy: float) -> float:
    return float((np.where(y > 0.5, heavy, 1.0) * -(y * np.log(p + 1e-8) + (1 - y) * np.log(1 - p + 1e-8))).mean())


def _train(x, y, xv, yv, seed: int, hidden: tuple[int, ...] = HIDDEN, epochs: int = EPOCHS, rate: float = 0.035, decay: float = 0.0015) -> tuple[list[float], float, int]:
    """Full-batch gradient descent with class weight and clipped gradients: the best validated weights, their loss, epochs run."""
    rng, sizes, model = np.random.default_rng(seed), (x.shape[1], *hidden, 1), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        limit = np.sqrt(6 / (a + b))
        model += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
    heavy = min(8.0, max(1, int((y == 0).sum())) / max(1, int((y == 1).sum())))
    weight, best, best_loss, stale = np.where(y > 0.5, heavy, 1.0), [v.copy() for v in model], float("inf"), 0
    for epoch in range(epochs):
        *outs, p = _forward(model, x)
        back, grads = ((p - y) * weight / len(y)).reshape(-1, 1), []
        for layer in reversed(range(len(outs))):
            w = model[2 * layer]
            grads = [outs[layer].T @ back + decay * w, back.sum(0), *grads]
            back = back @ w.T * (1 - outs[layer] * outs[layer])
        for value, grad in zip(model, grads, strict=True):
            value -= rate * np.clip(grad, -2, 2)
        if epoch % EVERY == 0:
            loss = _loss(yv, _forward(model, xv)[-1], heavy)
            if loss + 1e-5 < best_loss:
                best, best_loss, stale = [v.copy() for v in model], loss, 0
            else:
                stale += 1
            if stale >= PATIENCE:
                break
            if stale and stale % STALE == 0:
                rate *= 0.7
    return [float(v) for part in best for v in part.ravel()], best_loss, epoch + 1


def train_ensemble(rows: DataFrame, seeds: list[int], bound: int = 4000, held: Column | None = None) -> DataFrame:
    """(seed, n, n_validation, epochs, loss, weights): one network for each seed on ``rows(id, x, y)``, seeds in parallel.

    A network this small is fitted on a bounded sample: the ``bound`` rows
    with the smallest hash of id.  ``held`` marks validation rows (a fifth by
    hash of id if not given); loss is the validation loss of the weights kept.
    """
    held = F.pmod(F.xxhash64("id", F.lit("validation")), F.lit(5)) == 0 if held is None else held
    sample = rows.withColumn("held", held).orderBy(F.xxhash64("id"), "id").limit(bound)
    copies = sample.select("x", "y", "id", "held", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        seed, kept = int(frame["seed"].iloc[0]), frame["held"].to_numpy(bool)
        if kept.all() or not kept.any():
            raise ValueError("training needs rows of both kinds, for fitting and for validation")
        x, y = np.stack(frame["x"].to_numpy()).astype(float), frame["y"].to_numpy(float)
        weights, loss, epochs = _train(x[~kept], y[~kept], x[kept], y[kept], seed)
        return pd.DataFrame([(seed, int((~kept).sum()), int(kept.sum()), epochs, loss, weights)], columns=["seed", "n", "n_validation", "epochs", "loss", "weights"])

    return copies.groupBy("seed").applyInPandas(fit, "seed int, n int, n_validation int, epochs int, loss double, weights array<double>")
