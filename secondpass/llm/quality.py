"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; everything else is unlabelled web
text. The class prior of the unlabelled texts is estimated first: a classifier of
positives against unlabelled texts gives a score, and the prior cannot exceed the
ratio of the two tails of that score, whatever the threshold (with the sampling error
of both tails); the smallest such bound is the estimate. A small network then
minimises the non-negative unbiased risk: prior * loss of the positives as good, plus
the loss of the unlabelled as bad minus prior * loss of the positives as bad, where
the second part counting as zero where a batch makes it negative.

Inputs are measures of the whole text only: shares of kinds of bytes, repetition of
words and lines, lengths. Training reads a bounded sample, ``POSITIVES`` labelled and
``UNLABELLED`` other rows at most, both with crc32(doc_id) mod 5 not 0; labelled bad
rows are never used as such. Scoring reads every whole text.

Defined results: null and empty texts are measured as empty and scored; a null id is
never learned from; equal rows stay rows; an empty table gives no rows; without
positives or unlabelled rows the score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import held_out, id_and_text

POSITIVES, UNLABELLED = 4000, 8000
HIDDEN = 16
BATCH = 1024  # large, so that the sampling noise of a batch does not make its risk negative
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_FLOOR = 1e-3


def measures(text: str | None) -> np.ndarray:
    """Measures of one whole text."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    share = raw / size
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    counted, lined = Counter(words), Counter(lines)
    n, m = max(1, len(words)), max(1, len(lines))
    frequent = counted.most_common(3)
    shares = [
        share[97:123].sum(), share[65:91].sum(), share[48:58].sum(), share[[9, 10, 11, 12, 13]].sum(), share[32],
        share[_MARKS].sum(), share[_MARKS].max(), share[128:].sum(),
        frequent[0][1] / n if frequent else 0, sum(c for _, c in frequent) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(len(w) < 2 for w in words) / n,
        1 - len(lined) / m, max(lined.values(), default=0) / m,
        sum(not w[-1:].isalnum() and len(w) > 1 for w in words) / n, sum(any(c.isdigit() for c in w) for w in words) / n,
        *share[_MARKS],
    ]
    present = share[share > 0]
    plain = [
        np.log1p(len(words)), len(text) / n / 4, len(counted) / n, len(counted) / n ** 0.75, np.log1p(m),
        len(words) / m / 50, float(-(present * np.log(present)).sum()), np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([np.log(np.array(shares) + _FLOOR) - np.log(_FLOOR), plain])


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        W, b, v, c = self.parts
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ W + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _descend(positive: np.ndarray, other: np.ndarray, risk, epochs: int, seed: int, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam over batches of both sets; ``risk`` gives the slopes of the loss at the logits of both."""
    rng, n = np.random.default_rng(seed), positive.shape[1]
    parts = [rng.normal(0, n ** -0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    size = BATCH
    for _ in range(epochs):
        order = rng.permutation(len(other))
        for low in range(0, len(order), size):
            p = positive[rng.integers(0, len(positive), size)]
            x = np.concatenate([p, other[order[low:low + size]]])
            W, b, v, c = parts
            hidden = np.tanh(x @ W + b)
            slope = risk(hidden @ v + c[0], len(p))
            back = slope[:, None] * v * (1 - hidden * hidden)
            grads = [x.T @ back + decay * W, back.sum(0), hidden.T @ slope + decay * v, np.array([slope.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                parts[k] = parts[k] - 0.005 * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return parts


def estimate_prior(positive: np.ndarray, other: np.ndarray, seed: int = 7) -> float:
    """Share of positives among ``other``: fitted on one half of both, the tails are compared on the other half."""
    def against(logit, n):
        target = np.arange(len(logit)) < n
        return (_sigmoid(logit) - target) / np.where(target, n, max(1, len(logit) - n))

    bounds = []
    for half in (0, 1):
        parts = _descend(positive[half::2], other[half::2], against, 60, seed)
        W, b, v, c = parts
        tails = []
        for x in (positive[1 - half::2], other[1 - half::2]):
            tails.append(np.sort(np.tanh(x @ W + b) @ v + c[0]))
        p, u = tails
        for cut in np.quantile(p, np.linspace(0.02, 0.9, 45)):
            in_p, in_u = (p >= cut).mean(), (u >= cut).mean()
            error = 2 * np.sqrt(in_u * (1 - in_u) / len(u)) + 2 * in_u / max(in_p, 1e-9) * np.sqrt(in_p * (1 - in_p) / len(p))
            bounds.append((in_u + error) / in_p)
    return float(np.clip(min(bounds), 0.01, 0.99))


def train(positive: np.ndarray, other: np.ndarray, prior: float | None = None, epochs: int = 100, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk over measures of positives and unlabelled texts."""
    mean, scale = other.mean(0), other.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, other))
    prior = estimate_prior(p, u, seed) if prior is None else prior

    def risk(logit, n):
        good, rest = logit[:n], logit[n:]
        bad_risk = np.logaddexp(0, rest).mean() - prior * np.logaddexp(0, good).mean()
        slope_bad = np.concatenate([-prior * _sigmoid(good) / n, _sigmoid(rest) / max(1, len(rest))])
        slope_good = np.concatenate([prior * (_sigmoid(good) - 1) / n, np.zeros(len(rest))])
        return slope_good if bad_risk < 0 else slope_good + slope_bad

    return Model(mean, scale, _descend(p, u, risk, epochs, seed))


def _measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``docs`` (text first) as the columns ``extra`` and the measures of the text."""

    def compute(batches):
        for batch in batches:
            found = pa.array([measures(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], [*extra, "measures"])

    kinds = dict(docs.dtypes)
    return docs.select("text", *extra).mapInArrow(compute, ", ".join([*(f"{c} {kinds[c]}" for c in extra), "measures array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Model from bounded samples by a hash of the id; None where one of the two sets is empty."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    free = ~held_out() & F.col("doc_id").isNotNull()
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(free).distinct()
    good = good.orderBy(*order).limit(positives).withColumn("good", F.lit(1))
    rows = id_and_text(docs).where(free)
    ids = rows.select("doc_id").distinct().join(F.broadcast(good.select("doc_id")), "doc_id", "left_anti")
    chosen = good.unionByName(ids.orderBy(*order).limit(unlabelled).withColumn("good", F.lit(0)))
    # At most positives + unlabelled ids, so they may be broadcast.
    sample = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = _measured(sample, ["good"]).collect()
    table = [np.array([r["measures"] for r in found if r["good"] == g]) for g in (1, 0)]
    return train(*table) if all(map(len, table)) else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = id_and_text(docs, id_col, text_col)

    def compute(batches):
        for batch in batches:
            texts = batch.column(1)
            if batch.num_rows:
                found = model.scores(np.stack([measures(t.as_py()) for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = rows.mapInArrow(compute, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
