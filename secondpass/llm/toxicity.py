"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its lower-case words. Runs of more than ``WHOLE`` bytes (joined words, scripts
without spaces) are parted at underscores, and parts that are still longer are cut into
pieces of ``PIECE`` characters, one from every character on, so a term gives the same
pieces wherever it stands; parts and pieces are words like others. A word enters as two inputs: a row of a hashed word table and the
mean of the hashed rows of all its character trigrams. All windows of
``WINDOW`` words, each overlapping half of the next, pass through the network; the
score of a text is that of its worst window. The label belongs to the text, so the
network learns from the windows that it rates worst, chosen anew every round.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS`` of each class at
most, taken by a hash of the id, texts of up to ``TRAIN_CHARS`` characters) whose
crc32(doc_id) mod 5 is not 0. Scoring reads every whole text.

Defined results: null and empty texts, or texts without words, are scored as one
empty window; a null id is scored and never learned from; equal rows stay rows;
an empty table gives no rows; without labels of both kinds the score is 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondpass.llm.common import held_out, id_and_text

WINDOW, STRIDE = 32, 16
WHOLE, PIECE = 64, 4
TRAIN_ROWS = 2500
TRAIN_CHARS = 40_000
_WORD_ROWS, _CHAR_ROWS, _WIDTH, _HIDDEN, _ATTEND = 1 << 15, 1 << 12, 8, 8, 8
_CACHE, _CHUNK = 300_000, 512
_WORDS = re.compile(r"\w+")


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; long runs in parts and overlapping pieces."""
    words = _WORDS.findall((text or "").lower())
    # No character has more than four bytes.
    if max(map(len, words), default=0) * 4 <= WHOLE:
        return words
    out: list[str] = []
    for word in words:
        if len(word.encode()) <= WHOLE:
            out.append(word)
            continue
        for part in filter(None, word.split("_")):
            if len(part.encode()) <= WHOLE:
                out.append(part)
            else:
                out += [part[i:i + PIECE] for i in range(len(part) - PIECE + 1)]
    return out


def inputs_of(word: str) -> tuple[int, np.ndarray]:
    """Row of the word and rows of its character trigrams."""
    framed = f"^{word}$".encode()
    grams = [zlib.crc32(framed[i:i + 3]) % _CHAR_ROWS for i in range(max(1, len(framed) - 2))]
    return zlib.crc32(word.encode()) % _WORD_ROWS, np.array(grams)


def windows(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; there is always one and the last reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def cut(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of word numbers; -1 fills the last one."""
    starts = windows(len(ids))
    padded = np.full(starts[-1] + WINDOW, -1, dtype=np.int64)
    padded[:len(ids)] = ids
    return padded[starts[:, None] + np.arange(WINDOW)]


@dataclass
class Network:
    """Parameters by name; scoring and one gradient."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.2: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": draw(_WORD_ROWS, _WIDTH, scale=0.05), "char": draw(_CHAR_ROWS, _WIDTH, scale=0.05)}
        for side in "fb":
            p |= {f"W{side}": draw(2 * _WIDTH, 3 * _HIDDEN), f"U{side}": draw(_HIDDEN, 3 * _HIDDEN),
                  f"b{side}": np.zeros(3 * _HIDDEN, np.float32)}
        p |= {"A": draw(2 * _HIDDEN, _ATTEND), "v": draw(_ATTEND), "w": draw(2 * _HIDDEN), "c": np.zeros(1, np.float32)}
        return cls(p)

    def run(self, x: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits; ``x`` holds the input part of all gates of every word, ``at`` the words of every window."""
        n, steps = mask.shape
        states = np.zeros((n, steps, 2 * _HIDDEN), np.float32)
        at, full = np.ascontiguousarray(at.T), mask.all(0)
        h2 = 2 * _HIDDEN
        for part, side in enumerate("fb"):
            U, h = self.p[f"U{side}"], np.zeros((n, _HIDDEN), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                rec, given = h @ U, x[side][at[t]]
                gates = _sigmoid(given[:, :h2] + rec[:, :h2])
                z, r = gates[:, :_HIDDEN], gates[:, _HIDDEN:]
                new = np.tanh(given[:, h2:] + r * rec[:, h2:])
                m = mask[:, t, None]
                if keep is not None:
                    keep.append((part, side, t, h, z, r, new, rec[:, h2:], m))
                moved = new + z * (h - new)
                h = moved if full[t] else m * moved + (1 - m) * h
                states[:, t, part * _HIDDEN:(part + 1) * _HIDDEN] = h
        heat = np.tanh(states @ self.p["A"])
        weight = heat @ self.p["v"] + (mask - 1) * 30
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", weight, states)
        if keep is not None:
            keep.append((states, heat, weight, pooled))
        return pooled @ self.p["w"] + self.p["c"][0]

    def embed(self, table) -> np.ndarray:
        return np.concatenate([self.p["word"][table.rows], table.gram_mean(self.p["char"])], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"W{side}"] + self.p[f"b{side}"] for side in "fb"}

    def gradient(self, table, grid: np.ndarray, y: np.ndarray, class_weight: np.ndarray) -> dict:
        """Gradient of the log loss over windows of word numbers into ``table``."""
        mask = (grid >= 0).astype(np.float32)
        used, inverse = np.unique(np.maximum(grid, 0), return_inverse=True)
        part = table.take(used)
        vectors = self.embed(part)
        inverse = inverse.reshape(grid.shape)
        x = vectors[inverse]
        kept: list = []
        logit = self.run(self.project(vectors), inverse, mask, kept)
        p, g = self.p, {}
        d = class_weight * (_sigmoid(logit) - y) / len(y)
        states, heat, weight, pooled = kept.pop()
        g["w"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["w"]
        d_states = weight[:, :, None] * d_pool[:, None, :]
        d_weight = np.einsum("nk,ntk->nt", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", d_score, heat)
        d_heat = d_score[:, :, None] * p["v"] * (1 - heat * heat)
        g["A"] = np.einsum("ntk,nta->ka", states, d_heat)
        d_states += d_heat @ p["A"].T
        d_x = np.zeros_like(x)
        for side in "fb":
            g[f"U{side}"], g[f"W{side}"] = np.zeros_like(p[f"U{side}"]), np.zeros_like(p[f"W{side}"])
            g[f"b{side}"] = np.zeros_like(p[f"b{side}"])
        carry, last = None, None
        for number, side, t, h, z, r, new, rec_n, m in reversed(kept):
            if side != last:
                carry, last = np.zeros_like(h), side
            dh = carry + d_states[:, t, number * _HIDDEN:(number + 1) * _HIDDEN]
            up = m * dh
            d_new = up * (1 - z) * (1 - new * new)
            d_z = up * (h - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], axis=1)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[f"U{side}"] += h.T @ d_rec
            g[f"W{side}"] += x[:, t].T @ d_in
            g[f"b{side}"] += d_in.sum(0)
            d_x[:, t] += d_in @ p[f"W{side}"].T
            carry = (1 - m) * dh + up * z + d_rec @ p[f"U{side}"].T
        d_words = np.zeros_like(vectors)
        np.add.at(d_words, inverse.reshape(-1), (d_x * mask[:, :, None]).reshape(-1, d_x.shape[2]))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], part.rows, d_words[:, :_WIDTH])
        part.add_gram_gradient(g["char"], d_words[:, _WIDTH:])
        return g


class Words:
    """Distinct words with their input rows."""

    def __init__(self, rows: np.ndarray, grams: list[np.ndarray]):
        self.rows, self.grams = rows, grams
        self.sizes = np.array([len(x) for x in grams], dtype=np.int64)
        self.flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)

    def take(self, used: np.ndarray) -> Words:
        return Words(self.rows[used], [self.grams[i] for i in used])

    def gram_mean(self, char: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.sizes) - self.sizes
        return np.add.reduceat(char[self.flat], starts, axis=0) / self.sizes[:, None].astype(np.float32)

    def add_gram_gradient(self, out: np.ndarray, d: np.ndarray) -> None:
        np.add.at(out, self.flat, np.repeat(d / self.sizes[:, None], self.sizes, axis=0))


def number_words(texts: list[str | None]) -> tuple[Words, list[np.ndarray]]:
    seen: dict[str, int] = {"": 0}
    docs = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], np.int64) for t in texts]
    rows, grams = zip(*map(inputs_of, seen))
    return Words(np.array(rows), list(grams)), docs


def _worst(logits: np.ndarray, owner: np.ndarray, n: int, count: int) -> np.ndarray:
    """Windows with the highest logits of every text, up to ``count`` each."""
    order = np.lexsort((-logits, owner))
    first = np.searchsorted(owner[order], np.arange(n))
    return order[np.arange(len(order)) - first[owner[order]] < count]


def train(texts: list[str | None], labels: list[int], rounds: int = 3, epochs: int = 4, seed: int = 7) -> Network:
    """Fit on whole texts; the first choice of windows follows the words' odds of being in a toxic text."""
    table, docs = number_words(texts)
    y = np.array(labels, dtype=np.float32)
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    having = np.zeros((2, len(table.rows)))
    for ids, label in zip(docs, labels):
        having[int(label), np.unique(ids)] += 1
    odds = np.log((having[1] + 0.5) / (y.sum() + 1)) - np.log((having[0] + 0.5) / (len(y) - y.sum() + 1))
    # Words of one or two texts prove nothing: their odds shrink with their evidence.
    odds *= having.sum(0) / (having.sum(0) + 5)
    net.p["word"][table.rows, 0] = np.clip(odds, -3, 4) / 2
    grids = [cut(ids) for ids in docs]
    owner = np.repeat(np.arange(len(docs)), [len(g) for g in grids])
    grid = np.concatenate(grids)
    logits = np.where(grid >= 0, odds[np.maximum(grid, 0)], -9).max(1)
    weights = np.where(y == 1, min(4.0, max(1.0, (1 - y.mean()) / max(y.mean(), 1e-6)) ** 0.5), 1.0).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for number in range(rounds):
        if number:
            logits = score_grid(net, net.project(net.embed(table)), grid)
        top = _worst(logits, owner, len(docs), 2)
        best = np.zeros(len(owner), bool)
        best[_worst(logits, owner, len(docs), 1)] = True
        chosen = top[best[top] | (y[owner[top]] == 0)]
        for _ in range(epochs):
            rng.shuffle(chosen)
            for low in range(0, len(chosen), 128):
                batch = chosen[low:low + 128]
                grad = net.gradient(table, grid[batch], y[owner[batch]], weights[owner[batch]])
                step += 1
                for k, d in grad.items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d * d - second[k])
                    move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
                    net.p[k] -= (0.003 if k in ("word", "char") else 0.01) * move.astype(np.float32)
    return net


def score_grid(net: Network, gates: dict[str, np.ndarray], grid: np.ndarray) -> np.ndarray:
    """Logits of windows of word numbers, given the gate inputs of every word."""
    out = np.empty(len(grid), np.float32)
    for low in range(0, len(grid), _CHUNK):
        part = grid[low:low + _CHUNK]
        out[low:low + len(part)] = net.run(gates, np.maximum(part, 0), (part >= 0).astype(np.float32))
    return out


class Scorer:
    """Scores whole texts; the gate inputs of words seen before are kept, up to ``_CACHE`` words."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.gates = None

    def _extend(self) -> None:
        known = 0 if self.gates is None else len(self.gates["f"])
        if known == len(self.seen):
            return
        fresh = list(self.seen)[known:]
        rows, grams = zip(*map(inputs_of, fresh))
        new = self.net.project(self.net.embed(Words(np.array(rows), list(grams))))
        self.gates = new if self.gates is None else {s: np.concatenate([self.gates[s], new[s]]) for s in "fb"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.seen) > _CACHE:
            self._clear()
        seen = self.seen
        docs = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], np.int64) for t in texts]
        self._extend()
        grids = [cut(ids) for ids in docs]
        starts = np.cumsum([0] + [len(g) for g in grids[:-1]])
        return _sigmoid(np.maximum.reduceat(score_grid(self.net, self.gates, np.concatenate(grids)), starts).astype(float))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Network | None:
    """Train on a bounded sample of labelled rows; None where a class is missing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(rows).unionByName(known.where("y = 0").orderBy(*order).limit(rows))
    # At most 2 * rows ids: small enough to broadcast at every size of the corpus.
    sample = id_and_text(docs).where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    found = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * rows).select("text", "y").collect()
    if len({r["y"] for r in found}) < 2:
        return None
    return train([r["text"] for r in found], [r["y"] for r in found])


def score(docs: DataFrame, net: Network | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = id_and_text(docs, id_col, text_col)
    if net is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(net.p)

        def compute(batches):
            scorer = Scorer(Network(shared.value))
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    part = batch.slice(low, 64)
                    found = scorer.scores(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

        scored = rows.mapInArrow(compute, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, net: Network | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def keep(batches):
        scorer = Scorer(Network(shared.value))
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                yield part.filter(pa.array(scorer.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
