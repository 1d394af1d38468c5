"""Ranked lexical search: branch and bound over document FP-trees.

The items are the queries. Documents are restricted to the items' terms. A task lays its
documents out as FP-trees: terms ordered from most to least frequent, documents sorted by
these term vectors, so documents with a common beginning share a path and every node is
a stretch of documents. Chains of single children are one node, and neighbouring small
branches share a leaf of at most ``LEAF`` documents. A node holds the largest tf of every term
below it and the smallest m below it; the score cannot fall with tf nor rise with m, so both
bound every score of the subtree. Each item walks the tree depth first, best child first,
and skips a subtree that cannot reach its current top. The tops of a task carry over from
tree to tree, and only they leave the task.

Items are searched in blocks of about ``TERMS`` terms, so what a task holds of them is bounded
however many there are; all documents are scanned for every block.

Defined results: every row of ``items`` is an item, also with a null or repeated id; items
without a term, or whose terms no document of weight has, return nothing; null or wordless
documents are not counted and not found; equal scores go to the smaller id, null ids last; rows with
equal ids are documents of their own; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondpass.llm.common import id_and_text, words_of
from secondpass.session import pin

TOP = 10
LEAF, TREE = 32, 4096  # documents of a leaf, and of a tree
CELLS = 1 << 24  # of a tree's table of documents and terms
TERMS = 20_000  # terms of the items searched together
_NO_ID = 2**63 - 1


def contributions(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum over terms (last axis) of w * ((10^9 tf) div (1000 tf + 8 m))."""
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None]))).sum(axis=1)


class Tree:
    """Documents in tree order, and for every node its stretch, children, tf maxima, m minimum and smallest id."""

    def __init__(self, vectors: list[np.ndarray], tfs: list[np.ndarray], ids: np.ndarray, m: np.ndarray, terms: int):
        order = sorted(range(len(vectors)), key=lambda i: vectors[i].astype(">u4").tobytes())
        self.vectors = [vectors[i] for i in order]
        self.ids, self.m = ids[order], m[order]
        sizes = [len(v) for v in self.vectors]
        self.tf = np.zeros((len(order), terms), np.int32)
        self.tf[np.repeat(np.arange(len(order)), sizes), np.concatenate(self.vectors)] = np.concatenate([tfs[i] for i in order])
        self.spans, self.children = [], []
        self._grow(0, len(order))
        self.tf_max = np.zeros((len(self.spans), terms), np.int32)
        self.m_min, self.id_min = np.zeros(len(self.spans), np.int64), np.zeros(len(self.spans), np.int64)
        for node in reversed(range(len(self.spans))):  # children are numbered after their parents
            below = self.children[node]
            if below:
                self.tf_max[node] = self.tf_max[below].max(axis=0)
                self.m_min[node], self.id_min[node] = self.m_min[below].min(), self.id_min[below].min()
            else:
                low, high = self.spans[node]
                self.tf_max[node] = self.tf[low:high].max(axis=0)
                self.m_min[node], self.id_min[node] = self.m[low:high].min(), self.ids[low:high].min()

    def _grow(self, low: int, high: int) -> None:
        self.spans.append((low, high))
        self.children.append([])
        waiting = [0]
        while waiting:
            node = waiting.pop()
            low, high = self.spans[node]
            if high - low <= LEAF:
                continue
            for stretch in self._branches(low, high):
                self.children[node].append(len(self.spans))
                waiting.append(len(self.spans))
                self.spans.append(stretch)
                self.children.append([])

    def _branches(self, low: int, high: int) -> list[tuple[int, int]]:
        """Stretches of the children: by the first term in which the vectors differ, small neighbours together."""
        first, last = self.vectors[low], self.vectors[high - 1]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[:n] != last[:n])
        depth = int(differ[0]) if len(differ) else n
        if len(first) == len(last) == depth:  # all alike
            return [(i, min(high, i + LEAF)) for i in range(low, high, LEAF)]
        at = np.array([v[depth] if len(v) > depth else -1 for v in self.vectors[low:high]])
        edges = [low, *(low + 1 + np.flatnonzero(np.diff(at))).tolist(), high]
        out, start = [], low
        for a, b in zip(edges, edges[1:]):
            if b - start > LEAF:
                if a > start:
                    out.append((start, a))
                start = a
                if b - a > LEAF:
                    out.append((a, b))
                    start = b
        if start < high:
            out.append((start, high))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, top: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """The best (-score, id) of ``top`` and this tree, at most ``size``, best first."""
        bounds = contributions(weights, self.tf_max[:, terms], self.m_min).tolist()
        waiting = [0]
        while waiting:
            node = waiting.pop()
            best = (-bounds[node], self.id_min[node])
            if not bounds[node] or (len(top) == size and best > top[-1]):
                continue
            if self.children[node]:
                waiting.extend(sorted(self.children[node], key=bounds.__getitem__))
                continue
            low, high = self.spans[node]
            scores = contributions(weights, self.tf[low:high][:, terms], self.m[low:high])
            found = [(-s, i) for s, i in zip(scores.tolist(), self.ids[low:high].tolist()) if s > 0]
            top = sorted(top + found)[:size]
        return top


def _restricted(numbers: dict[bytes, int]):
    def run(batches):
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                known = Counter(map(numbers.get, words))
                known.pop(None, None)
                ids.append(i)
                sizes.append(len(words))
                terms.append(list(known))
                tfs.append(list(known.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def _searched(items: list[tuple], place: np.ndarray, n_docs: int, n_terms: int, size: int):
    """``items``: (number, terms, weights) with terms by frequency; ``place``: frequency order of the terms."""
    def run(batches):
        tops = {number: [] for number, _, _ in items}
        tree_size = max(LEAF, min(TREE, CELLS // max(1, len(place))))
        for batch in batches:
            for low in range(0, batch.num_rows, tree_size):
                part = batch.slice(low, tree_size)
                vectors, tfs = [], []
                for terms, counts in zip(part.column(2), part.column(3)):
                    ranks = place[np.asarray(terms.values)]
                    order = np.argsort(ranks)
                    vectors.append(ranks[order])
                    tfs.append(np.asarray(counts.values)[order])
                ids = np.array([_NO_ID if i is None else i for i in part.column(0).to_pylist()], np.int64)
                m = 10 + (90 * part.column(1).to_numpy() * n_docs) // n_terms
                tree = Tree(vectors, tfs, ids, m, len(place))
                for number, terms, weights in items:
                    tops[number] = tree.search(terms, weights, tops[number], size)
        rows = [(number, None if i == _NO_ID else i, -s) for number, top in tops.items() for s, i in top]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["number", "doc_id", "score"])

    return run


def _block(docs: DataFrame, texts: list[str | None], top: int) -> DataFrame:
    """(number, doc_id, score): the tops of all tasks for the items with these texts."""
    items = [sorted(set(words_of(t))) for t in texts]
    numbers = {term: i for i, term in enumerate(sorted(set().union(*items)))}
    vectors = pin(docs.mapInArrow(_restricted(numbers), "doc_id long, n long, terms array<int>, tfs array<bigint>"), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    # One row for every term of the block.
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    place = np.empty(len(df), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    asked = []
    for number, terms in enumerate(items):
        at = np.array([numbers[t] for t in terms], np.int64)
        at = at[(df[at] > 0) & (weight[at] > 0)]
        if len(at):
            asked.append((number, place[at], weight[at]))
    some = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    return some.mapInArrow(_searched(asked, place, n_docs, max(1, n_terms), top), "number int, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    rows = id_and_text(docs, id_col, text_col)
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    letters = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(letters / (8 * TERMS)))
    asked = pin(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = None
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in range(blocks):
        mine = asked.where(F.col("block") == block).select("item_id", "text").collect()  # bounded by TERMS
        tops = _block(rows, [r["text"] for r in mine], top)
        tops = tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = rows.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(mine)], f"number int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        tops = tops.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")
        found = tops if found is None else found.unionByName(tops)
    return found


def brute_force(docs: list[tuple], items: list[tuple], top: int = TOP) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item; for tests."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m, score = 10 + (90 * sum(c.values()) * n_docs) // n_terms, 0
            for term in set(words_of(text)):
                df = sum(term in other for _, other in counts)
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out
