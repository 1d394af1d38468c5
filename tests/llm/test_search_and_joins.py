"""Jaccard join, importance resampling and ranked search against brute force, with their edge cases; private columns and workers."""

import os
import shutil
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondpass.llm import importance, jaccard_join, ranked_search
from secondpass.llm.common import drop_documents, words_of
from secondpass.llm.decontamination import decontaminate
from secondpass.llm.exact_dedup import drop_duplicates

DOCS = "doc_id long, text string, sha string, node long, g long, token long, component long, n long, rank int, score long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], DOCS)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"{chr(97 + k % 26)}{k}" for k in rng.integers(words, size=n))


def edited(text, seed, share):
    rng = np.random.default_rng(seed)
    return " ".join(f"x{rng.integers(10**6)}" if rng.random() < share else w for w in text.split())


def test_sketch_bounds_hold():
    rng = np.random.default_rng(0)
    for n in range(1, 400):
        assert 100 * jaccard_join.required(n) >= 85 * n > 100 * (jaccard_join.required(n) - 1)
    for _ in range(300):
        n, m = int(rng.integers(1, 200)), int(rng.integers(1, 200))
        common = int(rng.integers(0, min(n, m) + 1))
        if not jaccard_join.linked(n, m, common):
            continue
        both = rng.choice(10**9, n + m - common, replace=False)
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:common], both[n:]]))
        met = len(np.intersect1d(a[:jaccard_join.sketch_size(n)], b[:jaccard_join.sketch_size(m)]))
        assert met >= jaccard_join.shared_at_least(n) and met >= jaccard_join.shared_at_least(m)


def test_jaccard_join(spark, monkeypatch):
    base, other = prose(1, 120), prose(2, 150)
    texts = [None, "", " \t ", "one two", "ONE  two", "one two three four", "one two three", "é É", base, base.upper(), base + " tail"]
    texts += [edited(base, i, 0.01) for i in range(25)] + [edited(other, i, 0.03) for i in range(25)]
    texts += [other[:300] + " " + prose(50 + i, 40) for i in range(10)] + ["w " * 4000, "w " * 3999] + [base] * 6
    rows = list(enumerate(texts))
    want = jaccard_join.brute_force(dict(rows))
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "QUERIES", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, rows)).collect()}
    assert got == want
    assert jaccard_join.jaccard_join(table(spark, rows).limit(0)).count() == 0
    odd = [(None, base), (None, base), (7, base + " tail"), (7, base + " tail"), (None, None), (9, prose(3, 30))]
    got = sorted(map(tuple, jaccard_join.jaccard_join(table(spark, odd)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (7, 7), (None, None), (9, 9)], key=str)


def test_prefix_crcs(monkeypatch):
    crcs = importance.PrefixCrc()
    words = [bytes(np.random.default_rng(i).integers(97, 123, 1 + i * i % 700, dtype=np.uint8)) for i in range(60)]
    for chunk in (1, 2, 7, 1000):
        monkeypatch.setattr(importance, "_CHUNK", chunk)
        for order in (1, 2, 3):
            got = sorted(np.concatenate(list(importance.buckets_of(words, crcs, order))).tolist())
            grams = [b" ".join(words[i:i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
            assert got == sorted(zlib.crc32(g) % importance.BUCKETS for g in grams)
    assert list(importance.buckets_of([], crcs)) == []


def test_importance_resampling(spark):
    texts = [None, "", "...", "One,two", "É é", prose(1, 19), prose(1, 20)] + [prose(i, 30 + i % 9) for i in range(60)]
    texts += [texts[8]] * 5 + [prose(9, 100_000)]
    items = [prose(3, 50), None, "", "one TWO"]
    rows = list(enumerate(texts))
    target = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in importance.resample(table(spark, rows), target).collect()}
    assert got == importance.brute_force(rows, items)
    assert importance.resample(table(spark, rows).limit(0), target).count() == 0
    got = {r.doc_id: tuple(r)[1:] for r in importance.resample(table(spark, rows), target.limit(0)).collect()}
    assert got == importance.brute_force(rows, [])
    same = importance.resample(table(spark, [(None, prose(1, 40))] * 8), target).collect()
    assert sorted(r["rank"] for r in same if r["rank"]) == [1, 2]


def test_ranked_search(spark, monkeypatch):
    texts = [None, "", "!!", "alpha beta", "Alpha ALPHA beta", "é"] + [prose(i, 20 + i % 60, 60) for i in range(300)]
    texts += [texts[20]] * 40 + ["alpha " * 5000]
    items = [(1, "alpha beta"), (2, prose(7, 12, 60)), (3, None), (4, "É é nowhere"), (5, prose(8, 30, 60)), (5, "alpha"), (None, "a0 b1 beta")]
    rows = list(enumerate(texts)) + [(None, "alpha beta"), (3, "alpha beta")]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = sorted(ranked_search.brute_force(rows, items), key=key)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for leaf, tree, terms in ((32, 4096, 20_000), (2, 64, 5)):
        monkeypatch.setattr(ranked_search, "LEAF", leaf)
        monkeypatch.setattr(ranked_search, "TREE", tree)
        monkeypatch.setattr(ranked_search, "TERMS", terms)
        got = sorted(map(tuple, ranked_search.search(table(spark, rows), asked).collect()), key=key)
        assert got == want
    assert ranked_search.search(table(spark, rows).limit(0), asked).count() == 0
    assert ranked_search.search(table(spark, rows), asked.limit(0)).count() == 0


def test_tree_skips_subtrees(monkeypatch):
    """Far fewer documents are scored than the tree holds, and the top is that of all of them."""
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    rng = np.random.default_rng(5)
    vectors = [np.unique(np.minimum(rng.zipf(1.5, rng.integers(1, 12)), 39)).astype(np.int64) for _ in range(2000)]
    tfs = [rng.integers(1, 4, len(v)) for v in vectors]
    m = rng.integers(10, 300, len(vectors))
    tree = ranked_search.Tree(vectors, tfs, np.arange(len(vectors)), m, 40)
    terms, weights = np.array([3, 21, 33]), np.array([500, 2000, 4000])
    scored = []
    plain = ranked_search.contributions
    ranked_search.contributions = lambda w, tf, m: scored.append(len(tf)) or plain(w, tf, m)
    try:
        top = tree.search(terms, weights, [], 10)
    finally:
        ranked_search.contributions = plain
    every = plain(weights, tree.tf[:, terms], tree.m)
    assert top == sorted((-s, i) for s, i in zip(every.tolist(), tree.ids.tolist()) if s > 0)[:10]
    assert sum(scored[1:]) < len(vectors) / 2


def test_columns_named_like_private_ones_stay(spark):
    names = ["_sha", "_salt", "sha", "salt", "gone_id", "gone_sha", "_gone_sha", "_text", "_row"]
    docs = spark.createDataFrame(
        [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b", "leak of all words that count here", "a b"])],
        ["doc_id", "text", *names]).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    leaks = spark.createDataFrame([(1, "leak of all words that count here")], "item_id long, text string")
    left = decontaminate(docs, leaks)
    assert left.columns == docs.columns and [r["_sha"] for r in left.orderBy("doc_id").collect()] == ["_sha0", "_sha2"]
    gone = docs.where("doc_id = 0").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    left = drop_documents(docs, gone)
    assert left.columns == docs.columns and sorted(r["gone_sha"] for r in left.collect()) == ["gone_sha1", "gone_sha2"]
    left = drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["_text"] for r in left.collect()) == ["_text1", "_text2"]


def test_words():
    assert words_of("A-b É1\x7f_c\x00") == ["a".encode(), b"b", "É1".encode(), b"c"]


@pytest.fixture
def root():
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_folders_can_be_deleted(root, tmp_path):
    """Without the corpus package the entry still offers all other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_workers_do_not_need_the_package(root):
    """Functions that run in workers arrive whole: they unpickle and run where the package cannot be imported."""
    send = (
        f"import sys; sys.path.insert(0, {root!r}); from pyspark import cloudpickle; from secondpass.llm import token_counts, packing; "
        "from secondpass.llm.queries import VOCABULARY as v; f = lambda t: token_counts.encoder(v).count(t); "
        "sys.stdout.buffer.write(cloudpickle.dumps(f))")
    sent = subprocess.run([sys.executable, "-c", send], cwd="/", check=True, capture_output=True).stdout
    run = "import sys, pickle; f = pickle.load(sys.stdin.buffer); assert f('two words') == 2; assert 'secondpass' not in sys.modules"
    subprocess.run([sys.executable, "-c", run], cwd="/", check=True, input=sent)
