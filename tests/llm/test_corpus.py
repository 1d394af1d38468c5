"""Corpus operators against brute-force versions on small tables, with their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from secondpass.llm import decontamination, packing, pii, quality, simhash, suffix_dedup, toxicity
from secondpass.llm.exact_dedup import drop_duplicates, exact_dedup
from secondpass.llm.queries import VOCABULARY
from secondpass.llm.sharding import shard_documents
from secondpass.llm.token_counts import token_counts

DOCS = "doc_id long, text string, lang string, sha string, fp long, salt int, kept boolean"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def table(spark, texts, start=0):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(start + i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + rng.integers(26)) for _ in range(2)) + str(rng.integers(words)) for _ in range(n))


def test_suffix_dedup(spark):
    passage = prose(1, 90)[:450]
    texts = [None, "", "x" * 500, passage[:199], "q" + passage[5:350] + "z", "é" * 150 + passage[:230] + "y", passage[100:310]]
    texts += [f"p{i} {passage[:260]} s{i}" for i in range(30)] + [prose(2, 80)] * 3
    docs = table(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == dict(enumerate(suffix_dedup.brute_force(texts)))
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_of_long_texts_and_null_ids(spark):
    passage = prose(3, 80)[:300]
    noise = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 1_300_000)))
    texts = [noise[:1_048_000] + passage + noise[1_048_000:] + passage, "v" * 3000, passage[20:260], "v" * 210, prose(5, 60)]
    docs = spark.createDataFrame([(None if i in (2, 3) else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(got) == sorted(suffix_dedup.brute_force(texts))


def test_repeated_keys_fill_many_buckets(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 500), (3, 2), (4, 1), (5, 1)) for i in range(n)]
    order = spark.createDataFrame(rows, "key long, tie long").repartition(5)
    got = suffix_dedup.repeated(order, ["key"], ["tie"], "met").collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if r[0] in (2, 3))


def _luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base(text):
    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and _luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group()))


def test_personal_data(spark):
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "é😀 +1 (809) 555-2752 x", None, "", "1" * 5000,
             "4111 1111 1111 1111 12", "4111 1111 1111 1111 x 4111111111111112", "+1 22", "me+x@a-b.co.uk, 10.0.0.1"]
    docs = table(spark, texts * 3)
    for r in pii.find_personal_data(docs).collect():
        want = _base(texts[r.doc_id % len(texts)])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_masks_find_replaced_words():
    assert decontamination.guaranteed()
    assert decontamination.allowed(decontamination.SPAN) == decontamination.REPLACED
    for n in range(7, decontamination.SPAN):
        assert decontamination.guaranteed(decontamination.allowed(n), n), n


def test_decontamination(spark):
    items = [prose(5, 30), prose(6, 8), "three short words", "", None, prose(5, 30)]
    changed = items[0].split()
    changed[3] = changed[9] = changed[17] = changed[22] = "other"
    half = items[0].split()[:12]
    texts = [None, "", prose(7, 60) + " " + items[0].upper() + " " + prose(8, 9), " ".join(changed), " ".join(half),
             prose(9, 200), items[1], "a three, SHORT words b", "short three words", prose(10, 5) + " " + items[0] + "."] + [items[0]] * 4
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, texts)
    known = [i for i in items if i]
    want = [decontamination.brute_force(t, known) for t in texts]
    got = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, benchmark).collect()}
    assert [got[i] for i in range(len(texts))] == want
    left = decontamination.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, w in enumerate(want) if not w]
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(texts)
    assert decontamination.contamination(docs.limit(0), benchmark).count() == 0


def _labelled(spark, column):
    rng = np.random.default_rng(3)
    bad = rng.random(240) < 0.3
    if column == "toxic":
        texts = [prose(i, 50) + (" vileword " if b else " ") + prose(i + 900, 20) for i, b in enumerate(bad)]
        labels = [(i, int(b)) for i, b in enumerate(bad)]
    else:
        texts = ["spam spam " * 40 if b else prose(i, 70) for i, b in enumerate(bad)]
        labels = [(i, int(not b)) for i, b in enumerate(bad) if i % 2]
    return table(spark, texts + [None, ""]), spark.createDataFrame(labels + [(None, 1)], f"doc_id long, {column} int"), bad


@pytest.mark.parametrize("column,operator", [("toxic", toxicity), ("quality", quality)])
def test_classifiers_on_held_out_rows(spark, column, operator):
    docs, labels, bad = _labelled(spark, column)
    run = operator.toxicity if column == "toxic" else operator.quality
    rows = {r.doc_id: r for r in run(docs, labels).collect()}
    assert len(rows) == 242 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    right = [rows[i].predicted == int(bad[i] == (column == "toxic")) for i in range(240) if rows[i].held_out]
    assert np.mean(right) >= 0.9
    assert run(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert run(docs.limit(0), labels).count() == 0


def test_toxicity_reads_long_runs_to_their_end():
    """Scripts without spaces and joined words: what stands behind 100 letters counts, in training and in scoring."""
    rng = np.random.default_rng(1)
    han = ["".join(chr(0x4E00 + rng.integers(300)) for _ in range(2)) for _ in range(60)]
    latin = ["".join(chr(97 + rng.integers(26)) for _ in range(rng.integers(2, 7))) for _ in range(60)]

    def texts(seed, n, glue, term, words):
        """Every second text holds the term, in its second half (behind 100 letters at least)."""
        drawn = np.random.default_rng(seed)
        for i in range(n):
            text = [words[k] for k in drawn.integers(len(words), size=100)]
            text[int(drawn.integers(60, 100))] = term if i % 2 else words[0]
            yield glue.join(text)

    for words, term, glue, joined in ((han, "".join(chr(0x5300 + i) for i in range(4)), "", ""), (latin, "vileword", " ", "_")):
        scorer = toxicity.Scorer(toxicity.train(list(texts(2, 400, glue, term, words)), [0, 1] * 200))
        found = scorer.scores(list(texts(3, 60, joined, term, words))) >= 0.5
        assert np.mean(found == np.array([False, True] * 30)) >= 0.9
    for text in ("é" * 32, "a" * 64, "ab_cd", "a b_" + "c" * 60, None):
        assert toxicity.words_of(text) == re.findall(r"\w+", text or "")
    for n in (22, 23, 100, 1001):
        text = "".join(chr(0x4E00 + i) for i in range(n))
        assert toxicity.words_of(text) == [text[i:i + toxicity.PIECE] for i in range(n - toxicity.PIECE + 1)]


def test_gradient_of_the_network():
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, docs = toxicity.number_words([prose(1, 20), prose(2, 45)])
    grid = np.concatenate([toxicity.cut(d) for d in docs])
    y, ones = np.arange(len(grid)) % 2, np.ones(len(grid))

    def loss():
        logit = net.run(net.project(net.embed(words)), np.maximum(grid, 0), (grid >= 0).astype(float))
        return np.mean(np.logaddexp(0, logit) - y * logit)

    grad = net.gradient(words, grid, y, ones)
    for name in ("w", "v", "A", "Uf", "Ub", "Wf", "bb", "word", "char"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(grad[name][at], rel=0.05), name


def test_simhash_links_and_components(spark):
    long = prose(4, 600)
    texts = [long, long + " tail", "a b c", "A  b\tc", None, "", "...", prose(11, 40)]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[b] for b in range(len(texts)) if near(a, b)) for a in range(len(texts))]
    assert [rows[i].component_id for i in range(len(texts))] == least
    left = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(least)) and left.columns == docs.columns


def test_exact_dedup_returns_every_row(spark):
    """Rows equal in id and text are rows and count; large ids stay exact beside digests with null ids only."""
    big = 2**60 + 1
    rows = [(1, "a", "y"), (1, "a", "x"), (big, "a", "z"), (None, "b", "q"), (None, "b", "p"), (big + 2, "c", "r"), (3, None, "s"),
            (3, "", "t"), (None, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    size = {"a": 3, "b": 2, "c": 1, "": 3}
    keep = {"a": big, "b": None, "c": big + 2, "": 3}
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id") > 2):
        got = [tuple(r) for r in exact_dedup(docs, history=history).drop("text_sha256").collect()]
        want = [(i, keep[t or ""], size[t or ""], i == keep[t or ""]) for i, t, _ in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.more for r in drop_duplicates(docs).collect()) == ["p", "r", "s", "z"]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Unrelated texts stay, whatever their ids; of a component one document stays."""
    copied = prose(25, 60)
    texts = [prose(20 + i, 60) for i in range(5)] + [copied, copied.upper(), copied]
    ids = [None, None, None, 7, 7, None, 7, 9]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(left, key=str) == sorted([*zip(ids[:5], texts[:5]), (7, copied.upper())], key=str)


def test_exact_dedup_counts_packing_sharding(spark):
    texts = ["a", "b", "a", None, "", "c<|endoftext|>d", prose(1, 900)]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in exact_dedup(docs).collect()}
    assert [rows[i].keep_id for i in range(7)] == [2, 1, 2, 4, 4, 5, 6]
    twice = docs.unionByName(docs.where("doc_id = 2"))
    assert sorted(r.doc_id for r in drop_duplicates(twice).collect()) == [1, 2, 4, 5, 6]
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(VOCABULARY)
    want = {i: len(known.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()} == want
    pieces = packing.pack(docs, VOCABULARY).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: n + 1 for i, n in want.items()}
    for _, bin_ in pieces.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 1024
    shards = shard_documents(docs).toPandas()
    assert len(shards) == 7 and all(sorted(s.slot) == list(range(len(s))) for _, s in shards.groupby("shard"))


def test_pipeline_stages(spark, tmp_path):
    docs, labels, bad = _labelled(spark, "toxic")
    # A clean text in words that the labelled clean texts hold, three times and in the benchmark.
    clean = [i for i in range(240) if not bad[i]][:4]
    planted = " ".join(" ".join(prose(i, 50).split()[10:22]) for i in clean)
    docs = docs.unionByName(table(spark, [planted] * 3, 1000))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, planted)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        assert kept.columns == docs.columns
        if name == "exact_dedup":
            assert kept.where(F.col("doc_id") >= 1000).count() == 1
    assert kept.where(F.col("doc_id") >= 1000).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("members", [2, 3, 48, 49, 300])
def test_simhash_groups_of_any_size(spark, members):
    """Components equal those of all pairs, for halves held by few and by many fingerprints, on both sides."""
    rng = np.random.default_rng(members)
    low, high = (int(x) for x in rng.integers(0, 2**32, 2))
    fps = {0, 2**64 - 1, 1, 3, 7}
    for i in range(members):
        fps.add(low | int(rng.integers(0, 2**32)) << 32)  # one half in common, the other at chance
        fps.add((high << 32) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
        fps.add(int(rng.integers(0, 2**63)))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()

    def roots(pairs):
        root = {v: v for v in signed}
        changed = True
        while changed:
            changed = False
            for u, v in pairs:
                least = min(root[u], root[v])
                changed |= root[u] != least or root[v] != least
                root[u] = root[v] = least
        return root

    wanted = simhash.links_of(sorted(fps))
    assert roots([(r["u"], r["v"]) for r in found]) == roots(list(zip(wanted["u"].tolist(), wanted["v"].tolist())))
    assert {(r["u"], r["v"]) for r in found} and all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 2 for r in found)
