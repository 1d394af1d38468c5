"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers

from secondpass.catalog.common import Catalog
from secondpass.llm.common import documents
from secondpass.llm.decontamination import contamination
from secondpass.llm.exact_dedup import exact_dedup
from secondpass.llm.importance import resample
from secondpass.llm.jaccard_join import jaccard_join
from secondpass.llm.packing import pack
from secondpass.llm.pii import find_personal_data
from secondpass.llm.quality import quality
from secondpass.llm.ranked_search import search
from secondpass.llm.sharding import shard_documents
from secondpass.llm.simhash import near_duplicates
from secondpass.llm.suffix_dedup import suffix_dedup
from secondpass.llm.token_counts import token_counts
from secondpass.llm.toxicity import toxicity

catalog = Catalog()
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@catalog.add("op1_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


@catalog.add("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@catalog.add("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), VOCABULARY)


@catalog.add("op5_simhash")
def op5_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


@catalog.add("op4_personal_data")
def op4_personal_data(spark, sf_dir):
    return find_personal_data(documents(spark, sf_dir))


@catalog.add("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@catalog.add("op7_sharding")
def op7_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))


@catalog.add("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir))


@catalog.add("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@catalog.add("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), VOCABULARY)


@catalog.add("op11_jaccard_join", r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ), links AS (
        SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
        WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes n ON n.doc_id = d.doc_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
""")
def op11_jaccard_join(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))


@catalog.add("op12_importance_resampling")
def op12_importance_resampling(spark, sf_dir):
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@catalog.add("op13_ranked_search", r"""
    WITH docs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), tf AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY doc_id, term),
    sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
    whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
    m AS (SELECT doc_id, 100 - 90 + (90 * n * big_n) // big_l AS m FROM sizes, whole),
    weights AS (
        SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, big_n
    ), scored AS (
        SELECT i.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
        FROM items i JOIN tf t USING (term) JOIN weights w USING (term) JOIN m ON m.doc_id = t.doc_id
        GROUP BY i.item_id, t.doc_id
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""")
def op13_ranked_search(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
