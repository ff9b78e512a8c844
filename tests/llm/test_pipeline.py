"""The corpus pipeline, stage by stage against its definitions on a small input."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from plumeline.llm import jaccard_dedup, quality_fm, toxicity, words as W
from plumeline.llm.queries import tokenizer_json

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test_{name}_{id(out)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= 3 * before
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, t in kept.items() if any(item in " ".join(t.split()) for item in items)]
    assert len(set(kept.values())) == len(kept)


def test_the_whole_run_encodes_what_the_mix_takes(spark):
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = Tokenizer.from_str(tokenizer_json())
    start = 0
    for r in out:
        assert (r["start"], r["n_tokens"]) == (start, len(whole.encode(text[r["doc_id"]], add_special_tokens=False).ids) + 1)
        start += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(toxicity.fold("doc_id", 3) != 1)
    machine = quality_fm.train(docs, labels)
    good = {r["doc_id"] for r in quality_fm.score(docs, machine).filter("score >= 0.5").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} == good


def test_near_dedup_goes_by_shared_shingles(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(64)]
        for edits in (0, 0, 1, 1, 2, 5):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 5000)}"
            rows.append((n, " ".join(words), "en", "s", 1))
            n += 1
    rows += [(n, "", "en", "s", 0), (n + 1, None, "en", "s", 0), (n + 2, "lone words", "en", "s", 0), (None, "lone words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    kept, want = [], set()
    for i, text, *_ in rows[:n]:
        w = text.split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if all(len(s & t) < 0.8 * len(s | t) for t in kept):
            kept.append(s)
            want.add(i)
    assert got == want | {n, n + 2, None}


CLASHES = ["__text", "__key", "__copy", "__id", "__dropped", "__times", "__scanned", "__score", "id_of_row", "key_of_text", "dropped_id", "mix_key", "mix_times", "Mix_Copy",
           "scanned", "quality_score", "whole_text", "text_size", "node", "rank", "similar"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_chars", F.concat(F.col("n_chars").cast("string"), F.lit(" or so")))
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES), name
        assert all(r["n_chars"].endswith(" or so") for r in rows), name


def _shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def test_near_dedup_keeps_a_family_that_is_not_similar_enough(spark):
    """120 texts that share most of their words but stay near 0.6, copies of some at 0.9, and very long and empty ones."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(400), 11):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    for i in range(0, 120, 10):
        words = rows[i][1].split()
        words[7] = "edited"
        rows.append((1000 + i, " ".join(words)))
    rows += [(5000, "long " + " ".join(f"z{k % 997}" for k in range(60000))), (5001, ""), (5002, None), (5003, "two words"), (5004, "Two  words"), (None, "lone"), (None, "lone"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in jaccard_dedup.keep_one(docs).collect())
    kept: list = []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        s = _shingles(text or "")
        if not any(len(s & t) >= 0.8 * len(s | t) for t in kept):
            kept.append(s)
    assert len(got) == len(set(got)) == len(kept) + 1 and set(range(120)) | {-1, 5000, 5001, 5003} == set(got)
    assert jaccard_dedup.keep_one(docs.limit(0)).collect() == []


def test_toxicity_sums_each_feature_of_a_text_once():
    texts = ["", "abc", "abcd", "aaaaaaaaaa", "ÄÖ abcabcabc déjà", "x" * 5000, "😀😀😀😀😀"]
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    points, first = toxicity.code_points(*W.text_buffer(pa.array(texts)))
    doc, feature = toxicity.gram_features(points, first)
    got = toxicity.summed_weights(points, first, weights, np.zeros(1 << toxicity.BITS, np.int32))
    for d, text in enumerate(texts):
        grams = {(n, text.lower()[i : i + n]) for n in toxicity.GRAMS for i in range(len(text) - n + 1)}
        own = set(feature[doc == d].tolist())
        assert len(own) == len(grams) and np.isclose(got[d], sum(weights[f] for f in own))
