"""Decontamination, token files, graph search and classifiers."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.llm import decontaminate as dec, graph_search as gs, quality_fm as fm, token_store as ts, toxicity as tox
from plumeline.llm.queries import tokenizer_json

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def _words(rng, n, size=4000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


# Decontamination ----------------------------------------------------------------------------------------------------


def _score(a, b):
    """Smith-Waterman by its recurrence."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_alignment_matches_the_recurrence():
    rng = random.Random(1)
    for _ in range(60):
        a = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 14))], np.uint64)
        b = np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 25))], np.uint64)
        score, start, stop = dec.align(a, b)
        assert score == _score(a.tolist(), b.tolist())
        if score:
            assert _score(a.tolist(), b[start:stop].tolist()) == score


def _contaminated(rng):
    items = [(k, " ".join(_words(rng, rng.randint(13, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "lone pair")]
    docs, planted = [], set()
    for i in range(200):
        words = _words(rng, rng.randint(0, 300))
        if i % 4 == 0:
            k, text = items[rng.randrange(30)]
            copy = text.split()
            if i % 8 == 0:  # edited: every sixth word replaced, one dropped, case and punctuation changed
                copy = [w.upper() + "," if j % 5 == 1 else w for j, w in enumerate(copy)]
                copy = [f"new{j}" if j % 6 == 4 else w for j, w in enumerate(copy) if j != 8]
            at = rng.randint(0, len(words))
            words[at:at] = copy
            planted.add((i, k))
        docs.append((i, " ".join(words)))
    return items, docs + [(300, None), (301, ""), (302, "a lone, pair here")], planted | {(302, 92)}


@pytest.mark.parametrize("item_bytes", [dec.ITEM_BYTES, 2000])
def test_planted_and_edited_items_are_found(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(dec, "ITEM_BYTES", item_bytes)
    items, docs, planted = _contaminated(random.Random(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = _docs(spark, docs).withColumn("item_id", F.lit("clash")).repartition(4)
    out = dec.contaminated_passages(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == planted
    text = dict(docs)
    for r in out:
        assert 0.5 <= r["score"] <= 1 and r["start"] < r["stop"] <= len(text[r["doc_id"]].split())
    clean = dec.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in planted}


def test_a_passage_that_is_everywhere_keeps_its_seeds(spark):
    rng = random.Random(3)
    item = " ".join(_words(rng, 30))
    docs = [(i, " ".join(_words(rng, 20)) + " " + item) for i in range(300)] + [(i, item) for i in (400, 400)]
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    out = dec.contaminated_passages(_docs(spark, docs), bench).collect()
    assert len(out) == 2 * len(docs) and all(r["score"] == 1 for r in out)


@pytest.mark.parametrize("offset", [0, 1, 2, 3])
def test_edited_copies_beside_many_exact_ones(spark, offset):
    rng = random.Random(4)
    item = _words(rng, 24)
    edited = " ".join(f"new{j}" if j % 4 == offset else w for j, w in enumerate(item))
    docs = [(i, " ".join(_words(rng, 20)) + " " + " ".join(item)) for i in range(300)]
    docs += [(1000, " ".join(_words(rng, 40)) + " " + edited + " " + " ".join(_words(rng, 40)))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    out = {r["doc_id"] for r in dec.contaminated_passages(_docs(spark, docs), bench).collect()}
    assert out == {i for i, _ in docs}


def test_every_passage_of_a_document_is_a_row(spark):
    rng = random.Random(5)
    item, other = _words(rng, 24), _words(rng, 10)
    text = " ".join([*other, *item, *item, *other, *item])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    out = dec.contaminated_passages(_docs(spark, [(1, text)]), bench).collect()
    assert sorted((r["start"], r["stop"]) for r in out) == [(10, 34), (34, 58), (68, 92)]


def test_documents_without_any_seed(spark):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    docs = _docs(spark, [(1, "x y z " * 50)])
    assert dec.contaminated_passages(docs, items).count() == 0 and dec.clean_documents(docs, items).count() == 1


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert dec.contaminated_passages(_docs(spark, []), items).count() == 0
    assert dec.contaminated_passages(_docs(spark, [(1, "a b c d e")]), items.limit(0)).count() == 0
    assert dec.clean_documents(_docs(spark, [(None, "a b c d e"), (None, "f")]), items).count() == 1


# Token files --------------------------------------------------------------------------------------------------------


def _package_merge(counts, most):
    """Least total length with codes of at most ``most`` bits, by dynamic merging of coins."""
    coins = sorted((c, (i,)) for i, c in enumerate(counts))
    level = list(coins)
    for _ in range(most - 1):
        pairs = [(level[k][0] + level[k + 1][0], level[k][1] + level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
        level = sorted(coins + pairs)
    lengths = [0] * len(counts)
    for _, ids in level[: 2 * len(counts) - 2]:
        for i in ids:
            lengths[i] += 1
    return sum(c * n for c, n in zip(counts, lengths, strict=True))


@pytest.mark.parametrize("most", [6, 9])
def test_code_lengths_are_optimal_and_bounded(most):
    rng = random.Random(most)
    counts = np.array([0, *[int(1.6**rng.randint(0, 25)) for _ in range(40)], 0])
    lengths = ts.code_lengths(counts, most)
    assert lengths.max() <= most and lengths[0] == lengths[-1] == 0
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    assert int((counts * lengths).sum()) == _package_merge(counts[counts > 0].tolist(), most)


@pytest.mark.parametrize("kinds", [1, 2, 3, 700])
def test_blocks_decode_to_what_was_packed(kinds):
    rng = np.random.default_rng(kinds)
    blocks = [np.minimum(rng.geometric(0.05, n), kinds) - 1 for n in (0, 1, ts.CHECKPOINT, 3 * ts.CHECKPOINT + 5, 40)]
    lengths = ts.code_lengths(np.bincount(np.concatenate(blocks), minlength=kinds))
    codes = ts.canonical_codes(lengths)
    packed = [(*ts.pack_bits(b, codes, lengths), len(b)) for b in blocks]
    assert ts.unpack_bits(packed, *ts.decode_table(lengths)).tolist() == np.concatenate(blocks).tolist()


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b", "\n a", "\ta \tb", "x  y", "x   y", "a  b",
    "it's I'll we've don't  'tis", "<|endoftext|> a<|endoftext|>", "é ü 漢字 🔑 ́x", "12 345 6,7 ### $$$ %%%", "\x1c a \x85 b", "word " * 5000, "Ġa Ġ b",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_whole_texts(name):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab \n'.1é<| ") for _ in range(60)) for _ in range(300)]
    encoder = ts.PieceEncoder(tokenizer_json(name))
    whole = Tokenizer.from_str(tokenizer_json(name))
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode(texts) == encoder.encode(texts)


def test_files_read_back_in_order(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(ts, "PART_TOKENS", 3000)
    whole = Tokenizer.from_str(tokenizer_json())
    rng = random.Random(8)
    texts = ODD + [" ".join(_words(rng, rng.randint(0, 400), 50)) for _ in range(80)]
    ids = rng.sample(range(10_000), len(texts))
    docs = _docs(spark, list(zip(ids, texts, strict=True))).withColumn("text_key", F.lit(0)).withColumn("part", F.lit(0)).repartition(6)
    path = str(tmp_path / "tokens")
    ts.write_tokens(docs, path, tokenizer_json())
    out = ts.read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(out, sorted(zip(ids, texts, strict=True)), strict=True):
        expected = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(expected), expected)
        assert r["ids_crc32"] == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += len(expected)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.select("part").distinct().count() > 1 and blocks.agg(F.sum("n_tokens")).first()[0] == start


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = _docs(spark, [(5, "a b"), (5, "a b"), (5, "c"), (None, "d e f"), (1, None)])
    out = sorted(((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in ts.round_trip(docs, tokenizer_json()).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [-1, 1, 5, 5, 5] and [r[1] for r in out] == np.cumsum([0, *(r[2] for r in out[:-1])]).tolist()
    assert ts.round_trip(docs.limit(0), tokenizer_json()).count() == 0


# Graph search -------------------------------------------------------------------------------------------------------


def test_recall_and_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(gs, "SHARD_NODES", 500)
    monkeypatch.setattr(gs, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[300:700] = vectors[7]  # a third are one vector
    vectors[900] = np.nan
    vectors[901] = 0
    vectors[902, 3] = np.inf
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows[903] = (903, [*rows[903][1][:-1], None], 1)
    rows += [(5000, None, 0), (5001, [], 0), (5002, [1.0, 2.0], 0), (5003, [1.0, 2.5], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("x"))
    queries = table.filter("vec_id % 20 = 0 or vec_id = 5002")
    out = gs.nearest(gs.build_index(table), queries).collect()
    good = [i for i in range(1500) if i not in (900, 901, 902, 903)]
    exact, hits, total = vectors[good].astype(float), 0, 0
    by_query = {}
    for r in out:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {i for i in good if i % 20 == 0} | {5002}
    assert [(r["vec_id"], r["score"]) for r in by_query.pop(5002)] == [(5003, 0.5)]
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        d = np.sqrt(((exact - vectors[q].astype(float)) ** 2).sum(1))
        order = [good[k] for k in np.lexsort((good, d)) if good[k] != q][:10]
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r["vec_id"] for r in found}
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        for r in found:
            assert r["score"] == pytest.approx(d[good.index(r["vec_id"])], rel=1e-12, abs=1e-12)
        hits, total = hits + len(set(order) & {r["vec_id"] for r in found}), total + 10
        if 300 <= q < 700 or q == 7:
            assert [r["vec_id"] for r in found] == order
    assert hits / total >= 0.9


def test_pruned_graph_is_bounded_and_diverse():
    vectors = np.random.default_rng(1).normal(size=(800, 8)).astype(np.float32)
    edges, entry = gs.build_graph(vectors)
    assert edges.shape == (800, gs.DEGREE + gs.SLACK) and 0 <= entry < 800
    assert all(len(set(r[r < 800])) == (r < 800).sum() and i not in r for i, r in enumerate(edges))
    line = np.array([[0.0], [1.0], [2.0], [-5.0]], np.float32)
    kept = gs.robust_prune(line, (line**2).sum(1), np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, 4]]  # 2 lies behind 1


def test_search_over_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    out = gs.nearest(gs.build_index(few), few.filter("vec_id = 100")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(1, 2), (2, 1)]
    assert gs.nearest(gs.build_index(few.limit(0)), few.limit(0)).count() == 0


# Classifiers --------------------------------------------------------------------------------------------------------


def _labelled(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = _words(rng, rng.randint(20, 120), 300)
        bad, rude = rng.random() < 0.3, rng.random() < 0.2
        if bad:
            words = [w + "###" if rng.random() < 0.5 else w.upper() for w in words]
        if rude:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["Nitwitted", "blockheads"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "é" * 100_000)], labels


@pytest.fixture(scope="module")
def labelled():
    return _labelled(random.Random(11))


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, labelled, kind):
    rows, labels = labelled
    docs = _docs(spark, rows).withColumn("label", F.lit("x")).withColumn("score", F.lit("y"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    fit = known.filter(tox.fold("doc_id", 5) != 0)
    module = tox if kind == "toxic" else fm
    model = module.train(docs, fit)
    scored = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in scored.values())
    truth = {i: (t if kind == "toxic" else q) for i, q, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == truth[i] for i in held) / len(held) >= 0.95
    again = {r["doc_id"]: r["score"] for r in module.score(docs.repartition(3), module.train(docs, fit)).collect()}
    assert again == pytest.approx(scored, abs=1e-6)
    assert module.score(docs.limit(0), model).count() == 0


def test_a_few_toxic_rows_are_enough_for_a_clear_vocabulary(spark):
    rng = random.Random(12)
    rows, truth = [], {}
    for i in range(140):
        words = _words(rng, rng.randint(30, 60), 300)
        truth[i] = int(i % 7 == 0)
        if truth[i]:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["nitwitted", "blockheads"]))
        rows.append((i, " ".join(words)))
    docs = _docs(spark, rows)
    fit = spark.createDataFrame([(i, k) for i, k in truth.items() if i < 70], "doc_id long, toxic int")
    model = tox.train(docs, fit)
    scored = {r["doc_id"]: r["score"] for r in tox.score(docs, model).collect()}
    found = {i for i in truth if scored[i] >= 0.5}
    assert {i for i in truth if truth[i] and i < 70} <= found <= {i for i in truth if truth[i]}
    assert len([i for i in found if i >= 70]) >= 6  # of 10
    # N-grams of the fitted rows have a weight, whatever their counts.
    assert np.count_nonzero(model.weights) > 1000


@pytest.mark.parametrize("module", [tox, fm])
def test_one_class_or_no_labels_score_the_share(spark, module):
    docs = _docs(spark, [(1, "a b"), (2, None), (None, "c")])
    kind = "toxic" if module is tox else "quality"
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7)], f"doc_id long, {kind} int")
    one = [r["score"] for r in module.score(docs, module.train(docs, labels)).collect()]
    none = [r["score"] for r in module.score(docs, module.train(docs, labels.limit(0))).collect()]
    assert len(one) == 3 and min(one) > 0.99 and max(none) < 0.01


def test_good_documents_keep_their_columns(spark, labelled):
    rows, labels = labelled
    docs = _docs(spark, rows).withColumn("score", F.lit("y"))
    machine = fm.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = fm.good_documents(docs, machine)
    truth = {i: q for i, q, _ in labels}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and sum((i in ids) == bool(truth[i]) for i in truth) / len(truth) > 0.97


def test_machine_score_is_the_pairwise_sum():
    rng = np.random.default_rng(2)
    size = (1 << fm.BITS) + fm._STATS
    machine = fm.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, fm.FACTORS)), np.zeros(fm._STATS), np.ones(fm._STATS))
    column, value, stats = np.array([3, 9, 3]), np.array([0.5, 1.0, 2.0]), rng.normal(size=(2, fm._STATS)).clip(-4, 4)
    got = machine.margins(np.array([0, 0, 1]), column, value, stats)
    for d, own in enumerate(([0, 1], [2])):
        x = dict(zip(column[own].tolist(), value[own].tolist(), strict=True)) | {(1 << fm.BITS) + k: s for k, s in enumerate(stats[d])}
        keys = list(x)
        want = 0.3 + sum(machine.weights[k] * x[k] for k in keys)
        want += sum(machine.factors[a] @ machine.factors[b] * x[a] * x[b] for n, a in enumerate(keys) for b in keys[:n])
        assert got[d] == pytest.approx(want)


def test_words_are_held_once_whatever_is_behind_them():
    """a word is a piece, and put together with the punctuation behind it; before, its ids were held a second time."""
    encoder = ts.PieceEncoder(tokenizer_json("byte_bpe_50k.json"))
    words = [f"{a}{b}" for a in ("tion", "grö", "ße", "slo") for b in ("wend", "äng", "ist", "lyb")]
    texts = ["x " + " ".join(words), "x " + " ".join(f"{w}," for w in words), "x " + " ".join(f"{w}\n{w}!?" for w in words), "x ы́ы 漢字, a1 " + words[3]]
    packed = encoder.encode(texts)
    direct = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(p, encoder.kind).tolist() for p in packed] == [e.ids for e in direct]
    assert not any(encoder.space + w in encoder.parts for w in words)
    assert all(w in encoder.pieces for w in words)
