"""Hard negatives, collocations and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.llm import bpe_codec as bpe, collocations as col, hard_negatives as hn
from plumeline.llm.queries import tokenizer_json

VECTORS = "vec_id long, embedding array<float>, label int, near string, norm string"
DOCS = "doc_id long, text string, lang string, batch string, n string"


# Hard negatives -----------------------------------------------------------------------------------------------------


def _negatives(rows, is_anchor, positives=5, negatives=5):
    """The definition, with Python's whole numbers."""
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [float(np.float32(x)) for x in vector])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = set()
    for a in filter(is_anchor, whole):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, (k, w) in whole.items() if i != a and len(w) == len(v))
        same = [(-s, i) for s, i, k in scored if k == label][:positives]
        for p, pid in same:
            inside = [(-s, i) for s, i, k in scored if k != label and 80 * p <= -100 * s <= 100 * p][:negatives]
            out |= {(a, pid, r, i, p, s) for r, (s, i) in enumerate(inside, 1)}
    return out


def _run_negatives(spark, rows, anchors="vec_id % 10 = 0"):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    return [tuple(r) for r in hn.hard_negatives(hn.usable(frame), F.expr(anchors)).collect()]


def _clustered(rng, n, dim=8, clusters=6):
    centres = rng.normal(size=(clusters, dim)) * 2
    at = rng.integers(0, clusters, n)
    vectors = centres[at] + rng.normal(size=(n, dim)) * 0.15
    return [(i, [float(x) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(vectors)]


def test_negatives_match_the_definition(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 15)
    rng = np.random.default_rng(3)
    rows = _clustered(rng, 400)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(30)]  # one vector under many ids: ties
    rows += rows[10:20]  # repeated rows
    rows += [(50, rows[3][1], 2), (2000, [0.0] * 8, 1), (2010, [0.0] * 8, 0), (2001, [1.0, 2.0], 1), (2020, [1.5, 2.0], 1), (2002, [1.0, 1.9], 0)]
    rows += [(3000, None, 1), (3010, [1.0] * 8, None), (None, [1.0] * 8, 1), (3020, [float("nan")] + [1.0] * 7, 1), (3030, [None] + [1.0] * 7, 1), (3040, [float("inf")] * 8, 0)]
    rows += [(3050, [], 1), (3060, [], 1), (3061, [], 0)]
    got = _run_negatives(spark, rows)
    assert len(got) == len(set(got)) > 50
    assert set(got) == _negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_numbers_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(1, 1 << 22)) for _ in range(3)], i % 2) for i in range(60)]
    assert set(_run_negatives(spark, rows)) == _negatives(rows, lambda i: i % 10 == 0)


def test_an_empty_table_has_no_negatives(spark):
    assert _run_negatives(spark, []) == []
    assert _run_negatives(spark, [(10, None, 1)]) == []
    assert _run_negatives(spark, [(10, [1.0], 1)]) == []


def test_the_filter_skips_what_bounds_rule_out_and_nothing_else():
    rng = np.random.default_rng(4)
    rows = sorted(_clustered(rng, 3000, dim=16, clusters=12), key=lambda r: r[1])
    vectors = hn.whole_numbers(np.array([r[1] for r in rows]))
    norms, angles = hn.angles_to(vectors, hn.far_apart(vectors[:500]))

    class Part:
        pass

    def part(use):
        out = Part()
        out.ids, out.labels = (np.array([rows[i][c] for i in use], np.int64) for c in (0, 2))
        out.vectors, out.norms, out.angles = vectors[use], norms[use], angles[use]
        return out

    anchors, blocks = part(range(0, 3000, 50)), [part(range(lo, lo + 100)) for lo in range(0, 3000, 100)]
    work = hn.Filter()
    scores, ids = hn.best_positives(anchors, iter(blocks), 5, work)
    assert work.scored < 0.3 * len(anchors.ids) * 3000
    for k, a in enumerate(range(0, 3000, 50)):
        exact = sorted((-int(vectors[a] @ vectors[i]), rows[i][0]) for i in range(3000) if i != a and rows[i][2] == rows[a][2])[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[k], ids[k], strict=True)] == exact
    # Bounds hold for every pair.
    least, most = np.zeros((60, 3000)), np.full((60, 3000), np.pi)
    for r in range(angles.shape[1]):
        own, other = anchors.angles[:, r][:, None], angles[:, r]
        least, most = np.maximum(least, abs(own - other)), np.minimum(most, np.minimum(own + other, 2 * np.pi - own - other))
    n = np.broadcast_to(norms, least.shape)
    low, high = hn.score_bounds(np.broadcast_to(anchors.norms[:, None], least.shape), least, most, n, n)
    real = anchors.vectors @ vectors.T
    assert (low <= real).all() and (real <= high).all()


# Collocations -------------------------------------------------------------------------------------------------------


def _phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in frequent.items():
            inside = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if len(p) > 1 and not any(100 * b >= 80 * a for b in inside):
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def _texts(rng):
    words = ["New", "york", "city", "the", "a", "é", "ß", "x y", "of", "und", "w7"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "!?"]) for _ in range(rng.randint(0, 120)))
        rows.append((i if i % 9 else None, text, rng.choice(["en", "de", None, "und"])))
    rows += [(200, None, "en"), (201, "", "fr"), (202, " .,\n", "fr"), (203, "only one word here", "es")]
    return rows + rows[:20] + [(204, "New york City state " * 4000 + "x" * 50000, "en"), (205, "b " * 3000, "b")]


@pytest.mark.parametrize("dense, block, group", [(4096, 8 << 20, 64), (1, 9000, 2), (10**9, 3000, 1)])
def test_phrases_match_the_definition(spark, monkeypatch, dense, block, group):
    monkeypatch.setattr(col, "DENSE", dense)
    monkeypatch.setattr(col, "BLOCK_BYTES", block)
    monkeypatch.setattr(col, "REPLY_BLOCKS", group)
    monkeypatch.setattr(col, "LEAST_BUCKETS", 8)
    rows = _texts(random.Random(6))
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in col.collocations(frame, least=8).collect()]
    assert set(got) == _phrases(rows, 8) and len(got) == len(set(got)) > 20


def test_only_the_first_phrases_are_returned(spark):
    rows = _texts(random.Random(7))
    got = {tuple(r) for r in col.collocations(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS), least=5, top=3).collect()}
    assert got == _phrases(rows, 5, 3)


def test_no_documents_have_no_phrases(spark):
    assert col.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert col.collocations(spark.createDataFrame([(1, None, None, "x", "y"), (2, "a b", "en", "x", "y")], DOCS)).collect() == []


def test_tiles_add_up_across_flushes(monkeypatch):
    monkeypatch.setattr(col, "_FLUSH", 50)
    monkeypatch.setattr(col, "DENSE", 40)
    rng = np.random.default_rng(8)
    counts, exact = col.TileCounts(), Counter()
    for _ in range(40):
        a, b, n = rng.geometric(0.001, 300), rng.geometric(0.01, 300), rng.integers(1, 9, 300)
        cell, n = (x[np.argsort(col.cells(a, b))] for x in (col.cells(a, b), n))
        counts.add(*col.unpack_cells(col.pack_cells(cell, n)))
        for x, y, z in zip(*(p.tolist() for p in col.pairs_of(cell)), n.tolist(), strict=True):
            exact[x, y] += z
    cell, n = counts.at_least(20)
    got = {(a, b): c for a, b, c in zip(*(x.tolist() for x in col.pairs_of(cell)), n.tolist(), strict=True)}
    assert got == {p: c for p, c in exact.items() if c >= 20} and counts.dense
    big = np.array([(1 << 32) - 1, 0, 257]), np.array([5, (1 << 32) - 1, 256])
    assert all((x == y).all() for x, y in zip(col.pairs_of(col.cells(*big)), big, strict=True))


def test_scores_survive_counts_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.createDataFrame([(big, [big, big], [big, big])], "f long, heads array<long>, tails array<long>").select(col._weakest_cut(2)).first()[0]
    assert row["score"] == 2000000 * big // (2 * big) and row["k"] == 1


# Byte-level BPE -----------------------------------------------------------------------------------------------------

PIECES = ["a", "the", "  ", " ", "\n", "\t", "'s", "'", "ll", "'ll", "é", "ß", "漢字", "١٢", "12", " ", " ", "\x1c", "\x85", "🎉", "👩‍👩‍👧",
          "<|endoftext|>", "<|endof", "!!", "?!", ".", "ing", "ATION", "zzzz", "aaaaaaaaaaaa", "=====", "\r\n", "ſ", "İ", "́", "𝒳", "\x00", "ހ", "𞥐"]


@pytest.fixture(scope="module")
def tables():
    from tokenizers import Tokenizer

    vocabulary = bpe.Vocabulary(tokenizer_json())
    return vocabulary, bpe.Encoder(vocabulary), Tokenizer.from_str(tokenizer_json())


def test_backtracking_gives_the_ids_of_the_library(tables):
    vocabulary, encoder, library = tables
    rng = random.Random(9)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(encoder.encode(text), "<i4")
        assert got.tolist() == ids, text
        assert vocabulary.decode_bytes(got)[0].tobytes().decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_runs_take_linear_work(tables):
    _, encoder, library = tables
    rng = random.Random(10)
    for text in ("a" * 20000, "ab" * 9000, "=-" * 9000, " " * 9000 + "x", "".join(rng.choice("abcdeth") for _ in range(20000))):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def _merges(text, ranks):
    """BPE by its definition: the first merge of the lowest rank, again and again."""
    parts = list(text)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


def test_any_merge_list_is_followed(tables):
    """Random merges, among them ones whose results other merges always take apart."""
    import json

    rng = random.Random(11)
    for _ in range(30):
        tokens, merges = list("abc"), []
        while len(merges) < 25:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 12:
                tokens.append(a + b)
                merges.append([a, b])
        names = [*bpe.byte_letters(), *tokens[3:]]
        config = {"pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(names)}, "merges": merges}}
        vocabulary = bpe.Vocabulary(json.dumps(config))
        encoder = bpe.Encoder.__new__(bpe.Encoder)
        import ahocorasick

        encoder.v, encoder.fits = vocabulary, {}
        encoder.packed = [i.to_bytes(4, "little") for i in vocabulary.ids]
        encoder.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, token in enumerate(vocabulary.tokens):
            if vocabulary.alive[k]:
                encoder.finder.add_word(token[::-1], k)
        encoder.finder.make_automaton()
        ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            assert [names[i] for i in np.frombuffer(encoder.backtrack(text), "<i4")] == _merges(text, ranks)


def test_two_merges_for_one_token_are_refused():
    import json

    names = [*bpe.byte_letters(), "ab", "bc", "abc"]
    model = {"type": "BPE", "vocab": {t: i for i, t in enumerate(names)}, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]}
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps({"pre_tokenizer": {"type": "ByteLevel"}, "model": model}))


def test_documents_are_encoded_and_decoded(spark, tables):
    vocabulary, _, library = tables
    rows = [(1, "Hello <|endoftext|> you're  here\n\n", "en"), (2, None, None), (3, "", "en"), (1, "Hello <|endoftext|> you're  here\n\n", "en"), (None, "naïve 漢字", "x"),
            (4, "word " * 50000 + "z" * 30000, "en")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).withColumn("ids", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r)
    got = [tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(frame, vocabulary), vocabulary)).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r)) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r)) and key(got[0])
    assert bpe.decode(bpe.encode(frame.limit(0), vocabulary), vocabulary).collect() == []
    odd = spark.createDataFrame([(1, [0, 10**6, -5, None, 50256]), (2, None), (3, [vocabulary.ids[byte] for byte in (100, 200)])], "doc_id long, ids array<int>")
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(odd, vocabulary).collect()}
    assert texts[1] == library.decode([0, 50256], skip_special_tokens=False) and texts[2] == ""
    assert texts[3] == library.decode([vocabulary.ids[byte] for byte in (100, 200)], skip_special_tokens=False)
