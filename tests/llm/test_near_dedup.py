"""Near-dedup by wide SimHash fingerprints: fingerprints, keys and meetings against their definitions."""

import numpy as np
import pyarrow as pa

from plumeline.llm import jaccard_dedup, simhash_dedup as sim, words as W


def test_candidates_of_near_dedup_come_from_fingerprints(monkeypatch, spark):
    """the stage goes by SimHash; without its meetings of fingerprints no near copy is found, only equal sets."""
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words))], "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard_dedup.keep_one(docs).collect()] == [1]
    monkeypatch.setattr(jaccard_dedup, "DISTANCE", -1)
    monkeypatch.setattr(jaccard_dedup, "_meetings", lambda batches: (jaccard_dedup._of_met(*np.zeros((2, 0), np.int64), np.zeros((4, 0), np.uint64)) for _ in batches))
    assert sorted(r["doc_id"] for r in jaccard_dedup.keep_one(docs).collect()) == [1, 2]


def test_wide_fingerprints_match_their_definition():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 255, 256, 700, 2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, bounds[-1]).astype(np.uint64) * np.uint64(2)
    prints, marks = sim.wide_prints(hashes, bounds, 3)
    for d, n in enumerate(sizes):
        own = hashes[bounds[d] : bounds[d + 1]]
        for word in range(3):
            set_ = [sum(int(h) >> bit & 1 for h in W.mix(own, word + 1)) for bit in range(64)]
            assert int(prints[d, word]) == sum(1 << bit for bit in range(64) if 2 * set_[bit] > n)
            for block in range(4):
                lead = [abs(2 * c - n) for c in set_[16 * block : 16 * block + 16]]
                at = lead.index(max(lead))
                assert marks[d, 4 * word + block] == 2 * at + (2 * set_[16 * block + at] > n)
    assert sim.wide_prints(np.zeros(0, np.uint64), np.zeros(1, np.int64), 3)[1].shape == (0, 12)


def test_all_near_fingerprints_of_small_keys_meet_and_large_keys_stay_whole():
    rng = np.random.default_rng(4)
    sizes = [1, 2, jaccard_dedup.LIMIT, jaccard_dedup.LIMIT + 1, 3 * jaccard_dedup.LIMIT, 5, 40]
    key = np.repeat(np.arange(len(sizes)), sizes)
    node = rng.permutation(len(key))
    a, b = np.zeros((2, len(key)), np.int64)
    b[:] = [sum(1 << int(k) for k in rng.choice(60, 2 * 12, replace=False)) for _ in key]
    near = lambda i, j: (int(b[i]) ^ int(b[j])).bit_count() <= 26
    table = pa.table({"key": key, "node": node, "print_a": a, "print_b": b})
    was, jaccard_dedup.DISTANCE = jaccard_dedup.DISTANCE, 26
    try:
        for rows in (1, 7, 100, 10_000):
            out = pa.Table.from_batches(jaccard_dedup._meetings(iter(table.to_batches(max_chunksize=rows)))).to_pylist()
            large = {(r["key"], r["head"]) for r in out if r["large"]}
            small = [(r["head"], r["node"]) for r in out if not r["large"]]
            assert large == {(int(k), int(n)) for k, n in zip(key, node, strict=True) if sizes[k] > jaccard_dedup.LIMIT}
            want = {tuple(sorted((int(node[i]), int(node[j])))) for i in range(len(key)) for j in range(i) if key[i] == key[j] and sizes[key[i]] <= jaccard_dedup.LIMIT and near(i, j)}
            assert len(small) == len(set(small)) and set(small) == want and want
    finally:
        jaccard_dedup.DISTANCE = was


def test_sets_at_the_least_similarity_share_a_key():
    """Pairs of sets of 100 at Jaccard 0.8 or just above: few may miss each other, by keys and by bits, with keys of 3 and of 4 marks."""
    rng = np.random.default_rng(5)
    pairs = 600
    sets = [s for _ in range(pairs) for s in (lambda u: (u[:100], np.concatenate([u[:89], u[100:111]])))(rng.integers(0, 1 << 62, 111).astype(np.uint64))]
    prints, marks = sim.wide_prints(np.concatenate(sets), np.arange(0, 100 * len(sets) + 1, 100), jaccard_dedup.WORDS)
    bits = np.bitwise_count(prints[::2, :2] ^ prints[1::2, :2]).sum(1)
    same = marks[::2] == marks[1::2]
    assert (bits <= jaccard_dedup.DISTANCE).all()
    for width, least in ((3, 0.985), (4, 0.965)):
        assert same[:, jaccard_dedup.chosen_blocks(width)].all(2).any(1).mean() >= least
    assert [jaccard_dedup.key_width(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 25, 1 << 40)] == [3, 3, 4, 4, 5]


def test_a_family_of_copies_costs_a_few_pairs_for_each_member(monkeypatch, spark):
    """copies leave with the smallest of them; before, each two members of a family were a pair with both texts."""
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(100)] + ["other words that nobody else has here at all"]
    rows = [(n, t) for n, t in enumerate(texts)] + [(7, texts[7]), (None, "no id but a text"), (None, "no id but a text")]
    counts, staged = {}, jaccard_dedup.staged

    def counting(df, name, *more):
        out = staged(df, name, *more)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_dedup, "staged", counting)
    kept = jaccard_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == [-1, 0, 100]
    assert counts["pairs"] + counts["edges"] <= len(texts)
    assert counts["stars"] <= 20 * len(texts)


def test_leaders_match_their_definition():
    """the smallest near one under a small key, the first one under a large key, and who waits there."""
    rng = np.random.default_rng(6)
    sizes = [1, 2, jaccard_dedup.LIMIT, jaccard_dedup.LIMIT + 1, 3 * jaccard_dedup.LIMIT, 5, 40]
    key = np.repeat(np.arange(len(sizes)), sizes)
    node = rng.permutation(len(key))
    a = np.zeros(len(key), np.int64)
    b = np.array([sum(1 << int(k) for k in rng.choice(62, 31, replace=False)) for _ in key])
    was, jaccard_dedup.DISTANCE = jaccard_dedup.DISTANCE, 28
    near = lambda i, j: (int(b[i]) ^ int(b[j])).bit_count() <= 28
    want = set()
    for i in range(len(key)):
        group = np.flatnonzero(key == key[i])
        before = group[(group < i)] if len(group) <= jaccard_dedup.LIMIT else group[:1]
        head = next((int(node[j]) for j in before if j < i and near(i, j)), None)
        if head is not None or len(group) > jaccard_dedup.LIMIT and i > group[0]:
            want.add((int(key[i]), head, int(node[i])))
    want = sorted((h if h is not None else -1, n) for _, h, n in want)
    try:
        table = pa.table({"key": key, "node": node, "print_a": a, "print_b": b})
        for rows in (1, 7, 100, 10_000):
            out = pa.Table.from_batches(jaccard_dedup._leaders(iter(table.to_batches(max_chunksize=rows)))).to_pylist()
            assert sorted((-1 if r["head"] is None else r["head"], r["node"]) for r in out) == want
        assert len({h >= 0 for h, _ in want}) == 2
    finally:
        jaccard_dedup.DISTANCE = was


def test_fine_fingerprints_of_similar_sets_meet():
    """F1: no pair at 0.8 is lost to the finer bits, whatever the sizes; sets at 0.5 no longer meet."""
    rng = np.random.default_rng(8)
    for sets in (
        [(u[:n], np.concatenate([u[: 8 * n // 9], u[n : n + n // 9]])) for n in (9, 18, 90, 900) for u in (rng.integers(0, 1 << 62, 2 * n).astype(np.uint64) for _ in range(60))],
        [(u[:n], u[: n * 4 // 5]) for n in (10, 50, 500) for u in (rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(60))],
    ):
        flat = [s for pair in sets for s in pair]
        prints, _ = sim.wide_prints(np.concatenate(flat), np.concatenate([[0], np.cumsum([len(s) for s in flat])]), jaccard_dedup.FINE_BITS // 64)
        assert all(jaccard_dedup.jaccard(np.sort(x), np.sort(y)) >= 0.8 for x, y in sets)
        assert jaccard_dedup._near(prints.T, np.arange(0, len(flat), 2), np.arange(1, len(flat), 2)).mean() >= 0.99
    far = [s for u in (rng.integers(0, 1 << 62, 150).astype(np.uint64) for _ in range(60)) for s in (u[:100], u[50:])]
    prints, _ = sim.wide_prints(np.concatenate(far), np.arange(0, 100 * len(far) + 1, 100), jaccard_dedup.FINE_BITS // 64)
    assert not jaccard_dedup._near(prints.T, np.arange(0, len(far), 2), np.arange(1, len(far), 2)).any()
