"""Substring dedup and SimHash near-dedup against their definitions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.llm import simhash_dedup as sim, substring_dedup as sub

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def _random_rows(seed=1, n=60):
    rng = random.Random(seed)
    shared = [[f"s{k}_{i}" for i in range(rng.randint(8, 30))] for k in range(4)]
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = s
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    return rows + [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, " \n\t ")]


@pytest.mark.parametrize("ranges", [None, 64])
def test_removed_words_match_the_definition(spark, ranges):
    rows = _random_rows()
    random.Random(2).shuffle(rows)
    out = sub.kept_digest(sub.remove_repeats(_docs(spark, rows).repartition(5), 7, ranges)).collect()
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out}
    assert got == set(sub.brute_force(rows, 7)) and len(out) == len(rows)


def test_intervals_are_maximal_and_kept_text_is_joined(spark):
    a = " ".join(f"a{i}" for i in range(20))
    rows = [(1, a), (2, f"x\n{a}\ty"), (3, " ".join(a.split()[2:9]) + " z")]
    out = {r["doc_id"]: r for r in sub.remove_repeats(_docs(spark, rows), 5).collect()}
    assert out[2]["kept"] == "x y" and [(s["start"], s["stop"]) for s in out[2]["intervals"]] == [(1, 21)]
    assert out[3]["kept"] == "z" and out[1]["n_removed"] == 0


def test_repeated_ids_null_ids_and_repeats_inside_one_text(spark):
    a = " ".join(f"a{i}" for i in range(6))
    rows = [(5, a), (5, a), (None, a), (None, "q " + a), (7, f"{a} {a}"), (5, "b " + a)]
    out = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in sub.remove_repeats(_docs(spark, rows), 5).collect()))
    assert out == sorted([(5, 6, 0), (5, 6, 0), (-1, 6, 6), (-1, 7, 6), (7, 12, 12), (5, 7, 0)])


def test_packed_blocks_keep_values():
    steps = np.array([0, 3, 3 + 255, 70_000, 70_001, 5_000_000])
    assert sub._unpack_steps(sub._pack_steps(steps)).tolist() == steps.tolist()
    ids, keys, first = np.array([4, 9, (1 << 63) - 1]), np.array([-5, 7, 0], np.int32), np.array([-3, 10, 10, 99])
    for a, b in zip((ids, keys, first), sub._unpack_table(sub._pack_table(ids, keys, first)), strict=True):
        assert a.tolist() == b.tolist()


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    out = {r["doc_id"]: r["n_removed"] for r in sub.remove_repeats(_docs(spark, [(1, long), (2, "x " + long)]), 50).collect()}
    assert out == {1: 0, 2: 300_000}


def test_empty_table_and_clashing_columns(spark):
    empty = _docs(spark, []).withColumn("text_key", F.lit(1)).withColumn("hits", F.lit("x"))
    assert sub.remove_repeats(empty, 5).count() == 0
    assert sim.near_duplicates(empty).count() == 0 and sim.keep_one(empty).columns == empty.columns
    full = _docs(spark, [(1, "a b c d e f")]).withColumn("text_key", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    assert sub.remove_repeats(full, 5).count() == 1 and sim.near_duplicates(full).count() == 1


def _xxh64(data: bytes, seed: int) -> int:
    """XXH64 by its published definition."""
    m = (1 << 64) - 1
    p = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m
    n, at = len(data), 0
    if n >= 32:
        v = [(seed + p[0] + p[1]) & m, (seed + p[1]) & m, seed, (seed - p[0]) & m]
        while at <= n - 32:
            for k in range(4):
                v[k] = rot((v[k] + int.from_bytes(data[at : at + 8], "little") * p[1]) & m, 31) * p[0] & m
                at += 8
        h = (rot(v[0], 1) + rot(v[1], 7) + rot(v[2], 12) + rot(v[3], 18)) & m
        for x in v:
            h = ((h ^ (rot(x * p[1] & m, 31) * p[0] & m)) * p[0] + p[3]) & m
    else:
        h = (seed + p[4]) & m
    h = (h + n) & m
    while at + 8 <= n:
        h ^= rot(int.from_bytes(data[at : at + 8], "little") * p[1] & m, 31) * p[0] & m
        h, at = (rot(h, 27) * p[0] + p[3]) & m, at + 8
    if at + 4 <= n:
        h ^= int.from_bytes(data[at : at + 4], "little") * p[0] & m
        h, at = (rot(h, 23) * p[1] + p[2]) & m, at + 4
    for b in data[at:]:
        h = rot(h ^ (b * p[4] & m), 11) * p[0] & m
    h = (h ^ (h >> 33)) * p[1] & m
    h = (h ^ (h >> 29)) * p[2] & m
    return h ^ (h >> 32)


def _print_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [_xxh64(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_match_the_definition(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 90)}" for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base) if i % 2 else [f"v{rng.randint(0, 50)}" for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = f"Ünï{rng.randint(0, 9)}"
        rows.append((i + 10, " ".join(words)))
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "One"), (6, "x" * 50_000 + " y z")]
    rows.sort()
    prints = [_print_of(t) for _, t in rows]
    ids = [i for i, _ in rows]
    expected = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, _roots(prints, 3), strict=True)}
    out = sim.near_duplicates(_docs(spark, rows)).select("doc_id", sim.hex_fingerprint().alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in out} == expected


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_every_choice_of_blocks_finds_all_links(spark, blocks):
    rng = random.Random(blocks)
    centre = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(25)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    out = {(r["low"], r["high"]) for r in sim.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 3, blocks).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert out == expected


def test_block_count_follows_the_number_of_fingerprints():
    counts = [sim.block_count(1 << k, 3) for k in (0, 10, 20, 30, 40)]
    assert counts == sorted(counts) and counts[0] == 5 and counts[-1] > counts[0]


def test_components_of_long_chains(spark):
    n = 200
    order = random.Random(5).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7000, 7000)]
    out = {r["node"]: r["root"] for r in sim.components(spark.createDataFrame(edges, "low long, high long")).collect()}
    assert out == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (9, "quite another text of some words"), (None, "lone words here"), (None, "lone words here")]
    out = sorted((r["doc_id"] or -1) for r in sim.keep_one(_docs(spark, rows)).collect())
    assert out == [-1, 1, 9]


def test_digest_is_of_kept_text(spark):
    out = sub.kept_digest(sub.remove_repeats(_docs(spark, [(1, "é  b")]), 5)).first()
    assert out["kept_sha256"] == hashlib.sha256("é b".encode()).hexdigest()
