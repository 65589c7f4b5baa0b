"""SimHash components against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, mask string, n int, root long"
WORDS = "the of and river stone market yellow quiet engine paper window garden signal under between copper winter méthode straße".split()


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, bits):
    """Smallest name that each place reaches; places are (name, fingerprint)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if bin(x ^ prints[j][1]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (name, _) in enumerate(prints):
        if name is not None:
            least[find(i)].append(name)
    return [min(least[find(i)], default=None) for i in range(len(prints))]


def made(seed=1):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(400)] = rng.choice(WORDS)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 4, 5, 50, 200)]
    texts += [None, "", " \t\n", "one", "ONE", "x" * 5000, texts[0].upper()]
    out = [(i * 7 % 101, t, "clash", i, "m", 1, 5) for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, texts[3], None, None, None, None, None), (None, "alone among all of these", None, None, None, None, None)]


@pytest.mark.parametrize(("bits", "most"), [(4, 1 << 17), (4, 40), (0, 40), (9, 40)])
def test_near_duplicates(spark, bits, most):
    rows = made()
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bits=bits, most=most).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = Counter((i, p, c) for (i, p), c in zip(prints, brute_components(prints, bits), strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == want


def test_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def dense(seed, n):
    """Fingerprints close to each other, in families and at random."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(n)}
    return sorted(out)


def parted(pairs, values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [1, 3, 4])
@pytest.mark.parametrize("held", [1 << 19, 50])
def test_trie_join_finds_what_all_pairs_find(seed, k, held):
    values = dense(seed, 60)
    fp = np.array(values, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= k
    want = parted([(values[i], values[j]) for i, j in zip(*np.nonzero(near), strict=True)], values)
    for mask in (0, 0xFF << 20):
        group = (fp & np.uint64(mask)).astype(np.int64)
        links = simhash.Links(len(fp))
        simhash.self_join(group, fp, np.full(len(fp), mask, np.uint64), k, links, held)
        pairs = [(values[a], values[b]) for u, p in zip(links.u, links.p, strict=True) for a, b in zip(u, p, strict=True)]
        if mask == 0:
            assert parted(pairs, values) == want
        same = near & (group[:, None] == group[None, :])
        assert parted(pairs, values) == parted([(values[i], values[j]) for i, j in zip(*np.nonzero(same), strict=True)], values)


def test_a_dense_family_is_not_put_out_as_all_pairs():
    rng = random.Random(9)
    values = sorted({sum(1 << b for b in rng.sample(range(40), 3)) for _ in range(3000)})
    fp, links = np.array(values, np.uint64), simhash.Links(0)
    links = simhash.Links(len(fp))
    simhash.self_join(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), np.uint64), 4, links)
    assert sum(map(len, links.u)) < 12 * len(fp) and len(set(links.label.tolist())) == 1


@pytest.mark.parametrize("most", [8, 64, 1 << 17])
def test_hot_groups_are_dealt_again(spark, most):
    values = dense(7, 50)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links_within(prints, 4, most).collect()]
    fp = np.array(values, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    assert parted(pairs, values) == parted([(values[i], values[j]) for i, j in zip(*np.nonzero(near), strict=True)], values)


def test_parts_cover_all_open_bits():
    for mask in (0, 0xFFFF << 13, (1 << 60) - 1):
        for k in (0, 1, 4):
            parts = simhash.parts_of(mask, k)
            assert len(parts) == k + 1
            union = mask
            for p in parts:
                assert p & mask == mask and (p & ~mask) & (union & ~mask) == 0
                union |= p
            assert union == (1 << 64) - 1


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(random.Random(0).choices([*WORDS, "y" * 90], k=500))
    whole = simhash.fingerprint(text.encode())
    assert whole == brute_print(text)
    monkeypatch.setattr(simhash, "PIECE", 20)
    assert simhash.fingerprint(text.encode()) == whole
    for short in ("a b c", "a", "z" * 100 + " b", "a b c d", ""):
        assert simhash.fingerprint(short.encode()) == brute_print(short)


def test_spark_hashes_shingles_alike(spark):
    """Spark's own xxhash64 is the same function of the shingle's bytes."""
    got = spark.range(1).select(F.xxhash64(F.lit("méthode straße of the")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest("méthode straße of the".encode(), seed=42)
