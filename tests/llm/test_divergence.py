"""The audit of sources against brute force in plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank int, term string"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def made(n=240, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "été", "ÉTÉ", "straße", "日本", "日", "a", "ab", "abc", "abd", "z", "x1y"]
    out = [(i, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(1, 12))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "é", "z", None]), "clash", 1, "t") for i in range(n)]
    out += [(1, None, "en", "empty", "clash", None, None), (2, "", "lone", "only", None, 1, "t"), (None, "alpha 12 -- beta", "en", "a", None, 1, "t")]
    return out + [out[0]] * 3


def brute(rows, least, smooth, scale, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = words(text)
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = set()
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {k[1] for k in counts if k[0] == lang}
        total = sum((counts[lang, s] for s in sources), Counter())

        def share(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + scale * (of[t] + smooth) // (n + smooth * len(kept)) for t in kept}

        q, p = share(total), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize(("least", "smooth", "scale", "top", "ranges", "leaves"), [(30, 5, 10**9, 50, 10**6, 10**6), (2, 1, 1000, 3, 40, 2), (10**6, 5, 10**9, 50, 60, 10)])
def test_divergence(spark, monkeypatch, least, smooth, scale, top, ranges, leaves):
    monkeypatch.setattr(divergence, "LEAVES", leaves)
    monkeypatch.setattr(divergence, "COUNTERS", 20 * leaves)
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = divergence.divergence(df, least_docs=least, smooth=smooth, scale=scale, top=top, range_size=ranges)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least, smooth, scale, top)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_sources_and_terms_change_nothing():
    rng = random.Random(5)
    names, terms = [f"s{i}" for i in range(9)], [f"t{i}" for i in range(40)]
    held = [(t, *zip(*[(s, rng.randint(1, 9)) for s in rng.sample(names, rng.randint(1, 9))], strict=True)) for t in terms]
    totals = Counter()
    for _, sources, counts in held:
        for s, n in zip(sources, counts, strict=True):
            totals[s] += n
    left = pa.table({"term": [h[0] for h in held], "sources": [list(h[1]) for h in held], "counts": [list(h[2]) for h in held]})
    right = pa.table({"lang": ["en"] * 9, "source": names, "n": [totals[s] for s in names], "kept": [len(terms)] * 9})
    whole = divergence._walked(5, 10**9, 4)(None, left, right).to_pylist()
    parts = divergence._walked(5, 10**9, 4, block=30)(None, left, right).to_pylist()
    assert len(whole) == len(parts) and {tuple(r.values()) for r in whole} == {tuple(r.values()) for r in parts}


def test_tries_merge_and_keep_utf8_order():
    rng = random.Random(1)
    docs = [(("en", f"s{i % 3}"), b" ".join(bytes(rng.choices(b"abAB\xc3\xa9", k=rng.randint(1, 6))) for _ in range(9))) for i in range(80)] + [(("en", "s1"), b"a" * 300 + b" " + b"a" * 299)]
    tries = [divergence.counted([g for g, _ in docs[i : i + 9]], [t for _, t in docs[i : i + 9]]) for i in range(0, len(docs), 9)]
    whole = divergence.Trie.merged(tries)
    want = Counter()
    of = Counter()
    for group, text in docs:
        words = text.lower().split()
        want.update((w, group) for w in words)
        of.update((w, group) for w in set(words))
    assert whole.terms == sorted({w for w, _ in want})
    assert {(whole.terms[i], whole.groups[g]): (n, d) for i, g, n, d in zip(whole.leaf, whole.group, whole.n, whole.docs, strict=True)} == {k: (n, of[k]) for k, n in want.items()}
    # a slice, and back from edges
    part = whole.slice(5, 17)
    shared, edges = part.edges()
    assert divergence.Trie.paths(shared.tolist(), edges) == whole.terms[5:17] and max(shared) > 0
    (again,) = divergence._tries(divergence._batch(3, part))
    assert again.terms == part.terms and again.n.tolist() == part.n.tolist()
    assert [again.groups[g] for g in again.group] == [part.groups[g] for g in part.group]


def test_long_division_is_exact():
    rng = random.Random(2)
    d = [rng.randint(1, 8 * 10**15) for _ in range(2000)]
    a = [rng.randint(0, x) for x in d]
    for scale in (1, 10, 10**9):
        got = divergence.long_division(scale, np.array(a), np.array(d)).tolist()
        assert got == [scale * x // y for x, y in zip(a, d, strict=True)]
    with pytest.raises(OverflowError):
        divergence.long_division(10, np.array([1]), np.array([10**16]))
    with pytest.raises(ValueError):
        divergence.long_division(20, np.array([1]), np.array([2]))


def test_long_texts_come_in_pieces(monkeypatch):
    text = " ".join(random.Random(0).choices(["aa", "B", "é" * 40, "1", "--"], k=300)).encode()
    whole = [w for ws in divergence.terms_of(text) for w in ws]
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert [w for ws in divergence.terms_of(text) for w in ws] == whole
    assert [w for ws in divergence.terms_of(b"x" * 100) for w in ws] == [b"x" * 100]
