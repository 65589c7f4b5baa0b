"""Hashes of words, shingles and byte windows in numpy, and counts of packed keys over the corpus."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def powers(kind: str, n: int) -> np.ndarray:
    base = BASE if kind == "up" else BASE_INVERSE
    have = _powers.get(kind)
    if have is None or len(have) < n:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        _powers[kind] = have = np.multiply.accumulate(out)
    return have[:n]


def forget() -> None:
    """Drop the tables of powers."""
    _powers.clear()


def string_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings, put together from those of powers of two."""

    def chain(a, size_a, b, size_b):
        n = len(a) - size_b
        return a[:n] * np.uint64(pow(BASE, size_b, 2**64)) + b[size_a : size_a + n]

    out, size, part, step = None, 0, text.astype(np.uint64) + np.uint64(1), 1
    while True:
        if k & step:
            out = part if out is None else chain(out, size, part, step)
            size += step
        if size == k:
            return out
        part, step = chain(part, step, part, step), 2 * step


#: Bytes of text that are hashed at once.
AT_ONCE = 250_000
GAP = re.compile(rb"[\x20\x09-\x0D]")


def _cut(text: bytes):
    """A text in pieces of about AT_ONCE bytes, cut between words."""
    begin = 0
    while len(text) - begin > AT_ONCE and (gap := GAP.search(text, begin + AT_ONCE)):
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased texts, one after another, and each text's first word (plus end)."""
    pieces = [(k, p) for k, t in enumerate(texts) for p in (_cut(t) if len(t) > AT_ONCE else (t,))]
    words, counts, begin, total = [], np.zeros(len(texts) + 1, dtype=np.int64), 0, 0
    for i, (_, p) in enumerate(pieces):
        total += len(p)
        if total >= AT_ONCE or i + 1 == len(pieces):
            own = pieces[begin : i + 1]
            found, first = _word_hashes([p for _, p in own])
            words.append(found)
            np.add.at(counts, np.array([k for k, _ in own]) + 1, np.diff(first))
            begin, total = i + 1, 0
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum(counts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    gap = SEPARATOR[joined]
    begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    run = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers("up", len(joined)), out=run[1:])
    h = (run[ends] - run[begins]) * powers("down", len(joined))[begins]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return mix(h + (ends - begins).astype(np.uint64) * MIX_A), np.searchsorted(begins, offsets + 1)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none are none."""
    words, first = word_hashes(texts)
    factors = [np.uint64(pow(BASE, 3 * i + 5, 2**64)) for i in range(k)]
    n = max(0, len(words) - k + 1)
    sums = np.zeros(n, dtype=np.uint64)
    for i, f in enumerate(factors):
        sums += words[i : i + n] * f
    sums = mix(sums)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(sums[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * np.array(factors[: b - a])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([b - a], dtype=np.uint64) * MIX_B))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of keys by part, and where each part begins; parts go by a hash of their own."""
    part = (mix(keys ^ MIX_A) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def short(keys: np.ndarray) -> bytes:
    """Six of a mixed key's eight bytes: among the keys of one part these tell different keys apart."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def long(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def key_counts(blocks: DataFrame, parts: int, count_of: int, together: int = 100_000) -> DataFrame:
    """(block, part, counts): for rows (block, keys) how often each key stands in all rows, capped at 65535.

    Keys (packed 64-bit integers) go to `parts` tasks by hash, as one binary a block and part that has each
    distinct key once, with its number; totals come back in the same order, so a block can put them to its keys
    (`told`).  A key that stands in every block brings one entry a block to its task; where the number of blocks,
    `count_of`, is beyond `together` their entries are first summed in groups of about so many blocks, so it brings one a group.  The cap is on
    the number that is told, not on what is counted.  A key travels as 48 of its bits: two keys of one part that
    agree in them would count together, so a count may be too high, but is the same for a key wherever it stands.
    """
    groups = max(1, -(-count_of // together))
    names = ["block", "part", "lot", "keys", "n"]

    def split(batches):
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = np.unique(np.frombuffer(packed, dtype=np.uint64), return_counts=True)
                order, at = dealt(keys, parts)
                own = [k for k in range(parts) if at[k + 1] > at[k]]
                lot = int(mix(np.array([block], dtype=np.int64).view(np.uint64))[0] % np.uint64(groups))
                cut = lambda x, k, order=order, at=at: x[order[at[k] : at[k + 1]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([lot] * len(own), pa.int32()),
                     pa.array([short(cut(keys, k)) for k in own], pa.binary()), pa.array([pack(cut(n, k)) for k in own], pa.binary())], names=names)

    def summed(table: pa.Table):
        """Distinct keys of the rows, their totals, each row's end, and where each entry stands among the keys."""
        held = [long(x) for x in table.column("keys").to_pylist()]
        n = np.concatenate([unpack(x, np.int64) for x in table.column("n").to_pylist()])
        keys, place = np.unique(np.concatenate(held), return_inverse=True)
        return keys, np.bincount(place, n).astype(np.int64), np.cumsum([len(x) for x in held]), place

    def cut_up(x: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
        return pa.array([pack(x[a:b].astype(kind)) for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)], pa.binary())

    def count(table: pa.Table) -> pa.Table:
        _, n, ends, place = summed(table)
        common.release(False)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "lot": table.column("lot"), "counts": cut_up(np.minimum(n, 65535)[place], ends, np.uint16)})

    def lots(table: pa.Table) -> pa.Table:
        keys, n, _, _ = summed(table)
        return pa.table({"block": pa.array([0], pa.int64()), "part": table.column("part")[:1], "lot": table.column("lot")[:1], "keys": pa.array([short(keys)], pa.binary()), "n": pa.array([pack(n)], pa.binary())})

    def back(own: pa.Table, total: pa.Table) -> pa.Table:
        keys, _, ends, place = summed(own)  # the same rows as in `lots`, so the same keys in the same order
        n = unpack(total.column("counts")[0].as_py(), np.uint16)
        return pa.table({"block": own.column("block"), "part": own.column("part"), "counts": cut_up(n[place], ends, np.uint16)})

    pieces = blocks.select("block", "keys").mapInArrow(split, "block long, part int, lot int, keys binary, n binary")
    told_ = "block long, part int, lot int, counts binary"
    if groups == 1:
        return pieces.groupBy("part").applyInArrow(count, told_).drop("lot")
    totals = pieces.groupBy("part", "lot").applyInArrow(lots, "block long, part int, lot int, keys binary, n binary").groupBy("part").applyInArrow(count, told_)
    return pieces.groupBy("part", "lot").cogroup(totals.groupBy("part", "lot")).applyInArrow(back, "block long, part int, counts binary")


def told(keys: np.ndarray, parts: int, counts: list[tuple[int, bytes]]) -> np.ndarray:
    """The counts of a block's keys, in the keys' order."""
    keys, place = np.unique(keys, return_inverse=True)
    order, at = dealt(keys, parts)
    out = np.zeros(len(keys), dtype=np.uint16)
    for part, packed in counts:
        out[order[at[part] : at[part + 1]]] = unpack(packed, np.uint16)
    return out[place]


def parts_for(blocks: DataFrame, column: str = "n_keys", each: int = 1_500_000) -> tuple[int, int]:
    """The number of parts for the blocks' keys, and of blocks."""
    total, n = blocks.agg(F.sum(column), F.count("*")).first()
    return max(1, -(-(total or 0) // each)), n
