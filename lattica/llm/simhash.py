"""Near duplicates by SimHash: a binary trie of the fingerprints joined with itself.

1. Map: each text's shingles are hashed (XXH64, seed 42); a fingerprint bit is 1 where over half of them have it.
2. Equal fingerprints are one class; only distinct fingerprints go on, so copies never meet as pairs.
3. Fingerprints are dealt by parts: with at most k differing bits, one of k + 1 parts of the bits is equal.  So
   each fingerprint goes to k + 1 groups, and each pair that links meets in one of them at least.  A group of more
   than `most` fingerprints is dealt again, by k + 1 parts of the bits that are still open, until none is
   larger; parts are what distributes the work, they decide no link.
4. Inside of a group the open bits make a binary trie (ranges of the sorted fingerprints), which is joined with
   itself: pairs of nodes go down together, a step to unlike children costs one differing bit, and a pair whose
   bits exceed the budget is dropped with all that is below.  The join runs with a budget of 1, 2, ... k bits, so
   that close pairs link first, and a pair of nodes whose fingerprints are all in one component already is
   dropped too: a large family of near copies doesn't come out as all its pairs.  For the budget k the join runs
   twice, with either half of the open bits first: at most k // 2 bits differ in the first half, or at most
   k - k // 2 - 1 in the second, so most pairs end near the root.
5. Links of all groups give components; a component's smallest id is its name.

Classes, components and fingerprints that very many rows have are joined by `plans.joins.join_counted`.

Defined cases: null and empty texts and texts without words have the fingerprint zero, and link like any
other; fewer words than a shingle are one shingle; repeated rows each have a row in the result; a null id is
never a component's name if there is another; an empty table gives no rows; a very long text is hashed in
pieces; ids are 64-bit integers and need not be unique; no other column is read, whatever its name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.components import connected_components, least_labels
from lattica.plans.joins import join_counted

from . import common

BITS = 64
#: Bytes of text whose words are hashed at once; fingerprints of a group that one task joins; pairs of nodes held at once.
PIECE, MOST, HELD = 1_000_000, 1 << 17, 1 << 19
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def word_lists(text: bytes):
    """Words of a text in lists of bounded size; a long text comes in several."""
    begin = 0
    while len(text) - begin > PIECE:
        cut = max(text.rfind(c, begin, begin + PIECE) for c in _SPACES)
        if cut < 0:
            found = [x for x in (text.find(c, begin + PIECE) for c in _SPACES) if x >= 0]
            if not found:
                break
            cut = min(found)
        yield text[begin:cut].split()
        begin = cut + 1
    yield text[begin:].split()


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a text's shingles, repeats included."""
    ones, total, carried, hashed = np.zeros(BITS, np.int64), 0, [], xxhash.xxh64_intdigest
    for found in word_lists((text or b"").lower()):
        found = carried + found
        if len(found) >= words:
            line = b" ".join(found)
            ends = np.cumsum([len(w) + 1 for w in found]) - 1
            begins = [0, *(ends[: len(found) - words] + 1).tolist()]
            hashes = np.array([hashed(line[b:e], seed) for b, e in zip(begins, ends[words - 1 :].tolist(), strict=True)], np.uint64)
            ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carried = found[-(words - 1) :] if words > 1 else []
    if not total:
        if not carried:
            return 0
        return hashed(b" ".join(carried), seed)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def fingerprints(docs: DataFrame, *, text_col: str = "text", words: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """`docs` with its fingerprint as a signed 64-bit column `name` in place of its text; map-only."""
    def make():
        return lambda texts: [[x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, words, seed) for t in texts)]]

    return common.drop_columns(common.append_columns(docs, text_col, [T.StructField(name, T.LongType())], make), [text_col])


def parts_of(mask: int, k: int) -> list[int]:
    """`mask` with each of k + 1 near equal parts of its open (zero) bits added."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(open_bits) * i // (k + 1) for i in range(k + 2)]
    return [mask | sum(1 << b for b in open_bits[cuts[i] : cuts[i + 1]]) for i in range(k + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Links:
    """Components of places 0..n-1, and a link for each time that two of them became one."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.u: list[np.ndarray] = []
        self.p: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        on = x != y
        if not on.any():
            return
        names, least = least_labels(x[on], y[on])
        moved = names != least
        self.u.append(names[moved])
        self.p.append(least[moved])
        to = np.arange(len(self.label))
        to[names] = least
        self.label = to[self.label]


def _spread(values: np.ndarray, masks: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """Open bits of each value at the top, in either order of their halves, and the number of open bits of the half that comes first."""
    out, half = np.zeros(len(values), np.uint64), np.zeros(len(values), np.int64)
    for mask in np.unique(masks):
        on = masks == mask
        bits = [b for b in range(BITS - 1, -1, -1) if not int(mask) >> b & 1]
        middle = (len(bits) + 1) // 2
        ordered = bits if first_half else bits[middle:] + bits[:middle]
        got, at = np.zeros(int(on.sum()), np.uint64), values[on]
        for place, bit in enumerate(ordered):
            got |= (at >> np.uint64(bit) & np.uint64(1)) << np.uint64(BITS - 1 - place)
        out[on], half[on] = got, middle if first_half else len(bits) - middle
    return out, half


def self_join(group: np.ndarray, fp: np.ndarray, mask: np.ndarray, k: int, links: Links, held: int = HELD) -> None:
    """Links that connect all fingerprints (distinct in a group) of equal `group` that differ in at most k bits, by joining each group's trie with itself."""
    for budget in range(1, k + 1):
        for first_half, early in ((True, budget // 2), (False, budget - budget // 2 - 1)):
            if early >= 0:
                key, half = _spread(fp, mask, first_half)
                order = np.lexsort((key, group))
                _descend(group[order], key[order], fp[order], half[order], order, early, budget, links, held)


def _descend(group, key, fp, half, order, early: int, budget: int, links: Links, held: int) -> None:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    zeros: dict[int, np.ndarray] = {}

    def split(lo, hi, depth):
        """Where the second child of each node begins."""
        if depth not in zeros:
            zeros[depth] = np.r_[0, np.cumsum(key >> np.uint64(BITS - 1 - depth) & np.uint64(1) == 0)]
        return lo + zeros[depth][hi] - zeros[depth][lo]

    on = ends - starts > 1
    todo = [(0, starts[on], ends[on], starts[on], ends[on], np.zeros(int(on.sum()), np.int8))]
    while todo:
        depth, alo, ahi, blo, bhi, cost = todo.pop()
        if len(alo) > held:
            for begin in range(0, len(alo), held):
                todo.append((depth, *(x[begin : begin + held] for x in (alo, ahi, blo, bhi, cost))))
            continue
        # pairs of single fingerprints are settled
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            links.add(order[a[near]], order[b[near]])
        on = ~single
        if not on.any() or depth == BITS:
            continue
        alo, ahi, blo, bhi, cost = (x[on] for x in (alo, ahi, blo, bhi, cost))
        am, bm = split(alo, ahi, depth), split(blo, bhi, depth)
        same = alo == blo
        pairs = [(alo, am, blo, bm, cost), (am, ahi, bm, bhi, cost), (alo, am, bm, bhi, cost + 1), (am[~same], ahi[~same], blo[~same], bm[~same], cost[~same] + 1)]
        alo, ahi, blo, bhi, cost = (np.concatenate(x) for x in zip(*pairs, strict=True))
        # beyond the first half only the whole budget counts
        on = (ahi > alo) & (bhi > blo) & (cost <= np.where(depth < half[np.minimum(alo, len(half) - 1)], early, budget)) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, cost = (x[on] for x in (alo, ahi, blo, bhi, cost))
        if len(alo):
            # nodes whose fingerprints are all in one component have nothing to link
            label = links.label[order]
            changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo])
            todo.append((depth + 1, *(x[~one] for x in (alo, ahi, blo, bhi, cost))))


def _joined(k: int, most: int):
    """Rows (mask, part, fp), sorted by (mask, part), to links (a, b) between fingerprints of equal mask and part."""

    def links_of(mask, part, fp):
        edge = np.r_[True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])]
        links = Links(len(fp))
        self_join(np.cumsum(edge), fp.view(np.uint64), mask.view(np.uint64), k, links)
        none = np.empty(0, np.int64)
        u, p = np.concatenate([none, *links.u]), np.concatenate([none, *links.p])
        return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[p])], names=["a", "b"])

    def run(batches):
        have = [np.empty(0, np.int64)] * 3
        for batch in batches:
            have = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(have, ("mask", "part", "fp"), strict=True)]
            if len(have[0]) >= most:
                # groups that have ended; the last one may go on in the next batch
                last = int(np.argmax((have[0] == have[0][-1]) & (have[1] == have[1][-1])))
                if last:
                    yield links_of(*(x[:last] for x in have))
                    have = [x[last:].copy() for x in have]
        if len(have[0]):
            yield links_of(*have)
        common.release()

    return run


def links_within(prints: DataFrame, k: int = 4, most: int = MOST) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within k bits of each other.

    A group whose open bits are k or fewer isn't dealt again: it has 2^k fingerprints at most.
    """
    if not 0 <= k < BITS // 2:
        raise ValueError("k must be 0 to 31")

    def dealt(df: DataFrame, masks: list[int]) -> DataFrame:
        """Each row once for each part of the open bits of its mask, which is one of `masks`."""
        options = [F.when(F.col("mask") == F.lit(signed(m)), F.array(*(F.lit(signed(x)).cast("long") for x in parts_of(m, k)))) for m in masks]
        return df.withColumn("mask", F.explode(F.coalesce(*options)))

    ready: list[DataFrame] = []
    rows = dealt(prints.select(F.lit(0).cast("long").alias("mask"), "fp"), [0])
    while True:
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")
        rows = rows.distinct() if ready else rows
        large = common.written(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.bit_count("mask") < BITS - k)), "large")
        total = large.agg(F.sum("n"), F.collect_set("mask")).first()
        if not total[0]:
            ready.append(rows)
            break
        ready.append(rows.join(large if large.count() > 100_000 else F.broadcast(large), ["mask", "part"], "left_anti"))
        again = common.written(join_counted(rows, large, ["mask", "part"], "n", total[0]).select("mask", "fp"), "again")
        rows = dealt(again, [m % (1 << BITS) for m in total[1]])
    rows = reduce(DataFrame.unionByName, ready)
    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(_joined(k, most), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, bits: int = 4, most: int = MOST,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the smallest id that links of at most `bits` bits reach."""
    rows = fingerprints(docs.select(common.col(id_col).cast("long").alias("id"), common.col(text_col).alias("text")), text_col="text", words=words, seed=seed)
    rows = common.written(rows, "prints")
    classes = common.written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    found = connected_components(links_within(classes.select("fp"), bits, most)).select(F.col("v").alias("fp"), "root")
    named = common.written(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    totals = named.agg(F.count("*"), F.sum("n")).first()
    of_class = join_counted(named.select("fp", "n", "root"), roots, ["root"], "k", totals[0] or 0).select("fp", "n", "component_id")
    return join_counted(rows, of_class, ["fp"], "n", totals[1] or 0).select(F.col("id").alias("doc_id"), "fp", "component_id")


def op12_trie_join(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
