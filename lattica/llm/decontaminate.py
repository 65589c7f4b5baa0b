"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become a normal form: words (ASCII letters lower-cased) with one space before and after each,
so that a run of words occurs in a text exactly where its own normal form occurs as a string.
A benchmark item's windows are its runs of `window` words; an item with fewer words, but not none,
is one window.  Windows are searched with shift tables over blocks of bytes, buckets of windows by
the hash of their suffix block, and a direct comparison (of the first bytes for all candidates at once, then
of the rest).

The tables are compact: windows are places in the benchmark's own normal form, a shift table is one byte for
each value of a block's hash, and a bucket is a range of a sorted array.  They take about 11 bytes for each
byte of the benchmark (50 while they are built), are built once, on the driver, and broadcast; a benchmark of more than `block_bytes`
is searched block by block.

Defined cases: a null or empty text has no words and is not contaminated; an item without words has
no window; repeated items count once for each distinct item id; a null item id is written `null`;
repeated document rows are judged one by one; a very long text is searched as a whole; extra columns pass
through (see `common`).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packed

#: Word bytes are 0-9, a-z and all above 0x7F; A-Z are lower-cased before.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_TABLE).split()


#: Bytes that are searched at once.
AT_ONCE = 250_000
#: Bits of a block's hash that a shift table tells apart, and the largest shift that it holds.
MOST_BITS, MOST_SHIFT = 24, 255


class WuManber:
    """Multi-pattern search over one class of patterns of like length (`m` is the shortest).

    Patterns are begins and lengths in `body`.
    """

    def __init__(self, body: bytes, begins: np.ndarray, lengths: np.ndarray):
        self.m = m = int(min(lengths.min(), MOST_SHIFT))
        # The block length that the method advises: log of 2 * m * patterns, to a base of about 8 letters.
        block, reach = 2, 64
        while reach < 2 * m * len(begins):
            block, reach = block + 1, reach * 8
        self.block = block = min(m, block)
        self.bits = min(MOST_BITS, max(12, int(8 * len(begins) * (m - block + 1)).bit_length()))
        text = np.frombuffer(body, np.uint8)
        blocks = self._slots(packed.string_hashes(text, block))
        self.shift = np.full(2**self.bits, m - block + 1, np.uint8)
        # Later blocks have smaller shifts, so each assignment leaves the smallest.
        for end in range(block, m + 1):
            self.shift[blocks[begins + end - block]] = m - end
        # Buckets by the suffix block's hash: ranges of the sorted patterns.
        suffix = blocks[begins + m - block]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.begins, self.lengths, self.names = suffix[order], begins[order], lengths[order], order

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * packed.MIX_A) >> np.uint64(64 - self.bits)).astype(np.uint32)

    def find(self, text: bytes, body: bytes):
        """(begin, number of the pattern) of every occurrence; `body` is the benchmark's normal form."""
        m, block, n = self.m, self.block, len(text)
        if n < m:
            return
        bytes_, known = np.frombuffer(text, np.uint8), np.frombuffer(body, np.uint8)
        slots = self._slots(packed.string_hashes(bytes_, block))
        shifts = self.shift[slots].tobytes()  # by the block's begin
        at, last, held = m - block, n - block, []
        while at <= last:
            skip = shifts[at]
            if skip:
                at += skip
            else:
                held.append(at)
                at += 1
        for k in range(0, len(held), 100_000):
            places = np.array(held[k : k + 100_000])
            low, high = np.searchsorted(self.suffix, slots[places]), np.searchsorted(self.suffix, slots[places], side="right")
            # Candidates in lots: a bucket can be large where many patterns begin alike.
            ends = np.cumsum(high - low)
            first = 0
            while first < len(places):
                stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 1_000_000, side="right")))
                counts = high[first:stop] - low[first:stop]
                begin = np.repeat(places[first:stop] - (m - block), counts)
                own = np.repeat(low[first:stop] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                for j in range(0, m, max(1, m // 4)):
                    same = bytes_[begin + j] == known[self.begins[own] + j]
                    begin, own = begin[same], own[same]
                for b, o in zip(begin.tolist(), own.tolist(), strict=True):
                    f = self.begins[o]
                    if text.startswith(body[f : f + self.lengths[o]], b):
                        yield b, int(self.names[o])
                first = stop


class Matcher:
    """Windows of many items, in one search table for each power of two of the window length.

    Windows of equal hashes (128 bits) and length are one pattern with several owners.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        normal, begins, ends, owners, at = [], [], [], [], 0
        for item, text in items:
            ws = words_of(text)
            if not ws:
                continue
            normal.append(b" " + b" ".join(ws) + b" ")
            edge = at + np.r_[0, np.cumsum([len(w) + 1 for w in ws])]
            count = max(1, len(ws) - window + 1)
            begins.append(edge[:count])
            ends.append(edge[min(window, len(ws)) :][:count] + 1)
            owners.append(np.full(count, number[item], np.int32))
            at += len(normal[-1])
        self.body = b"".join(normal)
        self.searches: list[tuple[WuManber, np.ndarray]] = []
        if not normal:
            return
        begin, end, owner = np.concatenate(begins), np.concatenate(ends), np.concatenate(owners)
        h1, h2 = _window_hashes(np.frombuffer(self.body, np.uint8), begin, end)
        length = end - begin
        order = np.lexsort((owner, h2, h1, length))
        same = lambda x: x[order][1:] == x[order][:-1]
        new = np.r_[True, ~(same(length) & same(h1) & same(h2))]
        # Pattern p is the window order[firsts[p]]; its owners stand from own_at[p] on.
        firsts, pattern = np.flatnonzero(new), np.cumsum(new) - 1
        kept = np.r_[True, (pattern[1:] != pattern[:-1]) | (owner[order][1:] != owner[order][:-1])]
        self.owners, self.own_at = owner[order][kept], np.searchsorted(pattern[kept], np.arange(len(firsts) + 1))
        begin, length = begin[order][firsts], length[order][firsts]
        kind = np.floor(np.log2(length)).astype(np.int64)
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            self.searches.append((WuManber(self.body, begin[own], length[own]), own))
        self.lengths = length

    def occurrences(self, normal: bytes):
        """(begin, end, number of the window) of all occurrences in normal forms that stand one after another.

        Between two of them are two spaces, which no window has, so none reaches over two texts.  They are searched
        in pieces that overlap by the longest window.
        """
        for search, names in self.searches:
            reach = int(search.lengths.max())
            for s in range(0, len(normal), AT_ONCE):
                for begin, p in search.find(normal[s : s + AT_ONCE + reach - 1], self.body):
                    if begin < AT_ONCE:
                        p = int(names[p])
                        yield s + begin, s + begin + int(self.lengths[p]), p

    def items_of(self, windows: set[int]) -> set[str]:
        """Ids of the items that have one of the windows."""
        return {self.items[k] for p in windows for k in self.owners[self.own_at[p] : self.own_at[p + 1]].tolist()}


def _window_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial hashes of each window."""
    out = []
    for salt in (0, 0x55):
        run = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(packed.mix((text ^ np.uint8(salt)).astype(np.uint64) + np.uint64(1 + salt)) * packed.powers("up", len(text)), out=run[1:])
        out.append((run[end] - run[begin]) * packed.powers("down", len(text))[begin])
    packed.forget()
    return out[0], out[1]


def hit_words(normal: bytes, spans: list[tuple[int, int]]) -> int:
    """Words of `normal` under the union of spans; each span begins and ends with the space around its words."""
    hit, end = 0, 0
    for b, e in sorted(spans):
        b = max(b, end)
        if e - b > 1:
            hit += normal.count(b" ", b, e) - 1
            end = e - 1
    return hit


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The query set in blocks of at most `block_bytes` of text (one longer item is a block of its own).

    The size is checked before anything is read to the driver, and the driver holds one block at a time.
    """
    own = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("i"), F.lit(count)) == k)
        block = [(r.i, r.t.encode()) for r in part.orderBy("i", "t").collect()]
        if block:
            yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 13, min_share: tuple[int, int] = (1, 20), block_bytes: int = 8_000_000) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items_sha256 and contaminated.

    Contaminated: n_hit > 0 and n_hit / n_words >= min_share.  The search is map-only: documents never
    shuffle.  Each block of the benchmark (`block_bytes` bounds it) becomes tables on the driver, which are
    broadcast; blocks are searched one after another.
    """
    num, den = min_share
    sent = [docs.sparkSession.sparkContext.broadcast(Matcher(b, window)) for b in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)]

    def make():
        def fn(texts):
            n_words, normal = [], []
            for t in texts:
                ws = words_of(t)
                n_words.append(len(ws))
                normal.append(b" " + b" ".join(ws) + b" " if ws else b"")
            ends, joined = np.cumsum([len(t) for t in normal]), b"".join(normal)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for block in sent:
                matcher = block.value
                if len(sent) > 1:
                    vars(block).pop("_value", None)  # a worker holds one block at a time
                found = list(matcher.occurrences(joined))
                windows = defaultdict(set)
                for k, (begin, end, p) in zip(np.searchsorted(ends, [f[0] for f in found], side="right").tolist(), found, strict=True):
                    spans[k].append((begin, end))
                    windows[k].add(p)
                for k, own in windows.items():
                    items[k] |= matcher.items_of(own)
            n_hit = [hit_words(joined, s) for s in spans]
            digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            return [n_words, n_hit, [len(i) for i in items], digest, [h > 0 and den * h >= num * n for h, n in zip(n_hit, n_words, strict=True)]]

        return fn

    # With several blocks, larger slices of documents: each slice reads every block's tables.
    return common.append_columns(docs, text_col, FIELDS, make, limit=2_000_000 if len(sent) < 2 else 32_000_000)


def op2_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *[f.name for f in FIELDS])


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bi as (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0),
bw as (select distinct item, least(len(w), 13) n, array_to_string(w[i:i + 12], ' ') s from bi),
sizes as (select distinct n from bw),
di as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') s from di),
hits as (select doc_id, dw.i, dw.n, item from dw join bw on dw.n = bw.n and dw.s = bw.s),
hw as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
hi as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) s from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hw on d.doc_id = hw.doc_id left join hi on d.doc_id = hi.doc_id
"""
