"""Suffix-array deduplication of repeated passages through a common-prefix interval tree.

Removed is every byte covered by a `length`-byte string that also starts in a document with a smaller id.

Suffixes are sampled: of each window of `length` bytes the k-byte string with the least hash is its anchor,
so equal windows have equal anchors.  Anchors whose hash stands only once in the corpus can't repeat and go no
further.  All occurrences of an anchor, with the bytes that a window around it can reach, come to one task,
which sorts them by what follows (a sparse suffix array), takes common prefixes of neighbours and scans them
with a stack for the intervals of the prefix tree.  Inside an interval, occurrences are ordered by what stands
before them, and a second stack scan over the common left contexts gives the maximal repeats: groups of
occurrences of one string of `length` bytes or more whose left extensions differ and whose right extensions
differ (`maximal_repeats`).  Of a group, every occurrence in a document with a larger id than the group's
least is covered.  All matches of one occurrence hold its anchor, so what they cover is one span.

A string longer than an anchor's reach (`length` - k bytes to its left, `length` to its right) is a chain of
such repeats; `repeat_groups` puts out all of them with all occurrences.

Hot anchors (`hot` occurrences or more) would bring too much to one task where their surroundings differ.  Their
windows are told apart instead: each `length`-byte window that holds one goes by its own 128-bit hash, the
smallest id of a block first, so that a group is one window and has a row a block at most.

Copies: only the smallest id of equal texts takes part; its copies are covered whole.  Equal surroundings of
an anchor are combined inside a block before anything is shuffled.

Defined cases: null is empty; documents shorter than `length` keep everything; ids that are equal aren't
smaller than each other; a null id counts as larger than all others; an empty table gives no rows; ids are
64-bit integers; a very long text is searched for anchors in pieces that overlap; `length` is at most 1000;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.joins import join_counted

from . import common, packed

LAST = 2**63 - 1


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for all full windows, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


#: Bytes that are searched for anchors at once.
AT_ONCE = 250_000


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in a block's text and their hashes; no window reaches over two documents.

    Long blocks go in pieces: each has `length` bytes more on both sides, so that it holds all windows around its
    own positions.
    """
    found = []
    for s in range(0, len(text), AT_ONCE):
        low, high = max(0, s - length), min(len(text), s + AT_ONCE + length)
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high)
        # Windows of `length` bytes that lie in the piece and in one document.
        first, last = np.maximum(starts[a:b], low) - low, np.minimum(ends[a:b], high) - low
        at, h = _anchors(text[low:high], first, last, length, k)
        own = (at + low >= s) & (at + low < s + AT_ONCE)
        found.append((at[own] + low, h[own]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([h for _, h in found])


def _anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = packed.string_hashes(text, k)
    h = packed.mix(h)
    width = length - k + 1
    least = sliding(h, width, np.minimum)
    inside = np.zeros(n + 1, dtype=np.int32)
    big = ends - starts >= length
    np.add.at(inside, starts[big], 1)
    np.add.at(inside, ends[big] - length + 1, -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    least = np.where(valid, least, np.uint64(0))
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def common_prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, at most `most`."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def as_rows(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1])))[:, 0]


def intervals(lcp: list[int], least: int):
    """(prefix, first, last) of every interval of a suffix array with a common prefix of `least` or more."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            prefix, first = stack.pop()
            yield prefix, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(context: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, k: int):
    """(reach left of the anchor, reach right of its begin, members) of each maximal repeat around one task's anchors.

    `context` has length - k bytes before the anchor's begin and `length` from it on, different in all rows
    (0 beyond the document); `left` and `right` say how many belong to it.  Members are rows.  A repeat has
    `length` bytes or more and holds the anchor; its members are all rows around which it stands, and it can't be
    extended to either side: the bytes there differ, or a member's document or reach ends.
    """
    before = length - k
    # The sparse suffix array; what ends first comes first, also where a text holds zero bytes.
    suffix = np.argsort(as_rows(_ended(context[:, before:], right)), kind="stable")
    following, preceding = context[suffix][:, before:], context[suffix][:, :before][:, ::-1]
    rl, rr = left[suffix].astype(np.int64), right[suffix].astype(np.int64)
    lcp = common_prefix(following[1:], following[:-1], np.minimum(rr[1:], rr[:-1]))
    joined = np.r_[False, lcp >= k, False]
    # Runs of two occurrences: one interval each, and one left context that is common to both.
    pair = np.flatnonzero(joined[1:-1] & ~joined[:-2] & ~joined[2:])
    if len(pair):
        shared = common_prefix(preceding[pair], preceding[pair + 1], np.minimum(rl[pair], rl[pair + 1]))
        for i in np.flatnonzero(shared + lcp[pair] >= length).tolist():
            yield int(shared[i]), int(lcp[pair[i]]), suffix[pair[i] : pair[i] + 2]
    begins = np.flatnonzero(joined[1:] & ~joined[:-1])
    stops = np.flatnonzero(~joined[1:] & joined[:-1])
    many = stops - begins >= 2
    for b, e in zip(begins[many].tolist(), (stops[many] + 1).tolist(), strict=True):
        rank = np.argsort(as_rows(_ended(preceding[b:e], rl[b:e])), kind="stable")
        place = np.empty(e - b, np.int64)
        place[rank] = np.arange(e - b)
        for prefix, lo, hi in intervals(lcp[b : e - 1].tolist(), k):
            # Rows of the interval in the order of their left contexts, by place in the suffix array.
            members = (rank if hi - lo + 1 == e - b else rank[np.sort(place[lo : hi + 1])]) + b
            rows = preceding[members]
            shared = common_prefix(rows[1:], rows[:-1], np.minimum(rl[members[1:]], rl[members[:-1]]))
            if shared.max(initial=-1) + prefix < length:
                continue
            for common_left, first, last in intervals(shared.tolist(), max(0, length - prefix)):
                own = members[first : last + 1]
                if lcp[own.min() : own.max()].min() > prefix:
                    continue  # all of them share more on the right: a group of an interval inside of this one
                if _extends(preceding[own], rl[own], common_left):
                    continue
                yield common_left, prefix, suffix[own]


def _ended(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, sizes.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)


def _extends(preceding: np.ndarray, left: np.ndarray, shared: int) -> bool:
    """Whether all left extensions are alike, so that a repeat of this left context isn't maximal."""
    if shared == preceding.shape[1] or (left <= shared).any():
        return False
    return bool((preceding[:, shared] == preceding[0, shared]).all())


def resolve(context: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each occurrence's covered span reaches left of its anchor and right of the anchor's begin (0, 0: none).

    Of rows with equal surroundings the smallest id stands for all in the suffix array; larger ids are covered as
    far as they reach.  Of each maximal repeat all members with an id larger than the least are covered.
    """
    cover_l, cover_r = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    order = np.argsort(ids, kind="stable")
    whole = np.concatenate([context, _columns(left, right)], axis=1)[order]
    _, first, inverse = np.unique(as_rows(whole), return_index=True, return_inverse=True)
    rep = order[first]
    rep_of = np.empty(len(ids), np.int64)
    rep_of[order] = rep[inverse]
    copy = ids > ids[rep_of]
    full = copy & (left + right >= length)
    cover_l[full], cover_r[full] = left[full], right[full]
    # Rows that differ only behind their document's end are still different rows of the array.
    got_l, got_r = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
    own = ids[rep]
    for reach_l, reach_r, members in maximal_repeats(context[rep], left[rep], right[rep], length, k):
        of = own[members]
        later = members[of > of.min()]
        got_l[later], got_r[later] = np.maximum(got_l[later], reach_l), np.maximum(got_r[later], reach_r)
    full_l, full_r = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    full_l[rep], full_r[rep] = got_l, got_r
    same = ~copy
    cover_l[same], cover_r[same] = full_l[rep_of[same]], full_r[rep_of[same]]
    return cover_l, cover_r


def _columns(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Both reaches as bytes beside a context."""
    return np.stack([left, right], axis=1).astype("<u2").view(np.uint8)


WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("at", "<i4")])


def least_ids(windows: np.ndarray) -> np.ndarray:
    """For each window record the smallest id of its hash."""
    order = np.lexsort((windows["id"], windows["h2"], windows["h1"]))
    sorted_ = windows[order]
    new = np.r_[True, (sorted_["h1"][1:] != sorted_["h1"][:-1]) | (sorted_["h2"][1:] != sorted_["h2"][:-1])][: len(windows)]
    out = np.empty(len(windows), np.int64)
    out[order] = sorted_["id"][np.maximum.accumulate(np.where(new, np.arange(len(windows)), 0))]
    return out


def hot_windows(text: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, doc_ids: np.ndarray, length: int) -> np.ndarray:
    """Records of all windows around hot anchors, each place once."""
    first, last = at - left, at + right - length
    counts = np.maximum(0, last - first + 1)
    place = np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    place, one = np.unique(place, return_index=True)
    out = np.zeros(len(place), WINDOW)
    if len(place):
        h = packed.string_hashes(text, length)[place]
        out["h1"], out["h2"] = packed.mix(h), packed.mix(packed.string_hashes(text ^ np.uint8(0x55), length)[place] ^ packed.MIX_B)
        out["id"], out["at"] = np.repeat(doc_ids, counts)[one], place
    return out


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(common.col(text_col), F.lit(""))
    source = docs.select(F.coalesce(common.col(id_col).cast("long"), F.lit(LAST)).alias("id"), common.col(id_col).isNull().alias("no_id"), F.xxhash64(text).alias("h1"),
                         F.xxhash64(F.lit(3), text).alias("h2"), common.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        seq = 0
        for part in common.pieces_of(batches, "text", 2_000_000):
            texts = [t or b"" for t in common.as_bytes(part.column(4))]
            lens = np.array(list(map(len, texts)), dtype=np.int64)
            lists = [pa.array([part.column(c).to_pylist()], pa.list_(kind)) for c, kind in ((0, pa.int64()), (1, pa.bool_()), (2, pa.int64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(5)[0].as_py() * 2**32 + seq], pa.int64()), *lists, pa.array([lens], pa.list_(pa.int64())), pa.array([int(lens.sum()) // 14], pa.int64()),
                 pa.array([packed.pack(np.frombuffer(b"".join(texts), dtype=np.uint8))], pa.binary())],
                names=["block", "ids", "no_id", "h1", "h2", "lens", "n_keys", "body"])
            seq += 1

    return source.mapInArrow(run, "block long, ids array<long>, no_id array<boolean>, h1 array<long>, h2 array<long>, lens array<long>, n_keys long, body binary")


def _open(lens, body) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's text, and where its documents begin and end."""
    text, ends = packed.unpack(body, np.uint8), np.cumsum(np.asarray(lens, dtype=np.int64))
    return text, ends - lens, ends


def surroundings(blocks: DataFrame, copies: DataFrame | None, parts: int, n_blocks: int, length: int, k: int, hot: int, whole: bool = False) -> DataFrame:
    """(part, block, at, context, left, right, ids, starts, done, windows): repeated anchors with their surroundings.

    Anchors are dealt to `parts` by hash.  Documents in `copies` (block, ats) take no part.  Equal surroundings of
    a block go as one row, with the smallest id, and the windows of hot anchors likewise; the larger ids' spans
    are `done`.  With `whole` every row goes.
    """
    before = length - k

    def block_keys(batches):
        for batch in batches:
            for block, lens, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                _, h = anchors(*_open(np.array(lens, dtype=np.int64), body), length, k)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([h.tobytes()], pa.binary())], names=["block", "keys"])

    counts = packed.key_counts(blocks.select("block", "lens", "body").mapInArrow(block_keys, "block long, keys binary"), parts, n_blocks)
    sides = counts.select("block", "part", "counts", F.lit(None).cast("array<int>").alias("ats"))
    if copies is not None:
        sides = sides.unionByName(copies.select("block", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("counts"), "ats"))
    columns = ("part", "block", "at", "context", "left", "right", "ids", "starts", "done", "windows")

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        out = {c: [] for c in columns}
        for r in range(own.num_rows):
            block, ids, lens, body = (own.column(c)[r].as_py() for c in ("block", "ids", "lens", "body"))
            ids, lens = np.array(ids, dtype=np.int64), np.array(lens, dtype=np.int64)
            text, starts, ends = _open(lens, body)
            at, h = anchors(text, starts, ends, length, k)
            if not len(at):
                continue
            said = list(zip(told.column("part").to_pylist(), told.column("counts").to_pylist(), strict=True))
            number = packed.told(h, parts, [x for x in said if x[0] >= 0])
            often = number > 1
            doc = np.searchsorted(ends, at, side="right")
            active = np.ones(len(lens), dtype=bool)
            for ats in told.column("ats").to_pylist():
                active[ats or []] = False
            often &= active[doc]
            at, h, doc, number = at[often], h[often], doc[often], number[often]
            left, right = np.minimum(before, at - starts[doc]), np.minimum(length, ends[doc] - at)
            many = number >= hot
            hot_keys = np.unique(h[many])
            windows = hot_windows(text, at[many], left[many], right[many], ids[doc[many]], length)
            at, h, doc, left, right = (x[~many] for x in (at, h, doc, left, right))
            if whole and len(windows):
                # Those whose own anchor is hot, by the digest of their bytes.
                least = sliding(packed.mix(packed.string_hashes(text, k)), length - k + 1, np.minimum)
                windows = windows[np.isin(least[windows["at"]], hot_keys)]
                for w in windows:
                    digest = xxhash.xxh3_128_intdigest(text[w["at"] : w["at"] + length].tobytes())
                    w["h1"], w["h2"] = digest >> 64, digest & (2**64 - 1)
            if whole:
                windows["at"] -= starts[np.searchsorted(ends, windows["at"], side="right")].astype(np.int32)
                window_spans = np.zeros((0, 2), np.int64)
            else:
                beaten = windows["id"] > least_ids(windows)
                window_spans = np.stack([windows["at"][beaten], windows["at"][beaten] + length], axis=1).astype(np.int64)
                windows = windows[~beaten]
            window_deal, window_begin = packed.dealt(windows["h1"], parts)
            padded = np.r_[np.zeros(before, np.uint8), text, np.zeros(length, np.uint8)]
            context = np.lib.stride_tricks.sliding_window_view(padded, before + length)[at].copy()
            place = np.arange(before + length)[None, :]
            context[(place < (before - left)[:, None]) | (place >= (before + right)[:, None])] = 0
            # Combine: of equal surroundings in this block the smallest id is sent, larger ids are done.
            order = np.argsort(ids[doc], kind="stable")
            _, first, inverse = np.unique(as_rows(np.concatenate([context, _columns(left, right)], axis=1)[order]), return_index=True, return_inverse=True)
            rep_of = np.empty(len(at), np.int64)
            rep_of[order] = order[first][inverse]
            done = np.zeros(len(at), bool) if whole else ids[doc] > ids[doc[rep_of]]
            spans = np.concatenate([np.stack([at - left, at + right], axis=1)[done & (left + right >= length)], window_spans])
            send = np.flatnonzero(~done)
            deal, begin = packed.dealt(h[send], parts)
            for p in range(parts):
                x = send[deal[begin[p] : begin[p + 1]]]
                w = windows[window_deal[window_begin[p] : window_begin[p + 1]]]
                if len(x) or len(w) or (p == 0 and len(spans)):
                    made = (p, block, packed.pack(at[x].astype(np.int32)), packed.pack(context[x]), packed.pack(left[x].astype(np.uint16)), packed.pack(right[x].astype(np.uint16)), packed.pack(ids[doc[x]]),
                            packed.pack(starts[doc[x]].astype(np.int32)) if whole else None, packed.pack(spans.astype(np.int32)) if p == 0 else None, packed.pack(w) if len(w) else None)
                    for c, v in zip(columns, made, strict=True):
                        out[c].append(v)
        kinds = {"part": pa.int32(), "block": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    schema = "part int, block long" + "".join(f", {c} binary" for c in columns[2:])
    # The columns that `remove_repeats` sends once more, so that Spark can use the exchange again.
    return blocks.select("block", "ids", "no_id", "lens", "body").groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(run, schema)


def _gathered(table: pa.Table, width: int):
    """The rows of one part together: context, left, right, ids, at; and where each row of the table ends."""
    got = {c: [packed.unpack(x, t) for x in table.column(c).to_pylist()] for c, t in (("at", np.int32), ("context", np.uint8), ("left", np.uint16), ("right", np.uint16), ("ids", np.int64))}
    bounds = np.r_[0, np.cumsum([len(x) for x in got["at"]])]
    context = np.concatenate(got["context"]).reshape(-1, width)
    left, right, at = (np.concatenate(got[c]).astype(np.int64) for c in ("left", "right", "at"))
    return context, left, right, np.concatenate(got["ids"]), at, bounds


def _windows(table: pa.Table) -> list[np.ndarray]:
    return [packed.unpack(x, WINDOW) if x is not None else np.zeros(0, WINDOW) for x in table.column("windows").to_pylist()]


def _anchored(string: np.ndarray, at: int, length: int, k: int) -> bool:
    """Whether the k bytes at `at` are the anchor of a window inside of the string, so that all its occurrences have it."""
    h = packed.mix(packed.string_hashes(string, k))
    least = sliding(h, length - k + 1, np.minimum)
    return bool((least[max(0, at + k - length) : at + 1] == h[at]).any())


def _checked(length: int, k: int) -> None:
    if not 0 < k <= length <= 1000:
        raise ValueError("k is at most length, and length at most 1000")


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20, hot: int = 20_000) -> DataFrame:
    """(repeat, n_bytes, doc_id, begin): all occurrences (in bytes) of all maximal repeats around anchors.

    `repeat` is a 128-bit digest of the repeated string.  A repeat around an anchor has `length` bytes or more and
    all its occurrences; it is maximal inside of the anchor's reach (see above).  Around hot anchors the repeats
    are the windows of `length` bytes.  The bytes that `remove_repeats` removes are those of the occurrences in
    documents with a larger id than the least of their repeat.  A null id stands for the largest integer inside; an
    input that has both is refused.
    """
    _checked(length, k)
    own = common.col(id_col).cast("long")
    ends = docs.agg(F.count_if(own.isNull()), F.count_if(own == LAST)).first()
    if ends[0] and ends[1]:
        raise ValueError(f"documents have null ids and the id {LAST}: name one of them otherwise")
    before = length - k
    blocks = common.written(blocks_of(docs, id_col, text_col), "bodies", "none")
    sent = surroundings(blocks, None, *packed.parts_for(blocks, each=700_000), length, k, hot, whole=True)

    def name(string: bytes) -> str:
        return xxhash.xxh3_128_hexdigest(string)

    def groups(table: pa.Table) -> pa.Table:
        context, left, right, ids, at, _ = _gathered(table, before + length)
        at -= np.concatenate([packed.unpack(x, np.int32) for x in table.column("starts").to_pylist()])
        out = []
        if len(ids):
            _, rep, inverse, n = np.unique(as_rows(np.concatenate([context, _columns(left, right)], axis=1)), return_index=True, return_inverse=True, return_counts=True)
            rows_of = np.split(np.argsort(inverse, kind="stable"), np.cumsum(n)[:-1])
            alone = (n > 1) & (left[rep] + right[rep] >= length)

            def put(reach_l, reach_r, members):
                one = rep[members[0]]
                string = context[one][before - reach_l : before + reach_r]
                if not _anchored(string, reach_l, length, k):
                    return  # an anchor of a longer window; the string's own anchors have it with all occurrences
                string = string.tobytes()
                rows = np.concatenate([rows_of[m] for m in members])
                out.append((name(string), len(string), ids[rows], at[rows] - reach_l))

            for reach_l, reach_r, members in maximal_repeats(context[rep], left[rep], right[rep], length, k):
                alone[members[(left[rep[members]] == reach_l) & (right[rep[members]] == reach_r)]] = False
                put(reach_l, reach_r, members.tolist())
            # Surroundings that repeat as a whole, and of which no other row holds as much.
            for m in np.flatnonzero(alone).tolist():
                put(int(left[rep[m]]), int(right[rep[m]]), [m])
        windows = np.concatenate(_windows(table))
        sizes = [len(x[2]) for x in out]
        many = lambda i, kind: pa.array([x[i] for x, n in zip(out, sizes, strict=True) for _ in range(n)], kind)
        return pa.table({
            "repeat": pa.concat_arrays([many(0, pa.string()), pa.array([f"{a:016x}{b:016x}" for a, b in zip(windows["h1"].tolist(), windows["h2"].tolist(), strict=True)], pa.string())]),
            "n_bytes": pa.concat_arrays([many(1, pa.int32()), pa.array(np.full(len(windows), length, np.int32))]),
            "doc_id": pa.array(np.concatenate([*(x[2] for x in out), windows["id"]]).astype(np.int64)),
            "begin": pa.array(np.concatenate([*(x[3] for x in out), windows["at"]]).astype(np.int64))})

    found = sent.groupBy("part").applyInArrow(groups, "repeat string, n_bytes int, doc_id long, begin long")
    # Windows of a hot anchor that stand once are no repeats; a place may be in several of its windows' rows.
    found = common.written(found.dropDuplicates(), "repeats")
    counts = found.groupBy("repeat", "n_bytes").agg(F.count("*").alias("k")).where("k > 1")
    out = join_counted(found, counts, ["repeat", "n_bytes"], "k", found.count())
    named = F.col("doc_id") if ends[1] else F.when(F.col("doc_id") != LAST, F.col("doc_id"))
    return out.select("repeat", "n_bytes", named.alias("doc_id"), "begin")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20, with_text: bool = False, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256[, kept]), one row for each row of `docs`.

    spans: array<struct<begin, end>> of maximal removed runs, in bytes.
    """
    _checked(length, k)
    before = length - k
    blocks = common.written(blocks_of(docs, id_col, text_col), "bodies", "none")
    parts, n_blocks = packed.parts_for(blocks, each=700_000)
    # Copies of a text with a smaller id, as places in their blocks.
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "h1", "h2", "lens")).alias("at", "r")).select("block", "at", "r.*")
    least = common.written(rows.groupBy("h1", "h2", "lens").agg(F.min("ids").alias("least"), F.count("*").alias("copies")).where("copies > 1"), "texts")
    total = least.agg(F.sum("copies")).first()[0] or 0
    copies = join_counted(rows, least, ["h1", "h2", "lens"], "copies", total).where("ids > least")
    copies = common.written(copies.groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("ats")), "copies")
    sent = surroundings(blocks, copies, parts, n_blocks, length, k, hot)

    def settle(table: pa.Table) -> pa.Table:
        context, left, right, ids, at, bounds = _gathered(table, before + length)
        l, r = resolve(context, left, right, ids, length, k) if len(ids) else (left, right)
        hot_of = _windows(table)
        windows = np.concatenate(hot_of)
        beaten = np.split(windows["id"] > least_ids(windows), np.cumsum([len(x) for x in hot_of])[:-1])
        spans = []
        for i, done in enumerate(table.column("done").to_pylist()):
            a, b = bounds[i], bounds[i + 1]
            on = r[a:b] > 0
            own = np.stack([at[a:b] - l[a:b], at[a:b] + r[a:b]], axis=1)[on].astype(np.int32)
            gone = hot_of[i]["at"][beaten[i]]
            own = np.concatenate([own, np.stack([gone, gone + length], axis=1)])
            spans.append(packed.pack(np.concatenate([own, packed.unpack(done, np.int32).reshape(-1, 2)]) if done is not None else own))
        return pa.table({"block": table.column("block"), "spans": pa.array(spans, pa.binary())})

    spans = sent.groupBy("part").applyInArrow(settle, "block long, spans binary")
    ends_of = spans.select("block", "spans", F.lit(None).cast("array<int>").alias("ats")).unionByName(copies.select("block", F.lit(None).cast("binary").alias("spans"), "ats"))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for r in range(own.num_rows):
            ids, no_id, lens, body = (own.column(c)[r].as_py() for c in ("ids", "no_id", "lens", "body"))
            text, starts, ends = _open(np.array(lens, dtype=np.int64), body)
            edge = np.zeros(len(text) + 1, dtype=np.int32)
            for packed_spans in told.column("spans").to_pylist():
                if packed_spans is not None:
                    pairs = packed.unpack(packed_spans, np.int32).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            for ats in told.column("ats").to_pylist():
                for d in ats or []:
                    if lens[d] >= length:
                        gone[starts[d] : ends[d]] = True
            for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                mask = gone[a:b]
                kept = text[a:b][~mask].tobytes()
                step = np.diff(np.r_[0, mask.astype(np.int8), 0])
                runs = [{"begin": x, "end": y} for x, y in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True)]
                rows.append((None if no_id[d] else ids[d], b - a, b - a - len(kept), len(runs), runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"][: 6 + with_text]
        return pa.table({c: pa.array([x[i] for x in rows], kinds[i]) for i, c in enumerate(names)})

    return blocks.select("block", "ids", "no_id", "lens", "body").groupBy("block").cogroup(ends_of.groupBy("block")).applyInArrow(cut, fields)


def op7_interval_tree(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) s from (select doc_id, h, unnest(range(len(h) // 2 - 49)) i from d where len(h) >= 100)),
dup as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) least from w) where least < doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) p from dup)),
runs as (select doc_id, count(*) n, count(*) filter (prev is null or prev < p - 1) spans from (select doc_id, p, lag(p) over (partition by doc_id order by p) prev from gone) group by doc_id),
kept as (select b.doc_id, string_agg(b.x, '' order by b.p) k from (select doc_id, p, substr(h, 2 * p + 1, 2) x from (select doc_id, h, unnest(range(len(h) // 2)) p from d where doc_id in (select doc_id from runs))) b
  left join gone g on g.doc_id = b.doc_id and g.p = b.p where g.p is null group by b.doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) n_bytes, coalesce(r.n, 0) n_removed, coalesce(r.spans, 0) n_spans, sha256(unhex(case when r.n is null then h else coalesce(k, '') end)) kept_sha256
from d left join runs r on r.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""
