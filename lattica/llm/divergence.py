"""Audit of how sources of a language differ in their words, by mergeable radix tries.

A trie is held in preorder (`Trie`): leaves in UTF-8 order, of each the number of bytes that its path shares with the
leaf before it and the bytes of its own edge, and at each leaf counters of occurrences and documents by
(lang, source).  A prefix range of a trie is a slice of it.

1. Map: a task counts terms in a trie.  One with `COUNTERS` counters is put out and a new one begun, so a task's memory
   doesn't grow with its input.  A trie is put out in pieces of `LEAVES` leaves.
2. Merge: the first terms of pieces, which stand equally dense among all leaves, give bounds of ranges of about `range_size`
   counters.  Pieces are cut at the bounds, and the pieces of a range are merged to one trie.  A term is in one range, so
   its leaf then has all its counts.  Terms in too few documents of a language end here.
3. Traversal: with the sizes of all groups, each range of a language is walked in UTF-8 order.  It adds up the
   differences of all pairs of sources, and keeps the best candidates of each source; among equal values the first of the walk
   stay.  Sums and candidates of ranges are then merged.

Every count and fraction is an integer: floor(scale * (count + s) / D) is found by long division, so that no
step leaves 64 bits while a group has under 9 * 10^15 occurrences (an error says so beyond).

Cost: a language with S sources and V kept terms takes V * S^2 differences, and its result has S^2 rows; both
are what is asked for.  A task holds one range of a language, all its sources, and sums of S x a block of
sources, never all terms.  The driver has one bound for each `range_size` counters.  One term, source or language may have any
share of the rows: a term has one counter a group and trie after step 1, and sources meet in step 3 only as counters.

Defined cases: null text, lang and source count as ''; a group without terms still has its rows, with counts of
zero; a language without kept terms has pairs of value 0; a language with one source has no pairs; repeated
rows and null ids count like any others (no id is read); an empty table gives no rows; very long texts are cut
at separators and counted in pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Counters of a trie of the first step before it is put out, leaves of a piece, counters of a range on average.
COUNTERS, LEAVES, RANGE_SIZE = 1_500_000, 20_000, 1_000_000
#: Bytes of text that are split into terms at once.
PIECE = 4_000_000
#: A path shares at most so many bytes with the one before; what is longer is in the leaf's own edge.
SHARED = 16
#: Bytes of each byte in terms: A-Z become lower, what separates becomes a blank.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in rising order, and the sums of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


@dataclass
class Trie:
    """A radix trie in preorder.

    Leaf i is a term; `leaf`, `group`, `n` and `docs` are its counters, by leaf and then by group, where `group` is a place
    in `groups`, the (lang, source) of which the trie has counters.
    """

    terms: list[bytes]
    groups: list[tuple[str, str]]
    leaf: np.ndarray
    group: np.ndarray
    n: np.ndarray
    docs: np.ndarray

    @staticmethod
    def of(terms: pa.Array, groups: list, code: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Trie:
        """From counters of distinct `terms` in any order; counters of equal term and group add up."""
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key, n, docs = summed(rank[code] * max(1, len(groups)) + group, n, docs)
        return Trie(terms.take(pa.array(order)).to_pylist(), groups, key // max(1, len(groups)), key % max(1, len(groups)), n, docs)

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        places: dict[tuple[str, str], int] = {}
        groups = [np.array([places.setdefault(g, len(places)) for g in t.groups], np.int64)[t.group] for t in tries]
        codes = pa.array([x for t in tries for x in t.terms], pa.binary()).dictionary_encode()
        code, begin, parts = codes.indices.to_numpy(), 0, []
        for t in tries:
            parts.append(code[begin : begin + len(t.terms)][t.leaf])
            begin += len(t.terms)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return Trie.of(codes.dictionary, list(places), join(parts).astype(np.int64), join(groups), join([t.n for t in tries]), join([t.docs for t in tries]))

    def slice(self, begin: int, end: int) -> Trie:
        """The leaves of a prefix range."""
        a, b = np.searchsorted(self.leaf, [begin, end])
        return Trie(self.terms[begin:end], self.groups, self.leaf[a:b] - begin, self.group[a:b], self.n[a:b], self.docs[a:b])

    def edges(self) -> tuple[np.ndarray, list[bytes]]:
        """How many bytes each path shares with the one before, and the bytes of the leaf's own edge."""
        head = np.array([t[:SHARED] for t in self.terms], f"S{SHARED}").view(np.uint8).reshape(-1, SHARED)
        size = np.minimum(np.array([len(t) for t in self.terms], np.int64), SHARED)
        same = np.minimum.accumulate(head[1:] == head[:-1], axis=1).sum(axis=1)
        shared = np.r_[np.zeros(min(1, len(size)), np.int64), np.minimum(same, np.minimum(size[1:], size[:-1]))]
        return shared, [t[k:] for t, k in zip(self.terms, shared.tolist(), strict=True)]

    @staticmethod
    def paths(shared: list[int], edges: list[bytes]) -> list[bytes]:
        out, term = [], b""
        for k, edge in zip(shared, edges, strict=True):
            term = term[:k] + edge
            out.append(term)
        return out


def terms_of(text: bytes):
    """Lists of the terms of a text; a long text comes in several, cut at separators."""
    text = text.translate(_TERM_BYTES)
    begin = 0
    while len(text) - begin > PIECE:
        cut = text.rfind(b" ", begin, begin + PIECE)
        cut = cut if cut >= 0 else text.find(b" ", begin + PIECE)
        if cut < 0:
            break
        yield text[begin:cut].split()
        begin = cut + 1
    yield text[begin:].split()


def counted(groups: list[tuple[str, str]], texts: list[bytes]) -> Trie:
    """The trie of some documents."""
    words: list[bytes] = []
    times: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if len(text) <= PIECE:
            found = text.translate(_TERM_BYTES).split()
            times.append(np.ones(len(found), np.int64))
        else:
            long = Counter()
            for terms in terms_of(text):
                long.update(terms)
            found = list(long)
            times.append(np.array(list(long.values()), np.int64))
        words += found
        sizes[i] = len(found)
    places: dict[tuple[str, str], int] = {}
    group = np.array([places.setdefault(g, len(places)) for g in groups], np.int64)
    codes = pa.array(words, pa.binary()).dictionary_encode()
    del words
    kinds = max(1, len(codes.dictionary))
    # once a document and term, then once a group and term
    key, n = summed(np.repeat(np.arange(len(texts)), sizes) * kinds + codes.indices.to_numpy(), np.concatenate(times) if times else sizes)
    return Trie.of(codes.dictionary, list(places), key % kinds, group[key // kinds], n, np.ones(len(n), np.int64))


_PIECE_ROW = "span int, first binary, langs array<string>, sources array<string>, shared array<int>, edges array<binary>, sizes array<int>, groups array<int>, n array<long>, docs array<long>"
_KINDS = (pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
_NAMES = ("span", "first", "langs", "sources", "shared", "edges", "sizes", "groups", "n", "docs")


def _batch(span: int, trie: Trie) -> pa.RecordBatch:
    """One row of a trie or a slice of one; only groups that it has counters of are in it."""
    shared, edges = trie.edges()
    present, group = np.unique(trie.group, return_inverse=True)
    named = [trie.groups[g] for g in present.tolist()]
    sizes = np.bincount(trie.leaf, minlength=len(trie.terms)).astype(np.int32)
    row = [span, trie.terms[0], [g[0] for g in named], [g[1] for g in named], shared.astype(np.int32), edges, sizes, group.astype(np.int32), trie.n, trie.docs]
    return pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, _KINDS, strict=True)], names=_NAMES)


def _tries(table) -> list[Trie]:
    """The tries of all rows of a batch or table."""
    out = []
    for i in range(table.num_rows):
        get = lambda c: table.column(c)[i]  # noqa: B023, E731
        numbers = lambda c: get(c).values.to_numpy().astype(np.int64)  # noqa: B023, E731
        terms = Trie.paths(numbers("shared").tolist(), get("edges").as_py())
        groups = list(zip(get("langs").as_py(), get("sources").as_py(), strict=True))
        out.append(Trie(terms, groups, np.repeat(np.arange(len(terms)), numbers("sizes")), numbers("groups"), numbers("n"), numbers("docs")))
    return out


def _count(batches):
    """(lang, source, text) to pieces of this task's tries."""
    held: list[Trie] = []

    def poured():
        trie = Trie.merged(held)
        held.clear()
        for begin in range(0, len(trie.terms), LEAVES):
            yield _batch(-1, trie.slice(begin, begin + LEAVES))

    for batch in batches:
        for part in common.pieces_of(iter([batch]), "text", PIECE):
            groups = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True))
            held.append(counted(groups, common.as_bytes(part.column("text"))))
            if sum(len(t.n) for t in held) >= COUNTERS:
                held[:] = [Trie.merged(held)]
                # half of it is new: a trie that hardly shrinks is put out, one that shrinks goes on
                if len(held[0].n) >= COUNTERS // 2:
                    yield from poured()
    if held:
        yield from poured()
    held.clear()
    common.release()


def _cut(bounds: list[bytes]):
    """Pieces cut at the bounds: range k has the terms from bound k - 1 up to bound k."""

    def run(batches):
        for batch in batches:
            for trie in _tries(batch):
                begin = 0
                while begin < len(trie.terms):
                    span = bisect_right(bounds, trie.terms[begin])
                    end = len(trie.terms)
                    if span < len(bounds) and trie.terms[-1] >= bounds[span]:
                        end = begin + bisect_right(trie.terms[begin:], bounds[span])
                        end -= trie.terms[end - 1] == bounds[span]
                    yield _batch(span, trie.slice(begin, end))
                    begin = end
        common.release()

    return run


_KEPT = "lang string, span int, term string, sources array<string>, counts array<long>"


def _merge(least_docs: int):
    """All pieces of one range to (lang, span, term, sources, counts) of the terms that a language keeps."""

    def run(table: pa.Table) -> pa.Table:
        trie, span = Trie.merged(_tries(table)), table.column("span")[0].as_py()
        langs = sorted({g[0] for g in trie.groups})
        lang = np.array([langs.index(g[0]) for g in trie.groups], np.int64)[trie.group]
        key = trie.leaf * len(langs) + lang
        own, docs = summed(key, trie.docs)
        keep = own[docs >= least_docs]
        on = np.flatnonzero(np.isin(key, keep))
        on = on[np.argsort(key[on], kind="stable")]
        sizes = np.diff(np.r_[np.searchsorted(key[on], keep), len(on)])
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        sources = pa.array([g[1] for g in trie.groups], pa.string()).take(pa.array(trie.group[on]))
        common.release(collect=False)
        return pa.table({
            "lang": pa.array(langs, pa.string()).take(pa.array(keep % len(langs))), "span": pa.array(np.full(len(keep), span, np.int32)),
            "term": pa.array([trie.terms[i] for i in (keep // len(langs)).tolist()], pa.binary()).cast(pa.string()),
            "sources": pa.ListArray.from_arrays(offsets, sources), "counts": pa.ListArray.from_arrays(offsets, pa.array(trie.n[on])),
        })

    return run


def long_division(scale: int, a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """floor(scale * a / d) of 0 <= a <= d, a digit of `scale` = 10^k at a time."""
    if scale < 1 or scale != 10 ** (len(str(scale)) - 1):
        raise ValueError("scale must be a power of ten")
    if np.max(d, initial=0) >= 9 * 10**15:
        raise OverflowError("a group has 9 * 10^15 occurrences or more")
    out, left = a // d, a % d
    for digits in [1000] * ((len(str(scale)) - 1) // 3) + [10] * ((len(str(scale)) - 1) % 3):
        left = left * digits
        out, left = out * digits + left // d, left % d
    return out


def _walked(smooth: int, scale: int, top: int, block: int = 4_000_000):
    """A range of a language, with all its sources, to sums of pairs and candidates of each source."""

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang = groups.column("lang")[0].as_py() if groups.num_rows else None
        names = sorted(groups.column("source").to_pylist(), key=str.encode)
        place = {s: i for i, s in enumerate(names)}
        totals = np.zeros(len(names), np.int64)
        totals[[place[s] for s in groups.column("source").to_pylist()]] = groups.column("n").to_numpy()
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
        if terms.num_rows and groups.num_rows:
            kept = groups.column("kept")[0].as_py()
            below = totals + smooth * kept
            all_below = np.int64(totals.sum() + smooth * kept)
            words = terms.column("term").to_pylist()
            order = sorted(range(len(words)), key=lambda i: words[i].encode())
            sources, counts = terms.column("sources").to_pylist(), terms.column("counts").to_pylist()
            size = len(names)
            rows, wide = max(1, block // 8 // size), max(1, min(size, block // size))
            best: list[list] = [[] for _ in names]
            for first in range(0, size, wide):
                sums = np.zeros((min(wide, size - first), size), np.int64)
                for begin in range(0, len(order), rows):
                    at = order[begin : begin + rows]
                    table = np.zeros((len(at), size), np.int64)
                    for i, k in enumerate(at):
                        table[i, [place[s] for s in sources[k]]] = counts[k]
                    p = 1 + long_division(scale, table + smooth, below[None, :])
                    for j in range(len(sums)):
                        sums[j] += np.abs(p - p[:, first + j : first + j + 1]).sum(axis=0)
                    if first == 0:
                        q = 1 + long_division(scale, table.sum(axis=1) + smooth, all_below)
                        for s in range(size):
                            more = p[:, s] - q
                            on = np.flatnonzero((table[:, s] > 0) & (more > 0))
                            on = on[np.argsort(-more[on], kind="stable")[:top]]
                            # the walk is in UTF-8 order and sorts are stable: of equal values the first stay
                            best[s] = sorted(best[s] + [(-int(more[i]), at[i]) for i in on], key=lambda x: x[0])[:top]
                for j in range(len(sums)):
                    for b in range(first + j + 1, size):
                        out["source"].append(names[first + j])
                        out["part"].append("pair")
                        out["item"].append(names[b])
                        out["value"].append(int(sums[j, b]))
            for s, found in enumerate(best):
                for value, k in found:
                    out["source"].append(names[s])
                    out["part"].append("term")
                    out["item"].append(words[k])
                    out["value"].append(-value)
        n = len(out["source"])
        return pa.table({"lang": pa.array([lang] * n, pa.string()), **{k: pa.array(out[k], pa.string()) for k in ("source", "part", "item")}, "value": pa.array(out["value"], pa.int64())})

    return run


def bounds_of(pieces: DataFrame, range_size: int) -> list[bytes]:
    """First terms of pieces, so that about `range_size` counters lie between two; four firsts are looked at for each bound."""
    count, total = pieces.agg(F.count("*"), F.sum(F.size("groups"))).first()
    ranges = -(-(total or 0) // range_size)
    if ranges < 2:
        return []
    taken = pieces.where(F.pmod(F.xxhash64("first", F.size("groups"), "n"), F.lit(count)) < 4 * ranges).select("first")
    firsts = sorted(bytes(r.first) for r in taken.collect())
    return sorted({firsts[len(firsts) * k // ranges] for k in range(1, ranges)}) if firsts else []


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, smooth: int = 5,
    scale: int = 1_000_000_000, top: int = 50, range_size: int = RANGE_SIZE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    A term's share in a group is p = 1 + floor(scale * (count + smooth) / (N + smooth * V)).  Part `pair`: the sum
    of |p - q| over all kept terms, for each other source.  Part `term`: p - q against the whole language, for the
    `top` terms that the source has and that it has more of.  Rank 1 has the largest value; ties go by UTF-8 order.
    """
    read = docs.select(*(F.coalesce(common.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    pieces = common.written(read.mapInArrow(_count, _PIECE_ROW), "pieces")
    cut = pieces.drop("span").mapInArrow(_cut(bounds_of(pieces, range_size)), _PIECE_ROW)
    kept = common.written(cut.groupBy("span").applyInArrow(_merge(least_docs), _KEPT), "kept")
    common.discard(pieces)
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = read.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = common.written(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    spans = groups.where("kept > 0").join(kept.select("lang", F.col("span").alias("of")).distinct(), "lang")
    schema = "lang string, source string, part string, item string, value long"
    found = kept.groupBy("lang", "span").cogroup(spans.groupBy("lang", "of")).applyInArrow(_walked(smooth, scale, top), schema)
    found = common.written(found, "found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_radix_tries(spark, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = r"""
with d as (select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
u as (select k, lang, source, unnest(w) term from d),
t as (select lang, term from u group by lang, term having count(distinct k) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from u semi join t using (lang, term) group by all),
v as (select g.lang, count(t.term) v from (select distinct lang from g) g left join t on t.lang = g.lang group by g.lang),
n as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint n from g left join c on c.lang = g.lang and c.source = g.source group by all),
nl as (select lang, sum(n)::hugeint n from n group by lang),
p as (select n.lang, n.source, t.term, coalesce(c.n, 0) k, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (n.n + 5 * v.v) p
    from n join v using (lang) join t on t.lang = n.lang left join c on c.lang = n.lang and c.source = n.source and c.term = t.term),
q as (select p.lang, p.term, 1 + (1000000000::hugeint * (sum(p.k) + 5)) // (any_value(nl.n) + 5 * any_value(v.v)) q from p join nl using (lang) join v using (lang) group by p.lang, p.term),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f.f, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select p.lang, p.source, 'term' part, p.term item, (p.p - q.q)::bigint value from p join q on q.lang = p.lang and q.term = p.term where p.k > 0 and p.p > q.q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from (from pairs union all from terms))
select * from r where part = 'pair' or rank <= 50
"""
