"""N-gram Jaccard join over a token-group matrix.

Documents become sets of 64-bit hashes of word shingles.  Two documents link when
den * |A & B| >= num * |A | B|; the result is the smallest id reachable by links.

1. Map: sets are built in blocks of the input.  A block keeps for each document its size, a digest of the set
   and the *posted* tokens: those below a fixed bound of the hash space, and at least the first
   p = n - ceil(num * n / den) + 1 tokens by hash.
2. Equal sets are one class, so copies never meet as pairs.
3. Posted tokens are counted over the whole corpus (packed.key_counts).  Tokens are ordered by this count,
   then by hash, unposted ones last by hash; this is one order for all documents, so by the prefix principle
   two linked classes share a token among the first p of both.  Tokens counted once come first: most
   documents without a near copy end here, as their prefix has no token that another document has.
4. Classes that share a prefix token (and whose sizes allow a link) are joined to clusters by connected
   components, through the smallest class of each token and size band, so a frequent token costs its rows once.
5. In a cluster (or in pairs of blocks of a cluster that is too large for one task, after a comparison with
   pivots): two sets are compared directly; of more, up to 24 are compared with all sets, and only where this
   doesn't connect all of them follows the token-group matrix: similar sets form groups, every group has the union of its members'
   tokens, a query's overlap with a group is bounded by its overlap with the union, and only groups that reach
   the overlap that a link needs are opened and compared.  Members already connected are skipped.

A class is named by 64 bits of its digest; classes that agree in these but not in the whole digest (128 bits)
and size get names of their own.  Clusters are settled without the matrix where step 5 says so.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; a text
with fewer words than a shingle is one shingle; repeated rows are copies; a null id is never a component's
smallest if there is another; an empty table gives no rows; ids are 64-bit integers; a very long text is
hashed in pieces, and is a task of its own where its shingles fill one; `near_duplicates` reads no other
column, `keep_one` passes all columns through, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.components import connected_components
from lattica.plans.joins import join_counted

from . import common, packed


def needed(n, num: int, den: int):
    """The least overlap that a set of n tokens must have with any set it links with."""
    return -(-(num * n) // den)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def _overlaps(flags: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For consecutive sets (at: their begins and the end) how many of their tokens are flagged."""
    run = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(flags[codes], out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def link_cluster(sets: list[np.ndarray], num: int, den: int, group_size: int = 64, prior: list | None = None) -> np.ndarray:
    """Roots (positions) of the components of linked sets; exact for any number of sets.

    Sets of equal `prior` are known to be in one component.
    """
    m = len(sets)
    forest = Forest(m)
    seen: dict = {}
    for i, c in enumerate(prior or []):
        forest.join(seen.setdefault(c, i), i)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if den * both >= num * (sizes[0] + sizes[1] - both):
            forest.join(0, 1)
        return forest.roots()
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(sizes)]
    flags = np.zeros(len(vocabulary), dtype=bool)

    def linked(q: int, own_codes, own_at, own_sizes) -> np.ndarray:
        flags[codes[at[q] : at[q + 1]]] = True
        both = _overlaps(flags, own_codes, own_at)
        flags[codes[at[q] : at[q + 1]]] = False
        return den * both >= num * (sizes[q] + own_sizes - both)

    # Sets with the most common tokens first: one that all others were made from connects them at once.
    spread = np.bincount(codes)
    common_first = np.argsort(-np.add.reduceat(spread[codes].astype(np.float64), at[:-1]) / sizes, kind="stable")
    alone, passes = np.ones(m, dtype=bool), 0
    for q in common_first.tolist():
        if passes >= 24 or not alone.any():
            break
        if not alone[q] and passes:
            continue
        passes += 1
        hit = np.flatnonzero(linked(q, codes, at, sizes))
        for x in hit.tolist():
            forest.join(q, x)
        alone[hit] = False
        alone[q] = False
    roots = forest.roots()
    if len(set(roots.tolist())) == 1:
        return roots
    # Groups: sets in order of their smallest tokens by a hash of its own, so that like sets come together.
    least = np.minimum.reduceat(packed.mix(vocabulary ^ packed.MIX_B)[codes], at[:-1])
    by_group = np.lexsort((sizes, least))
    groups = [by_group[i : i + group_size] for i in range(0, m, group_size)]
    unions = [np.unique(np.concatenate([codes[at[x] : at[x + 1]] for x in g])) for g in groups]
    # The matrix by token: which groups have it.
    row_of = np.concatenate(unions)
    group_of = np.repeat(np.arange(len(groups)), [len(u) for u in unions])
    order = np.argsort(row_of, kind="stable")
    group_of = group_of[order]
    row_at = np.searchsorted(row_of[order], np.arange(len(vocabulary) + 1))
    packs = [(np.concatenate([codes[at[x] : at[x + 1]] for x in g]), np.r_[0, np.cumsum(sizes[g])]) for g in groups]
    low, high = np.array([sizes[g].min() for g in groups]), np.array([sizes[g].max() for g in groups])
    for q in by_group.tolist():
        tokens = codes[at[q] : at[q + 1]]
        lengths = row_at[tokens + 1] - row_at[tokens]
        places = np.repeat(row_at[tokens] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        bound = np.bincount(group_of[places], minlength=len(groups))
        n = sizes[q]
        opened = np.flatnonzero((bound >= needed(n, num, den)) & (high * den >= num * n) & (num * low <= den * n))
        for k in opened.tolist():
            g = groups[k]
            own = forest.find(q)
            if all(forest.find(x) == own for x in g.tolist()):
                continue
            for x in g[linked(q, *packs[k], sizes[g])].tolist():
                forest.join(q, x)
    return forest.roots()


def blocks_of(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, bits: int = 64) -> DataFrame:
    """Blocks: ids, th (hash of the text), n, d1 and d2 (digest) of each document, and all posted tokens."""
    share = min(1.0, 1.6 * (1 - num / den))
    bound = np.uint64(min(2**64 - 1, int(share * 2**64)))
    source = docs.select(common.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(common.col(text_col), F.lit(""))).alias("th"), common.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches):
        seq = 0
        for part in common.pieces_of(batches, "text", 2_000_000):
            texts = [(t or b"").lower() for t in common.as_bytes(part.column(2))]
            sets = packed.shingle_sets(texts, words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            prefix = np.where(n > 0, n - needed(n, num, den) + 1, 0)
            posted = [s[: max(p, int(np.searchsorted(s, bound)))] for s, p in zip(sets, prefix.tolist(), strict=True)]
            d1 = np.array([int(packed.mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))]))[0]) for s in sets], dtype=np.uint64)
            d1 = (d1 >> np.uint64(64 - bits)).view(np.int64)
            d2 = np.array([int(np.bitwise_xor.reduce(packed.mix(s))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            keys = np.concatenate(posted)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(3)[0].as_py() * 2**32 + seq], pa.int64()), one(part.column(0).to_pylist(), pa.int64()), one(part.column(1).to_pylist(), pa.int64()),
                 one(n, pa.int64()), one(d1, pa.int64()), one(d2, pa.int64()), one([len(x) for x in posted], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary())],
                names=["block", "ids", "th", "n", "d1", "d2", "posted", "n_keys", "keys"])
            seq += 1
        packed.forget()
        common.release()

    many = "array<long>"
    schema = f"block long, ids {many}, th {many}, n {many}, d1 {many}, d2 {many}, posted {many}, n_keys long, keys binary"
    return source.mapInArrow(run, schema)


def renamed(classes: DataFrame, most: int = 1_000_000) -> DataFrame | None:
    """(d1, d2, n, name) of classes whose d1 is also another class's, all but one of each; None where there are none.

    Of k classes k ** 2 / 2 ** 65 are to be expected; that they are no more than `most` is checked, as they are
    broadcast.
    """
    first = Window.partitionBy("d1").orderBy("d2", "n")
    twice = classes.groupBy("d1").agg(F.count("*").alias("k")).where("k > 1").select("d1")
    later = classes.select("d1", "d2", "n").join(twice, "d1").withColumn("k", F.row_number().over(first)).where("k > 1")
    later = common.written(later.select("d1", "d2", "n", F.xxhash64("d1", "d2", "n").alias("name")), "renamed")
    if (k := later.count()) > most:
        raise ValueError(f"{k} classes share their 64-bit names")
    return later if k else None


def with_names(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return rows
    own = names.select(*[F.col(c).alias(f"_{c}") for c in ("d1", "d2", "n")], "name")
    on = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n"))
    return rows.join(F.broadcast(own), on, "left").withColumn("d1", F.coalesce("name", "d1")).select(*rows.columns)


def prefixes(blocks: DataFrame, counts: DataFrame, parts: int, num: int, den: int, share_bound: int, names: DataFrame | None = None) -> DataFrame:
    """(d1, n, score, key): tokens of each class's prefix that stand in two documents at least.

    score is the mean count of the class's posted tokens, higher for a text that others were made from.
    """

    named = blocks.sparkSession.sparkContext.broadcast({(r.d1, r.d2, r.n): r.name for r in names.collect()} if names is not None else {})

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        d1s, ns, scores, keys_out = [], [], [], []
        if own.num_rows and told.num_rows:
            keys = np.frombuffer(own.column("keys")[0].as_py(), dtype=np.uint64)
            n_of = packed.told(keys, parts, list(zip(told.column("part").to_pylist(), told.column("counts").to_pylist(), strict=True)))
            begin, seen = 0, set()
            for n, d1, d2, k in zip(*(own.column(c)[0].as_py() for c in ("n", "d1", "d2", "posted")), strict=True):
                d1 = named.value.get((d1, d2, n), d1)
                if not n or d1 in seen:
                    begin += k
                    continue
                seen.add(d1)
                token, count = keys[begin : begin + k], n_of[begin : begin + k]
                begin += k
                p = n - needed(n, num, den) + 1
                inside = int(np.searchsorted(token, np.uint64(share_bound)))
                rank = np.argsort(count[:inside], kind="stable")  # tokens are in hash order already
                chosen = np.r_[rank[:p], np.arange(inside, max(inside, p))] if inside < p else rank[:p]
                chosen = chosen[count[chosen] > 1]
                d1s.append(np.full(len(chosen), d1, dtype=np.int64))
                ns.append(np.full(len(chosen), n, dtype=np.int64))
                scores.append(np.full(len(chosen), count.mean() if len(count) else 0.0))
                keys_out.append(token[chosen].view(np.int64))
        common.release(False)
        cat = lambda x, kind=np.int64: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        return pa.table({"d1": cat(d1s), "n": cat(ns), "score": cat(scores, np.float64), "key": cat(keys_out)})

    both = blocks.select("block", "n", "d1", "d2", "posted", "keys").groupBy("block").cogroup(counts.groupBy("block"))
    return both.applyInArrow(run, "d1 long, n long, score double, key long").dropDuplicates(["d1", "key"])


def squeezed(texts: DataFrame) -> DataFrame:
    """(i, t, text) with lower-cased texts compressed, as they travel once more."""

    def run(batches):
        for part in common.pieces_of(batches, "text"):
            small = [packed.pack(np.frombuffer((t or b"").lower(), dtype=np.uint8)) for t in common.as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(small, pa.binary())], names=["i", "t", "text"])
        common.release()

    return texts.mapInArrow(run, "i long, t long, text binary")


def _band(num: int, den: int):
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("long")


def _texts(column) -> list[bytes]:
    return [packed.unpack(t, np.uint8).tobytes() for t in column.to_pylist()]


def comparer(words: int, num: int, den: int):
    """The kernel of a task: (d1, root) of the classes in a table (d1, text[, prior])."""

    def compare(table: pa.Table) -> pa.Table:
        prior = table.column("prior").to_pylist() if "prior" in table.column_names else [None] * table.num_rows
        kept = {d: (t, c) for d, t, c in zip(table.column("d1").to_pylist(), _texts(table.column("text")), prior, strict=True)}
        names = sorted(kept)  # repeated rows bring a class more than once
        sets = []
        for i in range(0, len(names), 500):
            sets += packed.shingle_sets([kept[d][0] for d in names[i : i + 500]], words)
        roots = link_cluster(sets, num, den, prior=[kept[d][1] for d in names] if "prior" in table.column_names else None)
        if len(names) > 200:
            del sets
            common.release(False)
        return pa.table({"d1": pa.array(names, pa.int64()), "root": pa.array([names[r] for r in roots.tolist()], pa.int64())})

    return compare


def block_pairs(own: DataFrame, tokens: DataFrame, few: int) -> DataFrame:
    """(block, n_block) of blocks that can hold a new link, from own(cluster, d1, own, band, block) and the prefix tokens.

    Linked classes share a token of their prefixes, so only blocks that share one meet.  Tokens of more than `few`
    blocks would be paired over and over; all blocks that have one of these meet.
    """
    names = ["cluster", "own", "band", "block"]
    has = tokens.select("d1", "key").join(own.select("d1", *names).distinct(), "d1").select("key", *names).distinct()
    has = common.written(has, "keys")
    spread = has.groupBy("cluster", "key").agg(F.count("*").alias("b")).where("b > 1")

    def meet(rows: DataFrame, by: list[str]) -> DataFrame:
        other = rows.select(*by, *[F.col(c).alias(f"n_{c}") for c in names[1:]])
        return rows.join(other, by).where("block <= n_block and abs(band - n_band) <= 1 and not (own is not null and own <=> n_own)").select("block", "n_block")

    rare = meet(has.join(spread.where(F.col("b") <= few), ["cluster", "key"]).drop("b"), ["cluster", "key"])
    often = meet(has.join(spread.where(F.col("b") > few), ["cluster", "key"]).select(*names).distinct(), ["cluster"])
    # Small components that share a block meet inside of it.
    inside = own.where("own is null").select("block", F.col("block").alias("n_block"))
    return rare.unionByName(often).unionByName(inside).distinct()


def link_large(held: DataFrame, tokens: DataFrame, words: int, num: int, den: int, block: int, most_tokens: int, pivots: int = 16, few: int = 64) -> DataFrame:
    """(d1, root) of clusters (cluster, d1, n, text) that are too large for one task.

    First every class is compared with its cluster's pivots, the classes with the most common tokens, wherever
    its row is; in a family of copies of one text this connects nearly all.  What isn't known to be connected
    yet is compared in blocks: classes of a component, or of small components together, form blocks of about
    `block` classes or `most_tokens` shingles of a size band, those with the same least prefix token together, and
    only pairs of blocks that can hold a new link meet in a task (`block_pairs`).
    """
    scores = tokens.groupBy("d1").agg(F.max("score").alias("score"), F.min(F.xxhash64("key")).alias("least"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "d1")
    tops = held.select("cluster", "d1").distinct().join(scores, "d1").withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots).select(F.col("d1").alias("_d"))
    leads = held.join(tops, F.col("d1") == F.col("_d")).groupBy("cluster").agg(F.collect_list(F.struct("d1", "text")).alias("leads"))
    leads = common.written(leads, "pivots", "none")

    def to_pivots(batches):
        known: dict[int, list] = {}
        for batch in batches:
            a, b = [], []
            cluster, d1, texts, leads_of = (batch.column(k) for k in range(4))
            sets = packed.shingle_sets(_texts(texts), words)
            for i, (c, d, s) in enumerate(zip(cluster.to_pylist(), d1.to_pylist(), sets, strict=True)):
                if c not in known:
                    known.clear()
                    rows = {x["d1"]: packed.unpack(x["text"], np.uint8).tobytes() for x in leads_of[i].as_py()}
                    known[c] = list(zip(rows, packed.shingle_sets(list(rows.values()), words), strict=True))
                a.append(d)
                b.append(d)
                for name, p in known[c]:
                    both = len(np.intersect1d(s, p, assume_unique=True))
                    if den * both >= num * (len(s) + len(p) - both):
                        a.append(d)
                        b.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = held.select("cluster", "d1", "text").join(leads, "cluster").mapInArrow(to_pivots, "a long, b long")
    first = common.written(connected_components(met).select(F.col("v").alias("_v"), F.col("root").alias("part")), "parts")
    placed = held.join(first, F.col("d1") == F.col("_v")).drop("_v")
    sizes = placed.groupBy("cluster", "part").agg(F.countDistinct("d1").alias("in_part"), F.sum("n").alias("in_tokens"))
    # One component: done.  Else large components have blocks of their own, small ones share blocks (part null).
    open_ = sizes.groupBy("cluster").agg(F.count("*").alias("parts")).where("parts > 1").select("cluster")
    own = placed.join(sizes, ["cluster", "part"]).join(open_, "cluster").withColumn("own", F.when((F.col("in_part") >= block) | (F.col("in_tokens") >= most_tokens), F.col("part"))).withColumn("band", _band(num, den))
    counts = own.groupBy("cluster", "own", "band").agg(F.countDistinct("d1").alias("k"), F.sum("n").alias("t")).select("cluster", F.col("own").alias("_o"), F.col("band").alias("_b"), F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("t") / most_tokens)).alias("ways"))
    on = (own["cluster"] == counts["cluster"]) & F.col("own").eqNullSafe(F.col("_o")) & (F.col("band") == F.col("_b"))
    own = own.join(counts, on).drop(counts["cluster"]).drop("_o", "_b")
    # A least token that more classes have than a block takes has blocks of its own.
    least = scores.select(F.col("d1").alias("_l"), "least")
    own = own.join(least, F.col("d1") == F.col("_l")).drop("_l")
    crowds = own.groupBy("cluster", "own", "band", "least").agg(F.greatest(F.ceil(F.countDistinct("d1") / block), F.ceil(F.sum("n") / most_tokens)).alias("split")).where("split > 1")
    crowds = crowds.select(F.col("cluster").alias("_c"), F.col("own").alias("_o"), F.col("band").alias("_b"), F.col("least").alias("_l"), "split")
    own = own.join(crowds, (F.col("cluster") == F.col("_c")) & F.col("own").eqNullSafe(F.col("_o")) & (F.col("band") == F.col("_b")) & (F.col("least") == F.col("_l")), "left")
    place = F.when(F.col("split").isNull(), F.xxhash64(F.pmod(F.xxhash64("least"), "ways"))).otherwise(F.xxhash64("least", F.pmod(F.xxhash64("d1"), "split")))
    own = own.withColumn("block", F.xxhash64(F.col("cluster"), F.col("own"), F.col("band"), place)).select("cluster", "d1", "part", "own", "band", "block", "text")
    own = common.written(own, "blocks", "none")
    pairs = block_pairs(own, tokens, few)
    pairs = pairs.withColumn("task", F.xxhash64("block", "n_block"))
    sides = pairs.select("task", F.col("block").alias("_k")).unionByName(pairs.select("task", F.col("n_block").alias("_k"))).distinct()
    rows = own.join(sides, F.col("block") == F.col("_k")).select("task", "d1", "text", F.col("part").alias("prior"))
    linked = rows.groupBy("task").applyInArrow(comparer(words, num, den), "d1 long, root long")
    edges = linked.select(F.col("d1").alias("a"), F.col("root").alias("b")).unionByName(first.select(F.col("_v").alias("a"), F.col("part").alias("b")))
    return connected_components(edges).select(F.col("v").alias("d1"), "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: Fraction = Fraction(4, 5), most_in_task: int = 1000,
                    most_tokens: int = 4_000_000, bits: int = 64, few: int = 64) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, root), one row for each row of `docs`.

    A task compares clusters of at most `most_in_task` classes with `most_tokens` shingles; larger ones are
    spread (see `link_large`).  th is xxhash64 of the text; root names the component by a digest (of `bits`
    bits, before names are told apart), null without shingles.
    """
    num, den = similarity.numerator, similarity.denominator
    share_bound = min(2**64 - 1, int(min(1.0, 1.6 * (1 - num / den)) * 2**64))
    blocks = common.written(blocks_of(docs, id_col, text_col, words, num, den, bits), "shingles", "lz4")
    rows = blocks.select(F.explode(F.arrays_zip("ids", "th", "n", "d1", "d2")).alias("r")).select("r.*")
    classes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("ids").alias("id"), F.min(F.struct("ids", "th")).alias("rep"), F.count("*").alias("members"))
    classes = common.written(classes, "classes")
    names = renamed(classes)
    rows, classes = with_names(rows, names), with_names(classes, names)
    parts, n_blocks = packed.parts_for(blocks)
    tokens = common.written(prefixes(blocks, packed.key_counts(blocks, parts, n_blocks), parts, num, den, share_bound, names), "prefixes")
    # Size bands: sets that can link are in one band or in neighbouring ones.
    banded = tokens.select("d1", "key", _band(num, den).alias("band"))
    leaders = banded.groupBy("key", "band").agg(F.min("d1").alias("lead"), F.count("*").alias("k"))
    near = leaders.alias("a").join(leaders.select("key", (F.col("band") - 1).alias("band"), F.col("lead").alias("next")).alias("b"), ["key", "band"])
    members = banded.join(leaders.where("k > 1"), ["key", "band"]).where("d1 <> lead").select(F.col("d1").alias("a"), F.col("lead").alias("b"))
    edges = members.unionByName(near.select(F.col("lead").alias("a"), F.col("next").alias("b"))).where("a <> b").distinct()
    clusters = connected_components(edges).select(F.col("v").alias("d1"), F.col("root").alias("cluster"))
    clusters = common.written(clusters.join(classes.select("d1", "rep", "n"), "d1"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    large = (F.col("m") > most_in_task) | (F.col("tokens") > most_tokens)
    sizes = common.written(sizes.select("cluster", "m", large.alias("large")), "sizes")
    texts = squeezed(docs.select(common.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(common.col(text_col), F.lit(""))).alias("t"), common.col(text_col).alias("text")))
    total = clusters.count()
    chosen = join_counted(clusters, sizes, ["cluster"], "m", total).select("cluster", "d1", "large", "n", F.col("rep.ids").alias("_i"), F.col("rep.th").alias("_t"))
    # Both sides grow with the input: a merge join at every size.
    held = texts.join(chosen.hint("merge"), (F.col("t") == F.col("_t")) & F.col("i").eqNullSafe(F.col("_i"))).select("cluster", "d1", "large", "n", "text")
    held = common.written(held, "held", "none")
    compare = comparer(words, num, den)
    found = held.where("not large").select("cluster", "d1", "text").groupBy("cluster").applyInArrow(compare, "d1 long, root long")
    if not sizes.where("large").isEmpty():
        spread = link_large(held.where("large").drop("large"), tokens, words, num, den, most_in_task, most_tokens, few=few)
        found = found.unionByName(spread)
    joined = classes.select("d1", "id", "members").join(found, "d1", "left").withColumn("root", F.coalesce("root", "d1"))
    joined = common.written(joined, "linked")
    common.discard(tokens, clusters, sizes, held)
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("k"), F.sum("members").alias("rows"))
    counts = least.agg(F.sum("k"), F.sum("rows")).first()
    of_class = join_counted(joined, least.drop("rows"), ["root"], "k", counts[0] or 0).select("d1", "component_id", "root", "members")
    # One class may have a good part of all rows; documents without shingles need no class.
    own = join_counted(rows.where("n > 0"), of_class, ["d1"], "members", counts[1] or 0).select("ids", "th", "n", F.coalesce("component_id", "ids").alias("component_id"), "root")
    alone = rows.where("n = 0").select("ids", "th", "n", F.col("ids").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return own.unionByName(alone).select(F.col("ids").alias("doc_id"), "th", F.col("n").alias("n_shingles"), "component_id", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of `docs` of which one stays for each group of near duplicates: that of the smallest id.

    All columns of `docs` are kept.  Documents without shingles all stay.  Ids need not be unique: a row is known by id and text, and of rows
    that repeat both, one stays.
    """
    found = common.written(near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity).select("doc_id", "th", "root"), "near")
    stays = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("s")).select("s.doc_id", "s.th")
    stays = stays.unionByName(found.where("root is null").select("doc_id", "th")).groupBy("doc_id", "th").agg(F.lit(1).alias("one"))
    stays = common.written(stays.select(F.col("doc_id").alias("_i"), F.col("th").alias("_t")), "stays")
    more = found.where("root is not null").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")
    i, t = common.fresh(docs.columns, "of_id", "of_text")
    named = docs.withColumn(i, common.col(id_col).cast("long")).withColumn(t, F.xxhash64(F.coalesce(common.col(text_col), F.lit(""))))
    other = common.fresh([*docs.columns, i, t], "stay_id", "stay_text")
    on = (F.col(t) == F.col(other[1])) & F.col(i).eqNullSafe(F.col(other[0]))
    kept = named.join(stays.toDF(*other), on, "left_semi")
    if not more.isEmpty():
        repeated = more.toDF(*other)
        kept = kept.join(repeated, on, "left_anti").unionByName(kept.join(repeated, on, "left_semi").dropDuplicates([i, t]))
    return kept.select(*map(common.col, docs.columns))


def op9_token_groups(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4, similarity=Fraction(17, 20)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
link as (select a, b from (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all) join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
e as (select a, b from link union all select b, a from link),
r as (select distinct a v, a u from e union select r.v, e.b from r join e on r.u = e.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(c.u, w.doc_id) component_id from w left join n on n.doc_id = w.doc_id left join (select v, min(u) u from r group by v) c on c.v = w.doc_id
"""
