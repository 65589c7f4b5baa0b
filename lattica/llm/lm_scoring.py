"""LM scoring by subword lattice likelihood.

The vocabulary is a fixed public one; its pieces' scores weight all segmentations of a text, and a forward
recursion in log space sums them to the text's marginal probability.  The files at hand hold merge ranks, not
unigram scores, so ranks stand in for these (`segmentation.load_pieces`), and EM over the words of all
training documents re-estimates them.

A text is its words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) and one end.  As no piece reaches over two
words, a text's probability is the product of its words' marginals and of the end's probability, so each
distinct word of the corpus goes through the forward recursion once, in a table of words.  Frequent words
(those with at least 1 / 2**17 of all tokens, so at most 2**17 of them) are broadcast; all other words of a
document meet the table in one shuffle join, where no key is hot.

`base_score` is an add-half unigram over whole words, learned from the same counts.

Defined cases: a null or empty text is the end alone; repeated rows are scored one by one; without training
documents counts are 0 and scores stay at the smoothed first values; an empty table gives no rows; texts and
words of any length are scored as a whole (long words in segments); ids are of any type that a string names;
other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, segmentation

END = b""
LN10 = float(np.log(10.0))


@dataclass
class Model:
    words: DataFrame  # word, c (in training), n (in all), lp (natural log of the marginal)
    tokens: int
    distinct: int
    ends: int
    end: float
    pieces: list[bytes]
    scores: np.ndarray

    @property
    def bottom(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def word_counts(docs: DataFrame, text_col: str, held_col: str) -> DataFrame:
    """(word, c, n) over all documents; the end is the empty word."""
    source = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(held_col), F.lit(False)).alias("held"))

    def count(batches):
        own, other = Counter(), Counter()
        for part in common.pieces_of(batches, "text"):
            for t, held in zip(common.as_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                at = other if held else own
                at.update((t or b"").lower().split())
                at[END] += 1
            if len(own) + len(other) > 250_000:
                yield _counted(own, other)
                own, other = Counter(), Counter()
        yield _counted(own, other)

    parts = source.mapInArrow(count, "word binary, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _counted(own: Counter, other: Counter) -> pa.RecordBatch:
    words = list(own.keys() | other.keys())
    c = np.array([own[w] for w in words], dtype=np.int64)
    n = c + np.array([other[w] for w in words], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])


def fit(docs: DataFrame, *, text_col: str = "text", held_col: str = "held_out", rounds: int = 3, vocabulary: str = segmentation.VOCABULARY) -> Model:
    """Counts, piece scores and word marginals from the rows of `docs` that aren't held out."""
    spark = docs.sparkSession
    pieces, scores = segmentation.load_pieces(vocabulary)
    sent = spark.sparkContext.broadcast(pieces)
    words = common.written(word_counts(docs, text_col, held_col), "words")
    is_end = F.col("word") == F.lit(END)
    total = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(is_end, F.col("c")))).first()
    tokens, distinct, ends = (x or 0 for x in total)
    known = words.where((F.col("c") > 0) & ~is_end).select("word", "c")
    end = float(scores.min())
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(scores)

        def expect(batches, now=now):
            lattice, out = segmentation.Lattice(sent.value), 0
            for batch in batches:
                ws, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
                for a, b in segmentation.chunks(ws):
                    out = out + lattice.expect(ws[a:b], c[a:b], now.value)
            if not isinstance(out, int):
                at = np.flatnonzero(out > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["piece", "e"])

        # One row for each piece of the fixed vocabulary comes to the driver.
        got = known.mapInArrow(expect, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        expected = np.zeros(len(pieces))
        expected[got.piece] = got.e
        scores = segmentation.new_scores(expected, extra=float(ends) + 0.1)
        end = float(np.log((ends + 0.1) / (expected.sum() + ends + 0.1 * (len(pieces) + 2))))
    final = spark.sparkContext.broadcast(scores)

    def marginals(batches):
        lattice = segmentation.Lattice(sent.value)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            parts = [lattice.forward(ws[a:b], final.value[:, None])[:, 0] for a, b in segmentation.chunks(ws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["word", "c", "n", "lp"])

    scored = common.written(words.where(~is_end).mapInArrow(marginals, "word binary, c long, n long, lp double"), "marginals")
    common.discard(words)
    return Model(scored, tokens, distinct, ends, end, pieces, scores)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", hot_share: int = 2**17) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of `docs`."""
    spark = docs.sparkSession
    bottom = model.bottom
    everything = model.words.agg(F.sum("n")).first()[0] or 0
    hot_rows = model.words.where(F.col("n") * hot_share >= F.lit(everything)).collect()
    base_of = lambda c: float(np.log10((c + 0.5) / bottom))
    hot = spark.sparkContext.broadcast({bytes(r.word): (base_of(r.c), r.lp / LN10, int(r.c > 0)) for r in hot_rows})
    end_base, end_lp, end_known = base_of(model.ends), model.end / LN10, int(model.ends > 0)
    schema = "key long, id string, held boolean, word binary, n long, tokens long, known long, base double, score double"
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("string").alias("id"), F.col(held_col).alias("held"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]

    def look_up(batches):
        get = hot.value.get
        for part in common.pieces_of(batches, "text"):
            keys = part.column(0).to_numpy()
            words, counts, cold, own = [], [], [], []
            for t in common.as_bytes(part.column(3)):
                base, lp, tokens, known, before = end_base, end_lp, 1, end_known, len(words)
                for w, n in Counter((t or b"").lower().split()).items():
                    tokens += n
                    found = get(w)
                    if found is None:
                        words.append(w)
                        counts.append(n)
                    else:
                        base += n * found[0]
                        lp += n * found[1]
                        known += n * found[2]
                cold.append(len(words) - before)
                own.append((tokens, known, base, lp))
            # A row for each cold word, then one for each document, whose word holds a space, so that no word of the
            # table equals it.
            m, sums = len(words), list(zip(*own, strict=True))
            of_doc = lambda column: pa.concat_arrays([pa.nulls(m, column.type), column])
            totals = [pa.concat_arrays([pa.array(np.zeros(m, dtype)), pa.array(v, pa.from_numpy_dtype(dtype))]) for v, dtype in zip(sums, (np.int64, np.int64, np.float64, np.float64), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.repeat(keys, cold), keys])), of_doc(part.column(1)), of_doc(part.column(2)), pa.array(words + [b" %d" % k for k in keys.tolist()], pa.binary()),
                 pa.array(np.concatenate([np.array(counts, dtype=np.int64), np.zeros(len(keys), np.int64)])), *totals], names=names)

    parts = source.mapInArrow(look_up, schema)
    table = model.words.where(F.col("n") * hot_share < F.lit(everything)).select("word", "c", "lp")
    joined = parts.join(table, "word", "left")
    c = F.coalesce("c", F.lit(0))
    summed = joined.groupBy("key").agg(
        F.max("id").alias("id"), F.max("held").alias("held_out"), F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("n") > 0, F.col("n") * F.log10((c + 0.5) / F.lit(bottom))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(F.col("n") * F.col("lp") / LN10, F.lit(0.0))).alias("score"))
    return summed.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(common.crc32_mod(F.col("doc_id"), 5) == 1, F.lit(False)))
    return score(docs, fit(docs))
