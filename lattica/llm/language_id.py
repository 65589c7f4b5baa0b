"""Language ID by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of one fixed public vocabulary, fitted by EM over all
segmentations of the words of its documents.  A text's likelihood under a language is the product over its
words of the sum over all segmentations (forward algorithm); the prediction is the language with the largest
posterior under equal priors, and that posterior is the score.

The classifier is fitted on a bounded sample: the `per_lang` documents of each language that come first by a
hash of id and text; any number of languages is fitted.  Prediction covers every text as a whole and is map-only.

Defined cases: a text that is null or has no letters is `und` with score 0; without any labelled document
every text is `und`; rows with a null language or text aren't learned from; ties go to the first language by
code point; very long texts are scored as a whole, and very long words in segments (see `segmentation`); an
empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, segmentation

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    pieces: list[bytes]
    langs: list[str]
    scores: np.ndarray  # pieces x languages


def has_letter(text: bytes) -> bool:
    if ASCII_LETTER.search(text):
        return True
    return not text.isascii() and LETTER.search(text.decode(errors="replace")) is not None


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(lang, text): at most `per_lang` rows of each language, the first by hash.

    Languages are counted, each count gives a bound on the hash that about 1.25 times the rows pass, and only
    these rows are ranked.
    """
    rows = labelled.where(common.col(text_col).isNotNull() & common.col(lang_col).isNotNull()).select(
        common.col(lang_col).alias("lang"), common.col(text_col).alias("text"), F.xxhash64(F.lit(5), common.col(id_col).cast("string"), common.col(text_col)).alias("h"))
    share = F.least(F.lit(1.25 * per_lang) / F.col("n"), F.lit(1.0))
    bound = F.when(share < 1.0, (F.lit(-(2.0**63)) + F.lit(2.0**64) * share).cast("long")).otherwise(F.lit(2**63 - 1))
    bounds = common.written(rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("_l"), bound.alias("bound")), "languages")
    order = Window.partitionBy("lang").orderBy("h")
    near = rows.join(bounds, F.col("lang") == F.col("_l")).where("h <= bound")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("lang", "text")


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000,
        rounds: int = 3, vocabulary: str = segmentation.VOCABULARY) -> Model:
    spark = labelled.sparkSession
    pieces, first = segmentation.load_pieces(vocabulary)
    sent = spark.sparkContext.broadcast(pieces)

    def count(batches):
        found: dict[str, Counter] = {}
        for part in common.pieces_of(batches, "text"):
            for lang, t in zip(part.column(0).to_pylist(), common.as_bytes(part.column(1)), strict=True):
                found.setdefault(lang, Counter()).update(t.lower().split())
            if sum(map(len, found.values())) > 200_000:
                yield from _counted(found)
                found = {}
        yield from _counted(found)
        common.release()

    words = sample(labelled, id_col, text_col, lang_col, per_lang).mapInArrow(count, "lang string, word binary, n long")
    words = common.written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langwords")
    langs = sorted((r.lang for r in words.select("lang").distinct().collect()), key=lambda x: x.encode())
    place = {x: k for k, x in enumerate(langs)}
    scores = np.repeat(first[:, None], len(langs), axis=1)
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast(scores)

        def expect(batches, now=now):
            lattice, total = segmentation.Lattice(sent.value), {}
            for batch in batches:
                lang = np.array([place[x] for x in batch.column(0).to_pylist()])
                ws, ns = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy()
                for k in np.unique(lang):
                    own, n = ws[lang == k].tolist(), ns[lang == k].astype(np.float64)
                    for a, b in segmentation.chunks(own):
                        total[k] = total.get(k, 0) + lattice.expect(own[a:b], n[a:b], now.value[:, k])
            for k, e in total.items():
                at = np.flatnonzero(e > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(e[at])], names=["k", "piece", "e"])
            del lattice, total
            common.release()

        # At most pieces x languages rows come to the driver.
        got = words.mapInArrow(expect, "k int, piece int, e double").groupBy("k", "piece").agg(F.sum("e").alias("e")).toPandas()
        expected = np.zeros_like(scores)
        expected[got.piece, got.k] = got.e
        scores = np.stack([segmentation.new_scores(expected[:, k]) for k in range(len(langs))], axis=1)
    common.discard(words)
    return Model(pieces, langs, scores)


def _counted(found):
    for lang, words in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


class Scorer:
    """Log likelihoods of texts; words already seen by this task are kept, up to a bounded number of figures."""

    def __init__(self, model: Model, room: int = 4_000_000):
        self.lattice, self.scores, self.room = segmentation.Lattice(model.pieces), model.scores, min(200_000, room // max(1, len(model.langs)))
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, model.scores.shape[1]))

    def learn(self, words) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.room:
            self.known, self.table = {}, self.table[:0]
            fresh = list(words)
        parts = [self.table]
        parts += [self.lattice.marginals(fresh[a:b], self.scores) for a, b in segmentation.chunks(fresh)]
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.table = np.asfortranarray(np.concatenate(parts))

    def texts(self, split: list[list[bytes]]) -> np.ndarray:
        """One row of log likelihoods for each list of words."""
        self.learn(set().union(*split))
        out = np.zeros((len(split), self.scores.shape[1]))
        sizes = np.array(list(map(len, split)))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        full, begins = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
        for k in range(out.shape[1] if len(at) else 0):
            out[full, k] = np.add.reduceat(self.table[:, k][at], begins)
        return out


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer, langs = Scorer(sent.value), sent.value.langs

        def fn(texts):
            lettered = [bool(langs) and t is not None and has_letter(t) for t in texts]
            like = scorer.texts([t.lower().split() if ok else [] for t, ok in zip(texts, lettered, strict=True)])
            if not langs:
                return [["und"] * len(texts), [0.0] * len(texts)]
            best = like.argmax(axis=1)
            share = 1.0 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
            return [[langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(share, lettered, strict=True)]]

        return fn

    return common.append_columns(docs, text_col, FIELDS, make)


def held_out():
    return F.coalesce(common.crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))


def op4_marginal_unigrams(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
