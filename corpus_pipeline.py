"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor kept.
All but the last return the columns that they got, with their values, whatever their names; the last adds shard and slot in place
of columns of these names.

Defined cases: a document with null or empty text or without a letter has no language and goes in the first stage; below
LEAST_SCORE its language isn't clear and it goes as well.  What reaches the later stages has text; given to them directly,
texts without words link with nothing, aren't contaminated, have size 0 in the mix and are dealt like all others.  Rows that repeat id and text are copies, of which one stays; a null id is an
id like others.  A null source is a source of its own.  Without a labelled document the model knows no language and all go; an
empty table gives an empty result.  Very long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, jaccard, language_id, mixing, sharding

#: Documents below this posterior have no language that the model tells from the others.
LEAST_SCORE = 0.5


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], made: tuple[str, ...]) -> tuple[DataFrame, list]:
    """What `judge` makes of `docs`, and the columns of `docs` in it.

    Columns that have the name of one that the judge makes stand aside under names of their own.
    """
    aside = [c for c in docs.columns if c.lower() in made]
    names = dict(zip(aside, common.fresh([*docs.columns, *made], *(f"own_{c}" for c in aside)), strict=True))
    out = judge(docs.select(*[common.col(c).alias(names.get(c, c)) for c in docs.columns]))
    return out, [common.col(names.get(c, c)).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or with no clear language; the model is fitted on labelled rows of its input."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    judged, own = _judged(docs, lambda df: language_id.predict(df, model), tuple(f.name for f in language_id.FIELDS))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*own)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group linked by five-word shingles at 0.8."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which 5 % of the words or more lie in 13-word windows of benchmark items."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    judged, own = _judged(docs, lambda df: decontaminate.decontaminate(df, benchmark), tuple(f.name for f in decontaminate.FIELDS))
    return judged.where(~F.col("contaminated")).select(*own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed, own = _judged(docs, mixing.mix, ("size", "source_size", "target", "copies", "taken"))
    (time,) = common.fresh(mixed.columns, "time")
    times = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(time)
    return mixed.where("copies > 0").select("*", times).select(*own)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All records with shard and slot."""
    return sharding.external_shuffle(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express fitting and scoring of the language model; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    What a stage wrote for itself is deleted when its result is written, and a result when the next one is.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, f"stage-{name}")
        with common.scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        common.discard(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._written_path = path
    return STAGES[-1][1](spark, docs, sf_dir)
