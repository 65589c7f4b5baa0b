"""The two jobs: runs over growing input, reruns, repeated batches, odd rows, and their SQL."""

import json
import os
import re
import shutil
import subprocess
import sys
from collections import defaultdict

import compare
import pytest
from pyspark.sql import functions as F

from jobs import agglomerate_volume, queries, text_scorers

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_job_equals_its_sql(spark, duck, sf_dir, name):
    ok, why = compare.compare(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert ok, why


def test_configs_are_read_by_spark(spark):
    for name in ("text_scorers", "agglomerate_volume"):
        assert text_scorers.read_config(spark, f"{ROOT}/jobs/{name}.json") == queries.config(name)


# Text scorers

TEXTS = ["A b a b", "", None, "one\n\none\ntwo", "x" * 4000, "é é É", " ".join(map(str, range(3000))), "1 2 3", "Word word"]


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(i, t, None if i == 1 else "en", "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, scores string, batch int")
    names = list(text_scorers.scorers(F.col("text")))
    for row in text_scorers.score(df, names, "lang").collect():
        text = TEXTS[row.doc_id] or ""
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
        share = lambda a, b: 1000 * a // b if b else 0
        assert row.scores == {"words": min(len(words), 1000), "letters": share(len(re.sub("[^A-Za-z]", "", text)), len(text)),
                              "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines))}
        assert row.subset == ("" if row.doc_id == 1 else "en")
    with pytest.raises(ValueError):
        text_scorers.score(df, ["nothing"], "lang")


def brute_report(scores, truth):
    """{(subset, network): (threshold, tp, fp, fn, tn, f1, auc)} from {doc: (subset, {network: score})}."""
    by = defaultdict(list)
    for doc, (subset, of) in scores.items():
        if doc in truth:
            for network, x in of.items():
                by[subset, network].append((x, truth[doc]))
    out = {}
    for key, found in by.items():
        pos, neg = sum(t for _, t in found), sum(not t for _, t in found)
        best = None
        for threshold in {x for x, _ in found}:
            tp, fp = sum(x >= threshold and t for x, t in found), sum(x >= threshold and not t for x, t in found)
            f1 = 2 * tp / (2 * tp + fp + pos - tp) if tp or fp or pos else 0.0
            best = max(best or (-1,), (f1, threshold, tp, fp, pos - tp, neg - fp))
        area = sum((a > b) + 0.5 * (a == b) for a, t in found if t for b, u in found if not u) / (pos * neg) if pos and neg else None
        out[key] = (*best[1:], round(best[0], 6), None if area is None else round(area, 6))
    return out


def test_report_against_brute_force(spark):
    import random

    rng = random.Random(3)
    docs = {i: (rng.choice(["en", "", "fr"]), {n: rng.randint(0, 9) * 100 for n in ("one", "two")}) for i in range(150)}
    docs[500] = ("lone", {"one": 5, "two": 5})
    truth = {i: rng.random() < 0.4 for i in list(docs)[:120]} | {500: True}
    scores = spark.createDataFrame([(i, s, of, 0) for i, (s, of) in docs.items()] + [(None, "en", {"one": 1}, 0)], text_scorers.SCORES)
    labels = spark.createDataFrame([(i, int(t), None) for i, t in truth.items()] + [(3, None, 1), (None, 1, 1), (500, 0, 0)], "doc_id long, quality int, toxic int")
    got = text_scorers.report(scores, labels, "quality").collect()
    assert {(r.subset, r.network): (r.threshold, r.tp, r.fp, r.fn, r.tn, r.f1, r.auc) for r in got} == brute_report(docs, truth)
    for subset in {r.subset for r in got}:
        places = sorted((r.place, -r.f1, r.network) for r in got if r.subset == subset)
        assert [p[0] for p in places] == [1, 2] and [p[1:] for p in places] == sorted(p[1:] for p in places)


def test_runs_over_growing_input_take_only_what_is_new(spark, sf_dir, tmp_path):
    docs, config = spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.config("text_scorers")
    arriving, labels, out = str(tmp_path / "docs"), f"{sf_dir}/labels.parquet", str(tmp_path / "out")
    docs.where("doc_id % 3 = 0").coalesce(1).write.parquet(arriving)
    first = text_scorers.run(spark, arriving, labels, out, config)
    assert first["documents"] == docs.where("doc_id % 3 = 0").count()
    before = {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "out" / "scores").rglob("*.parquet"))}
    docs.where("doc_id % 3 <> 0").coalesce(2).write.mode("append").parquet(arriving)
    second = text_scorers.run(spark, arriving, labels, out, config)
    assert second["documents"] == docs.where("doc_id % 3 <> 0").count()
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    grown = rows_of(text_scorers.output(spark, out))
    assert text_scorers.run(spark, arriving, labels, out, config)["documents"] == 0
    assert rows_of(text_scorers.output(spark, out)) == grown
    # one run over everything says the same
    text_scorers.run(spark, arriving, labels, str(tmp_path / "once"), config)
    assert rows_of(text_scorers.output(spark, str(tmp_path / "once"))) == grown


def test_a_repeated_batch_and_a_newer_document_replace_what_was_there(spark, tmp_path):
    out, config = str(tmp_path / "out"), queries.config("text_scorers")
    schema = "doc_id long, text string, lang string"
    old = spark.createDataFrame([(1, "a a", "en"), (2, None, None), (3, "b", "fr")], schema)
    new = spark.createDataFrame([(1, "a b c", "fr")], schema)
    for _ in range(2):
        text_scorers.keep(old, 0, out, config)
    text_scorers.keep(new, 1, out, config)
    text_scorers.keep(new, 1, out, config)
    kept = spark.read.schema(text_scorers.SCORES).parquet(f"{out}/scores")
    assert kept.count() == 4
    found = {(r.doc_id, r.network): (r.subset, r.score) for r in text_scorers.current(kept).collect()}
    assert len(found) == 12 and found[1, "words"] == ("fr", 3) and found[2, "words"] == ("", 0) and found[3, "distinct_words"] == ("fr", 1000)


def test_no_documents(spark, sf_dir, tmp_path):
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(empty)
    out = str(tmp_path / "out")
    assert text_scorers.run(spark, empty, f"{sf_dir}/labels.parquet", out, queries.config("text_scorers"))["report"] == 0
    assert text_scorers.output(spark, out).count() == 0


# Agglomeration

def test_agglomeration_reruns_with_the_same_result(spark, sf_dir, tmp_path):
    out, config = str(tmp_path / "out"), queries.config("agglomerate_volume")
    counted = agglomerate_volume.run(spark, sf_dir, out, config)
    once = rows_of(agglomerate_volume.output(spark, out))
    # what a failed run leaves behind is replaced
    spark.range(5).selectExpr("id iv", "id label", "id mapped", "99 slab").write.partitionBy("slab").mode("append").parquet(f"{out}/volume")
    shutil.rmtree(tmp_path / "out" / "quality")
    assert agglomerate_volume.run(spark, sf_dir, out, config) == counted
    assert rows_of(agglomerate_volume.output(spark, out)) == once
    assert counted["voxels"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert {"slab=0"} <= {p.name for p in (tmp_path / "out" / "volume").iterdir()}


def test_agglomeration_merges_what_it_says(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    agglomerate_volume.run(spark, sf_dir, out, {"threshold": 0.5, "least_faces": 1, "slab": 1})
    found = agglomerate_volume.output(spark, out)
    mapped = {r.label: r.mapped for r in found.where("part = 'volume'").select("label", "mapped").distinct().collect()}
    edges = found.where("part = 'edges'").collect()
    assert mapped[0] == 0 and all(m <= v for v, m in mapped.items()) and {e.decision for e in edges} == {"merged", "kept"}
    for e in edges:
        assert (e.decision == "merged") == (e.affinity > 0.5)
        if e.decision == "merged":
            assert mapped[e.label_one] == mapped[e.label_two]
    figures = {r.stage: r for r in found.where("part = 'quality'").collect()}
    assert figures["after"].vi_merge >= figures["before"].vi_merge and figures["after"].vi_split <= figures["before"].vi_split


def test_command_line(sf_dir, tmp_path):
    """The command line makes its own session, runs, and stops it."""
    config = json.loads(open(f"{ROOT}/jobs/agglomerate_volume.json").read()) | {"slab": 2}
    (tmp_path / "c.json").write_text(json.dumps(config))
    done = subprocess.run([sys.executable, "-m", "jobs.agglomerate_volume", "--tables", sf_dir, "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and (tmp_path / "out" / "edges").is_dir()
