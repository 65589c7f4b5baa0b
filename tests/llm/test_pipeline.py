"""The pipeline's stages against brute force, stage by stage, on the smallest tables."""

import os
import re
import sys
from collections import Counter

import compare
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = c.common.table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(10**6, None, "en", None, None), (10**6 + 1, "12 34 !", "fr", "src0", 5)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs]
    for name, stage in c.STAGES:
        docs = c.common.written(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_language_stage_drops_only_what_has_no_language(stages):
    assert set(ids(stages[0])) - set(ids(stages[1])) == {10**6, 10**6 + 1}


CLASHING = ["size", "n_words", "score", "col", "host", "lang_pred", "copies", "time", "contaminated", "own_size"]


def test_stages_keep_columns_of_any_name(spark, sf_dir, stages):
    """Columns with names that operators use come through with their values."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    docs = stages[0]
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + i)
    for (name, stage), after in zip(c.STAGES[:-1], stages[1:], strict=False):
        docs = c.common.written(stage(spark, docs, sf_dir), f"clash-{name}")
        assert docs.columns == [*stages[0].columns, *CLASHING], name
        assert ids(docs) == ids(after), name
        assert docs.where(" or ".join(f"`{x}` is distinct from doc_id * 100 + {i}" for i, x in enumerate(CLASHING))).isEmpty(), name
    last = c.STAGES[-1][1](spark, docs.withColumn("slot", F.lit(-1)), sf_dir)
    assert ids(last) == ids(stages[5]) and last.where("slot < 0").isEmpty()


def test_stages_of_nothing(spark, sf_dir, stages):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, stages[0].limit(0), sf_dir).count() == 0, name


def test_language_stage_judges_by_its_bar(spark, sf_dir, stages, monkeypatch):
    """On a bar that half of the documents pass, the stage keeps those whose score, worked out word by word, reaches it."""
    import corpus_pipeline as c
    from lattica.llm import language_id

    model = language_id.fit(stages[0].where(~language_id.held_out()))
    scores = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(stages[0].select("doc_id", "text"), model).collect()}
    known = sorted(s for lang, s in scores.values() if lang != "und")
    bar = known[len(known) // 2]
    monkeypatch.setattr(c, "LEAST_SCORE", bar)
    want = {i for i, (lang, s) in scores.items() if lang != "und" and s >= bar}
    assert set(ids(c.language_stage(spark, stages[0], sf_dir))) == want and 0 < len(want) <= len(known)


def test_near_duplicate_stage(stages):
    from test_operators import brute_links

    source = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, _, n, c in brute_links(source, 5, 4, 5) if str(c) == i}
    assert {str(i) for i in ids(stages[2])} == want


def test_decontamination_stage(spark, sf_dir, stages):
    from test_operators import brute_contamination

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    have = [r for r in stages[2].collect() if r.doc_id % 4 == 0]  # brute force is slow; the stage itself sees all rows
    assert {r.doc_id for r in have if not brute_contamination(r.text, items)[4]} == {i for i in ids(stages[3]) if i % 4 == 0}


def contaminated_ids(rows, items, window=13):
    """Ids of documents of which 5 % of the words or more lie in windows of the items, by an index of all windows."""
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(table))
    known = {}
    for _, t in items:
        b = cut(t)
        n = min(window, len(b))
        if b:
            known.setdefault(n, set()).update(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
    out = set()
    for r in rows:
        ws, hit = cut(r.text), set()
        for n, windows in known.items():
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(ws):
            out.add(r.doc_id)
    return out


def test_decontamination_stage_of_all_documents(spark, sf_dir, stages):
    import corpus_pipeline as c

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # besides the stage's own input, contaminated documents of each remainder of the id
    made = [(2 * 10**6 + i, items[i][1], "en", "src0", len(items[i][1])) for i in range(4)]
    for before, after in ((stages[2], stages[3]), (df := stages[2].unionByName(spark.createDataFrame(made, stages[2].schema)), c.decontamination_stage(spark, df, sf_dir))):
        rows = before.collect()
        bad = contaminated_ids(rows, items)
        assert ids(after) == Counter(r.doc_id for r in rows if r.doc_id not in bad)
    assert {i for i, *_ in made} <= bad


def test_mixing_stage_meets_the_target_of_each_source(stages):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    have, largest, taken = Counter(), Counter(), Counter()
    for r in stages[3].collect():
        have[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in stages[4].collect():
        taken[r.source] += size(r)
    order = sorted(have, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, budget = {}, dict(weight), 1.5 * sum(have.values())
    while open_:
        level = (budget - sum(target.values())) / sum(open_.values())
        over = [s for s in open_ if level * weight[s] > 2 * have[s]]
        target |= {s: 2 * have[s] if over else level * weight[s] for s in over or open_}
        open_ = {s: w for s, w in open_.items() if s not in target}
    assert len(order) > 1 and set(taken) <= set(have)
    for s in order:
        # of the documents that stand on the budget, as many are taken as come nearest to it
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6, s


def test_mixing_stage(stages):
    before, after = ids(stages[3]), ids(stages[4])
    assert set(after) <= set(before) and max(after.values()) <= 2
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(words(stages[4]) / words(stages[3]) - 1.5) < 0.1


def test_sharding_stage(stages):
    rows = stages[5].collect()
    assert ids(stages[5]) == ids(stages[4])
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))


@pytest.mark.parametrize("name", ["op2_wu_manber", "op3_link_propagation", "op6_hash_thresholds", "op7_interval_tree", "op8_grace_hash", "op9_token_groups", "op10_blob_ledger"])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    from lattica.llm import queries

    ok, why = compare.compare(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert ok, why
