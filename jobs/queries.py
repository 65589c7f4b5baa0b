"""The jobs as queries: each runs twice into one new folder of the shared one and reads back what then stands there."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from jobs import agglomerate_volume, text_scorers
from lattica import fixtures
from lattica.plans.components import ensure_checkpoint_dir
from lattica.queries import closure


def config(name: str) -> dict:
    with open(os.path.join(os.path.dirname(__file__), f"{name}.json")) as f:
        return json.load(f)


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_scorers(spark, sf_dir: str):
    out, own = new_folder(spark, "job1"), config("text_scorers")
    for _ in range(2):
        text_scorers.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, own)
    return text_scorers.output(spark, out)


def job2_agglomerate_volume(spark, sf_dir: str):
    out, own = new_folder(spark, "job2"), config("agglomerate_volume")
    for _ in range(2):
        agglomerate_volume.run(spark, sf_dir, out, own)
    found = agglomerate_volume.output(spark, out)
    return found.withColumn("affinity", F.round("affinity", 6))


QUERIES = {"job1_text_scorers": job1_text_scorers, "job2_agglomerate_volume": job2_agglomerate_volume}

_SCORERS = r"""
with w as (select doc_id, coalesce(lang, '') subset, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') l from documents),
s as (select doc_id, subset, unnest(['words', 'letters', 'distinct_words', 'distinct_lines']) network, unnest([least(len(w), 1000), coalesce(1000 * length(regexp_replace(t, '[^A-Za-z]', '', 'g')) // nullif(length(t), 0), 0),
    coalesce(1000 * len(list_distinct(w)) // nullif(len(w), 0), 0), coalesce(1000 * len(list_distinct(l)) // nullif(len(l), 0), 0)])::int score from w),
c as (select subset, network, score, count(*) filter (quality > 0) t, count(*) filter (quality <= 0) f from s join labels using (doc_id) where quality is not null group by all),
r as (select *, sum(t) over d tp, sum(f) over d fp, sum(t) over e pos, sum(f) over e neg from c window d as (partition by subset, network order by score desc), e as (partition by subset, network)),
x as (select *, pos - tp fn, neg - fp tn, coalesce(2.0::double * tp / nullif(2.0::double * tp + fp + pos - tp, 0), 0) exact from r),
a as (select subset, network, round(sum(f * (2 * tp - t))::double / nullif(2.0::double * max(pos) * max(neg), 0), 6) auc from r group by all),
b as (select *, row_number() over (partition by subset, network order by exact desc, score desc) k from x),
g as (select subset, network, score threshold, tp, fp, fn, tn, exact, auc from b join a using (subset, network) where k = 1)
select 'score' part, doc_id, subset, network, score, null::int threshold, null::bigint tp, null::bigint fp, null::bigint fn, null::bigint tn, null::double as precision, null::double recall, null::double f1, null::double auc, null::int place from s
union all select 'report', null, subset, network, null, threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6), round(tp / nullif(tp + fn, 0), 6), round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), auc,
  row_number() over (partition by subset order by exact desc, network) from g
"""

_MERGED = "n >= 3 and total / (n * 1000.0::double) > 0.65"
_QUALITY = """(select round(-sum(p * log2(p / ps)), 6) vi_merge, round(-sum(p * log2(p / pt)), 6) vi_split from (select n / sum(n) over () p, sum(n) over (partition by seg) / sum(n) over () ps, sum(n) over (partition by gold) / sum(n) over () pt from {0})),
  (select round((tp_fp - tp) / e, 6) rand_merge, round((tp_fn - tp) / e, 6) rand_split from (select sum(n * (n - 1) / 2) tp, sum(n) * (sum(n) - 1) / 2 e from {0}),
  (select sum(n * (n - 1) / 2) tp_fp from (select sum(n) n from {0} group by seg)), (select sum(n * (n - 1) / 2) tp_fn from (select sum(n) n from {0} group by gold)))"""
_AGGLOMERATED = fixtures.SQL.rstrip() + f""",
picked as (select label_one v1, label_two v2, n, total / (n * 1000.0::double) affinity, {_MERGED} merged from aff where label_one <> 0),
root as {closure('merged', 'picked')},
before as (select seg, gold, count(*)::double n from voxel where gold <> 0 group by all),
after as (select coalesce(mapped, seg) seg, gold, sum(n) n from before left join root on label = seg group by all)
select 'volume' part, iv, seg label, coalesce(mapped, seg) mapped, (z // 16)::int slab, null::bigint label_one, null::bigint label_two, null::bigint n, null::double affinity, null::bigint z, null::bigint y, null::bigint x, null truth, null decision,
  null::double vi_merge, null::double vi_split, null::double rand_merge, null::double rand_split, null stage from voxel left join root on label = seg
union all select 'edges', null, null, null, null, v1, v2, picked.n, round(affinity, 6), cand.z, cand.y, cand.x, truth, case when merged then 'merged' else 'kept' end, null, null, null, null, null
  from picked join cand on cand.label_one = v1 and cand.label_two = v2 join truth on truth.label_one = v1 and truth.label_two = v2
union all select 'quality', null, null, null, null, null, null, null, null, null, null, null, null, null, vi_merge, vi_split, rand_merge, rand_split, 'before' from {_QUALITY.format('before')}
union all select 'quality', null, null, null, null, null, null, null, null, null, null, null, null, null, vi_merge, vi_split, rand_merge, rand_split, 'after' from {_QUALITY.format('after')}
"""
ORACLE_SQL = {"job1_text_scorers": _SCORERS, "job2_agglomerate_volume": _AGGLOMERATED}
