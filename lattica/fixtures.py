"""The canonical voxel view and what derives from it, from the driver's tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import coordinates
from lattica.geometry import Geometry
from lattica.operators import neighbors, skeleton

NY, NX, SMALL, REACH = 30, 50, 50, 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geometry(spark: SparkSession, sf_dir: str) -> Geometry:
    n = table(spark, sf_dir, "orders").count()
    return Geometry(n // (NY * NX), NY, NX, (30, 15, 15), ((0, n // (NY * NX)), (0, NY), (0, 40)))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("iv"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    base = o.select("iv", *coordinates("iv", NY, NX), "c")
    d = lambda c, n: F.expr(f"{c} div {n}")
    seg = F.expr("1 + (z div 2) * 60 + (y div 5) * 10 + 2 * (x div 10) + IF(x % 10 >= 7, 1, 0)")
    gold = F.expr("1 + (z div 4) * 24 + ((y + 2) div 10) * 6 + ((x + 3) div 10)")
    v = base.select("iv", "z", "y", "x", "c", F.when(F.col("c") % 11 == 0, 0).otherwise(seg).cast("long").alias("seg"),
                    F.when((F.col("c") % 7 == 0) | ((F.col("y") >= 25) & (F.col("x") < 20)), 0).otherwise(gold).cast("long").alias("gold"),
                    (F.col("c") % 1000).alias("aff_x"), (d("c", 10) % 1000).alias("aff_y"), (d("c", 100) % 1000).alias("aff_z"))
    return v.withColumn("seg_split", F.when(F.col("seg") == 0, 0).otherwise(1 + (F.col("seg") - 1) % 97).cast("long")).withColumn("image", F.col("c") % 256)


def labels(spark: SparkSession, sf_dir: str, label: str = "seg") -> DataFrame:
    return voxels(spark, sf_dir).withColumn("label", F.col(label))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.adjacency(labels(spark, sf_dir)).select(F.col("label_one").alias("v1"), F.col("label_two").alias("v2"))
    return pairs.withColumn("p", (1 + (F.col("v1") * 7919 + F.col("v2") * 104729) % 998) / 1000.0)


def skeleton_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where("label > 0 and y % 5 = 2 and z % 2 = 0").select("label", "iv", "z", "y", "x")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.endpoint_vectors(skeleton_points(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.floor(F.col("embedding")[k].cast("double") * 1000).cast("long").alias(a) for k, a in enumerate("zyx")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *at)


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("truth"), ((F.col("event_id") * 7919) % 1001 / 1000.0).alias("prob"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") % 256).alias("g"), F.expr("(p_partkey div 256) % 256").alias("b"))


def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, pred = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    from lattica.operators.metrics import confusion_counts

    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("network"), F.col("l_linestatus").alias("subset")).agg(*confusion_counts(truth, pred))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat_ws("-", "n_name", "s_name", F.lit("reduced")).alias("prefix"))


#: Common tables of the SQL forms; a query uses the ones it names.
SQL = f"""with recursive
base as (select o_orderkey iv, o_orderkey // 1500 z, (o_orderkey // 50) % 30 y, o_orderkey % 50 x, cast(round(o_totalprice * 100) as bigint) c from orders),
voxel0 as (select iv, z, y, x, c,
  cast(case when c % 11 = 0 then 0 else 1 + (z // 2) * 60 + (y // 5) * 10 + 2 * (x // 10) + case when x % 10 >= 7 then 1 else 0 end end as bigint) seg,
  cast(case when c % 7 = 0 or (y >= 25 and x < 20) then 0 else 1 + (z // 4) * 24 + ((y + 2) // 10) * 6 + ((x + 3) // 10) end as bigint) gold,
  c % 1000 aff_x, (c // 10) % 1000 aff_y, (c // 100) % 1000 aff_z, c % 256 image from base),
voxel as (select *, cast(case when seg = 0 then 0 else 1 + (seg - 1) % 97 end as bigint) seg_split from voxel0),
axis(ax, dz, dy, dx) as (values ('z', 1, 0, 0), ('y', 0, 1, 0), ('x', 0, 0, 1)),
face as (select a.iv, b.iv n_iv, a.z, a.y, a.x, a.seg a, b.seg b, ax, case ax when 'z' then a.aff_z when 'y' then a.aff_y else a.aff_x end aff
  from voxel a, axis join voxel b on b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx where a.seg <> b.seg),
adj as (select distinct least(a, b) label_one, greatest(a, b) label_two from face where a <> 0 and b <> 0),
aff as (select least(a, b) label_one, greatest(a, b) label_two, count(*) n, cast(sum(aff) as bigint) total from face group by all),
vol as (select seg label, count(*) n, count(*) < {SMALL} is_small from voxel group by seg),
cg as (select seg label, gold g, count(*) n from voxel group by all),
s2g as (select label, cast(case when sm * 1000 < al * 400 or sm = 0 then 0 when tn * 1000 < sm * 800 then -1 else tg end as bigint) gold from (
  select label, sum(n) al, coalesce(sum(n) filter (g <> 0), 0) sm, max(n) filter (g <> 0) tn, min(case when g <> 0 and n = mx then g end) tg
  from (select *, max(case when g <> 0 then n end) over (partition by label) mx from cg) group by label)),
truth as (select label_one, label_two, case when a.gold < 1 or b.gold < 1 then 'unknown' when a.gold = b.gold then 'positive' else 'negative' end truth
  from adj join s2g a on a.label = label_one join s2g b on b.label = label_two),
scored as (select label_one v1, label_two v2, (1 + (label_one * 7919 + label_two * 104729) % 998) / 1000.0::double p from adj),
off26 as (select a.range - 1 dz, b.range - 1 dy, c.range - 1 dx, cast(row_number() over (order by a.range, b.range, c.range) as bigint) - 1 k
  from range(3) a, range(3) b, range(3) c where not (a.range = 1 and b.range = 1 and c.range = 1)),
skel as (select seg label, iv, z, y, x from voxel where seg > 0 and y % 5 = 2 and z % 2 = 0),
snb as (select s.label, s.iv, t.iv n_iv, t.z nz, t.y ny, t.x nx, k from skel s, off26 join skel t on t.z = s.z + dz and t.y = s.y + dy and t.x = s.x + dx and t.label = s.label),
sdeg as (select s.label, s.iv, s.z, s.y, s.x, count(n_iv) n, coalesce(bit_or(cast(1 as bigint) << cast(k as integer)), 0) mask from skel s left join snb n on n.iv = s.iv group by all),
ends as (select label, iv, z, y, x from sdeg where n <= 1),
w1 as (select e.*, count(n_iv) c1, min(n_iv) p1 from ends e left join snb n on n.iv = e.iv group by all),
w2 as (select w1.*, count(n.n_iv) c2, min(n.n_iv) p2 from w1 left join snb n on n.iv = p1 and c1 = 1 and n.n_iv <> w1.iv group by all),
w3 as (select w2.*, count(n.n_iv) c3, min(n.n_iv) p3 from w2 left join snb n on n.iv = p2 and c1 = 1 and c2 = 1 and n.n_iv not in (w2.iv, p1) group by all),
lastp as (select label, iv, z, y, x, case when c1 <> 1 then iv when c2 <> 1 then p1 when c3 <> 1 then p2 else p3 end q from w3),
evec0 as (select label, iv, z, y, x, z - q // 1500 az, y - (q // 50) % 30 ay, x - q % 50 ax from lastp),
evec as (select label, iv, z, y, x, coalesce(az / nullif(sqrt(az * az + ay * ay + ax * ax), 0), 0) vz, coalesce(ay / nullif(sqrt(az * az + ay * ay + ax * ax), 0), 0) vy,
  coalesce(ax / nullif(sqrt(az * az + ay * ay + ax * ax), 0), 0) vx from evec0),
pbound as (select distinct v.iv, v.z, v.y, v.x from voxel v join voxel w on w.z = v.z and abs(w.y - v.y) + abs(w.x - v.x) = 1 and w.y between v.y - 1 and v.y + 1 and w.seg <> v.seg),
roots95e as (select v1 a, v2 b from scored where p >= 0.95 union all select v2, v1 from scored where p >= 0.95),
roots95r as (select distinct a v, a u from (select v1 a from scored union select v2 from scored) union select r.v, e.b from roots95r r join roots95e e on r.u = e.a),
roots95 as (select v label, min(u) mapped from roots95r group by v),
best as (select label, other best, score from (select *, row_number() over (partition by label order by score desc, other) k from (
  select l.label, o.label other, total / (n * 1000.0) score from (select label_one s, label_two o, n, total from aff where label_one <> 0 union all select label_two, label_one, n, total from aff where label_one <> 0) x
  join (select label from vol where is_small) l on l.label = x.s join (select label from vol where not is_small) o on o.label = x.o)) where k = 1),
mid as (select least(a, b) label_one, greatest(a, b) label_two, count(*) n, sum(2 * z + (ax = 'z')::int) sz, sum(2 * y + (ax = 'y')::int) sy, sum(2 * x + (ax = 'x')::int) sx from face group by all),
cand as (select m.label_one, m.label_two, cast(sz // (2 * m.n) as bigint) z, cast(sy // (2 * m.n) as bigint) y, cast(sx // (2 * m.n) as bigint) x from mid m where label_one <> 0),
cone as (select distinct e.label, e.iv, v.seg neighbour from evec e join voxel v on v.z between e.z - {REACH // 30} and e.z + {REACH // 30} and v.y between e.y - {REACH // 15} and e.y + {REACH // 15} and v.x between e.x - {REACH // 15} and e.x + {REACH // 15}
  where vz * vz + vy * vy + vx * vx >= 0.5 and v.seg <> 0 and v.seg <> e.label and 900 * (v.z - e.z) ** 2 + 225 * ((v.y - e.y) ** 2 + (v.x - e.x) ** 2) <= {REACH * REACH}
  and vz * 30 * (v.z - e.z) + vy * 15 * (v.y - e.y) + vx * 15 * (v.x - e.x) >= cos(0.3216) * sqrt(900 * (v.z - e.z) ** 2 + 225 * ((v.y - e.y) ** 2 + (v.x - e.x) ** 2))),
sided as (select a label, b other, z, y, x, ax from face where a <> 0 and b <> 0 union all select b, a, z, y, x, ax from face where a <> 0 and b <> 0),
trav as (select c.label, c.iv, c.neighbour, cast(sum(2 * f.z + (ax = 'z')::int) // (2 * count(*)) as bigint) z, cast(sum(2 * f.y + (ax = 'y')::int) // (2 * count(*)) as bigint) y, cast(sum(2 * f.x + (ax = 'x')::int) // (2 * count(*)) as bigint) x
  from cone c join evec e on e.iv = c.iv join sided f on f.label = c.label and f.other = c.neighbour and abs(f.z - e.z) <= {REACH // 30} and abs(f.y - e.y) <= {REACH // 15} and abs(f.x - e.x) <= {REACH // 15} group by all),
cls as (select event_id, event_type = 'error' truth, (event_id * 7919) % 1001 / 1000.0::double prob from events),
cur0 as (select prob threshold, count(*) filter (truth) t, count(*) filter (not truth) f from cls group by prob),
cur as (select threshold, t, f, sum(t) over (order by threshold desc) tp, sum(f) over (order by threshold desc) fp, sum(t) over () pos, sum(f) over () neg from cur0)
"""
