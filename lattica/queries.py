"""Every operator as a query over the fixture views, next to its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import fixtures as fx
from lattica.operators import contraction, features, graph, metrics, neighbors, partition, scoring, skeleton, spatial, surface, sweep, truth, voxel

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OUT, WIDTH, RADIUS = (60, 60, 60), (3, 5, 5), 60
MASKED = (1, 2, 13, 14, 25)


def query(name: str, sql: str | None = None, tables: str = ""):
    """Registers a query; `tables` are common table expressions of its own SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = (fx.SQL.rstrip() + ",\n" + tables + "\n" if tables else fx.SQL) + sql
        return fn

    return add


def small(s, d):
    return voxel.small_segments(fx.labels(s, d), fx.SMALL)


def mapping(s, d):
    return truth.seg2gold(fx.labels(s, d))


def pairs(s, d):
    return neighbors.adjacency(fx.labels(s, d))


def table(s, d):
    return metrics.contingency(fx.labels(s, d))


# Projections and filters

@query("index_decode", "select iv, z, y, x from voxel")
def _(s, d):
    return fx.voxels(s, d).select("iv", "z", "y", "x")


query("label_volume", "select label, n from vol")(lambda s, d: voxel.label_volume(fx.labels(s, d)))
query("max_label", "select max(seg) max_label, max(seg) + 1 size from voxel")(lambda s, d: voxel.max_label(fx.labels(s, d)))
query("unique_labels", "select distinct seg label from voxel")(lambda s, d: voxel.unique_labels(fx.labels(s, d)))
query("topk_labels", "select gold label, count(*) n from voxel where gold <> 0 group by gold order by n desc, gold desc limit 500")(lambda s, d: voxel.topk_labels(fx.labels(s, d, "gold")))
query("label_bbox", "select seg label, min(z) zmin, max(z) zmax, min(y) ymin, max(y) ymax, min(x) xmin, max(x) xmax from voxel where seg <> 0 group by seg")(lambda s, d: voxel.label_bbox(fx.labels(s, d)))
query("small_segments", "select label, n, is_small from vol")(small)
query("remove_small", "select iv, case when n < 64 then 0 else seg end label from voxel join vol on seg = label")(lambda s, d: voxel.remove_small(fx.labels(s, d)).select("iv", "label"))
query("reduce_labels", "select seg label, dense_rank() over (order by seg) mapped from (select distinct seg from voxel where seg <> 0) union all select distinct seg, seg from voxel where seg = 0")(lambda s, d: voxel.reduce_labels(fx.labels(s, d)))
query("map_labels", "select iv, coalesce(mapped, 0) label from voxel left join (select seg l, dense_rank() over (order by seg) mapped from (select distinct seg from voxel where seg <> 0)) on seg = l")(
    lambda s, d: voxel.map_labels(fx.labels(s, d), voxel.reduce_labels(fx.labels(s, d))).select("iv", "label"))
query("split_data", "select iv, case when x >= 25 then 1 else 0 end part from voxel")(lambda s, d: voxel.split_data(fx.labels(s, d), fx.geometry(s, d), "x").select("iv", "part"))
query("mask_and_crop", f"""select z - z0 z, y - y0 y, x - x0 x, case when seg in {MASKED} then seg else 0 end label from voxel,
  (select min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from voxel where seg in {MASKED}) where z between z0 and z1 and y between y0 and y1 and x between x0 and x1""")(
    lambda s, d: voxel.mask_and_crop(fx.labels(s, d), MASKED))
query("downsample_nearest", """select z, i y, j x, seg label from voxel join (select range i, cast(floor(range * 2.0) as bigint) sy from range(15)) on y = sy
  join (select range j, cast(floor(range * 2.5) as bigint) sx from range(20)) on x = sx""")(lambda s, d: voxel.downsample_nearest(fx.labels(s, d), fx.geometry(s, d), (1, 2, 2.5)))
query("rgb_decode", "select p_partkey, p_partkey % 256 * 65536 + p_size % 256 * 256 + (p_partkey // 256) % 256 label from part")(lambda s, d: voxel.rgb_decode(fx.rgb(s, d)).select("p_partkey", "label"))
query("colorize", "select label, (107 * label) % 700 % 255 r, (509 * label) % 900 % 255 g, (200 * label) % 777 % 255 b from vol")(
    lambda s, d: voxel.unique_labels(fx.labels(s, d)).select("label", *voxel.colorize(F.col("label"))))
query("overlay", """select iv, case when r + g + b = 0 then image else cast(floor(0.5 * r + 0.5 * image) as bigint) end r, case when r + g + b = 0 then image else cast(floor(0.5 * g + 0.5 * image) as bigint) end g,
  case when r + g + b = 0 then image else cast(floor(0.5 * b + 0.5 * image) as bigint) end b from (select iv, image, (107 * seg) % 700 % 255 r, (509 * seg) % 900 % 255 g, (200 * seg) % 777 % 255 b from voxel)""")(
    lambda s, d: voxel.overlay(fx.labels(s, d)))


query("grey_rgb", "select iv, image r, image g, image b from voxel")(lambda s, d: voxel.grey_rgb(fx.labels(s, d)).select("iv", "r", "g", "b"))
query("extract_example", "select iv, case when seg in (1, 2) then seg else 0 end label from voxel")(lambda s, d: features.extract_example(fx.labels(s, d), 1, 2).select("iv", "label"))
query("image_order", "select s_suppkey, row_number() over (order by n_name || '-' || s_name || '-reduced') - 1 z from supplier join nation on s_nationkey = n_nationkey")(
    lambda s, d: voxel.slice_ids(fx.prefixes(s, d), "prefix").select("s_suppkey", "z"))


@query("bbox_intersection", """select a_label, b_label, greatest(a.z0, b.z0) zmin, least(a.z1, b.z1) zmax, greatest(a.y0, b.y0) ymin, least(a.y1, b.y1) ymax, greatest(a.x0, b.x0) xmin, least(a.x1, b.x1) xmax,
  greatest(a.z0, b.z0) > least(a.z1, b.z1) or greatest(a.y0, b.y0) > least(a.y1, b.y1) or greatest(a.x0, b.x0) > least(a.x1, b.x1) as empty from (select label_one a_label, label_two b_label from adj)
  join (select seg, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from voxel group by seg) a on a.seg = a_label
  join (select seg, min(z) z0, max(z) z1, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from voxel group by seg) b on b.seg = b_label""")
def _(s, d):
    box = voxel.label_bbox(fx.labels(s, d))
    return voxel.bbox_intersection(box, box, pairs(s, d).select(F.col("label_one").alias("a_label"), F.col("label_two").alias("b_label")))


@query("parse_prefix", """select s_suppkey, split_part(p, '-', 1) dataset, array_to_string((string_split(p, '-'))[2:-2], '-') subset, split_part(p, '-', -1) = 'reduced' reduced
  from (select s_suppkey, n_name || '-' || s_name || '-reduced' p from supplier join nation on s_nationkey = n_nationkey)""")
def _(s, d):
    parts = F.split("prefix", "-")
    return fx.prefixes(s, d).select("s_suppkey", parts[0].alias("dataset"), F.concat_ws("-", F.slice(parts, F.lit(2), F.size(parts) - 2)).alias("subset"), (F.element_at(parts, -1) == "reduced").alias("reduced"))


# Truth and metrics

_C = "(select seg, gold, count(*)::double n from voxel where gold <> 0 group by all)"
query("contingency", "select seg, gold, count(*) n from voxel where gold <> 0 group by all")(table)
query("rand_error", f"""select round((tp_fp - tp) / e, 6) rand_merge, round((tp_fn - tp) / e, 6) rand_split from
  (select sum(n * (n - 1) / 2) tp, sum(n) * (sum(n) - 1) / 2 e from {_C}), (select sum(n * (n - 1) / 2) tp_fp from (select sum(n) n from {_C} group by seg)), (select sum(n * (n - 1) / 2) tp_fn from (select sum(n) n from {_C} group by gold))""")(
    lambda s, d: metrics.rand_error(table(s, d)))
_VI = """select round(-sum(p * log2(p / ps)), 6) vi_merge, round(-sum(p * log2(p / pt)), 6) vi_split from (select n / sum(n) over () p, sum(n) over (partition by {0}) / sum(n) over () ps, sum(n) over (partition by gold) / sum(n) over () pt from {1})"""
query("variation_of_information", _VI.format("seg", _C))(lambda s, d: metrics.variation_of_information(table(s, d)))
query("adapted_rand", """select round(1 - 2 * p * r / (p + r), 6) are, round(p, 6) as precision, round(r, 6) recall from (select (ab + c / n) / (b + c / n) p, (ab + c / n) / a r from
  (select count(*)::double n from voxel), (select sum(k * k) a from (select count(*)::double k from voxel where gold > 0 group by gold)), (select sum(k * k) b from (select count(*)::double k from voxel where gold > 0 and seg > 0 group by seg)),
  (select sum(k * k) ab from (select count(*)::double k from voxel where gold > 0 and seg > 0 group by gold, seg)), (select count(*)::double c from voxel where gold > 0 and seg = 0))""")(lambda s, d: metrics.adapted_rand(fx.labels(s, d)))
_FILTERED = """small0 as (select iv, z, y, x, case when count(*) over (partition by seg) < 50 then 0 else seg end seg, case when count(*) over (partition by gold) < 50 then 0 else gold end gold from voxel),
edge0 as (select distinct v.z, v.y, v.x from small0 v join small0 w on w.z = v.z and abs(w.y - v.y) + abs(w.x - v.x) = 1 and w.y between v.y - 1 and v.y + 1 and w.gold <> v.gold),
near0 as (select distinct w.iv from small0 w join edge0 b on b.z = w.z and b.y between w.y - 2 and w.y + 2 and b.x between w.x - 2 and w.x + 2 and (b.y - w.y) ** 2 + (b.x - w.x) ** 2 <= 4),
kept0 as (select s.iv, seg, case when n.iv is null then gold else 0 end gold from small0 s left join near0 n on n.iv = s.iv)"""
query("adapted_rand_prepared", """select round(1 - 2 * p * r / (p + r), 6) are, round(p, 6) as precision, round(r, 6) recall from (select (ab + c / n) / (b + c / n) p, (ab + c / n) / a r from
  (select count(*)::double n from kept0), (select coalesce(sum(k * k), 0) a from (select count(*)::double k from kept0 where gold > 0 group by gold)), (select coalesce(sum(k * k), 0) b from (select count(*)::double k from kept0 where gold > 0 and seg > 0 group by seg)),
  (select coalesce(sum(k * k), 0) ab from (select count(*)::double k from kept0 where gold > 0 and seg > 0 group by gold, seg)), (select count(*)::double c from kept0 where gold > 0 and seg = 0))""", _FILTERED)(
    lambda s, d: metrics.adapted_rand(fx.labels(s, d), dilate=2, least=50))
query("seg2gold", "select label, gold from s2g")(mapping)
query("classify_pairs", "select * from truth")(lambda s, d: truth.classify_pairs(pairs(s, d), mapping(s, d)))


def candidates(s, d):
    m = neighbors.middle_boundary(fx.labels(s, d)).where("label_one <> 0")
    own = m.select("label_one", "label_two", *[F.floor(f"{a}_mean").cast("long").alias(a) for a in "zyx"])
    return truth.classify_pairs(truth.crop_forward(own, fx.geometry(s, d)), mapping(s, d))


query("crop_forward", "select label_one, label_two, z, y, x, x >= 40 forward from cand")(lambda s, d: candidates(s, d).select("label_one", "label_two", "z", "y", "x", "forward"))
query("prob2pred", "select event_id, prob > 0.5 pred from cls")(lambda s, d: metrics.prob2pred(fx.classifier(s, d)).select("event_id", "pred"))
_RATES = """round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1"""
_COUNTS = "count(*) filter ({0} and {1}) tp, count(*) filter (not {0} and {1}) fp, count(*) filter ({0} and not {1}) fn, count(*) filter (not {0} and not {1}) tn"
query("confusion_matrix", f"select *, {_RATES} from (select {_COUNTS.format('truth', 'prob > 0.5')} from cls)")(lambda s, d: metrics.confusion_matrix(metrics.prob2pred(fx.classifier(s, d))))


@query("edge_confusion", f"""select *, {_RATES} from (select m as method, {_COUNTS.format("(truth = 'positive')", 'pred')} from (
  select truth, unnest(['cnn', 'partition']) m, unnest([p > 0.5, a.mapped = b.mapped]) pred from truth join scored on v1 = label_one and v2 = label_two join roots95 a on a.label = v1 join roots95 b on b.label = v2 where truth <> 'unknown') group by m)""")
def _(s, d):
    edges = fx.scored(s, d)
    roots = graph.graph_baseline(edges)
    cut = edges.join(roots.select(F.col("label").alias("v1"), F.col("mapped").alias("r1")), "v1").join(roots.select(F.col("label").alias("v2"), F.col("mapped").alias("r2")), "v2")
    cut = cut.withColumn("cut", F.col("r1") != F.col("r2"))
    return metrics.edge_confusion(truth.classify_pairs(cut, mapping(s, d), "v1", "v2"))


query("network_leaderboard", f"""select subset, network, tp, fp, fn, tn, f1 from (select *, row_number() over (partition by subset order by f1 desc nulls last, network) k from (select *, {_RATES} from (
  select l_returnflag network, l_linestatus subset, {_COUNTS.format('l_quantity > 25', 'l_discount > 0.05')} from lineitem group by all))) where k = 1""")(lambda s, d: metrics.network_leaderboard(fx.confusions(s, d)))
query("pr_curve", "select threshold, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(pos, 0), 6) recall from cur")(lambda s, d: metrics.pr_curve(fx.classifier(s, d)))
query("average_precision", "select round(sum(t / pos * (tp / (tp + fp))), 6) average_precision from cur")(lambda s, d: metrics.average_precision(fx.classifier(s, d)))
query("roc_curve", "select threshold, round(fp / nullif(neg, 0), 6) fpr, round(tp / nullif(pos, 0), 6) tpr from cur")(lambda s, d: metrics.roc_curve(fx.classifier(s, d)))
query("roc_auc", "select round(sum(f * (2 * tp - t)) / (2.0 * max(pos) * max(neg)), 6) auc from cur")(lambda s, d: metrics.roc_auc(fx.classifier(s, d)))


@query("endpoint_grid_best", """select *, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) fscore from (select l_partkey % 864 config, count(*) filter (l_returnflag = 'R') tp, count(*) filter (l_returnflag = 'A') fp, count(*) filter (l_returnflag = 'N') fn
  from lineitem group by config) order by fscore desc, config limit 1""")
def _(s, d):
    counts = [F.count_if(F.col("l_returnflag") == v).alias(n) for n, v in (("tp", "R"), ("fp", "A"), ("fn", "N"))]
    return metrics.endpoint_grid_best(fx.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 864).alias("config")).agg(*counts))


# Neighbours

query("face_pairs", "select iv, n_iv, ax as axis, a label, b n_label from face")(lambda s, d: neighbors.face_pairs(fx.labels(s, d)).select("iv", "n_iv", "axis", "label", "n_label"))
query("adjacency", "select * from adj")(pairs)
query("middle_boundary", "select label_one, label_two, n, sz / (2.0::double * n) z_mean, sy / (2.0::double * n) y_mean, sx / (2.0::double * n) x_mean from mid")(lambda s, d: neighbors.middle_boundary(fx.labels(s, d)))
query("mean_affinity", "select label_one, label_two, n, total, total / (n * 1000.0::double) affinity from aff")(lambda s, d: neighbors.mean_affinity(fx.labels(s, d)))
query("baseline_graph", "select count(*) filter (truth = 'positive') n_positive, count(*) filter (truth = 'negative') n_negative, count(*) filter (truth = 'unknown') n_unknown from truth")(
    lambda s, d: truth.baseline_graph(truth.classify_pairs(pairs(s, d), mapping(s, d))))


def best_node(s, d):
    a = neighbors.mean_affinity(fx.labels(s, d)).where("label_one <> 0").withColumn("score", F.col("total") / (F.col("n") * 1000.0))
    return neighbors.best_large_neighbour(a, small(s, d), "score")


query("baseline_nodes", """select count(*) filter (a.gold >= 1 and b.gold >= 1 and a.gold = b.gold) n_correct, count(*) filter (a.gold >= 1 and b.gold >= 1 and a.gold <> b.gold) n_incorrect
  from best join s2g a on a.label = best.label join s2g b on b.label = best.best""")(lambda s, d: truth.baseline_nodes(best_node(s, d), mapping(s, d)))
query("isolated_small", "select label from vol where is_small and label <> 0 and label not in (select label from best)")(lambda s, d: neighbors.isolated_small(pairs(s, d), small(s, d)))
query("neighbour_mask", "select label, iv, mask, n from sdeg")(lambda s, d: neighbors.neighbour_mask(fx.skeleton_points(s, d)))
query("distance_transform_2d", "select v.iv, round(sqrt(min((v.y - b.y) ** 2 + (v.x - b.x) ** 2)), 6) distance from voxel v left join pbound b on b.z = v.z group by v.iv")(
    lambda s, d: skeleton.distance_transform_2d(fx.labels(s, d), fx.geometry(s, d)))
query("dilate_gold", """select v.iv, case when n.iv is null then v.gold else 0 end gold from voxel v left join (select distinct w.iv from voxel w join
  (select distinct v.z, v.y, v.x from voxel v join voxel w on w.z = v.z and abs(w.y - v.y) + abs(w.x - v.x) = 1 and w.y between v.y - 1 and v.y + 1 and w.gold <> v.gold) b
  on b.z = w.z and b.y between w.y - 2 and w.y + 2 and b.x between w.x - 2 and w.x + 2 and (b.y - w.y) ** 2 + (b.x - w.x) ** 2 <= 4) n on n.iv = v.iv""")(
    lambda s, d: neighbors.dilate_gold(fx.labels(s, d, "gold"), 2).select("iv", F.col("label").alias("gold")))

_DBF = """dbf0 as (select v.seg label, v.iv, v.z, v.y, v.x, count(w.iv) n from voxel v left join voxel w on w.seg = v.seg and abs(w.z - v.z) + abs(w.y - v.y) + abs(w.x - v.x) = 1 where v.seg <> 0 group by all),
dbf as (select a.label, a.iv, round(sqrt(case when a.n < 6 then 1 else least(min((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 + 1), min(o.d)) end), 6) dbf from dbf0 a join dbf0 b on b.label = a.label and b.n < 6
  left join (select a.iv, min(dz * dz + dy * dy + dx * dx) d from dbf0 a, (select p.range - 4 dz, q.range - 4 dy, r.range - 4 dx from range(9) p, range(9) q, range(9) r)
    left join dbf0 b on b.label = a.label and b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx where b.iv is null group by a.iv) o on o.iv = a.iv group by a.label, a.iv, a.n)
"""
query("dbf_3d")(lambda s, d: skeleton.dbf_3d(fx.labels(s, d)))
ORACLE_SQL["dbf_3d"] = fx.SQL.rstrip() + ",\n" + _DBF + "select * from dbf"
query("pdrf_penalty")(lambda s, d: skeleton.pdrf_penalty(skeleton.dbf_3d(fx.labels(s, d))))
ORACLE_SQL["pdrf_penalty"] = fx.SQL.rstrip() + ",\n" + _DBF + "select label, iv, round(5000.0 * pow(1.0 - dbf / max(dbf) over (partition by label), 16), 6) penalty from dbf"

# Downsampling and skeletons

_CELL = "z * 30 // 60 dz, y * 15 // 60 dy, x * 15 // 60 dx"
query("downsample_topological", f"select distinct seg label, {_CELL} from voxel where seg <> 0")(lambda s, d: voxel.downsample_topological(fx.labels(s, d), fx.geometry(s, d), OUT))
_UP = f"""(select label, dz, dy, dx, iv up_iv from (select seg label, dz, dy, dx, iv, row_number() over (partition by seg, dz, dy, dx order by
  abs(z - (dz * 2 + least(dz * 2 + 2, (select max(z) + 1 from voxel))) // 2) + abs(y - (dy * 4 + least(dy * 4 + 4, 30)) // 2) + abs(x - (dx * 4 + least(dx * 4 + 4, 50)) // 2), iv) k from (select *, {_CELL} from voxel where seg <> 0)) where k = 1)"""
query("upsample_representative", f"select * from {_UP}")(lambda s, d: voxel.upsample_representative(fx.labels(s, d), fx.geometry(s, d), OUT))


@query("upsample_skeleton", f"select u.label, up_iv from {_UP} u join (select distinct label, {_CELL} from skel) using (label, dz, dy, dx)")
def _(s, d):
    g = fx.geometry(s, d)
    cells = voxel.downsample_topological(fx.skeleton_points(s, d), g, OUT)
    return skeleton.upsample_skeleton(cells, voxel.upsample_representative(fx.labels(s, d), g, OUT))


query("skeleton_endpoints", "select * from ends")(lambda s, d: skeleton.skeleton_endpoints(fx.skeleton_points(s, d)))
query("skeleton_pairs", "select label, iv, n_iv from snb where n_iv > iv")(lambda s, d: skeleton.skeleton_pairs(fx.skeleton_points(s, d)))
query("endpoint_vectors", "select label, iv, z, y, x, round(vz, 6) vz, round(vy, 6) vy, round(vx, 6) vx from evec")(
    lambda s, d: fx.endpoints(s, d).select("label", "iv", "z", "y", "x", *[F.round(f"v{a}", 6).alias(f"v{a}") for a in "zyx"]))


@query("endpoint_vector_dot", "select a.label, a.iv, b.iv n_iv, round(a.vz * b.vz + a.vy * b.vy + a.vx * b.vx, 6) dot from evec a join evec b on a.label = b.label and a.iv < b.iv")
def _(s, d):
    e = fx.endpoints(s, d)
    o = e.select("label", F.col("iv").alias("n_iv"), *[F.col(f"v{a}").alias(f"n_v{a}") for a in "zyx"])
    dot = sum((F.col(f"v{a}") * F.col(f"n_v{a}") for a in "zyx"), F.lit(0.0))
    return e.join(o, "label").where("iv < n_iv").select("label", "iv", "n_iv", F.round(dot, 6).alias("dot"))


query("points_within", """select a.id, b.id n_id from (select vec_id id, floor(embedding[1]::double * 1000) z, floor(embedding[2]::double * 1000) y, floor(embedding[3]::double * 1000) x from embeddings) a
  join (select vec_id id, floor(embedding[1]::double * 1000) z, floor(embedding[2]::double * 1000) y, floor(embedding[3]::double * 1000) x from embeddings) b
  on a.id < b.id and b.z between a.z - 100 and a.z + 100 and (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 10000""")(lambda s, d: spatial.points_within(fx.points(s, d), 100))
_MATCH = f"""(select distinct a.label label_one, b.label label_two from evec a join evec b on a.label < b.label where 900 * (a.z - b.z) ** 2 + 225 * ((a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= {fx.REACH ** 2} and a.vz * b.vz + a.vy * b.vy + a.vx * b.vx <= -1 / sqrt(2))"""


def matched(s, d):
    return spatial.endpoint_pair_match(fx.endpoints(s, d), fx.geometry(s, d), fx.REACH)


query("endpoint_pair_match", f"select * from {_MATCH}")(matched)


@query("medial_axis_baseline", f"""select tp, fp, fn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from (select tp, fp, (select count(*) from truth where truth = 'positive') - tp fn from (
  select count(*) filter (a.gold >= 1 and b.gold >= 1 and a.gold = b.gold) tp, count(*) filter (a.gold >= 1 and b.gold >= 1 and a.gold <> b.gold) fp from {_MATCH} join s2g a on a.label = label_one join s2g b on b.label = label_two))""")
def _(s, d):
    m = mapping(s, d)
    rows = fx.table(s, d, "orders").count()  # both kinds of pairs grow with the volume
    n = truth.baseline_graph(truth.classify_pairs(pairs(s, d), m, rows=rows))
    return spatial.medial_axis_baseline(truth.classify_pairs(matched(s, d), m, rows=rows), n)


query("endpoint_cone", "select * from cone")(lambda s, d: spatial.endpoint_cone(fx.endpoints(s, d), fx.labels(s, d), fx.geometry(s, d), fx.REACH))


def traversal(s, d):
    return spatial.endpoint_traversal(fx.endpoints(s, d), fx.labels(s, d), fx.geometry(s, d), fx.REACH)


query("endpoint_traversal", "select * from trav")(traversal)
query("skeleton_label_semi", "select * from skel where label in (select label from vol where not is_small)")(
    lambda s, d: fx.skeleton_points(s, d).join(small(s, d).where("not is_small").select("label"), "label", "left_semi"))

# Features and candidates

#: The whole volume: three cells for four planes, so that planes 0 and 1, which hold labels 1 and 2, are both taken.
_SCALED_ALL = """(select iz, iy, ix, case seg when 1 then 1 when 2 then 2 else 0 end val from (select iz, cast(floor(nz::double / nc::double * iz) as bigint) az from (select nz, nc, unnest(range(nc)) iz from (select max(z) + 1 nz, (3 * (max(z) + 1) + 3) // 4 nc from voxel)))
  cross join (select a.range iy, b.range ix from range(10) a, range(20) b) join voxel on z = az and y = iy * 3 and x = cast(floor(2.5 * ix) as bigint))"""


def scaled(s, d):
    nz = fx.geometry(s, d).nz
    return features.scale_feature(fx.labels(s, d), (nz, fx.NY, fx.NX), ((3 * nz + 3) // 4, 10, 20), 1, 2)


query("scale_feature", f"select iz, iy, ix, val from {_SCALED_ALL}")(scaled)
query("example_channels", f"select iz, iy, ix, case when val > 0 then 0.5 else -0.5 end::double c0, case when val = 1 then 0.5 else -0.5 end::double c1, case when val = 2 then 0.5 else -0.5 end::double c2 from {_SCALED_ALL}")(
    lambda s, d: features.example_channels(scaled(s, d)))
_CUBE = """(select {0}, string_agg(case seg when c.label_one then '1' when c.label_two then '2' else '0' end, '' order by k) cube from {1} c,
  (select a.range * 25 + b.range * 5 + e.range k, cast(floor(5.0 / 3.0 * a.range) as bigint) - 2 oz, cast(floor(9.0 / 5.0 * b.range) as bigint) - 4 oy, cast(floor(9.0 / 5.0 * e.range) as bigint) - 4 ox from range(3) a, range(5) b, range(5) e)
  left join voxel v on v.z = c.z + oz and v.y = c.y + oy and v.x = c.x + ox group by {0})"""


def with_cubes(df, s, d):
    out = features.feature_cubes(df, fx.labels(s, d), fx.geometry(s, d), WIDTH, RADIUS)
    return out.withColumn("cube", F.array_join(F.transform("cube", lambda v: v.cast("string")), ""))


query("feature_cubes", "select * from " + _CUBE.format("c.label_one, c.label_two, c.z, c.y, c.x", "cand"))(lambda s, d: with_cubes(candidates(s, d).select("label_one", "label_two", "z", "y", "x"), s, d))
_RANK = "cast((case truth when 'positive' then 0 when 'negative' then 1 else 2 end) + case when forward then 3 else 0 end as integer)"
_TRUTH = "case when a.gold < 1 or b.gold < 1 then 'unknown' when a.gold = b.gold then 'positive' else 'negative' end"
_EXAMPLES = f"""(select *, row_number() over (partition by source_rank order by label_one, label_two, z, y, x) - 1 ordinal from (select *, {_RANK} source_rank from (
  select label_one, label_two, z, y, x, x >= 40 forward, {_TRUTH} truth from {{0}} join s2g a on a.label = label_one join s2g b on b.label = label_two)))"""
_COLS = ["label_one", "label_two", "z", "y", "x", "forward", "truth", "source_rank", "ordinal"]
query("examples_union", f"select label_one, label_two, z, y, x, forward, truth, source_rank, ordinal from {_EXAMPLES.format('cand')}")(lambda s, d: features.examples_union(candidates(s, d)).select(*_COLS))
_NODES = "(select cand.* from cand join vol p on p.label = label_one join vol q on q.label = label_two where p.is_small <> q.is_small) nodes"


def node_candidates(s, d):
    own = small(s, d).select("label", "is_small")
    one = own.select(F.col("label").alias("label_one"), F.col("is_small").alias("_s1"))
    two = own.select(F.col("label").alias("label_two"), F.col("is_small").alias("_s2"))
    return candidates(s, d).join(one, "label_one").join(two, "label_two").where("_s1 <> _s2").drop("_s1", "_s2")


_ALL = ", ".join(f"c.{c}" for c in _COLS)
query("generate_nodes", f"select * from {_CUBE.format(_ALL, _EXAMPLES.format(_NODES))}")(lambda s, d: with_cubes(features.examples_union(node_candidates(s, d)).select(*_COLS), s, d))
_EDGES = """(select label label_one, neighbour label_two, z, y, x from (select label, neighbour, z, y, x, row_number() over (partition by label, neighbour order by iv) k from trav) where k = 1) edges"""


@query("generate_edges", f"select * from {_CUBE.format(_ALL, _EXAMPLES.format(_EDGES))}")
def _(s, d):
    # The first endpoint of a label stands for those that see the same neighbour.
    t = traversal(s, d).groupBy("label", "neighbour").agg(F.min(F.struct("iv", "z", "y", "x")).alias("e"))
    own = t.select(F.col("label").alias("label_one"), F.col("neighbour").alias("label_two"), "e.z", "e.y", "e.x")
    judged = truth.classify_pairs(truth.crop_forward(own, fx.geometry(s, d)), mapping(s, d))
    return with_cubes(features.examples_union(judged).select(*_COLS), s, d)


_MERGE = """(select v.label, coalesce(m.best, v.label) mapped from vol v left join (select * from (select l.label, o.label best, p, row_number() over (partition by l.label order by p desc, o.label) k from
  (select v1 s, v2 o, p from scored union all select v2, v1, p from scored) e join (select label from vol where is_small) l on l.label = e.s join (select label from vol where not is_small) o on o.label = e.o) where k = 1 and p >= 0.5) m on m.label = v.label)"""


def merged_nodes(s, d):
    return features.merge_nodes(fx.scored(s, d), small(s, d), "v1", "v2")


query("node_merge_mapping", f"select * from {_MERGE}")(merged_nodes)


@query("end2end_mapping", f"""select m.label, coalesce(r.mapped, 0) mapped from {_MERGE} m left join (select mapped l, dense_rank() over (order by mapped) mapped from (select distinct mapped from {_MERGE} where mapped <> 0)) r on r.l = m.mapped""")
def _(s, d):
    merged = merged_nodes(s, d)
    return features.compose(merged, voxel.reduce_labels(merged, "mapped"))


# Graphs

def closure(keep: str, edges: str = "scored") -> str:
    """SQL of (label, mapped): what the vertices of `edges` reach over edges with `keep`."""
    return f"""(with recursive e as (select v1 a, v2 b from {edges} where {keep} union all select v2, v1 from {edges} where {keep}),
r as (select distinct a v, a u from (select v1 a from {edges} union select v2 from {edges}) union select r.v, e.b from r join e on r.u = e.a) select v label, min(u) mapped from r group by v)"""


query("connected_components", "select label v, mapped root from roots95 where label in (select a from roots95e)")(
    lambda s, d: graph.connected_components(fx.scored(s, d).where("p >= 0.95").select(F.col("v1").alias("a"), F.col("v2").alias("b"))))
query("graph_baseline", "select * from roots95")(lambda s, d: graph.graph_baseline(fx.scored(s, d)))
query("agglomerate", f"select * from {closure('p > 0.5')}")(lambda s, d: graph.agglomerate(fx.scored(s, d)))
query("merge_ground_truth", f"select * from {closure('(select gold from s2g where label = v1) = (select gold from s2g where label = v2) and (select gold from s2g where label = v1) <> 0')}")(
    lambda s, d: graph.merge_ground_truth(fx.scored(s, d), mapping(s, d)))
query("collapse_graph", "select iv, coalesce(mapped, seg) label from voxel left join roots95 on label = seg")(
    lambda s, d: graph.collapse_graph(fx.labels(s, d), graph.graph_baseline(fx.scored(s, d))).select("iv", "label"))
query("collapse_vi", _VI.format("seg", "(select coalesce(mapped, seg) seg, gold, count(*)::double n from voxel left join roots95 on label = seg where gold <> 0 group by 1, 2)"))(
    lambda s, d: metrics.variation_of_information(metrics.contingency(graph.collapse_graph(fx.labels(s, d), graph.graph_baseline(fx.scored(s, d))))))
_PARTS = """(with recursive e as (select a.iv a, b.iv b from voxel a, off26 join voxel b on b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx and b.seg_split = a.seg_split where a.seg_split > 0),
r as (select iv v, iv u from voxel where seg_split > 0 union select r.v, e.b from r join e on r.u = e.a) select v.seg_split label, r.v iv, min(u) component from r join voxel v on v.iv = r.v group by all)"""
query("components_per_label", f"select label, count(distinct component) n_components from {_PARTS} group by label")(lambda s, d: graph.components_per_label(fx.labels(s, d, "seg_split")))
query("force_connectivity", """select v.iv, coalesce(p.new, v.seg_split) label from voxel v left join named p on p.iv = v.iv""", f"""parts as materialized {_PARTS},
ranked as materialized (select label, component, row_number() over (partition by label order by component) k from (select label, component from parts group by all)),
added as materialized (select label, component, k, (select max(seg_split) from voxel) + cast(sum(case when k > 1 then 1 else 0 end) over (order by label, component) as bigint) n from ranked),
named as (select parts.iv, case when k = 1 then parts.label else n end as new from parts join added on added.component = parts.component)""")(lambda s, d: graph.force_connectivity(fx.labels(s, d, "seg_split")).select("iv", "label"))


def lifted_rows(df):
    """Millionths, halves upwards: products of thousandths often end on a half, where the last bit of a product would decide."""
    return df.select("v1", "v2", (F.floor(F.col("p") * 1e6 + 0.5001) / 1e6).alias("p"))


#: Best products of all pairs: paths of one edge, then of twice as many each time; 1024 edges are more than any path here has.
_PATHS = ",\n".join(["""path0 as materialized (select v1 a, v2 b, p from scored union all select v2, v1, p from scored union all select v, v, 1.0::double from (select v1 v from scored union select v2 from scored))""",
                     *(f"path{k + 1} as materialized (select x.a, y.b, max(x.p * y.p) p from path{k} x join path{k} y on y.a = x.b group by all)" for k in range(10))])
query("lifted_edges", "select a v1, b v2, floor(p * 1e6 + 0.5001) / 1e6 p from path10 where a < b", _PATHS)(lambda s, d: lifted_rows(graph.lifted_edges(fx.scored(s, d))))
#: Forty steps: no path inside of a label of this volume is longer.
_GEODESIC = """ge as (select a.iv, b.iv n_iv, sqrt(dz * dz + dy * dy + dx * dx) len from voxel a, off26 join voxel b on b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx and b.seg = a.seg where a.seg <> 0),
geo(i, iv, d) as (select 0, min(iv), 0.0::double from voxel where seg <> 0 group by seg union all
  select i + 1, iv, min(d) from (select i, iv, d from geo where i < 40 union all select geo.i, ge.n_iv, geo.d + len from geo join ge on ge.iv = geo.iv where geo.i < 40) group by i, iv)"""
query("voxel_geodesic", "select seg label, v.iv, round(d, 6) distance from voxel v left join geo on geo.iv = v.iv and i = 40 where seg <> 0", _GEODESIC)(
    lambda s, d: graph.voxel_geodesic(fx.labels(s, d)).withColumn("distance", F.round("distance", 6)))

# Partition

query("multicut_weights", "select v1, v2, round(ln(p / (1 - p)) + ln((1 - 0.95) / 0.95), 6) weight from scored")(lambda s, d: partition.multicut_weights(fx.scored(s, d)).withColumn("weight", F.round("weight", 6)))
query("lifted_weights", """select a v1, b v2, s.v1 is not null original, round(case when s.v1 is not null then nv * (nv - 1) / 2 else ne end * (ln(q / (1 - q)) + ln((1 - 0.95) / 0.95)), 4) weight
  from (select a, b, least(greatest(p, 1e-12), 1 - 1e-12) q from path10 where a < b) left join scored s on s.v1 = a and s.v2 = b, (select max(v2) + 1.0::double nv, count(*)::double ne from scored)""", _PATHS)(
    lambda s, d: partition.lifted_weights(fx.scored(s, d)).withColumn("weight", F.round("weight", 4)))
query("multicut")(lambda s, d: partition.multicut(fx.scored(s, d)))
#: Contraction in rounds: rows of k = 0 are the edges of round i, those of k = 1 the part of each vertex.
_ROUNDS = """mcw as materialized (select v1 a, v2 b, cast(round((ln(p / (1 - p)) + ln((1 - 0.95) / 0.95)) * 1e6) as bigint) w from scored),
mc(i, k, a, b, w) as ((select 0, 0, a, b, w from mcw union all select 0, 1, v, v, 0 from (select a v from mcw union select b from mcw)) union all
  (with e as (select * from mc where k = 0), ends as (select a v, b o, w from e union all select b, a, w from e),
  chosen as (select v, o t, w from (select *, row_number() over (partition by v order by w desc, o) n from ends where w > 0) where n = 1),
  pair as (select x.v, least(x.v, x.t) star from chosen x join chosen y on y.v = x.t and y.t = x.v),
  mem as (select v, star, 1 fixed, 0 w from pair union all select c.v, p.star, 0, c.w from chosen c join pair p on p.v = c.t where c.v not in (select v from pair)),
  waits as (select case when (x.fixed, x.w, -x.v) < (y.fixed, y.w, -y.v) then x.v else y.v end v from e join mem x on x.v = e.a join mem y on y.v = e.b where x.star = y.star and e.w < 0),
  step as (select v, star from mem where v not in (select v from waits)),
  moved as (select e.i, coalesce(x.star, a) a, coalesce(y.star, b) b, e.w from e left join step x on x.v = a left join step y on y.v = b)
  select i + 1, 0, least(a, b), greatest(a, b), cast(sum(w) as bigint) from moved where a <> b and exists (from step) group by all
  union all select i + 1, 1, a, coalesce(star, b), 0 from mc left join step on step.v = mc.b where mc.k = 1 and exists (from step))),
mcr as (select a v, b root from mc where k = 1 and i = (select max(i) from mc))"""
query("multicut_rounds", "select v1, v2, x.root <> y.root cut from scored join mcr x on x.v = v1 join mcr y on y.v = v2", _ROUNDS)(lambda s, d: contraction.multicut_in_rounds(fx.scored(s, d)))
query("lifted_multicut_rounds")(lambda s, d: contraction.lifted_multicut_in_rounds(fx.scored(s, d)))
query("lifted_multicut")(lambda s, d: partition.lifted_multicut(fx.scored(s, d)))
query("thinning")(lambda s, d: skeleton.thinning(fx.labels(s, d)))
query("teaser")(lambda s, d: skeleton.teaser(fx.labels(s, d)))


@query("endpoint_matching")
def _(s, d):
    own = skeleton.skeleton_endpoints(fx.skeleton_points(s, d))
    thin = skeleton.thinning(fx.labels(s, d)).where("is_endpoint").join(fx.labels(s, d).select("iv", "z", "y", "x"), "iv")
    return skeleton.endpoint_matching(own, thin.select("label", "iv", "z", "y", "x"), fx.geometry(s, d))


query("balanced_batches", f"""select label_one, label_two, z, y, x, forward, truth, 2 * k + case when truth = 'negative' then 1 else 0 end as position from (select *, min(n) over () least, count(distinct truth) over () kinds from (
  select *, row_number() over (partition by truth order by md5('7:' || label_one || ':' || label_two || ':' || z || ':' || y || ':' || x)) - 1 k, count(*) over (partition by truth) n from (
  select label_one, label_two, z, y, x, x >= 40 forward, {_TRUTH} truth from cand join s2g a on a.label = label_one join s2g b on b.label = label_two) where truth <> 'unknown')) where kinds = 2 and k < least""")(
    lambda s, d: features.balanced_batches(candidates(s, d)).select("label_one", "label_two", "z", "y", "x", "forward", "truth", "position"))
query("medial_axis")(lambda s, d: skeleton.medial_axis(fx.labels(s, d)))


def proposed(s, d):
    thin = skeleton.thinning(fx.labels(s, d)).where("is_endpoint").join(fx.labels(s, d).select("iv", "z", "y", "x"), "iv")
    return thin.select("label", "iv", "z", "y", "x")


@query("nearby_matching")
def _(s, d):
    own = skeleton.skeleton_endpoints(fx.skeleton_points(s, d))
    return spatial.nearby_matching(own, proposed(s, d), fx.geometry(s, d))


@query("endpoint_scores")
def _(s, d):
    own = skeleton.skeleton_endpoints(fx.skeleton_points(s, d))
    return skeleton.endpoint_scores(skeleton.endpoint_matching(own, proposed(s, d), fx.geometry(s, d)), own, proposed(s, d))


#: States (pair, voxel, cost) of a search; costs are whole and bounded, so that there are few.
_SEARCH = f"""ups as materialized (select v.seg label, v.iv, v.z, v.y, v.x from (select u.label, up_iv from {_UP} u join (select distinct label, {_CELL} from skel) using (label, dz, dy, dx)) p join voxel v on v.iv = p.up_iv),
close as materialized (select a.label, a.iv a, b.iv b, a.z, a.y, a.x, b.z bz, b.y by_, b.x bx, 1.5 * ((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) most
  from ups a join ups b on b.label = a.label and b.iv > a.iv and abs(a.z - b.z) <= 3 and abs(a.y - b.y) <= 3 and abs(a.x - b.x) <= 3),
seen as (select a, b, label, z, y, x, bz, by_, bx, most, 0::bigint g from close union
  select a, b, s.label, v.z, v.y, v.x, bz, by_, bx, most, g + dz * dz + dy * dy + dx * dx from seen s, off26 join voxel v on v.seg = s.label and v.z = s.z + dz and v.y = s.y + dy and v.x = s.x + dx
  where g + dz * dz + dy * dy + dx * dx + (v.z - bz) ** 2 + (v.y - by_) ** 2 + (v.x - bx) ** 2 <= most),
met as (select distinct a, b from seen where z = bz and y = by_ and x = bx)"""


@query("upsample_endpoints", "select label, iv, (select count(*) from met where a = iv or b = iv) < 2 is_endpoint from ups", _SEARCH)
def _(s, d):
    g = fx.geometry(s, d)
    cells = voxel.downsample_topological(fx.skeleton_points(s, d), g, OUT)
    return skeleton.upsample_endpoints(skeleton.upsample_skeleton(cells, voxel.upsample_representative(fx.labels(s, d), g, OUT)), fx.labels(s, d))


@query("endpoint_sweep")
def _(s, d):
    """Two resolutions and two methods' parameters of the benchmark's grid, over all labels."""
    own = skeleton.skeleton_endpoints(fx.skeleton_points(s, d))
    return sweep.endpoint_sweep(fx.labels(s, d), own, fx.geometry(s, d), (60, 120), (0, 15), (13,), (2,))


def cubes(s, d):
    own = candidates(s, d).select("label_one", "label_two", "z", "y", "x")
    return features.feature_cubes(own, fx.labels(s, d), fx.geometry(s, d), WIDTH, RADIUS)


query("augmented_cubes")(lambda s, d: features.augment(cubes(s, d).withColumn("id", F.xxhash64("label_one", "label_two")), WIDTH))
query("network_scores")(lambda s, d: scoring.score_examples(cubes(s, d), scoring.edge_network(3, WIDTH, (4, 8), hidden=16)).drop("cube"))


# Scoring

@query("edge_forward", f"""select *, {_RATES} from (select {_COUNTS.format("(truth = 'positive')", 'p > 0.5')} from truth join scored on v1 = label_one and v2 = label_two where truth <> 'unknown')""")
def _(s, d):
    return scoring.edge_forward(truth.classify_pairs(fx.scored(s, d), mapping(s, d), "v1", "v2"))


query("surface_vertices", """select seg label, cast(2 * z + dz as int) z, cast(2 * y + dy as int) y, cast(2 * x + dx as int) x from (select v.seg, v.z, v.y, v.x, dz, dy, dx, w.seg n from
  voxel v cross join (select s * a.range dz, s * b.range dy, s * c.range dx from range(2) a, range(2) b, range(2) c, (select unnest([-1, 1]) s) where a.range + b.range + c.range > 0)
  left join voxel w on w.z = v.z + dz and w.y = v.y + dy and w.x = v.x + dx where v.seg <> 0) where n is distinct from seg""")(lambda s, d: surface.mesh_vertices(fx.labels(s, d)))
query("surface_triangles")(lambda s, d: surface.marching(fx.labels(s, d)))
_TETRAHEDRA = ", ".join(str(sum(1 << (4 * z + 2 * y + x) for z, y, x in t)) for t in surface.tetrahedra())
query("surface_counts", f"""select label, cast(sum(case bit_count(m & t) when 1 then 1 when 2 then 2 when 3 then 1 else 0 end) as bigint) n from (
  select seg label, z - dz z, y - dy y, x - dx x, bit_or(1 << (4 * dz + 2 * dy + dx)) m from voxel, (select a.range::int dz, b.range::int dy, c.range::int dx from range(2) a, range(2) b, range(2) c) where seg <> 0 group by all), (select unnest([{_TETRAHEDRA}]) t) group by label""")(
    lambda s, d: surface.mesh_sizes(fx.labels(s, d)))
