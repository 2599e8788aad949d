"""Registered queries of study endpoints, export checks and coverage-matched contrasts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.enclosures import angle_interval
from ..operators import coverage as C
from ..operators import endpoints as E
from ..operators import readouts as G
from ..operators import risk as R
from ..operators import thresholds as T
from ..sources import exports as X
from .catalog import _ANGLE, _COORDS, _RES, COV, HCP, OBJECTS, PAIRS, RISK, SCORES, gwd_scores, naive_rows, query, risk_rows
from .fixtures import detections, objects, pairs

_SRC = 'src as (select distinct scene_id as scene, role, cast(substr(scene_id, 2) as bigint) % 3 as mult from objects)'
_CNT = 'cnt as (select "class", scene_id as scene, count(*) filter (has_gt) as n_gt, count(*) filter (has_det) as n_det, count(*) filter (has_gt and has_det) as n_tp from objects group by all)'


def _mult():
    """A scene's multiplicity. Columns need a session, so none is built on import."""
    return F.expr("cast(substr(scene, 2) as bigint) % 3")


def _sources(spark, sf_dir):
    return objects(spark, sf_dir).select(F.col("scene_id").alias("scene"), "role").distinct().withColumn("mult", _mult())


def _counts(spark, sf_dir):
    o = objects(spark, sf_dir).withColumnRenamed("scene_id", "scene")
    return E.source_counts(o, o.where("has_gt and has_det"), ["class"])


def _rounded(df, skip=(), digits=6):
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in skip else F.col(f.name) for f in df.schema.fields])


@query(f"""with {OBJECTS}, {_SRC}, own as (select "class", scene_id as scene, count(*) as m from objects where has_gt group by all)
    select "class", role, count(*)::bigint as sources, sum(mult)::bigint as copies, sum(mult * m)::bigint as weighted_objects from own join src on own.scene = src.scene where mult > 0 group by all""")
def role_support(spark, sf_dir):
    o = objects(spark, sf_dir).where("has_gt").withColumnRenamed("scene_id", "scene")
    return E.role_support(o.select("class", "scene"), _sources(spark, sf_dir), ["class"])


@query(f"""with {OBJECTS}, {_CNT} select "class", count(*)::bigint as sources, count(*) filter (n_tp > 0)::bigint as tp_sources, count(*) filter (n_gt > 0)::bigint as gt_sources, sum(n_tp)::bigint as tp, sum(n_gt)::bigint as gt, sum(n_det - n_tp)::bigint as fp from cnt group by "class" """)
def class_support(spark, sf_dir):
    return E.class_support(_counts(spark, sf_dir), ["class"])


@query(f"""with {OBJECTS}, {_SRC}, {_CNT}, every as (select role, sum(mult) as source_copies, count(*) as sources from src where mult > 0 group by role),
    own as (select role, "class", sum(mult) filter (n_gt > 0) as a, sum(mult) filter (n_tp > 0) as b, sum(mult * n_gt) as c, sum(mult * n_tp) as d, sum(mult * n_det) as e from cnt join src on cnt.scene = src.scene where mult > 0 group by all)
    select every.role, k as "class", source_copies::bigint as source_copies, sources::bigint as sources, coalesce(a, 0)::bigint as gt_source_copies, coalesce(b, 0)::bigint as tp_source_copies, coalesce(c, 0)::bigint as gt_objects, coalesce(d, 0)::bigint as tp_objects, coalesce(e, 0)::bigint as det_objects
    from every cross join (values ('A'), ('N'), ('R'), ('X')) t(k) left join own on own.role = every.role and own."class" = k""")
def support_cube(spark, sf_dir):
    roster = spark.createDataFrame([("A",), ("N",), ("R",), ("X",)], "class string")
    return E.support_cube(_counts(spark, sf_dir), _sources(spark, sf_dir), roster)


_PR = 'pr as (select scene_id as scene, "class", role, round(sqrt(((px - gx) * (px - gx) + (py - gy) * (py - gy)) + (greatest(0.0, p11 + p22 + g11 + g22 - 2 * sqrt(greatest(0.0, p11 * g11 + 2 * p12 * g12 + p22 * g22 + 2 * sqrt(greatest(0.0, (p11 * p22 - p12 * p12) * (g11 * g22 - g12 * g12)))))))), 6) as score, * exclude (scene_id, "class", role, score) from cov)'
_TH = f"{SCORES}, {HCP}, {_SRC}, {_CNT}"


@query(f"""with {_TH}, ev as (select scene, mult from src where role = 'eval' and mult > 0), hits as (select s.scene, sum((s.score <= h.q)::int) as hits from scores s join hcp h on s."class" = h."class" group by s.scene),
    per as (select scene, sum(n_gt) as gt, sum(n_det) as det, sum(n_tp) as tp from cnt group by scene),
    r as (select mult as m, coalesce(gt, 0) as gt, coalesce(det, 0) as det, coalesce(tp, 0) as tp, coalesce(hits, 0) as hit from ev left join per on ev.scene = per.scene left join hits on ev.scene = hits.scene)
    select sum(m)::bigint as sources, sum(m) filter (gt > 0)::bigint as gt_sources, sum(m) filter (tp > 0)::bigint as tp_sources, coalesce(sum(m) filter (tp = 0), 0)::bigint as no_tp_sources, coalesce(sum(m) filter (gt > 0 and tp = 0), 0)::bigint as gt_no_tp_sources,
      sum(m * gt)::bigint as gt_count, sum(m * tp)::bigint as tp_count, sum(m * (det - tp))::bigint as fp_count, sum(m * (gt - tp))::bigint as fn_count, sum(m * det)::bigint as det_count,
      round(sum(m * tp / gt) filter (gt > 0) / sum(m) filter (gt > 0), 6) as recall_scene, round(sum(m * tp) / sum(m * gt), 6) as recall_object, round(sum(m * hit / gt) filter (gt > 0) / sum(m) filter (gt > 0), 6) as end_to_end_scene,
      round(sum(m * hit) / sum(m * gt), 6) as end_to_end_object, round(sum(m * hit / tp) filter (tp > 0) / sum(m) filter (tp > 0), 6) as coverage_scene, round(sum(m * hit) / sum(m * tp), 6) as coverage_object from r""")
def all_source_metrics(spark, sf_dir):
    s = gwd_scores(spark, sf_dir)
    q = T.class_thresholds(s.where("role = 'cal'"), 0.1, "hcp").withColumnRenamed("q_hat", "q")
    hits = C.covered(s, q, ["class"]).groupBy("scene").agg(F.count_if("covered").alias("hits"))
    return _rounded(E.all_source_metrics(_counts(spark, sf_dir), hits, _sources(spark, sf_dir).where("role = 'eval'")))


_HALF = "case when q >= (plw - plh) / (2 * sqrt(2)) then pi() / 2 else acos(least(1.0, greatest(-1.0, sqrt(greatest(0.0, pow((plw * plw + plh * plh) / 8 - q * q, 2) - plw * plw * plh * plh / 16)) / ((plw * plw - plh * plh) / 8)))) / 2 end"
_WMEAN = lambda k: f"round(sum(m * {k}) filter ({k} is not null) / sum(m) filter ({k} is not null), 6)"


@query(f"""with {_TH}, {_PR}, ev as (select scene, mult as m from src where role = 'eval' and mult > 0),
    g as (select p.*, q, {_HALF} as half, q >= (plw - plh) / (2 * sqrt(2)) as open_, sqrt((gx - px) * (gx - px) + (gy - py) * (gy - py)) <= q as inside, {_ANGLE} as dist from pr p join hcp h on p."class" = h."class"),
    tpm as (select "class", scene, sum((score <= q)::int) as hits, avg(q / sqrt(plw * plh)) as nr, avg((not open_)::int) as inf, avg(open_::int) as whole, avg(half) as half, avg((inside and (open_ or (glw <> glh and dist <= half)))::int) as joint from g group by all),
    dm as (select o."class", scene_id as scene, avg(q / sqrt(plw * plh)) as dnr, avg((q < (plw - plh) / (2 * sqrt(2)))::int) as dinf from objects o join hcp h on o."class" = h."class" where has_det group by all),
    r as (select c."class", m, n_gt as gt, n_det as det, n_tp as tp, coalesce(hits, 0) as hit, nr, inf, whole, half, joint, dnr, dinf from cnt c join ev on c.scene = ev.scene left join tpm on tpm."class" = c."class" and tpm.scene = c.scene left join dm on dm."class" = c."class" and dm.scene = c.scene),
    cs as (select "class", count(distinct scene) as cal_s, count(*) as cal_o from scores where role = 'cal' group by "class"), al as (select sum(m) as alln from ev)
    select r."class", round(sum(m * hit / tp) filter (tp > 0) / sum(m) filter (tp > 0), 6) as coverage_scene, round(sum(m * hit) / sum(m * tp), 6) as coverage_object, round(sum(m) filter (tp > 0 and hit = tp) / sum(m) filter (tp > 0), 6) as coverage_simultaneous,
      round(any_value(h.q), 6) as q, 1.0::double as finite_q, {_WMEAN('nr')} as normalized_center_radius, {_WMEAN('inf')} as informative_angle_rate, {_WMEAN('whole')} as full_angle_rate, {_WMEAN('half')} as angle_halfwidth_lower, {_WMEAN('half')} as angle_halfwidth_upper,
      {_WMEAN('joint')} as joint_center_angle_lower, {_WMEAN('joint')} as joint_center_angle_upper, round(sum(m * tp / gt) filter (gt > 0) / sum(m) filter (gt > 0), 6) as recall_scene, round(sum(m * tp) / sum(m * gt), 6) as recall_object,
      round(sum(m * hit / gt) filter (gt > 0) / sum(m) filter (gt > 0), 6) as end_to_end_scene, round(sum(m * hit) / sum(m * gt), 6) as end_to_end_object, round(sum(m) filter (tp > 0) / any_value(alln), 6) as tp_source_rate, round(1 - sum(m) filter (tp > 0) / any_value(alln), 6) as no_tp_source_rate,
      round(coalesce(sum(m) filter (gt > 0 and tp = 0), 0) / any_value(alln), 6) as gt_no_tp_source_rate, sum(m * tp)::bigint as tp_count, sum(m * (det - tp))::bigint as fp_count, sum(m * (gt - tp))::bigint as fn_count, sum(m * gt)::bigint as gt_count, sum(m * det)::bigint as det_count,
      sum(m) filter (tp > 0)::bigint as tp_source_count, sum(m) filter (gt > 0)::bigint as gt_source_count, (any_value(alln) - sum(m) filter (tp > 0))::bigint as no_tp_source_count, any_value(cal_s)::bigint as cal_tp_sources, any_value(cal_o)::bigint as cal_tp_objects,
      0.0::double as no_calibration_support, 1.0::double as all_detection_finite_q_rate, {_WMEAN('dnr')} as all_detection_normalized_radius, {_WMEAN('dinf')} as all_detection_informative_rate
    from r join hcp h on r."class" = h."class" join cs on cs."class" = r."class" cross join al group by r."class" """)
def class_metrics(spark, sf_dir):
    s = gwd_scores(spark, sf_dir)
    q = T.class_thresholds(s.where("role = 'cal'"), 0.1, "hcp").select("class", F.col("q_hat").alias("q"))
    p = pairs(spark, sf_dir).select("class", F.col("scene_id").alias("scene"), "pred", "gt", F.round(B.gwd(F.col("pred"), F.col("gt")), 6).alias("score"))
    support = s.where("role = 'cal'").groupBy("class").agg(F.countDistinct("scene").alias("cal_tp_sources"), F.count("*").alias("cal_tp_objects"))
    d = detections(spark, sf_dir).withColumnRenamed("scene_id", "scene")
    return _rounded(E.class_metrics(p, d, _counts(spark, sf_dir), _sources(spark, sf_dir).where("role = 'eval'"), q, support))


def _enclosed(spark, sf_dir):
    q = T.class_thresholds(gwd_scores(spark, sf_dir).where("role = 'cal'"), 0.1, "hcp").select("class", F.col("q_hat").alias("q"))
    d = B.canonical(F.col("obb"))
    return detections(spark, sf_dir).join(F.broadcast(q), "class").withColumn("arc", angle_interval(d["w"], d["h"], F.col("q")))


@query(f"""with {SCORES}, {HCP}, d as (select o."class", {_HALF} as half, q >= (plw - plh) / (2 * sqrt(2)) as whole from objects o join hcp h on o."class" = h."class" where has_det)
    select "class", count(*)::bigint as n, round(avg(half), 6) as lower, round(avg(half), 6) as upper, count(*) filter (whole)::bigint as whole from d group by "class" """)
def angle_enclosures(spark, sf_dir):
    """Doubles that enclose every detection's half width, and exactly decided full sets."""
    a = F.col("arc")
    return _rounded(_enclosed(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.avg(a["lower"]).alias("lower"), F.avg(a["upper"]).alias("upper"), F.count_if(a["full"]).alias("whole")))


@query()
def angle_exact_rows(spark, sf_dir):
    """How many rows the cascade leaves to whole numbers, and how wide the enclosures are at most, in neighbouring doubles."""
    a = F.col("arc")
    return _enclosed(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.count_if(a["exact"]).alias("exact"), F.avg(a["exact"].cast("double")).alias("share"), F.max((a["upper"] - a["lower"]) / a["upper"]).alias("widest"))


_METRICS = ("finite", "bounded", "center_defined", "normalized_radius", "angle_defined", "informative", "full", "angle_length", "half_width", "joint", "near_square", "middle", "elongated", "seam", "off_seam")


@query(f"""with {SCORES}, {HCP}, {_PR}, g as (select p.*, q, {_HALF} as half, {_ANGLE} as dist, sqrt((gx - px) * (gx - px) + (gy - py) * (gy - py)) <= q as inside from pr p join hcp h on p."class" = h."class" where role = 'eval')
    select "class", count(*)::bigint as n, 1.0::double as finite, 1.0::double as bounded, 1.0::double as center_defined, round(avg(q / sqrt(plw * plh)), 6) as normalized_radius, 1.0::double as angle_defined, round(avg((2 * half < pi())::int), 6) as informative, round(avg((2 * half >= pi())::int), 6) as "full",
      round(avg(2 * half), 6) as angle_length, round(avg(half), 6) as half_width, round(avg((inside and case when glw = glh then half >= pi() / 2 else dist <= half end)::int), 6) as "joint", round(avg((plw / plh < 1.2)::int), 6) as near_square, round(avg((plw / plh >= 1.2 and plw / plh < 3)::int), 6) as middle,
      round(avg((plw / plh >= 3)::int), 6) as elongated, round(avg((pi() / 2 - abs(plt) <= pi() / 36)::int), 6) as seam, round(avg((pi() / 2 - abs(plt) > pi() / 36)::int), 6) as off_seam from g group by "class" """)
def geometry_endpoints(spark, sf_dir):
    s = gwd_scores(spark, sf_dir)
    q = T.class_thresholds(s.where("role = 'cal'"), 0.1, "hcp").select("class", F.col("q_hat").alias("q"))
    rows = pairs(spark, sf_dir).where("role = 'eval'").join(F.broadcast(q), "class").select("class", "pred", "gt", "q")
    e = G.geometry_endpoints(rows, "gwd", [F.col("q")])
    return e.groupBy("class").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in _METRICS])


# ---- coverage-matched contrasts ---------------------------------------------------------------------------------------------------

REPEATS = 4


def _splits(spark, sf_dir):
    """Hashed splits, which any engine repeats: 40 % calibration, 20 % matching, 40 % evaluation in each repeat."""
    scenes = objects(spark, sf_dir).select(F.col("scene_id").alias("scene")).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("split"), F.col("repeat").cast("string"), "scene"), 256), 1, 8), 16, 10).cast("bigint") % 10
    return scenes.select("repeat", "scene", F.when(u < 4, "calibration").when(u < 6, "matching").otherwise("eval").alias("role"))


def _matched_sql(by: str) -> str:
    b = f", {by}" if by else ""
    on = lambda x, y: f"{x}.repeat = {y}.repeat" + (f" and {x}.{by} = {y}.{by}" if by else "")
    k = "repeat" + b
    return f"""{SCORES}, {_RES}, sp as (select repeat, scene, case when u < 4 then 'calibration' when u < 6 then 'matching' else 'eval' end as part from
      (select repeat, scene, ('0x' || substr(sha256('split:' || repeat || ':' || scene), 1, 8))::bigint % 10 as u from (select distinct scene_id as scene from objects), (select unnest(range(0, {REPEATS})) as repeat))),
    own as (select sp.repeat, part, r.*, s.score, case when r.idx % 2 = 0 then 'even' else 'odd' end as regime from res r join scores s on r.idx = s.idx and r.image_id = s.image_id join sp on sp.scene = r.scene where part <> 'calibration'),
    cal as (select * from own where part = 'matching'), ev as (select *, row_number() over () as id from own where part = 'eval'),
    rk as (select {k}, score, row_number() over (partition by {k} order by score) as r, count(*) over (partition by {k}) as n from cal), ball as (select {k}, min(case when r >= (n + 1) - floor((n + 1) * 0.1) then score end) as q, min(n) as n from rk group by {k}),
    seen as (select {', '.join('e.' + c.strip() for c in k.split(','))}, any_value(q) as q, any_value(n) as n, count(*) as total, avg((e.score <= q)::int) as coverage from ev e join ball b on {on('e', 'b')} group by all),
    cl as (select {k}, coord, val from (select {k}, cx, cy, w, h, theta from cal) unpivot (val for coord in (cx, cy, w, h, theta))), cc as (select {k}, coord, val, count(*) as c from cl group by all),
    cu as (select {k}, coord, val, sum(c) over (partition by {k}, coord order by val) as upto from cc), el as (select {k}, id, coord, val from (select {k}, id, cx, cy, w, h, theta from ev) unpivot (val for coord in (cx, cy, w, h, theta))),
    need as (select {', '.join('el.' + c.strip() for c in k.split(','))}, id, max(coalesce(upto, 0)) + 1 as need from el asof left join cu on {on('el', 'cu')} and el.coord = cu.coord and el.val > cu.val group by all),
    steps as (select {k}, need, sum(count(*)) over (partition by {k} order by need) as cum from need group by {k}, need),
    best as (select {', '.join('s.' + c.strip() for c in k.split(','))}, any_value(s.q) as q, any_value(s.coverage) as coverage, any_value(n) as n, any_value(total) as total, coalesce(min(need) filter (cum / total >= coverage and need <= n), any_value(n) + 1) as k,
      coalesce(max(cum / total) filter (need <= least(n, (n + 1) - floor((n + 1) * (1 - 1e-6) / 5))), 0) as high from seen s join steps t on {on('s', 't')} group by all),
    lv as (select *, case when coverage >= 1 then 1e-6 when high >= coverage then 1 - 1e-6 else 5 * (n + 2 - k) / (n + 1) end as level, case when coverage >= 1 then n + 1 when high >= coverage then (n + 1) - floor((n + 1) * (1 - 1e-6) / 5) else k end as kk from best),
    cut as (select {', '.join('lv.' + c.strip() for c in k.split(','))}, coord, min(val) filter (upto >= (n + 1) - floor((n + 1) * 0.02)) as nom, min(val) filter (upto >= kk) as fit from cu join lv on {on('cu', 'lv')} group by all),
    wide as (select {k}, max(nom) filter (coord = 'cx') as ncx, max(nom) filter (coord = 'cy') as ncy, max(nom) filter (coord = 'w') as nw, max(nom) filter (coord = 'h') as nh, max(nom) filter (coord = 'theta') as nt, max(fit) filter (coord = 'cx') as fcx, max(fit) filter (coord = 'cy') as fcy from cut group by all),
    bc as (select {', '.join('e.' + c.strip() for c in k.split(','))}, avg((cx <= ncx and cy <= ncy and w <= nw and h <= nh and theta <= nt)::int) as box_coverage from ev e join wide w_ on {on('e', 'w_')} group by all),
    mc as (select {', '.join('lv.' + c.strip() for c in k.split(','))}, case when any_value(kk) > any_value(n) then 1.0 else coalesce(max(cum / total) filter (need <= kk), 0) end as matched from lv join steps t on {on('lv', 't')} group by all),
    cells as (select {', '.join('lv.' + c.strip() for c in k.split(','))}, q, coverage, pi() * q * q as area, box_coverage, 4 * ncx * ncy as box_area, pi() * q * q / (4 * ncx * ncy) as ratio, level, matched as matched_coverage, 4 * fcx * fcy as matched_area, pi() * q * q / (4 * fcx * fcy) as matched_ratio
      from lv join wide on {on('lv', 'wide')} join bc on {on('lv', 'bc')} join mc on {on('lv', 'mc')})"""


def _matched_rows(spark, sf_dir):
    s = gwd_scores(spark, sf_dir).select("idx", "image_id", "score")
    return naive_rows(spark, sf_dir).join(s, ["idx", "image_id"]).withColumn("regime", F.when(F.col("idx") % 2 == 0, "even").otherwise("odd"))


@query(f"with {PAIRS}, {_matched_sql('').removeprefix(PAIRS + ', ')} select repeat::int as repeat, round(q, 6) as q, round(coverage, 6) as coverage, round(area, 4) as area, round(box_coverage, 6) as box_coverage, round(box_area, 4) as box_area, round(ratio, 6) as ratio, round(level, 6) as level, round(matched_coverage, 6) as matched_coverage, round(matched_area, 4) as matched_area, round(matched_ratio, 6) as matched_ratio from cells")
def coverage_matched_splits(spark, sf_dir):
    c = E.coverage_matched(_matched_rows(spark, sf_dir), _splits(spark, sf_dir), "score", _COORDS)
    area = ("area", "box_area", "matched_area")
    return c.select("repeat", *[F.round(k, 4 if k in area else 6).alias(k) for k in c.columns if k != "repeat"])


@query(f"""with {PAIRS}, {_matched_sql('regime').removeprefix(PAIRS + ', ')} select regime, count(*)::bigint as splits, round(avg(ratio), 6) as ratio_mean, round(min(ratio), 6) as ratio_low, round(max(ratio), 6) as ratio_high, round(avg(matched_ratio), 6) as matched_mean, round(min(matched_ratio), 6) as matched_low,
    round(max(matched_ratio), 6) as matched_high, round(avg(level), 6) as level_mean, round(avg(matched_coverage), 6) as coverage_mean, round(avg(abs(matched_coverage - coverage)), 6) as gap_mean, count(*) filter (matched_ratio < 1)::bigint as splits_smaller from cells group by regime""")
def coverage_matched_regimes(spark, sf_dir):
    c = E.coverage_matched(_matched_rows(spark, sf_dir), _splits(spark, sf_dir), "score", _COORDS, by=["regime"])
    return _rounded(E.matched_summary(c, ["regime"]))


# ---- chosen levels, rank bounds, exact moments -------------------------------------------------------------------------------------


@query(f"""with {SCORES}, g as (select unnest([0.05, 0.1, 0.15, 0.2])::double as alpha), cal as (select "class", score, row_number() over (partition by "class" order by score) as r, count(*) over (partition by "class") as n from scores where role = 'cal'),
    q as (select "class", alpha, min(case when r >= (n + 1) - floor((n + 1) * alpha) then score end) as q from cal cross join g group by all), c as (select s."class", alpha, avg((score <= q)::int) as cov from scores s join q on s."class" = q."class" where role = 'eval' group by all),
    m as (select alpha, avg(cov) as macro from c group by alpha) select alpha, round(macro, 6) as macro from m order by abs(macro - 0.9), alpha limit 1""")
def chosen_level(spark, sf_dir):
    s = gwd_scores(spark, sf_dir)
    grid = T.threshold_grid(s.where("role = 'cal'"), [0.05, 0.1, 0.15, 0.2], ["class"])
    return T.choose_alpha(C.coverage_curve(s.where("role = 'eval'"), grid, ["class"])).withColumn("macro", F.round("macro", 6))


@query(f"""with {PAIRS}, {_RES}, l as (select "class", mult, coord, val from (select "class", cast(substr(scene, 2) as bigint) % 3 as mult, cx, cy, w, h, theta from res where role = 'design') unpivot (val for coord in (cx, cy, w, h, theta)) where mult > 0),
    c as (select "class", coord, val, sum(mult) as w from l group by all), u as (select *, sum(w) over (partition by "class", coord order by val) as upto, sum(w) over (partition by "class", coord) as n from c)
    select "class", coord, min(val) filter (upto > round(0.9 * n, 6)) as q from u group by all""")
def max_rank_bounds(spark, sf_dir):
    rows = naive_rows(spark, sf_dir).where("role = 'design'").withColumn("mult", _mult())
    q = rows.select("class").distinct().withColumn("q", F.lit(0.9))
    return T.max_rank_bounds(rows, q, _COORDS, ["class"], "mult")


@query(f"""with {RISK}, k as (select "class", scene_id as scene, sum((not has_det or score < 0.3)::int) as miss, count(*) as n, cast(substr(scene_id, 2) as bigint) % 3 as mult from objects where has_gt group by all)
    select "class", sum(mult)::bigint as n, round(sum(mult * (miss / n)) / sum(mult), 9) as mean, round(sum(mult * (miss / n) * (miss / n)) / sum(mult), 9) as square from k where mult > 0 group by "class" """)
def exact_moments(spark, sf_dir):
    o = objects(spark, sf_dir).where("has_gt").withColumnRenamed("scene_id", "scene")
    k = o.groupBy("class", "scene").agg(F.count_if(~F.col("has_det") | (F.col("score") < 0.3)).alias("miss"), F.count("*").alias("n")).withColumn("mult", _mult())
    m = R.exact_moments(k, ["class"])
    return m.select("class", "n", F.round("mean", 9).alias("mean"), F.round("square", 9).alias("square"))


# ---- exports ------------------------------------------------------------------------------------------------------------------------


@query("""with t as (select o_orderkey as tile, case when o_orderkey % 50 = 0 then 'same' else 'n' || o_orderkey end as name, o_orderkey as tile_index from orders where o_orderkey % 97 <> 0),
    l as (select l_orderkey as tile, l_linenumber, case when l_suppkey % 60 = 0 then -0.1 else l_discount end as w, l_tax as x, l_linenumber - 1 as label, l_quantity / 50 as p from lineitem)
    select * from (select 'tiles: name repeated' as problem, count(*)::bigint as n from (select name from t group by name having count(*) > 1)
    union all select 'gt: side not positive', count(*)::bigint from l where w <= 0 union all select 'gt: box outside', count(*)::bigint from l where w < 0 union all select 'gt: label outside', count(*)::bigint from l where label >= 5
    union all select 'pred: side not positive', count(*)::bigint from l where w <= 0 union all select 'pred: box outside', count(*)::bigint from l where w < 0 union all select 'pred: score below floor', count(*)::bigint from l where greatest(p, 0.01) < 0.05
    union all select 'gt: unknown tile', count(*)::bigint from l where tile not in (select tile from t) union all select 'pred: unknown tile', count(*)::bigint from l where tile not in (select tile from t)) where n > 0""")
def export_problems(spark, sf_dir):
    o, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    tiles = o.where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("tile"), F.expr("if(o_orderkey % 50 = 0, 'same', concat('n', o_orderkey))").alias("name"), F.col("o_orderkey").alias("tile_index"))
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else F.lit(c)
    box = F.array(F.lit(0.5), d("l_tax"), F.when(F.col("l_suppkey") % 60 == 0, -0.1).otherwise(d("l_discount")), F.lit(0.2), F.lit(0.0))
    rows = line.select(F.col("l_orderkey").alias("tile"), (F.col("l_linenumber") - 1).alias("label"), box.alias("box"), F.array(d("l_quantity") / 50, *[F.lit(0.01)] * 4).alias("prob"))
    return X.export_problems(tiles, rows.select("tile", "label", "box"), rows.select("tile", "box", "prob"), 5)


@query(f"""with {OBJECTS}, {_CNT}, c as (select "class", scene, n_gt, n_det, case when cast(substr(scene, 2) as bigint) % 40 = 0 then n_tp + 1 else n_tp end as n_tp from cnt)
    select * from (select 'more matches than objects' as problem, count(*) filter (n_tp > n_gt)::bigint as n from c union all select 'more matches than detections', count(*) filter (n_tp > n_det)::bigint from c
    union all select 'score outside', count(*)::bigint from objects where has_gt and has_det and score > 0.9 union all select 'iou outside', count(*)::bigint from objects where has_gt and has_det and score < 0.1
    union all select 'pairs against counts', count(*)::bigint from c where cast(substr(scene, 2) as bigint) % 40 = 0) where n > 0""")
def prepared_problems(spark, sf_dir):
    o = objects(spark, sf_dir).withColumnRenamed("scene_id", "scene")
    c = _counts(spark, sf_dir).withColumn("n_tp", F.expr("if(cast(substr(scene, 2) as bigint) % 40 = 0, n_tp + 1, n_tp)"))
    tp = o.where("has_gt and has_det").select("scene", "class", "pred", "gt", F.expr("if(score > 0.9, -1.0D, score)").alias("keep"), F.expr("if(score < 0.1, 0.4D, 0.6D)").alias("iou")).withColumnRenamed("keep", "score")
    return X.prepared_problems(c, tp, o.where("has_det").select("scene", "class", F.col("pred").alias("obb")))


@query(f"""with {PAIRS}, e as (select gx, gy, abs(cos(glt)) * glw / 2 + abs(sin(glt)) * glh / 2 as hw, abs(sin(glt)) * glw / 2 + abs(cos(glt)) * glh / 2 as hh, px, py, plw / 2 as sw, plh / 2 as sh from pairs),
    i as (select greatest(0.0, least(gx + hw, px + sw) - greatest(gx - hw, px - sw)) * greatest(0.0, least(gy + hh, py + sh) - greatest(gy - hh, py - sh)) as inter, 4 * hw * hh + 4 * sw * sh as total from e)
    select round(quantile_cont(inter / (total - inter), 0.5), 6) as median_iou, count(*)::bigint as n, quantile_cont(inter / (total - inter), 0.5) >= 0.9 as passes from i""")
def convention_gate(spark, sf_dir):
    p = pairs(spark, sf_dir)
    q = B.canonical(F.col("pred"))
    rows = p.select(F.col("gt").alias("obb"), (q["cx"] - q["w"] / 2).alias("x0"), (q["cy"] - q["h"] / 2).alias("y0"), (q["cx"] + q["w"] / 2).alias("x1"), (q["cy"] + q["h"] / 2).alias("y1"))
    return X.convention_gate(rows).withColumn("median_iou", F.round("median_iou", 6))


@query(f"""with {OBJECTS}, i as (select image_id, count(*) filter (has_det) as n_det, count(*) filter (has_gt) as n_gt from objects group by image_id), b as (select image_id, n_gt, row_number() over (order by image_id) - 1 as i, count(*) over () as n from i where n_det > 0 and n_gt > 0)
    select image_id from b where i % greatest(1, n // 12) = 0 and i / greatest(1, n // 12) < 12 union select image_id from (select image_id from b order by abs(n_gt - 12), image_id limit 3)""")
def parity_picks(spark, sf_dir):
    i = objects(spark, sf_dir).groupBy("image_id").agg(F.count_if("has_det").alias("n_det"), F.count_if("has_gt").alias("n_gt"))
    return X.parity_picks(i)
