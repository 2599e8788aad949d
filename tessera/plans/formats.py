"""Registered queries of readers, writers, record filters and box bounds: what is written is read back and compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import names as N
from ..operators import audit as A
from ..operators import thresholds as T
from ..operators.readouts import doubled_length
from ..sources import annotations as ANN
from ..sources import checkpoints as K
from ..sources import records as REC
from ..sources.scratch import forgotten, scratch_path
from .catalog import HCP, OBJECTS, PAIRS, RECORDS, SCORES, gwd_scores, query, records
from .fixtures import ground_truth, pairs


def _written(df, name: str) -> str:
    """The path of a one-column frame of lines in the shared folder, deleted when the driver ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    forgotten(df.sparkSession, path)
    return path


_BACK = 'round(glw, 2) as w, round(glh, 2) as h, round(gx, 2) as cx, round(gy, 2) as cy'


def _sides(df, *keep):
    b = B.canonical(F.col("obb"))
    return df.select(*keep, *[F.round(b[k], 2).alias(k) for k in ("w", "h", "cx", "cy")])


@query(f"with {OBJECTS} select \"class\" || '-' || idx as class, 0::int as difficult, {_BACK} from objects where has_gt")
def annotation_text(spark, sf_dir):
    """Boxes as corner lines and back, with the box's number in its class."""
    g = ground_truth(spark, sf_dir).withColumn("class", F.concat_ws("-", "class", "idx"))
    return _sides(ANN.dota_text(spark, _written(ANN.corner_lines(g).select("line"), "lines")), "class", "difficult")


@query(f"""with {OBJECTS} select case "class" when 'A' then 'large vehicle' when 'N' then 'ship' else 'harbor' end as class, (idx % 3)::int as difficult, count(*)::bigint as n, round(sum(glw), 0) as widths from objects where has_gt and idx % 3 <= 1 group by all""")
def annotation_strict(spark, sf_dir):
    """The strict form: class names with blanks, and objects above the difficulty limit left out."""
    g = ground_truth(spark, sf_dir)
    name = F.when(F.col("class") == "A", "large vehicle").when(F.col("class") == "N", "ship").otherwise("harbor")
    key = F.concat_ws("@", "idx", "image_id").alias("image_id")
    lines = ANN.corner_lines(g.select(key, "class", "obb")).join(g.select(key, name.alias("name"), (F.col("idx") % 3).alias("hard")).distinct(), "image_id")
    text = lines.select(F.concat_ws(" ", F.array_join(F.slice(F.split("line", " "), 1, 8), " "), "name", "hard").alias("value"))
    rows = ANN.dota_text(spark, _written(text, "lines"), ["large vehicle", "ship", "harbor"], 1)
    return rows.groupBy("class", "difficult").agg(F.count("*").alias("n"), F.round(F.sum(F.greatest("obb.w", "obb.h")), 0).alias("widths"))


@query("""select lower(p_type) as class, (p_size % 2)::int as difficult, round(greatest(4.0 + p_size, 30.0), 4) as w, round(least(4.0 + p_size, 30.0), 4) as h, round(p_partkey % 500 + 0.0, 4) as cx, round(p_size * 3.0, 4) as cy from part where p_size > 2
    union all select lower(p_type), 0, round(8.0, 4), round(4.0, 4), round(p_partkey % 500 + 4.0, 4), round(p_size + 2.0, 4) from part where p_size = 2""")
def annotation_xml(spark, sf_dir):
    """Objects with five parameters, with corners, and with neither (skipped)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = lambda c: c.cast("double").cast("string")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    x, y, size = F.col("p_partkey") % 500, F.col("p_size"), F.col("p_size")
    five = tag("robndbox", F.concat(tag("cx", s(x)), tag("cy", s(y * 3)), tag("w", s(size + 4)), tag("h", F.lit("30.0")), tag("angle", F.lit("0.3"))))
    corner = [(x, y), (x + 8, y), (x + 8, y + 4), (x, y + 4)]
    eight = tag("polygon", F.concat(*[v for i, (a, b) in enumerate(corner, 1) for v in (tag(f"x{i}", s(a)), tag(f"y{i}", s(b)))]))
    head = F.concat(tag("name", F.col("p_type")), F.when(size > 2, tag("difficult", (size % 2).cast("string"))).otherwise(F.lit("")))
    body = F.when(size > 2, five).when(size == 2, eight).otherwise(tag("bndbox", tag("xmin", F.lit("1"))))
    objects = p.select((F.col("p_partkey") % 16).alias("file"), tag("object", F.concat(head, body)).alias("o"))
    docs = objects.groupBy("file").agg(tag("annotation", F.array_join(F.collect_list("o"), "")).alias("value"))  # a file has one root
    path = scratch_path(spark, "xml")
    docs.write.partitionBy("file").text(path)
    forgotten(spark, path)
    rows = ANN.dior_xml(spark, path, skip_without=True)
    b = B.canonical(F.col("obb"))
    return rows.select("class", "difficult", *[F.round(b[k], 4).alias(k) for k in ("w", "h", "cx", "cy")])


@query("""select n_nationkey::bigint as image_id, n_name || '.png' as file_name, lower(r_name) as class, s_suppkey::bigint as annotation_id, (s_suppkey % 100)::double as x, (s_suppkey % 37)::double as y, 5.0::double as w, (1 + s_suppkey % 9)::double as h
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def annotation_coco(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    nation, region = t("nation"), t("region")
    d = lambda c: c.cast("double")
    k = F.col("s_suppkey")
    notes = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("id"), F.col("n_nationkey").alias("image_id"), F.col("n_regionkey").alias("category_id"), F.array(d(k % 100), d(k % 37), F.lit(5.0), d(1 + k % 9)).alias("bbox"))
    one = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))  # noqa: E731  (a COCO file is one document)
    doc = one(nation.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(".png")).alias("file_name")), "images").crossJoin(one(region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "categories")).crossJoin(one(notes, "annotations"))
    rows = ANN.coco_json(spark, _written(doc.select(F.to_json(F.struct("*")).alias("value")), "coco"))
    return rows.select(F.col("image_id").cast("bigint").alias("image_id"), "file_name", "class", "annotation_id", *"xywh")


@query("""with r as (select l_orderkey, l_linenumber, (l_partkey % 3) as a, (l_suppkey % 2) as b, (l_linenumber * 40) as difficult from lineitem)
    select l_orderkey, l_linenumber::bigint as l_linenumber, a::bigint as a, b::bigint as b, (a = 0 or b = 0)::int as zero_area, (difficult > 100)::int as hard from r""")
def exclusion_reasons(spark, sf_dir):
    """Quadrilaterals (0,0) (a,0) (a,b) (0,b) with sides 0 to 2 in tenths: without area where a side is 0."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = F.col("l_partkey") % 3, F.col("l_suppkey") % 2
    t = lambda c: F.concat(F.lit("0."), c.cast("string"))
    o = F.lit("0.0")
    rows = line.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), F.array(o, o, t(a), o, t(a), t(b), o, t(b)).alias("xy"), (F.col("l_linenumber") * 40).alias("difficult"))
    e = ANN.exclusions(rows)
    return e.select("l_orderkey", "l_linenumber", "a", "b", F.array_contains("reasons", "zero_area").cast("int").alias("zero_area"), F.array_contains("reasons", "difficult").cast("int").alias("hard"))


@query(f"""with {SCORES}, {HCP} select s."class", count(*)::bigint as n, count(*) filter (score <= q)::bigint as inside, count(*) filter (score <= 3.25)::bigint as near from scores s join hcp h on s."class" = h."class" group by s."class" """)
def ball_membership(spark, sf_dir):
    q = T.class_thresholds(gwd_scores(spark, sf_dir).where("role = 'cal'"), 0.1, "hcp").select("class", F.col("q_hat").alias("q"))
    slack = F.lit(5e-7)  # thresholds are rounded to six digits
    rows = pairs(spark, sf_dir).join(F.broadcast(q), "class")
    hit = lambda r: F.count_if(B.in_ball(F.col("pred"), F.col("gt"), r + slack))
    return rows.groupBy("class").agg(F.count("*").alias("n"), hit(F.col("q")).alias("inside"), hit(F.lit(3.25)).alias("near"))


@query(f"""with {SCORES}, {HCP} select idx, image_id, round(px - q, 4) as cx_lo, round(px + q, 4) as cx_hi, round(py - q, 4) as cy_lo, round(py + q, 4) as cy_hi from objects o join hcp h on o."class" = h."class" where has_det""")
def centre_bounds(spark, sf_dir):
    from .fixtures import detections

    q = T.class_thresholds(gwd_scores(spark, sf_dir).where("role = 'cal'"), 0.1, "hcp").select("class", F.col("q_hat").alias("q"))
    rows = detections(spark, sf_dir).join(F.broadcast(q), "class").select("idx", "image_id", B.centre_envelope(F.col("obb"), F.col("q")).alias("c"))
    return rows.select("idx", "image_id", *[F.round(F.col("c")[k], 4).alias(k) for k in ("cx_lo", "cx_hi", "cy_lo", "cy_hi")])


@query(f"""with {PAIRS}, c as (select idx, image_id, cos(2 * plt) as c, sin(2 * plt) as s, 0.4 as qc, 0.7 as qs from pairs),
    e as (select *, list_sort(list_distinct(list_filter([0.0, 2 * pi(), case when abs(c - qc) < 1 then acos(c - qc) end, case when abs(c - qc) < 1 then 2 * pi() - acos(c - qc) end, case when abs(c + qc) < 1 then acos(c + qc) end, case when abs(c + qc) < 1 then 2 * pi() - acos(c + qc) end,
      case when abs(s - qs) < 1 then asin(s - qs) + case when s - qs < 0 then 2 * pi() else 0 end end, case when abs(s - qs) < 1 then pi() - asin(s - qs) end, case when abs(s + qs) < 1 then asin(s + qs) + case when s + qs < 0 then 2 * pi() else 0 end end, case when abs(s + qs) < 1 then pi() - asin(s + qs) end], lambda x: x is not null))) as v from c),
    g as (select idx, image_id, c, s, qc, qs, unnest(list_zip(v[1:len(v) - 1], v[2:])) as z from e)
    select idx, image_id, round(coalesce(sum(z[2] - z[1]) filter (abs(cos((z[1] + z[2]) / 2) - c) <= qc and abs(sin((z[1] + z[2]) / 2) - s) <= qs), 0) / 2, 5) as length from g group by idx, image_id""")
def doubled_lengths(spark, sf_dir):
    t = B.canonical(F.col("pred"))["theta"]
    rows = pairs(spark, sf_dir).select("idx", "image_id", F.round(doubled_length(t, F.lit(0.4), F.lit(0.7)), 5).alias("length"))
    return rows.distinct()


_ACOS = "case when 1.5 >= (plw - plh) / (2 * sqrt(2)) then pi() / 2 else acos(least(1.0, greatest(-1.0, sqrt(greatest(0.0, pow((plw * plw + plh * plh) / 8 - 2.25, 2) - plw * plw * plh * plh / 16)) / ((plw * plw - plh * plh) / 8)))) / 2 end"


@query(f"with {PAIRS} select idx, image_id, round({_ACOS}, 5) as by_tangent, round({_ACOS}, 5) as by_sine from pairs")
def half_extents(spark, sf_dir):
    """The half width by arc tangent and by arc sine; SQL has the arc cosine."""
    p = B.canonical(F.col("pred"))
    f = lambda g: F.round(g(p["w"], p["h"], F.lit(1.5)), 5)
    return pairs(spark, sf_dir).select("idx", "image_id", f(B.half_extent_tangent).alias("by_tangent"), f(B.half_extent_stable).alias("by_sine"))


@query(f"""with recursive {RECORDS} select "class", match_type, count(*)::bigint as n, round(sum(coalesce(pred_score, 0)), 4) as scores from records
    where (match_type = 'fn' or pred_score >= 0.3) and image_id in (select image_id from gts where gx > 100) and image_id not in (select image_id from gts where gy > 900) group by all""")
def kept_records(spark, sf_dir):
    """Confidence filter, semi-join with listed images and anti-join with excluded ones, on records that must have scenes."""
    g = ground_truth(spark, sf_dir)
    listed, excluded = (g.where(c).select("image_id").distinct() for c in ("obb.cx > 100", "obb.cy > 900"))
    rows = records(spark, sf_dir).where("match_type = 'fn' or pred_score >= 0.3").join(listed, "image_id", "left_semi").join(excluded, "image_id", "left_anti")
    return rows.groupBy("class", "match_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("pred_score", F.lit(0.0))), 4).alias("scores"))


@query("""select draw::bigint as draw, count(*)::bigint as n, sum(c_custkey % (draw + 2))::bigint as total from customer, (select unnest(range(0, 7)) as draw) group by draw""")
def resumed_draws(spark, sf_dir):
    """A draw table made in two runs, of which the first broke off."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    path = scratch_path(spark, "draws")
    made = lambda ids: c.withColumn("draw", F.explode(F.array(*[F.lit(r.draw) for r in ids.collect()]))).groupBy("draw").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey") % (F.col("draw") + 2)).alias("total"))
    K.run_blocks(spark, path, 4, 3, made)
    out = K.run_blocks(spark, path, 7, 3, made)
    forgotten(spark, path)
    return out.select(F.col("draw").cast("bigint").alias("draw"), "n", "total")


@query("select p_partkey, p_name, p_size::int as p_size, p_retailprice from part")
def csv_round_trip(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")
    path = scratch_path(spark, "csv")
    p.write.option("header", True).csv(path)
    forgotten(spark, path)
    return spark.read.schema(p.schema).option("header", True).csv(path)


@query("""select p_partkey, case when p_size % 5 <> 0 and p_size % 7 <> 0 then p_size::double end as a, case when p_size % 5 = 0 then 'Infinity' when p_size % 7 = 0 then 'NaN' end as why from part""")
def strict_number_rows(spark, sf_dir):
    """Numbers that JSON cannot hold, taken out and named, through a JSON-lines file and back."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    odd = F.when(F.col("p_size") % 5 == 0, F.lit(float("inf"))).when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    path = scratch_path(spark, "records")
    REC.write_lines(REC.strict_numbers(p.select("p_partkey", odd.alias("a")), ["a"]), path)
    forgotten(spark, path)
    rows = REC.read_lines(spark, path, "p_partkey long, a double, nonfinite map<string,string>")
    return rows.select("p_partkey", "a", F.col("nonfinite")["a"].alias("why"))


@query(f"""with {OBJECTS}, k as (select image_id, gx, gy, "class", round_even(glw, 0)::double as kw, round_even(glh, 0)::double as kh, round_even(glt / 0.02, 0)::double as kt from objects where has_gt),
    good as (select "class", kw, kh, kt from k group by all having count(distinct image_id) between 2 and 50), g as (select k.* from k join good using ("class", kw, kh, kt)),
    v as (select a.image_id as a, b.image_id as b, round_even((b.gx - a.gx) / 4, 0)::double as ox, round_even((b.gy - a.gy) / 4, 0)::double as oy, count(*)::bigint as votes from g a join g b using ("class", kw, kh, kt) where a.image_id < b.image_id group by all)
    select a, b, ox, oy, votes from v order by votes desc, a, b, ox, oy limit 10""")
def top_votes(spark, sf_dir):
    """The ten best image pairs of the geometric hash, an example list."""
    return A.geometric_votes(ground_truth(spark, sf_dir), least_votes=1).orderBy(F.col("votes").desc(), "a", "b", "ox", "oy").limit(10)


@query("""with p as (select p_partkey, case p_size % 5 when 0 then ' Feright ' when 1 then 'truvk' when 2 then 'FERIGHT CAR' when 3 then 'Truck' else 'ship' end as n from part)
    select p_partkey, case lower(trim(n)) when 'feright' then 'freight car' when 'feright car' then 'freight car' when 'truvk' then 'truck' else lower(trim(n)) end as class from p""")
def mended_classes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.element_at(F.array(*[F.lit(x) for x in (" Feright ", "truvk", "FERIGHT CAR", "Truck", "ship")]), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select("p_partkey", N.class_name(n).alias("class"))

