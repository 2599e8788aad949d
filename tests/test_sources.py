import json
import zipfile

import pytest

from tessera.sources import annotations as A
from tessera.sources import checkpoints as K
from tessera.sources import records as R


def test_lines(spark, tmp_path):
    good = {"image_id": "a/P1__1024__0___0.png", "scene_id": None, "class": "ship", "obb": [0, 0, 4, 2, 0], "score": 0.5}
    p = tmp_path / "d.jsonl"
    p.write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "scene_id": "X"}) + "\n")
    rows = R.read_detections(spark, str(p)).collect()
    assert sorted(r.scene_id for r in rows) == ["P1", "X"] and rows[0].obb.w == 4
    for bad, match in (("{", "invalid"), ("", "no records"), (json.dumps({**good, "obb": [0, 0, -1, 2, 0]}), "negative side"), (json.dumps({**good, "score": None}), "score")):
        p.write_text(bad + "\n")
        with pytest.raises(R.SchemaError, match=match):
            R.read_detections(spark, str(p))


def test_strict_numbers(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (float("nan"), 2.0)], "a double, b double")
    rows = R.strict_numbers(df, ["a", "b"]).collect()
    assert rows[0].b is None and rows[0].nonfinite == {"b": "Infinity"} and rows[1].a is None and rows[1].b == 2.0


def test_xml(spark, tmp_path):
    p = tmp_path / "00001.xml"
    p.write_text("<annotation><object><name>Ship</name><difficult>0</difficult><robndbox><cx>5</cx><cy>6</cy><w>2</w><h>8</h><angle>0.0</angle></robndbox></object>"
                 "<object><name>truvk</name><robndbox><x_left_top>0</x_left_top><y_left_top>0</y_left_top><x_right_top>4</x_right_top><y_right_top>0</y_right_top>"
                 "<x_right_bottom>4</x_right_bottom><y_right_bottom>2</y_right_bottom><x_left_bottom>0</x_left_bottom><y_left_bottom>2</y_left_bottom></robndbox></object></annotation>")
    rows = {r["class"]: r for r in A.dior_xml(spark, str(p)).collect()}
    assert rows["ship"].obb.w == 8 and rows["ship"].image_id == "00001" and rows["truck"].obb.w == 4 and rows["truck"].obb.cy == 1
    p.write_text("<annotation><object><name>ship</name><bndbox><xmin>1</xmin></bndbox></object></annotation>")
    with pytest.raises(Exception, match="no oriented box"):
        A.dior_xml(spark, str(p)).collect()
    assert A.hrsc_xml(spark, str(p)).count() == 0


def test_text_and_coco(spark, tmp_path):
    p = tmp_path / "P1.txt"
    p.write_text("imagesource:x\n0 0 4 0 4 2 0 2 small vehicle 1\n0 0 4 0 4 2 0 2 ship\nshort\n")
    assert {r["class"] for r in A.dota_text(spark, str(p)).collect()} == {"small", "ship"}
    strict = A.dota_text(spark, str(p), ["small vehicle"]).collect()
    assert [(r["class"], r.difficult, r.obb.w) for r in strict] == [("small vehicle", 1, 4.0)]
    c = tmp_path / "c.json"
    doc = {"images": [{"id": 1, "file_name": "a.png"}], "categories": [{"id": 2, "name": "Ship"}], "annotations": [{"id": 3, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}]}
    c.write_text(json.dumps(doc))
    assert A.coco_json(spark, str(c)).first()["class"] == "ship"
    doc["annotations"][0]["image_id"] = 9
    c.write_text(json.dumps(doc))
    with pytest.raises(A.AnnotationError):
        A.coco_json(spark, str(c))


def test_archives_and_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.txt", "hello")
    r = A.archive_members(spark, str(tmp_path / "a.zip")).first()
    assert (r.member, r.bytes) == ("x/1.txt", 5)
    for bad in ('{"a": 1, "a": 2}', "[NaN]"):
        with pytest.raises(A.AnnotationError):
            A.strict_json(bad)
    line = spark.createDataFrame([(["0", "0", "1", "1", "2", "2", "3", "3"], 0), (["0", "0", "1", "0", "1", "1", "0", "1"], 200)], "xy array<string>, difficult int")
    assert [r.reasons for r in A.exclusions(line).collect()] == [["zero_area"], ["difficult"]]


def test_checkpoints_resume(spark, tmp_path):
    path, made = str(tmp_path / "draws"), []

    def make(ids):
        made.append(1)
        return ids.selectExpr("draw", "draw * 2 as value")

    assert K.run_blocks(spark, path, 10, 4, make).count() == 10 and len(made) == 3
    assert K.run_blocks(spark, path, 14, 4, make).count() == 14 and len(made) == 5
    p = K.problems(K.run_blocks(spark, path, 14, 4, make), 14).first()
    assert (p.missing, p.repeated) == (0, 0) and len(made) == 5


def test_scratch_is_in_the_shared_folder(spark):
    from tessera.sources import scratch

    df = scratch.stored(spark.range(3), "three")
    assert df.count() == 3 and all(scratch.shared_dir(spark).split(":")[-1] in f for f in df.inputFiles())
    assert scratch.stored(spark.range(0), "none").count() == 0
