"""Content hashes, order-free digests, exports whose record names what changed, manifests; pickled outputs and refused ones."""

import hashlib
import math
import os
import pathlib
import pickle
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import pickles, provenance


@pytest.fixture
def inputs(tmp_path):
    out = {}
    for name in ("config", "checkpoint", "data_manifest"):
        path = tmp_path / f"{name}.bin"
        path.write_bytes(os.urandom(5000) if name == "checkpoint" else name.encode())
        out[name] = str(path)
    return out


def facts(inputs):
    return {**inputs, "seed": "1", "command": "run", "start_utc": "2026-01-01T00:00:00Z", "upstream_commit": "abc"}


def test_content_hashes_by_parts(spark, inputs):
    got = {r.file.rsplit("/", 1)[-1]: r for r in provenance.content_hashes(spark, list(inputs.values()), part=1000).collect()}
    data = pathlib.Path(inputs["checkpoint"]).read_bytes()
    want = hashlib.sha256("".join(hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, 5000, 1000)).encode()).hexdigest()
    assert (got["checkpoint.bin"].bytes, got["checkpoint.bin"].parts, got["checkpoint.bin"].digest) == (5000, 5, want)


def test_digest_ignores_order_and_counts_repeats(spark):
    rows = [(1, "a", None), (2, None, 1.5), (2, None, 1.5), (3, "", 2.0)]
    df = spark.createDataFrame(rows, "i int, s string, d double")
    one = provenance.table_digest(df).first()
    other = provenance.table_digest(spark.createDataFrame(rows[::-1], "i int, s string, d double").repartition(3).select("d", "s", "i")).first()
    assert one == other and one["rows"] == 4 and len(one.digest) == 60
    for changed in (rows[:3], rows + rows[:1], [(1, "", None), *rows[1:]], [(1, "a", 0.0), *rows[1:]]):
        assert provenance.table_digest(spark.createDataFrame(changed, "i int, s string, d double")).first().digest != one.digest
    assert provenance.table_digest(df.limit(0)).first()[:] == (0, "0" * 60)


def test_a_changed_byte_names_its_file(spark, inputs, tmp_path):
    df = spark.range(100).withColumn("v", F.sqrt("id")).repartition(3)
    path = str(tmp_path / "export")
    with pytest.raises(provenance.ProvenanceError, match="facts are missing.*seed"):
        provenance.export(df, path, {k: v for k, v in facts(inputs).items() if k != "seed"})
    record = provenance.export(df, path, facts(inputs))
    assert record["rows"] == 100 and len(record["checkpoint_digest"]) == 64
    assert provenance.problems(spark, path).count() == 0
    part = sorted(pathlib.Path(path, "rows").glob("part-*.parquet"))[0]
    data = bytearray(part.read_bytes())
    data[20] ^= 1
    part.write_bytes(bytes(data))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    pathlib.Path(inputs["config"]).write_bytes(b"other")
    spark.catalog.refreshByPath(path)
    assert {tuple(r) for r in provenance.problems(spark, path).collect()} == {("file changed", part.name), ("config changed", inputs["config"])}
    part.unlink()
    assert ("file is missing", part.name) in {tuple(r) for r in provenance.problems(spark, path).collect()}
    with pytest.raises(provenance.ProvenanceError, match="no record"):
        provenance.problems(spark, str(tmp_path / "nothing"))


def test_manifests_bind_cells(spark):
    cells = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", None, 5), ("d", "4", -1), ("x", "5", 0), (None, "6", 1), ("e", "7", 1), ("e", "7", 1)], "k string, h string, n int")
    manifest = spark.createDataFrame([("a", "1"), ("b", "other"), ("c", "3"), ("d", "4"), ("e", "7"), ("f", "8")], "k string, h string")
    got = {tuple(r) for r in provenance.manifest_problems(cells, manifest, "k", ["h"], ["n"]).collect()}
    assert got == {("h differs", "b", 1), ("h differs", "c", 1), ("n is not a count", "d", 1), ("cell is unknown", "x", 1), ("cells: key is null", None, 1), ("cells: key repeated", "e", 2), ("cell is missing", "f", 1)}
    with pytest.raises(provenance.ProvenanceError, match="cell is missing: f"):
        provenance.bound_cells(cells, manifest, "k", ["h"], ["n"])
    good = cells.where("k = 'a'")
    assert provenance.bound_cells(good, manifest.where("k = 'a'"), "k", ["h"], ["n"]).count() == 1
    assert provenance.cell_of(manifest, good.select("k"), "k").first().h == "1"
    with pytest.raises(provenance.ProvenanceError, match="x has 0 entries"):
        provenance.cell_of(manifest, cells.where("k = 'x'").select("k"), "k")


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/never-made",)


def write(folder, name, samples, protocol=4):
    (folder / name).write_bytes(pickle.dumps(samples, protocol))


def sample(image, boxes, labels, scores):
    return {"img_path": f"/x/{image}.png", "pred_instances": {"bboxes": np.array(boxes, np.float32), "labels": np.array(labels), "scores": np.array(scores, np.float32)}}


@pytest.mark.parametrize("protocol", [2, 4, 5])
def test_pickled_detections(spark, tmp_path, protocol):
    corners = [[0, 0, 4, 0, 4, 2, 0, 2]]
    write(tmp_path, "a.pkl", [sample("i1", [[5, 6, 2, 4, 0.1], [1, 1, 3, 1, 0]], [0, 1], [0.9, 0.01]), sample("i2", corners, [1], [0.5])], protocol)
    write(tmp_path, "b.pkl", [OrderedDict(metainfo={"img_id": "i3"}, pred_instances={"bboxes": [], "labels": [], "scores": []})], protocol)
    write(tmp_path, "c.pkl", [], protocol)
    rows = sorted(pickles.detections(spark, str(tmp_path), ["ship", "car"], offset=(10, 0)).collect(), key=lambda r: r.image_id)
    assert [(r.image_id, r["class"], round(r.score, 3)) for r in rows] == [("i1", "ship", 0.9), ("i2", "car", 0.5)]
    a, b = rows[0].obb, rows[1].obb
    assert (a.cx, a.cy, a.w, a.h) == (15, 6, 4, 2) and math.isclose(a.theta, 0.1 - math.pi / 2, abs_tol=1e-6)
    assert np.allclose([b.cx, b.cy, b.w, b.h, b.theta], [12, 1, 4, 2, 0])


@pytest.mark.parametrize("samples, told", [
    ([Hostile()], "system is refused"), ([sample("i", [[1, 1, 1, 1, 0]], [0], [1.5])], "score"), ([sample("i", [[1, 1, 1, 1, 0]], [7], [0.5])], "label"), ([sample("i", [[1, 1, 1, 1, 0]], [0, 1], [0.5])], "differ in number"),
    ([sample("i", [[1, 1, 1]], [0], [0.5])], "five or eight"), ([{"pred_instances": {"bboxes": [], "labels": [], "scores": []}}], "no image"), ([sample("i", [[1, 1, math.nan, 1, 0]], [0], [0.5])], "not finite"), ({"a": 1}, "list of samples"),
    ([sample("i", [[1, 1, 1, 1, 0]], [0], [0.5])] * 2, "occurs 2 times"), ([{"img_id": "i", "pred_instances": {"bboxes": np.array([Hostile()], object), "labels": [0], "scores": [1]}}], "refused"),
])
def test_faulty_and_hostile_pickles_are_errors(spark, tmp_path, samples, told):
    write(tmp_path, "a.pkl", samples)
    with pytest.raises(Exception, match=told):
        pickles.detections(spark, str(tmp_path), ["ship", "car"]).collect()
    assert not pathlib.Path("/tmp/never-made").exists()


def test_damaged_pickles_and_repeats_over_files(spark, tmp_path):
    with pytest.raises(pickles.RefusedPickle, match="not a readable file"):
        pickles.loads(b"\x80\x04damaged")
    for name in ("a.pkl", "b.pkl"):
        write(tmp_path, name, [sample("same", [[1, 1, 1, 1, 0]], [0], [0.5])])
    with pytest.raises(ValueError, match="image same occurs 2 times"):
        pickles.detections(spark, str(tmp_path), ["ship"])
