import json
import random

import pytest

from tessera import cli


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r, d = random.Random(0), tmp_path_factory.mktemp("cli")
    det, gt = [], []
    for s in range(40):
        for k in range(r.randint(1, 2)):
            image = f"P{s:04}__1024__{k}___0"
            for _ in range(4):
                box = [r.uniform(0, 1000), r.uniform(0, 1000), r.uniform(15, 30), r.uniform(5, 15), r.uniform(-1.5, 1.5)]
                kind = r.choice(["ship", "harbor", "plane"])
                gt.append({"image_id": image, "class": kind, "obb": box})
                det.append({"image_id": image, "class": kind, "obb": [box[0] + r.gauss(0, 1), box[1] + r.gauss(0, 1), *box[2:]], "score": r.uniform(0.3, 0.99)})
    for name, rows in (("det", det), ("gt", gt)):
        (d / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return d


def test_chain(spark, files):
    at = lambda n: str(files / n)
    assert cli.main(["ingest", "--source", at("det.jsonl"), "--out", at("clean")]) == 0
    assert cli.main(["match", "--detections", at("det.jsonl"), "--truth", at("gt.jsonl"), "--iou", "0.3", "--out", at("matched")]) == 0
    assert spark.read.json(at("matched")).where("match_type = 'tp'").count() > 150
    assert cli.main(["calibrate", "--matched", at("matched"), "--by-class", "--out", at("cert.json")]) == 0
    cert = json.loads((files / "cert.json").read_text())
    assert {r["class"] for r in cert} == {"ship", "harbor", "plane"} and all(r["q"] > 0 and not r["refused"] for r in cert)
    assert cli.main(["calibrate", "--matched", at("matched"), "--score", "naive-coord", "--out", at("cert2.json")]) == 0
    assert len(json.loads((files / "cert2.json").read_text())) == 5
    assert cli.main(["calibrate", "--matched", at("matched"), "--method", "hcp", "--by-class"]) == 0
    assert cli.main(["recall", "--matched", at("matched"), "--beta", "0.5", "--out", at("recall.json")]) == 0
    assert len(json.loads((files / "recall.json").read_text())) == 50
    assert cli.main(["audit", "--matched", at("matched"), "--draws", "50", "--out", at("audit.json")]) == 0
    audit = {r["stratum"]: r for r in json.loads((files / "audit.json").read_text())}
    assert audit["all"]["coverage"] >= 0.9 and audit["all"]["low"] <= audit["all"]["coverage"] <= audit["all"]["high"]
    assert cli.main(["report", "--result", at("audit.json"), "--out", at("audit.md")]) == 0
    assert "coverage" in (files / "audit.md").read_text()


def test_errors(files, capsys):
    (files / "bad.jsonl").write_text('{"image_id": "a"}\n')
    assert cli.main(["ingest", "--source", str(files / "bad.jsonl"), "--out", str(files / "x")]) == 1
    assert "missing" in capsys.readouterr().err
