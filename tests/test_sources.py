from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trackframe.operators import trajectory as tr
from trackframe.plans import views as v
from trackframe.sources import readers as rd
from trackframe.sources import sinks as sk


def test_files_are_read_as_declared(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps([{"sequence_id": "7", "frame": 1, "num_objects": 0, "object_coords": []}, {"sequence_id": "7", "frame": 2, "num_objects": 1, "object_coords": [[3.5, 4]]}]))
    _, pts, _ = rd.read_point_labels(spark, str(tmp_path / "labels.json"))
    assert [(r.frame_index, r.num_objects, r.x, r.y) for r in pts.orderBy("frame").collect()] == [(0, 0, None, None), (1, 1, 3.5, 4.0)]

    seq = {"schema_version": "0.1.0", "sequence_id": "q", "source_type": "real", "profile": "spotgeo", "frames": [{"frame_index": i, "image_ref": f"i{i}", "width_px": 640, "height_px": 480, "timestamp_s": None} for i in range(3)]}
    (tmp_path / "seq.json").write_text(json.dumps(seq))
    _, frames, _ = rd.read_sequences(spark, str(tmp_path / "seq.json"))
    assert [(r.position, r.image_ref, r.timestamp_s) for r in frames.orderBy("position").collect()] == [(i, f"i{i}", None) for i in range(3)]

    for s, n in (("train/10", 5), ("train/9", 2), ("test/1", 1)):
        (tmp_path / "img" / s).mkdir(parents=True)
        for i in range(1, n + 1):
            (tmp_path / "img" / s / f"{i}.png").write_bytes(f"{s}{i}".encode())
    (tmp_path / "img/train/9/note.png").write_bytes(b"x")
    (tmp_path / "img/train/007").mkdir()
    (tmp_path / "img/train/007/1.png").write_bytes(b"x")
    frames, rejected = rd.read_frame_listing(spark, str(tmp_path / "img"), "train")
    listing = frames.orderBy("sequence_number", "frame").collect()
    assert sorted(r.reason for r in rejected.collect()) == ["sequence is not a canonical number", "unsupported frame name"]
    assert [tuple(r) for r in rd.incomplete_folders(frames).collect()] == [("train", "9", [3, 4, 5])]
    assert [(r.sequence_id, r.frame) for r in listing] == [("9", 1), ("9", 2)] + [("10", i) for i in range(1, 6)]
    files = rd.hash_files(spark, str(tmp_path / "img/test/1")).collect()
    assert [(r.name, r.sha256) for r in files] == [("test/1/1.png", hashlib.sha256(b"test/11").hexdigest())]


def test_box_label_audit_case(spark, tmp_path):
    (tmp_path / "lb").mkdir()
    (tmp_path / "lb/empty.txt").write_text("")
    (tmp_path / "lb/mixed.txt").write_text("0 .5 .5 .2 .2\n1 .5 .5 .2 .2\n0 nan .5 .2 .2\n0 .5 .5 .2\n\n0 .95 .5 .2 .2\n")
    listing = spark.createDataFrame([(str(f),) for f in (tmp_path / "lb").iterdir()], "path string")
    boxes, files = rd.read_box_labels(spark, str(tmp_path / "lb"), listing)
    got = boxes.orderBy("line").collect()
    assert [(r.line, r.reason) for r in got] == [(1, None), (2, "class is not 0"), (3, "not a finite number"), (4, "expected five fields"), (6, None)]
    assert files.where("empty").count() == 1
    from trackframe.operators.datasets import missing_and_orphans
    from trackframe.operators.rules import box_extends_outside

    assert boxes.where("reason is null").where(box_extends_outside()).count() == 1
    images = spark.createDataFrame([("empty",), ("mixed",), ("missing",)], "stem string")
    assert [tuple(r) for r in missing_and_orphans(images, files).collect()] == [("missing", "missing_label")]


def test_box_csv_never_evaluates(spark, tmp_path):
    (tmp_path / "b.csv").write_text('ImageID,bboxes\na,"[[1, 2, 3, 4], (5, 6, 7, 8)]"\nb,[]\nc,"__import__(\'os\')"\na,[]\nd,"[[1, NaN]]"\n')
    boxes, errors = rd.read_box_csv(spark, str(tmp_path / "b.csv"))
    assert {(r.ImageID, r.reason) for r in errors.collect()} == {("a", "duplicate ID"), ("c", "not a box list"), ("d", "invalid box values")}
    assert {r.arity: r.boxes for r in rd.box_arity_histogram(boxes).collect()} == {0: 2, 4: 2}


def test_exports_round_trip_and_refuse_to_overwrite(spark, sf, tmp_path):
    p = v.points(spark, sf)
    fits = tr.fit_velocity(p)
    d = v.detections(spark, sf).withColumnsRenamed({"x": "x_raw_px", "y": "y_raw_px"})
    seq = v.frames(spark, sf).select("sequence_id").distinct().unionByName(spark.createDataFrame([("lost",), ("nowhere",)], "sequence_id string"))
    outcomes = seq.where("sequence_id <> 'nowhere'").select("sequence_id", F.when(F.col("sequence_id") == "lost", "invalid_input").otherwise("succeeded").alias("status"), F.lit(None).cast("string").alias("detail"))
    evidence = d.withColumn("evidence_statistics", F.create_map(F.lit("snr"), F.col("quality_score")))
    nested = sk.nest_results(seq, outcomes, evidence, v.tracks(spark, sf), p, fits, tr.extrapolate(fits))
    out = str(tmp_path / "json")
    sk.write_results_json(nested, out)
    back = rd.read_results(spark, out)
    assert back["rejected"].count() == 0 and back["sequences"].count() == seq.count()
    assert {r.sequence_id: r.status for r in back["sequences"].collect() if r.status != "succeeded"} == {"lost": "invalid_input", "nowhere": "uncertain_observation"}
    assert back["detections"].where("evidence_statistics['snr'] is null").count() == 0
    assert spark.read.text(out).where("value like '%\"lost\"%' and value like '%\"detections\":[],\"tracks\":[]%'").count() == 1
    assert back["points"].count() == p.count() and back["detections"].count() == d.count()
    assert back["tracks"].select("sequence_id", "track_id", "status").exceptAll(v.tracks(spark, sf).select("sequence_id", "track_id", "status")).count() == 0
    rows = sk.track_point_rows(p, tr.extrapolate(fits))
    csv = str(tmp_path / "csv")
    sk.write_track_points_csv(rows, csv)
    assert spark.read.option("header", True).csv(csv).count() == rows.count()
    for again in (lambda: sk.write_results_json(nested, out), lambda: sk.write_track_points_csv(rows, csv)):
        with pytest.raises(Exception, match="(?i)exist"):
            again()


def test_broken_documents_come_back_as_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"sequence_id": "a", "frames": [{"frame_index": 0}]}\n{"sequence_id": "b", "frames": [{"frame_in\n{"frames": []}\n')
    sequences, frames, rejected = rd.read_sequences(spark, str(tmp_path / "m.json"))
    assert [r.sequence_id for r in sequences.collect()] == ["a"] and frames.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == ["not a document of the declared form", "sequence_id is missing"]
    (tmp_path / "one.json").write_text('{\n "sequence_id": "a",\n "frames": [{"frame_index": 0}]\n}')
    assert rd.read_sequences(spark, str(tmp_path / "one.json"), multiline=True)[1].count() == 1


def test_manifest_digest_ignores_order_and_sees_changes(spark):
    m = spark.createDataFrame([(f"f{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(200)], "name string, sha256 string")
    a = rd.manifest_digest(m).first()
    assert a == rd.manifest_digest(m.orderBy(F.rand(1)).repartition(7)).first() and a.files == 200
    assert a != rd.manifest_digest(m.withColumn("sha256", F.when(F.col("name") == "f7", "0").otherwise(F.col("sha256")))).first()
