"""Targets and their shards: what ranks read together is the table, no image is split, order follows seed and epoch."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyx.operators import targets

BOX = "ann_id long, image_path string, label string, xmin int, ymin int, xmax int, ymax int, area double"
LABELS = {"a": 0, "b": 1}


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([(f"i{k}", 100, 80) for k in range(30)] + [("bare", 10, 10), ("frame", 10, 10)], "image_path string, width int, height int")


@pytest.fixture(scope="module")
def ann(spark):
    rows = [(k, f"i{k % 30}", "ab"[k % 2], k % 90, k % 70, k % 90 + 20, k % 70 + 20, float(k)) for k in range(300)]
    odd = [(900, "i0", "a", 150, 10, 160, 20, 1.0), (901, "unknown", "a", 0, 0, 5, 5, 1.0), (902, "frame", "a", 0, 0, 0, 0, 0.0), (903, "i1", None, 1, 1, 9, 9, 1.0)]
    return spark.createDataFrame(rows + odd, BOX).repartition(5)


def test_targets(spark, ann, images):
    got = {(r["image_path"], r["ann_id"]): r for r in targets.targets(ann, images, LABELS).collect()}
    assert len(got) == 303 and got["bare", None]["label"] is None and got["frame", None]["xmin"] is None
    assert got["i29", 89]["label"] == 1 and (got["i29", 89]["xmax"], got["i29", 89]["area"]) == (100, 89.0) and got["i1", 903]["label"] is None
    with pytest.raises(Exception, match="unknown label"):
        targets.targets(ann, images, {"a": 0}).collect()
    points = spark.createDataFrame([(1, "i0", "a", 5.0, 5.0), (2, "i0", "a", 500.0, 5.0)], "ann_id long, image_path string, label string, x double, y double")
    assert targets.targets(points, images, LABELS).where("x is not null").count() == 1
    assert targets.targets(ann.where("false"), images, LABELS).count() == 32 and targets.targets(ann, images.where("false"), LABELS).count() == 0


def test_shards(spark, ann, images, tmp_path):
    rows = targets.targets(ann, images, LABELS)
    manifest = {r["shard"]: r for r in targets.write_shards(rows, str(tmp_path / "s"), 7, seed=3).collect()}
    assert set(manifest) == set(range(7)) and sum(r["images"] for r in manifest.values()) == 32 and sum(r["rows"] for r in manifest.values()) == rows.count()
    plain = lambda d: sorted(map(str, d.select(rows.columns).collect()))
    parts = [targets.read_shards(spark, str(tmp_path / "s"), k, 3) for k in range(3)]
    assert plain(parts[0].unionByName(parts[1]).unionByName(parts[2])) == plain(rows)
    of = [{r["image_path"] for r in p.select("image_path").collect()} for p in parts]
    assert not of[0] & of[1] and not of[1] & of[2] and not of[0] & of[2]
    assert "PartitionFilters: [isnotnull" in parts[0]._jdf.queryExecution().toString() or "PartitionFilters: [shard" in parts[0]._jdf.queryExecution().toString()
    again = targets.write_shards(rows.repartition(2), str(tmp_path / "t"), 7, seed=3, epoch=1)
    place = lambda p: {r["image_path"]: r["place"] for r in targets.read_shards(spark, str(tmp_path / p)).select("image_path", "place").distinct().collect()}
    shard = lambda p: {r["image_path"]: r["shard"] for r in targets.read_shards(spark, str(tmp_path / p)).select("image_path", "shard").distinct().collect()}
    assert shard("s") == shard("t") and place("s") != place("t") and again.count() == 7
    for bad in (lambda: targets.write_shards(rows, str(tmp_path / "u"), 0), lambda: targets.read_shards(spark, str(tmp_path / "s"), 3, 3)):
        with pytest.raises(ValueError):
            bad()
    few = targets.write_shards(rows.where("image_path = 'i0'"), str(tmp_path / "few"), 5)
    assert few.where("rows = 0").count() == 4 and targets.read_shards(spark, str(tmp_path / "few")).count() == 10


def test_images_in_order(spark, ann, images, tmp_path):
    targets.write_shards(targets.targets(ann, images, LABELS), str(tmp_path / "s"), 4, seed=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # images reach over batches
    try:
        seen = lambda name, rows: pd.DataFrame({"image_path": [name], "n": [len(rows)], "ids": [rows["ann_id"].astype("int64").tolist()]})
        got = targets.per_image(targets.read_shards(spark, str(tmp_path / "s")), seen, "image_path string, n int, ids array<long>").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 32 and sum(r["n"] for r in got) == 301 and {r["image_path"]: r["n"] for r in got}["bare"] == 0
    assert all(r["ids"] == sorted(r["ids"]) for r in got)
    at = {r["image_path"]: (r["shard"], r["place"]) for r in targets.read_shards(spark, str(tmp_path / "s")).select("image_path", "shard", "place").distinct().collect()}
    for task in {r["task"] for r in got}:
        own = [at[r["image_path"]] for r in got if r["task"] == task]
        assert own == sorted(own)


def test_arrays(spark, ann, images):
    rows = targets.targets(ann, images, LABELS)
    got = {r["image_path"]: r for r in targets.for_images(rows, ["i3", "bare"], ("area",)).collect()}
    assert set(got) == {"i3", "bare"} and got["bare"]["boxes"] == got["bare"]["labels"] == []
    assert got["i3"]["area"] == [float(k) for k in range(3, 300, 30)] and got["i3"]["boxes"][0] == [3, 3, 23, 23] and got["i3"]["labels"] == [1] * 10
