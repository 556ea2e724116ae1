"""The command line from files to files, and frames whose shapes are text."""

import json

import numpy as np
import pytest

from canopyx import cli
from canopyx.sources import readers, tiff, vector


SCORER = """
import pandas as pd


def find(windows):
    # one sure object at (10, 20) of each image, where a window shows it, and a doubtful one
    w = windows[(windows.window_xmin <= 10) & (windows.window_ymin <= 20)]
    one = pd.DataFrame({"image_path": w.image_path, "window_index": w.window_index, "window_xmin": w.window_xmin, "window_ymin": w.window_ymin, "xmin": 10.0 - w.window_xmin, "ymin": 20.0 - w.window_ymin, "xmax": 20.0 - w.window_xmin, "ymax": 40.0 - w.window_ymin, "label": "0", "score": 0.9, "ann_id": w.window_index.astype("int64")})
    return pd.concat([one, one.assign(xmin=one.xmin + 30, xmax=one.xmax + 30, score=0.01, ann_id=one.ann_id + 1000)])
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    for k in range(2):
        (at / f"i{k}.tif").write_bytes(tiff.encode(np.zeros((90, 120, 3), "u1"), 32, geo=(100.0 * k, 1000.0, 0.5), epsg=32617))
    return str(at)


def test_predict(spark, folder, tmp_path, monkeypatch, capsys):
    (tmp_path / "own_scorer.py").write_text(SCORER)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_scorer.py"))
    (tmp_path / "s.json").write_text(json.dumps({"patch_size": 60, "label_dict": {"Tree": 0}}))
    (tmp_path / "some.csv").write_text("image_path,x\ni1.tif,1\n")
    common = ["predict", "--images", folder, "--scorer", "own_scorer:find", "--settings", str(tmp_path / "s.json")]
    for mode in ("single", "tile"):
        cli.main([*common, "--mode", mode, "--output", str(tmp_path / mode)])
        got = readers.read_csv(spark, str(tmp_path / mode)).collect()
        assert sorted((r["image_path"], r["xmin"], r["ymax"], r["label"]) for r in got) == [(f"i{k}.tif", 10, 40, "Tree") for k in range(2)]
    cli.main([*common, "--mode", "csv", "--csv", str(tmp_path / "some.csv"), "--output", str(tmp_path / "out.gpkg")])
    (r,) = vector.read_geopackage(spark, f"{tmp_path}/out.gpkg/").collect()
    assert (r["xmin"], r["ymax"], r["attributes"]["image_path"]) == (105.25, 989.75, "i1.tif") and vector.crs(spark, f"{tmp_path}/out.gpkg/").first()["epsg"] == 32617
    cli.main([*common, "--output", str(tmp_path / "out.shp")])
    assert vector.read_shapefile(spark, f"{tmp_path}/out.shp/").count() == 2
    for bad in (["--mode", "other", "--output", "x"], ["--scorer", "own_scorer:nope", "--output", "x"]):
        with pytest.raises((SystemExit, ValueError)):
            cli.main([*common, *bad])
    cli.main(["config", "--settings", str(tmp_path / "s.json")])
    assert json.loads(capsys.readouterr().out)["patch_size"] == 60


def test_evaluate(spark, tmp_path):
    rows = "ann_id,image_path,xmin,ymin,xmax,ymax,label,score\n1,a,0,0,10,10,T,0.5\n2,a,20,20,30,30,T,0.5\n"
    (tmp_path / "t.csv").write_text(rows)
    (tmp_path / "p.csv").write_text(rows.replace("20,20,30,30", "50,50,60,60"))
    cli.main(["evaluate", "--predictions", str(tmp_path / "p.csv"), "--truth", str(tmp_path / "t.csv"), "--output", str(tmp_path / "m")])
    got = {r["metric"]: float(r["value"]) for r in readers.read_csv(spark, str(tmp_path / "m")).collect()}
    assert got["recall"] == got["precision"] == 0.5 and got["T_recall"] == 1.0


def test_shapes_in_text(spark):
    frame = lambda *g: spark.createDataFrame([(k, "i", "T", x) for k, x in enumerate(g)], "ann_id long, image_path string, label string, geometry string")
    got = readers.read_annotations(spark, frame("POLYGON ((0 0, 4 0, 4 3, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1)), ((5 5, 6 5, 6 6)))", None), root_dir="r").orderBy("ann_id").collect()
    assert [len(r["rings"]) if r["rings"] else None for r in got] == [1, 2, None] and got[0]["rings"][0][0][2]["x"] == 4.0
    got = readers.read_annotations(spark, frame("POINT (1.5 -2)", "Point(3 4e1)"), root_dir="r").orderBy("ann_id").collect()
    assert [(r["x"], r["y"]) for r in got] == [(1.5, -2.0), (3.0, 40.0)]
    for bad in (frame("POINT (1 2)", "POLYGON ((0 0, 1 1, 2 2))"), frame("LINESTRING (0 0, 1 1)")):
        with pytest.raises(Exception, match="another kind"):
            readers.read_annotations(spark, bad, root_dir="r").collect()
    with pytest.raises(ValueError, match="no annotations"):
        readers.read_annotations(spark, frame("POINT (1 2)").where("false"), root_dir="r")
