"""evaluate: predictions against truth, from CSV files, to a folder of metrics. predict: a scorer over images, to CSV or vector
files. config: the settings with a file's over them."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from canopyx import config, scorer
from canopyx.operators import coords, evaluate
from canopyx.sources import readers, tiff, vector_sink, writers


def _settings(path: str | None) -> config.Config:
    if not path:
        return config.load()
    with open(path, encoding="utf-8") as f:
        return config.load(json.load(f))


def load_scorer(name: str) -> scorer.Scorer:
    """A function from `module:name`."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None) if function else None
    if not callable(found):
        raise ValueError(f"no function {name!r}; give module:function")
    return found


def predict(spark: SparkSession, images: DataFrame, score: scorer.Scorer, settings: config.Config, mode: str) -> DataFrame:
    """single: whole images; csv: whole images, suppressed where classes mix; tile: windows and their mosaic. Detections below the
    settings' score go, and labels get their names."""
    names = {number: name for name, number in settings.label_dict.items()}
    if mode == "tile":
        found = scorer.predict_tile(images, score, settings.patch_size, settings.patch_overlap, settings.nms_thresh, names)
    elif mode in ("single", "csv"):
        found = (scorer.predict_image if mode == "single" else scorer.predict_file)(images, score, names, settings.nms_thresh)
    else:
        raise ValueError(f"mode {mode!r} is none of single, tile, csv")
    return found.where(found["score"] > settings.score_thresh)


def save(found: DataFrame, images: DataFrame, path: str) -> None:
    """A folder of GeoPackages or shapefiles, in projected coordinates where an image has any, by the path's ending; else CSV."""
    kind = {"gpkg": "geopackages", "shp": "shapefiles"}.get(path.rpartition(".")[2])
    if kind is None:
        return writers.write_csv(found, path)
    known = images.where("left is not null")
    codes = [r["epsg"] for r in known.select("epsg").distinct().limit(2).collect()]
    if len(codes) > 1:
        raise ValueError("the images lie in more than one coordinate system")
    plain = found.join(known.select("image_path"), "image_path", "left_anti")
    projected = coords.to_geo(found, known).select(found.columns).unionByName(plain.selectExpr(*(f"cast({c} as double) {c}" if c in ("xmin", "ymin", "xmax", "ymax") else c for c in found.columns)))
    vector_sink.write_features(projected, path, kind, codes[0] if codes else None, "overwrite")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="canopyx")
    sub = p.add_subparsers(dest="what", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--predictions", required=True)
    e.add_argument("--truth", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--iou", type=float, default=evaluate.IOU_THRESHOLD)
    r = sub.add_parser("predict")
    r.add_argument("--images", required=True, help="tiled TIFF files")
    r.add_argument("--csv", help="only images that stand in this file's column image_path")
    r.add_argument("--scorer", required=True, help="module:function, from a batch of windows to detections")
    r.add_argument("--mode", default="single")
    r.add_argument("--output", required=True, help="a folder; .gpkg and .shp for vector files")
    c = sub.add_parser("config")
    for s in (r, c):
        s.add_argument("--settings", help="a JSON file")
    a = p.parse_args(args)
    if a.what == "config":
        print(json.dumps(dataclasses.asdict(_settings(a.settings)), indent=1))
        return
    spark = SparkSession.builder.getOrCreate()
    if a.what == "evaluate":
        found = evaluate.evaluate(readers.read_csv(spark, a.predictions), readers.read_csv(spark, a.truth), "box", a.iou)
        writers.write_metrics(found["macro"], found["class"], a.output)
        return
    if a.mode not in ("single", "tile", "csv"):
        p.error(f"mode {a.mode!r} is none of single, tile, csv")
    images = tiff.layouts(spark, a.images)
    if a.csv:
        images = images.join(readers.read_csv(spark, a.csv).select("image_path").distinct(), "image_path", "left_semi")
    save(predict(spark, images, load_scorer(a.scorer), _settings(a.settings), a.mode), images, a.output)


if __name__ == "__main__":
    main()
