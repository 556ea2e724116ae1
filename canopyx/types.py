"""Schemas of the relations that operators exchange. Unknown columns pass through unchanged."""

from pyspark.sql import types as T

_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX)))  # parts, rings, vertices

BOX = ("xmin", "ymin", "xmax", "ymax")
POINT = ("x", "y")

_TYPES = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "rings": RINGS}


def _schema(names: str) -> T.StructType:
    """From `name kind` pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (x.split() for x in names.split(","))])


ANNOTATION = _schema("ann_id long, image_path string, label string, score double, geom_type string, xmin double, ymin double, xmax double, ymax double, x double, y double, rings rings, root_dir string")
WINDOW = _schema("image_path string, window_index int, window_xmin int, window_ymin int, window_w int, window_h int")
MATCH = _schema("image_path string, truth_id long, prediction_id long, IoU double, distance double, score double, predicted_label string, true_label string, match boolean")
CLASS_METRIC = _schema("label string, recall double, precision double, size long")


def geometry_kind(columns: list[str]) -> str:
    """box, polygon or point, from column names; raises if none fits."""
    have = set(columns)
    if have.issuperset(BOX):
        return "box"
    if have & {"rings", "polygon", "geometry"}:
        return "polygon"
    if have.issuperset(POINT):
        return "point"
    raise ValueError(f"no geometry columns among {sorted(have)}")
