"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a Python task works on at a time.
STEP_BYTES = 8 << 20
#: Removes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where it is unset and Spark runs in one machine, as in tests."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors. The
    shuffle files of the write go with its end; otherwise they stay until the driver's next garbage collection."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialize() once all that reads them is a written table itself: nothing goes back behind those."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            if shared_dir(table.sparkSession).split(":", 1)[-1].strip("/") not in folder:
                raise ValueError(f"{folder} is not in the shared folder")
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: Spark must not send it through the driver. Left alone it goes by the
    bytes of a written table, which tell little of the rows that an explode makes of them."""
    return df.hint("merge")


def fold(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def integral(df: DataFrame, name: str) -> None:
    """Raises unless the column holds whole numbers; ids of other types would be lost in a cast."""
    if not isinstance(df.schema[name].dataType, T.IntegralType):
        raise TypeError(f"{name} must hold whole numbers, not {df.schema[name].dataType.simpleString()}")


def raw_text(text):
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def steps(batches: Iterator[pa.RecordBatch], by: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes in binary column `by`, one row at least."""
    for batch in batches:
        sizes, start, total = pc.binary_length(batch.column(by)).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def out_schema(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of df's columns `names` and then those of the DDL `more`."""
    return T.StructType([df.schema[c] for c in names] + T.StructType.fromDDL(more).fields)


def map_arrow(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], by: int) -> DataFrame:
    """mapInArrow with a function that each task makes once; it sees slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in steps(batches, by):
            yield step(part)

    return df.mapInArrow(run, schema)
