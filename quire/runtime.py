"""Python functions on executors, with the package sent along, and checkpoints."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each application; they need no copy of their own."""
    context = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(here):
        return
    folder = tempfile.mkdtemp(prefix="quire-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "quire"), "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with a function of this package; columns may have any names."""
    ship(df.sparkSession)
    if not isinstance(schema, StructType) or not any("." in c or "`" in c for c in df.columns):
        return df.mapInArrow(function, schema)
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(_renamed(function, plain.names), plain).toDF(*schema.names)


def _renamed(function: Callable, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local master gets a temporary folder, removed at the end; on a cluster
    that would be one machine's, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[[^\]]*\])?$", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quire-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``checkpointed`` for tables of a few numbers a row: one file for each core at most.

    Without Hadoop's native library a local file system starts two processes for every file, and
    while one starts, it counts with all the executor's memory. ``dealt`` is for few rows of a
    long computation, whose tasks stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return checkpointed(df.repartition(cores) if dealt else df.coalesce(cores))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; what is read from there, and the path for ``remove``."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are cores.

    One Parquet row group is read by one task, whatever is done to its rows. On inputs of many
    files this changes nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
