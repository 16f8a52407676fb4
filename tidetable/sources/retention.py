"""Removal of old local snapshots in two phases, safe to break off and to run again.

Phase one writes a manifest: the files of folders that are old enough and whose every file is in the remote store with the same
size. Phase two deletes what a manifest lists, on the executors, each file only if it is still as the manifest says, and then marks the
manifest as done. Nothing is deleted that no manifest lists; a manifest that isn't done is taken up by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exports import removable

RESULT = "path string, outcome string"


def local_files(spark: SparkSession, root: str) -> DataFrame:
    """feed, date, name, size, path of <root>/<feed>/<date>/<file>; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3).alias("feed"), F.element_at(parts, -2).alias("date"), F.element_at(parts, -1).alias("name"), "size", "path").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_manifest(local: DataFrame, remote: DataFrame, manifests: str, *, days: int, today: str) -> str:
    """Phase one: where the manifest (path, size) was written. local: from local_files; remote: feed, date, name, size."""
    folders = removable(local.drop("path"), remote, days=days, today=today).select("feed", "date").distinct()
    path = f"{manifests}/{uuid.uuid4().hex}"
    local.join(folders, ["feed", "date"], "left_semi").select("path", "size").write.parquet(f"{path}/files")
    return path


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outcome = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
            fs, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.NotFound:
                outcome.append("gone")
            elif info.size != size:
                outcome.append("changed")
            else:
                fs.delete_file(inner)
                outcome.append("deleted")
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(outcome, pa.string())], ["path", "outcome"])


def finish(spark: SparkSession, manifest: str) -> DataFrame:
    """Phase two: path, outcome ('deleted', 'gone' already, 'changed' since and left alone) of a manifest's files. Again, it tells what the first end told."""
    if not _exists(spark, f"{manifest}/done/_SUCCESS"):
        files = spark.read.schema("path string, size bigint").parquet(f"{manifest}/files")
        files.repartition("path").mapInArrow(_delete, RESULT).write.mode("overwrite").parquet(f"{manifest}/done")
    return spark.read.schema(RESULT).parquet(f"{manifest}/done")


def pending(spark: SparkSession, manifests: str) -> list[str]:
    """Manifests that were written whole but aren't done (a run each; names alone are listed)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(manifests)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(jvm_path)]
    return sorted(p for p in found if _exists(spark, f"{p}/files/_SUCCESS") and not _exists(spark, f"{p}/done/_SUCCESS"))


def clean(spark: SparkSession, root: str, remote: DataFrame, manifests: str, *, days: int, today: str) -> list[str]:
    """Ends what earlier runs left, then removes what is due now. The manifests that were ended."""
    todo = [*pending(spark, manifests), write_manifest(local_files(spark, root), remote, manifests, days=days, today=today)]
    for m in todo:
        finish(spark, m)
    return todo
