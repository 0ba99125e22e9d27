"""Tables that a plan writes once and reads several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path not used before below spark.checkpoint.dir; what is written there goes when the driver's JVM ends.

    Without that setting a temporary folder serves, on a local master only.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="silt-checkpoint-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a fresh path: computed once, whatever reads it and however often."""
    path = fresh_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """A small table in a folder, replaced as a whole: each version is a folder of its own, the last whole one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def _whole(self) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.root)]
        return sorted(int(n) for n in names if n.isdigit() and self.fs.exists(self._at(f"{n}/_SUCCESS")))

    def last(self) -> DataFrame | None:
        found = self._whole()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def put(self, df: DataFrame) -> None:
        found = self._whole()
        df.write.mode("overwrite").parquet(f"{self.path}/{found[-1] + 1 if found else 0}")
        for n in found:
            self.fs.delete(self._at(str(n)), True)
