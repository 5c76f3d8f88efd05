"""Keyed Parquet tables as a sequence of versions, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the session's checkpoint folder. Where neither is set, a folder of our own is
    taken on one machine only; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return folder.rstrip("/")


class Versions:
    """Folders ``v0, v1, ...`` below ``root``. A version counts once its write has committed (``_SUCCESS``), so one
    that a lost driver left half written is passed over and written anew."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def done(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        if not self.files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and self.files.exists(self._path(f"{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The version asked for, or the newest; None if there is none."""
        known = self.done()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.root}/v{known[-1] if version is None else version}")

    def write(self, rows: DataFrame, version: int, by: str | None = None) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.root}/v{version}")

    def keep(self, newest: int) -> None:
        """Deletes all but the ``newest`` versions; readers of the last ones are not disturbed."""
        for n in self.done()[:-newest]:
            self.files.delete(self._path(f"v{n}"), True)


class VersionedTable(Versions):
    """A keyed table. Each change reads the newest version below its own number and writes the next folder: nothing
    is overwritten while it is read, and a change that is run again with its number changes nothing."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        super().__init__(spark, root)
        self.key = key

    def upsert(self, rows: DataFrame, version: int) -> None:
        """``rows`` replace those of the same key (null keys are one key); of several new rows of a key the one
        that is last by its other columns counts."""
        known = self.done()
        if version in known:
            return
        others = [F.desc(c) for c in rows.columns if c != self.key] or [F.col(self.key)]
        fresh = rows.withColumn("__one", F.row_number().over(Window.partitionBy(self.key).orderBy(*others))).where("__one = 1").drop("__one")
        before = [n for n in known if n < version]
        if before:
            old = self.read(before[-1])
            keys = fresh.select(F.col(self.key).alias("__key"))
            fresh = old.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti").select(*rows.columns).unionByName(fresh)
        self.write(fresh, version)
