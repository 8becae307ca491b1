"""Session and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Settings that the plans here count on; a cluster's own values for the rest stand.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(app: str = "rillflow", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless they find it on their path anyway."""
    app = spark.sparkContext.applicationId
    if app in _shipped or os.getcwd() == str(_ROOT) or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="rillflow-code-")) / "rillflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((_ROOT / "rillflow").rglob("*.py")):
            z.write(file, file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or one of this machine's where it is unset and no other machine takes part."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rillflow.work.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rillflow-')}"
        spark.conf.set("rillflow.work.dir", named)
    return named.rstrip("/")


#: Bytes of files up to which Spark may broadcast a written table: it goes by the files, which are far smaller than the rows in memory.
SMALL = 256 * 1024


class Rounds:
    """Tables of an iteration, each written to the shared folder: of those that are kept the last of a name, of those appended all. Joins with large ones are shuffled, not broadcast by the driver."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, list[str]] = {}
        self.schemas: dict[str, StructType] = {}

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{name}-{self.n}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        self.schemas[name] = df.schema
        return self._read(df.schema, [path])

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table in the place of the last of its name."""
        out = self._write(name, df)
        self._drop(self.paths[name][:-1])
        self.paths[name] = self.paths[name][-1:]
        return out

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table beside those of its name; returns what was added."""
        return self._write(name, df)

    def all(self, name: str) -> DataFrame:
        return self._read(self.schemas[name], self.paths[name])

    def close(self, *but: str) -> None:
        for name in [n for n in self.paths if n not in but]:
            self._drop(self.paths.pop(name))

    def _read(self, schema: StructType, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(*paths)
        size = 0
        for path in paths:
            fs, target = self._file(path)
            size += fs.getContentSummary(target).getLength()
        return rows.hint("merge") if size > SMALL else rows

    def _file(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            fs, target = self._file(path)
            fs.delete(target, True)
