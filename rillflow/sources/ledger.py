"""Tables written by runs that count as a whole or not at all.

A run stages tables (``Run.stage``) and publishes them together (``Run.publish``), by moving one small file into place. Readers
(``rows``) see the files that published runs list, nothing else: not those of tasks that were tried again, of failed jobs or of runs that
never ended. A run that is repeated under its name takes the place of the earlier one, so its rows never count twice. The folder must be one that driver
and executors share, on a file system that moves a file in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Bytes of rows that a task holds before it writes them.
ROW_GROUP = 32 << 20


def _files(folder: str):
    """(file system, path) of a folder, named by a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, content: dict) -> None:
    """A small file, there as a whole or not at all."""
    system, base = _files(folder)
    path = f"{base}/{name}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        out.write(json.dumps(content).encode())
    system.move(draft, path)


def _get(folder: str, name: str) -> dict | None:
    system, base = _files(folder)
    try:
        with system.open_input_stream(f"{base}/{name}") as file:
            return json.loads(file.readall())
    except FileNotFoundError:
        return None


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    partition: int
    file: str | None
    rows: int


class LedgerSink(DataSource):
    """``df.write.format("ledger")`` with folder, table and attempt; used by ``Run.stage``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LedgerWriter(self.options["folder"], self.options["table"], self.options["attempt"], schema)


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, table: str, attempt: str, schema: StructType):
        self.folder, self.table, self.attempt, self.schema = folder, table, attempt, schema

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.parquet as pq

        partition, rows, out = TaskContext.get().partitionId(), 0, None
        name = f"data/{self.attempt}/{self.table}/part-{partition:06d}-{uuid.uuid4().hex}.parquet"
        system, base = _files(self.folder)
        waiting: list = []

        def flush() -> None:
            nonlocal out
            if out is None:
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                out = pq.ParquetWriter(f"{base}/{name}", waiting[0].schema, filesystem=system)
            out.write_table(pa.Table.from_batches(waiting))
            waiting.clear()

        try:
            for batch in iterator:
                if batch.num_rows:
                    waiting.append(batch)
                    rows += batch.num_rows
                    if sum(b.nbytes for b in waiting) >= ROW_GROUP:
                        flush()
            if waiting:
                flush()
        finally:
            if out is not None:
                out.close()
        return Written(partition, name if rows else None, rows)

    def commit(self, messages: list) -> None:
        found = sorted((m for m in messages if m and m.file), key=lambda m: m.partition)
        _put(self.folder, f"staged/{self.attempt}/{self.table}.json", {"schema": self.schema.json(), "files": [m.file for m in found], "rows": sum(m.rows for m in found)})

    def abort(self, messages: list) -> None:
        system, base = _files(self.folder)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{base}/{m.file}")


class Run:
    """One run's tables. ``name`` tells runs apart: the same name again means the same work again."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a name of a run: {name!r}")
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.attempt = f"{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, dict] = {}

    def stage(self, table: str, df: DataFrame) -> int:
        """Write a table, unseen as yet; its number of rows."""
        self.spark.dataSource.register(LedgerSink)
        df.write.format("ledger").mode("append").options(folder=self.folder, table=table, attempt=self.attempt).save()
        self.tables[table] = _get(self.folder, f"staged/{self.attempt}/{table}.json")
        return self.tables[table]["rows"]

    def publish(self) -> None:
        """All staged tables are there from now on, in place of those of an earlier run of the name."""
        _put(self.folder, f"runs/{self.name}.json", {"attempt": self.attempt, "tables": self.tables})


def runs(folder: str) -> list[str]:
    """Names of the published runs."""
    from pyarrow import fs

    system, base = _files(folder.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(f"{base}/runs", allow_not_found=True))
    return sorted(f.base_name[: -len(".json")] for f in found if f.base_name.endswith(".json"))


def rows(spark: SparkSession, folder: str, table: str, names: list[str] | None = None) -> DataFrame:
    """Rows of a table from all published runs, or those named. Columns that a run did not have are null. A table that no run has is an error."""
    folder = folder.rstrip("/")
    held = [r["tables"][table] for n in names or runs(folder) if (r := _get(folder, f"runs/{n}.json")) and table in r["tables"]]
    if not held:
        raise FileNotFoundError(f"no run has a table {table}")
    by_schema: dict[str, list[str]] = {}
    for h in held:
        by_schema.setdefault(h["schema"], []).extend(h["files"])
    out = None
    for schema, files in by_schema.items():
        kind = StructType.fromJson(json.loads(schema))
        one = spark.read.schema(kind).parquet(*[f"{folder}/{f}" for f in files]) if files else spark.createDataFrame([], kind)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def vacuum(folder: str) -> list[str]:
    """Delete what no published run lists: earlier attempts, failed tasks, staged lists. Only while no run is being written. The attempts deleted."""
    from pyarrow import fs

    folder = folder.rstrip("/")
    system, base = _files(folder)
    kept = {}
    for n in runs(folder):
        run = _get(folder, f"runs/{n}.json")
        kept[run["attempt"]] = {f for t in run["tables"].values() for f in t["files"]}
    gone = []
    for one in system.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)):
        if one.base_name not in kept:
            system.delete_dir(one.path)
            gone.append(one.base_name)
            continue
        for file in system.get_file_info(fs.FileSelector(one.path, recursive=True)):
            name = file.path[len(base) + 1 :]
            if file.type == fs.FileType.File and name not in kept[one.base_name]:
                system.delete_file(file.path)
                gone.append(name)
    if system.get_file_info(f"{base}/staged").type == fs.FileType.Directory:
        system.delete_dir(f"{base}/staged")
    return sorted(gone)
