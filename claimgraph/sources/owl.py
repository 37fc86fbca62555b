"""A data source that writes a run's ontology files under their names: patents_<time of the run>_<n>.owl.

Every task writes its files into a folder of the job's own beside the target, under names of its attempt. Only the job's commit gives the files of the
attempts that count their names, so tasks that die or run twice leave nothing: whatever is still in the job's folder goes with it, and a job
that fails has no more than that folder, which its abort deletes.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "claimgraph-owl"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as far as Arrow knows it, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class OwlWriter(DataSourceWriter):
    """Rows (n, text), one file each: text is written as it is, and no two rows may have one n."""

    def __init__(self, folder: str, started: str, overwrite: bool):
        self.folder, self.started, self.overwrite = folder.rstrip("/"), started, overwrite
        self.own = f"{self.folder}/_job-{uuid.uuid4().hex}"
        # Made here and not by tasks, so that tasks that are still at work when the job is given up find no folder to write to.
        system, own = _place(self.own)
        system.create_dir(own, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        system, own = _place(self.own)
        attempt, files = uuid.uuid4().hex, []
        for row in rows:
            path = f"{own}/{row.n}-{attempt}"
            with system.open_output_stream(path) as out:
                out.write(row.text.encode("utf-8", "surrogatepass"))
            files.append((row.n, path))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, own = _place(self.own)
        _, folder = _place(self.folder)
        files = [f for m in messages if m for f in m.files]
        twice = sorted(n for n, k in Counter(n for n, _ in files).items() if k > 1)
        if twice:
            self.abort(messages)
            raise ValueError(f"several files numbered {twice}")
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.startswith("patents_") and f.base_name.endswith(".owl")] if self.overwrite else []
        names = [f"{folder}/patents_{self.started}_{n}.owl" for n, _ in files]
        for (_, path), name in zip(files, names, strict=True):
            system.move(path, name)
        for path in old:
            if path not in names:
                system.delete_file(path)
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        """Delete the job's folder, again where a task has written into it meanwhile."""
        system, own = _place(self.own)
        for tries_left in range(4, -1, -1):
            try:
                if system.get_file_info(own).type == fs.FileType.NotFound:
                    return
                system.delete_dir(own)
            except OSError:
                if not tries_left:
                    raise
                time.sleep(0.5)


class OwlFiles(DataSource):
    """Options: path, the folder; started, the time in the files' names, as yyyyMMddHHmmss."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> OwlWriter:
        if [f.name for f in schema] != ["n", "text"]:
            raise ValueError("columns n and text are asked for")
        return OwlWriter(self.options["path"], self.options["started"], overwrite)


def write_files(files: DataFrame, folder: str, started: str) -> None:
    """Files (n, text) as folder/patents_<started>_<n>.owl; those of earlier runs go when the new ones are there."""
    files.sparkSession.dataSource.register(OwlFiles)
    files.select("n", "text").write.format(FORMAT).option("started", started).mode("overwrite").save(folder)


def read_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the files in a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="patents_*.owl").selectExpr("_metadata.file_name as name", "value as text")
