"""One file a row, as a Spark data source: a written folder is whole or not there.

Each attempt of a task writes into a folder of its own under `_temporary`. When all tasks are done the driver moves one folder a
task, not one file a row, into place; an attempt that failed, was repeated or ran twice leaves nothing, and an aborted job removes its
temporary folder. Names are cleaned, and rows whose names are then equal get numbers, before anything is written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.timecode import file_name

SCHEMA = "name string, content binary"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    part: int
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = _file_system(self.path)
        folder, files = f"{root}/_temporary/{self.job}/{part}-{uuid.uuid4().hex}", 0
        for row in iterator:
            if not files:
                fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content if row.content is not None else b""))
            files += 1
        return Written(folder, part, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(FileSelector(root)):
                if old.base_name != "_temporary":
                    (fs.delete_dir if old.type == FileType.Directory else fs.delete_file)(old.path)
        for m in messages:
            if m is not None and m.files:
                fs.move(m.folder, f"{root}/part-{m.part:05d}-{self.job[:8]}")
        fs.delete_dir(f"{root}/_temporary") if fs.get_file_info(f"{root}/_temporary").type == FileType.Directory else None
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = _file_system(self.path)
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")


class Files(DataSource):
    """format("spanloom_files"): rows (name, content), a file each, in a folder a task under the path."""

    @classmethod
    def name(cls) -> str:
        return "spanloom_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def named(rows: DataFrame, name: str, content: str, suffix: str) -> DataFrame:
    """(name, content) with names that any file system takes and no two rows share: of equal names, whatever their case, all but the first get a number.

    Names stay under 200 bytes; rows are told apart by their own name, then their content.
    """
    clean = F.substring(file_name(F.col(name).cast("string")), 1, 48)
    clean = F.regexp_replace(clean, r"[\x00-\x1F]|^\.+|[. ]+$", "_")
    rows = rows.select(clean.alias("_clean"), F.col(name).cast("string").alias("_name"), F.col(content).cast("binary").alias("content"))
    turn = F.row_number().over(Window.partitionBy(F.lower("_clean")).orderBy("_name", F.xxhash64("content")))
    # a number is set behind two lines, which no cleaned name that was alone with its own ends with
    plain = F.regexp_replace("_clean", r"__([0-9]+)$", "__$1_")
    return rows.withColumn("_turn", turn).select(F.concat(F.when(F.col("_turn") == 1, plain).otherwise(F.concat(plain, F.lit("__"), F.col("_turn").cast("string"))), F.lit(f".{suffix}")).alias("name"), "content")


def write_files(rows: DataFrame, path: str, name: str, content: str, suffix: str) -> None:
    """Column `content` of each row as a file named by column `name`, under folders of path; what was there is replaced when the job commits."""
    rows.sparkSession.dataSource.register(Files)
    named(rows, name, content, suffix).write.format("spanloom_files").mode("overwrite").save(path)
