"""One file for each row, under the row's own name.

Spark's writers choose the names of their files. This one stages each task's files in a folder of its own and moves them
to their names when the job commits, so tasks that are lost, repeated or stopped leave nothing behind.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Staged(WriterCommitMessage):
    folder: str


def _open(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:"):
        address = "/" + address[5:].lstrip("/")
    return (fs.LocalFileSystem(), address) if "://" not in address else fs.FileSystem.from_uri(address)


class _Writer(DataSourceWriter):
    def __init__(self, address: str):
        self.address, self.job = address.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _open(self.address)
        folder, seen = f"{root}/{self.job}/{TaskContext.get().taskAttemptId()}", set()
        for row in iterator:
            name = row["file"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"no name for a file: {name!r}")
            if name in seen:
                raise ValueError(f"two rows for the file {name}")
            seen.add(name)
            path = f"{folder}/{name}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write((row["content"] or "").encode())
        return _Staged(folder)

    def commit(self, messages: list) -> None:
        """Moves the files of each task that counts; those of other attempts go with the staging folder."""
        system, root = _open(self.address)
        for message in messages:
            if message is None or system.get_file_info(message.folder).type == fs.FileType.NotFound:
                continue  # a task without rows
            for found in system.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                if found.type == fs.FileType.File:
                    target = f"{root}/{found.path[len(message.folder) :].lstrip('/')}"
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    if system.get_file_info(target).type == fs.FileType.File and system.type_name != "local":
                        system.delete_file(target)  # where a move does not replace
                    system.move(found.path, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _open(self.address)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """Rows (file, content) as files under a path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_named(rows: DataFrame, path: str) -> None:
    """Each row (file, content) as the file of that name under path; files of other names stay, two rows of one name are an error."""
    rows.sparkSession.dataSource.register(NamedFiles)
    one_task_a_name = rows.select("file", "content").repartition("file")
    one_task_a_name.write.format("named_files").mode("append").save(path)
