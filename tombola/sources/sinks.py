"""Publishing: one JSON document, written by tasks and put in place as a whole.

Every task writes its rows beside the target, in a folder of the run's own. Only
when all of them are done does the driver put the parts together, in the order of
partitions and one block at a time, and move the new document over the old one. So a
failed task, or a driver that dies on the way, leaves the document that was
there. (An attempt that still runs when the run is given up can leave its part beside it.)"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Bytes that the driver holds while it puts parts together.
BLOCK = 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, array: bool):
        self.path, self.array = path, array
        self.folder = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Part:
        """An attempt's own file: one that is run again, or twice at once, disturbs
        nothing, as only the paths of attempts that count reach commit()."""
        task = TaskContext.get()
        files, folder = _at(self.folder)
        files.create_dir(folder, recursive=True)
        path, n = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with files.open_output_stream(path) as out:
            for row in rows:
                out.write((("," if n and self.array else "") + "\n" + row[0]).encode() if self.array else row[0].encode())
                n += 1
        return Part(task.partitionId(), path, n)

    def commit(self, messages: list[Part | None]) -> None:
        files, target = _at(self.path)
        new, begun = f"{target}.new-{uuid.uuid4().hex}", False
        with files.open_output_stream(new) as out:
            out.write(b"[" if self.array else b"")
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write(b"," if begun and self.array else b"")
                with files.open_input_stream(part.path) as of:
                    shutil.copyfileobj(of, out, BLOCK)
                begun = True
            out.write(b"\n]\n" if self.array else b"")
        files.move(new, target)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = _at(self.folder)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class JsonDocument(DataSource):
    """df.write.format("json_document"): a frame of one string column, each row a
    JSON value, as one array in the file `path`; with array=false the rows as they are, one
    after another. Executors and the driver have to reach the path (a shared file system)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema: StructType, overwrite: bool) -> _DocumentWriter:
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, StringType):
            raise ValueError("a json_document takes one string column")
        if not overwrite:
            raise ValueError('a json_document replaces what is there: mode("overwrite")')
        return _DocumentWriter(self.options["path"], self.options.get("array", "true").lower() == "true")


def write_document(values: DataFrame, path: str, array: bool = True) -> None:
    values.sparkSession.dataSource.register(JsonDocument)
    values.write.format("json_document").mode("overwrite").option("array", str(array).lower()).save(path)
