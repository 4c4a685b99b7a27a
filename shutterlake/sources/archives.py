"""Files of an export as bounded ZIP archives, written by all tasks, seen only when all are done.

``df.write.format("archives").option("path", ...).option("most_bytes", ...).mode("append").save()`` writes rows (name, content). A task
streams its rows into archives in a folder of their own; one is closed when it holds ``most_bytes``. Only when every task has said
which archives it made do these get their names; archives of tasks that were lost or ran twice go with the folder, and so do all
if the write fails. The path is one that driver and executors share, of any file system that Arrow knows.

Defined results: a null content is an empty file; a null name is refused; an empty table makes no archive. Names must be distinct:
``rollups.numbered_names`` makes them so.
"""

from __future__ import annotations

import dataclasses
import uuid
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MOST_BYTES = 256 << 20


@dataclasses.dataclass
class Made(WriterCommitMessage):
    """The archives of one task, in order."""

    names: list[str]


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("archives are made of columns name and content")
        return Writer(self.options["path"], int(self.options.get("most_bytes", MOST_BYTES)))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer(DataSourceWriter):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes, self.run = path.rstrip("/"), most_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Made:
        store, path = _opened(self.path)
        store.create_dir(f"{path}/_{self.run}", recursive=True)
        names, archive, out, size = [], None, None, 0
        for row in iterator:
            if row["name"] is None:
                raise ValueError("a file without a name")
            if archive is None:
                names.append(f"{uuid.uuid4().hex}.zip")
                out = store.open_output_stream(f"{path}/_{self.run}/{names[-1]}")
                archive, size = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0
            content = row["content"] or b""
            archive.writestr(zipfile.ZipInfo(row["name"]), content if isinstance(content, bytes | str) else bytes(content), zipfile.ZIP_DEFLATED)
            size += len(content)
            if size >= self.most_bytes:
                archive.close()
                out.close()
                archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Made(names)

    def commit(self, messages: list[Made | None]) -> None:
        store, path = _opened(self.path)
        made = [n for m in messages if m for n in m.names]
        for k, name in enumerate(made):
            store.move(f"{path}/_{self.run}/{name}", f"{path}/export-{self.run}-{k:05d}.zip")
        self._clear()

    def abort(self, messages: list[Made | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = _opened(self.path)
        if store.get_file_info(f"{path}/_{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_{self.run}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
