"""A pull source with a cursor: a stream over a folder of documents that grows.

A batch is what lies between two offsets. An offset is the last name pulled and how many documents that makes, so a batch that is run again after a
failure reads the same documents, a restart goes on where the last commit was, and a query's progress tells the count. A batch's
documents are dealt to tasks in runs of `run` names, and each task reads its own.

    spark.dataSource.register(DocumentFolder)
    spark.readStream.format("document_folder").option("path", folder).load()

Names must grow: a document that comes later has a later name, as the entries of a cursor do. Names that begin with a dot or an underscore
are not documents yet. A document that is no UTF-8 has a null value and an error. The folder is any that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Run(InputPartition):
    """Names that one task reads, and the number of the first."""

    def __init__(self, first: int, names: list[str]):
        super().__init__(None)
        self.first, self.names = first, names


class _Folder:
    def __init__(self, options: dict):
        self.path, self.size = options.get("path"), int(options.get("run", 100))
        if not self.path:
            raise ValueError("option path is missing")
        if self.size < 1:
            raise ValueError("option run is 1 or more")

    def _open(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def names(self, after: str = "", upto: str | None = None) -> list[str]:
        from pyarrow import fs

        system, root = self._open()
        found = (f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file)
        return sorted(n for n in found if n[0] not in "._" and n > after and (upto is None or n <= upto))

    def runs(self, names: list[str], first: int) -> list[Run]:
        return [Run(first + k, names[k : k + self.size]) for k in range(0, len(names), self.size)]

    def read(self, partition: Run) -> Iterator[tuple]:
        system, root = self._open()
        for k, name in enumerate(partition.names):
            with system.open_input_stream(f"{root}/{name}") as f:
                raw = f.readall()
            try:
                yield partition.first + k, name, raw.decode(), None
            except UnicodeDecodeError as e:
                yield partition.first + k, name, None, str(e)


class FolderStream(_Folder, DataSourceStreamReader):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": "", "count": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        # the names up to the last offset are counted once a reader, later ones as they come
        known = self.last or self.initialOffset()
        new = self.names(known["after"])
        self.last = {"after": new[-1], "count": known["count"] + len(new)} if new else known
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return self.runs(self.names(start["after"], end["after"]), start["count"])

    def commit(self, end: dict) -> None:
        """Nothing to keep: the folder is never changed."""


class FolderBatch(_Folder, DataSourceReader):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)

    def partitions(self) -> list[Run]:
        return self.runs(self.names(), 0) or [Run(0, [])]


class DocumentFolder(DataSource):
    """Rows (number, name, value, error): number counts the documents from 0, value is a document's text."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return "number bigint, name string, value string, error string"

    def reader(self, schema: object) -> FolderBatch:
        return FolderBatch(self.options)

    def streamReader(self, schema: object) -> FolderStream:  # noqa: N802
        return FolderStream(self.options)
