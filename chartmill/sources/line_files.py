"""A data source that writes sorted lines as one text file a name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written: where they are, and their names."""

    folder: str
    names: list[str]


class LineFiles(DataSource):
    """Rows (name, line), those of a name together and in order, to the file of that name under the option path.

    A task streams its lines into files in a folder of its own; when all tasks are done the files are moved to their
    place, and what failed or repeated tasks have left goes.  Lines are joined by one line feed, without one at the end.
    """

    @classmethod
    def name(cls) -> str:
        return "linefiles"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: write with mode append")
        return LineWriter(self.options["path"], self.options.get("suffix", ".txt"))


class LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path.rstrip("/"), suffix
        self.staging = f"_writing-{uuid.uuid4().hex}"

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self.place()
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{folder}")
        names: list[str] = []
        out, open_name = None, None
        try:
            for batch in iterator:
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if out is None or name != open_name:
                        if out:
                            out.close()
                        open_name = name
                        names.append(quote(name or "", safe=" ") + self.suffix)
                        out = store.open_output_stream(f"{root}/{folder}/{names[-1]}", buffer_size=1 << 16)
                    else:
                        out.write(b"\n")
                    out.write((line or "").encode())
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.place()
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self.clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clean(*self.place())

    def clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")
