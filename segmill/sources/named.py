"""A data source that writes files with names of their own: rows (name, line), one file a name, whose rows are in one
task. A task needs no order of its rows: lines are held by name, beyond HELD bytes in a file of the task's own.

Tasks write the files of their partition beside their places, under names that readers pass over, and
move them once all are complete; what a failed task has begun is removed by that task, and its next
attempt writes the same files. So the driver neither lists nor renames anything.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of lines that a task holds before they go to a file of its own.
HELD = 32 << 20
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = pafs.FileSystem.from_uri(self.path)
        mark = uuid.uuid4().hex
        done: list[tuple[str, str]] = []
        folders: set[str] = set()
        held: dict[str, bytearray] = {}
        runs: dict[str, list[tuple[int, int]]] = {}  # of a name's lines in the task's own file
        size = 0
        fs.create_dir(top)
        try:
            with tempfile.TemporaryFile() as own:
                for b in iterator:
                    for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        x = f"{line or ''}\n".encode()
                        held.setdefault(name, bytearray()).extend(x)
                        size += len(x)
                        if size >= HELD:
                            for k, body in held.items():
                                runs.setdefault(k, []).append((own.tell(), len(body)))
                                own.write(body)
                            held, size = {}, 0
                for name in dict.fromkeys([*runs, *held]):
                    folder, _, last = f"{top}/{name}".rpartition("/")
                    if folder not in folders:
                        fs.create_dir(folder)
                        folders.add(folder)
                    at = f"{folder}/_{mark}-{last}"
                    done.append((at, f"{folder}/{last}"))
                    with fs.open_output_stream(at) as out:
                        if self.header:
                            out.write(f"{self.header}\n".encode())
                        for begin, n in runs.get(name, ()):
                            own.seek(begin)
                            for i in range(0, n, CHUNK):
                                out.write(own.read(min(CHUNK, n - i)))
                        out.write(held.get(name, b""))
            for at, target in done:
                fs.move(at, target)
        except BaseException:
            for at, _ in done:
                if fs.get_file_info(at).type == pafs.FileType.File:
                    fs.delete_file(at)
            raise
        return Written(len(done))


class NamedFiles(DataSource):
    """Options: path, a folder's address that pyarrow opens, and header, a first line for each file."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("header", ""))
