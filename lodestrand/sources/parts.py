"""A data source writer of a file for each task, none of which is seen before all tasks have ended.

Attempts write to a hidden folder beside the files; the commit renames what the
successful ones left and writes _SUCCESS, an abort removes the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .bgzf import opened


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    endings: tuple[str, ...] = ()


class PartsWriter(DataSourceArrowWriter):
    """Files part-00000-<job><ending>, by number of task, with files of further endings beside them."""

    ending = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex[:12]

    @property
    def hidden(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def put(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, bytes]]:
        """Write a file; how many rows it has, and what goes to files beside it, by ending."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = opened(self.hidden)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}{self.ending}"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            rows, more = self.put(out, iterator)
        if not rows and task.partitionId():  # an empty table still has one file
            fs.delete_file(f"{folder}/{name}")
            return Written(None)
        for end, data in more.items():
            with fs.open_output_stream(f"{folder}/{name}{end}", compression=None) as out:
                out.write(data)
        return Written(name, tuple(more))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = opened(self.path)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if x.type == pafs.FileType.File:
                    fs.delete_file(x.path)
        hidden = opened(self.hidden)[1]
        for m in messages:
            if m and m.name:
                for end in (*m.endings, ""):  # what is beside a file is there before it
                    fs.move(f"{hidden}/{m.name}{end}", f"{folder}/{m.name.rsplit('-', 1)[0]}{self.ending}{end}")
        self.abort(messages)
        fs.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, hidden = opened(self.hidden)
        if fs.get_file_info(hidden).type == pafs.FileType.Directory:
            fs.delete_dir(hidden)
