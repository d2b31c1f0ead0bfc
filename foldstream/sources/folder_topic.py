"""A topic in a shared folder, with offsets: a streaming data source and sink.

Each micro-batch of the sink adds files of lines, and then one commit file that names them. Lines count from then on, in
the order of the commits; files without a commit, of a task or a batch that did not end, never count. A batch that runs again
writes its commit anew, so nothing is doubled. The offset of a reader is the last commit it has read; it starts from the first
one or, with `starting` = latest, after the last one that is there when the stream starts for the first time.

The folder is reached through pyarrow, so it must be in a store that knows (a shared disk, s3, hdfs, gs). One stream at a
time writes to a topic.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "folder_topic"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def commits(path: str) -> list[int]:
    """Numbers of the commits of a topic, ascending."""
    fs, root = _store(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json"))


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, starting: str):
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        there = commits(self.path) if self.starting == "latest" else []
        return {"after": there[-1] if there else -1}

    def latestOffset(self) -> dict:
        there = commits(self.path)
        return {"after": there[-1] if there else -1}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        fs, root = _store(self.path)
        out = []
        for n in commits(self.path):
            if start["after"] < n <= end["after"]:
                with fs.open_input_stream(f"{root}/commits/{n}.json") as f:
                    out += [_File(name) for name in json.loads(f.read())["files"]]
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, root = _store(self.path)
        with fs.open_input_stream(f"{root}/{partition.path}") as f:
            for line in f.read().decode().split("\n")[:-1]:
                yield (json.loads(line),)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        fs, root = _store(self.path)
        name, out = f"lines/{uuid.uuid4().hex}", None
        for row in iterator:
            if out is None:
                fs.create_dir(f"{root}/lines", recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            out.write((json.dumps(row[0]) + "\n").encode())  # a line may hold anything, also a newline
        if out is not None:
            out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list, batchId: int) -> None:
        fs, root = _store(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        made = f"{root}/commits/{uuid.uuid4().hex}.new"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"files": sorted(m.file for m in messages if m is not None and m.file)}).encode())
        fs.move(made, f"{root}/commits/{batchId}.json")  # there as a whole or not at all

    def abort(self, messages: list, batchId: int) -> None:
        """Files without a commit do not count."""


class FolderTopic(DataSource):
    """Options: path, starting (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> _Reader:
        starting = self.options.get("starting", "latest")
        if starting not in ("earliest", "latest"):
            raise ValueError(f"starting: {starting}")
        return _Reader(self.options["path"], starting)

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderTopic)
