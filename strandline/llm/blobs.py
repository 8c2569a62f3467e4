"""Files of raw bytes in the shared folder, written and read by tasks; a table of places says which of them count.

A task attempt appends to a file of its own, and the rows that name its parts are written by Spark, which
keeps those of one attempt a task; the file of a lost or repeated attempt is never named.  Works wherever
``pyarrow.fs`` does (local and mounted paths, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid

from pyarrow import fs


class Writer:
    """Opens its file with the first part, so that a task without rows leaves none."""

    def __init__(self, folder: str):
        self.folder, self.path, self.size, self.out = folder, "", 0, None

    def append(self, data: bytes) -> int:
        """Where the data begins."""
        if self.out is None:
            where, base = fs.FileSystem.from_uri(self.folder)
            where.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            self.path, self.out = f"{self.folder}/{name}", where.open_output_stream(f"{base}/{name}")
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def read(path: str, start: int, size: int) -> bytes:
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        return f.read_at(size, start)
