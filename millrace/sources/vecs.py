"""fvecs and ivecs files (int32 dimension, then that many float32 or int32, little endian) as a data source, both ways."""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MOST_DIM = 1 << 20


def read_vecs(path: str, kind: str, first: int = 0, until: int | None = None) -> Iterator[tuple[int, list]]:
    """(position, values) of rows first to until. A dimension outside 1..2^20, one that differs, or a cut row is an error."""
    with open(path, "rb") as f:
        head = f.read(4)
        if not head:
            return
        dim = struct.unpack("<i", head)[0]
        if not 0 < dim <= MOST_DIM:
            raise ValueError(f"dimension {dim} in {path}")
        width = 4 + 4 * dim
        f.seek(first * width)
        at = first
        while until is None or at < until:
            row = f.read(width)
            if not row:
                return
            if len(row) != width or struct.unpack("<i", row[:4])[0] != dim:
                raise ValueError(f"ragged row {at} in {path}")
            yield at, np.frombuffer(row[4:], "<f4" if kind == "fvecs" else "<i4").tolist()
            at += 1


class _Part(InputPartition):
    def __init__(self, path: str, first: int, until: int | None):
        self.path, self.first, self.until = path, first, until


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, most: int | None, per_task: int):
        self.path, self.kind, self.most, self.per_task = path, kind, most, per_task

    def partitions(self) -> list[InputPartition]:
        size = os.path.getsize(self.path)
        if not size:
            return [_Part(self.path, 0, 0)]
        with open(self.path, "rb") as f:
            dim = struct.unpack("<i", f.read(4))[0]
        if not 0 < dim <= MOST_DIM:
            raise ValueError(f"dimension {dim} in {self.path}")
        rows = -(-size // (4 + 4 * dim))
        rows = min(rows, self.most) if self.most is not None else rows
        return [_Part(self.path, a, min(a + self.per_task, rows)) for a in range(0, rows, self.per_task)] or [_Part(self.path, 0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        yield from read_vecs(part.path, self.kind, part.first, part.until)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """One part file a task, joined in order of position at commit."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, rows) -> WriterCommitMessage:
        part = f"{self.path}.part-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for r in sorted(rows, key=lambda r: r[0]):
                v = np.asarray(r[1], "<f4" if self.kind == "fvecs" else "<i4")
                f.write(struct.pack("<i", len(v)) + v.tobytes())
        return _Written(part)

    def commit(self, messages) -> None:
        tmp = self.path + ".tmp"
        with open(tmp, "wb") as out:
            for m in messages:
                if m is not None:
                    with open(m.path, "rb") as f:
                        out.write(f.read())
                    os.remove(m.path)
            out.flush()
            os.fsync(out.fileno())
        os.replace(tmp, self.path)

    def abort(self, messages) -> None:
        for p in glob.glob(glob.escape(self.path) + ".part-*"):
            os.remove(p)


class _Vecs(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return "position bigint, vector array<float>" if self.kind == "fvecs" else "position bigint, vector array<int>"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("max")
        return _Reader(self.options["path"], self.kind, int(most) if most else None, int(self.options.get("per_task", "100000")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.kind)


class FvecsSource(_Vecs):
    kind = "fvecs"


class IvecsSource(_Vecs):
    kind = "ivecs"
