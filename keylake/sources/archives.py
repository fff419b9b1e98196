"""Tar archives: members are found by their headers and read in spans, so that one archive is the work of several tasks.

    read_members(spark, files)                                   # files (path, length) as binaryFile lists them
    spark.dataSource.register(TarFiles)
    df.write.format("tar_files").mode("append").option("path", folder).save()   # df (name, content)

A first pass over an archive reads its headers only, from each to the next; a second one reads the members, those of each
SPAN bytes of an archive together. Archives in the seekable form of zstd (.tar.zst whose last frame lists the sizes of all
others, as `tar_files` writes them) are read in spans as well, a frame of some FRAME bytes being held at a time. Other
compressed archives have no places to start from: they are streamed, a member at a time, by one task each, but never held
whole. Stores that neither Python nor pyarrow opens have their archives read whole by Spark.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from io import BytesIO
from urllib.parse import quote

import numpy as np
import pandas as pd
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SPAN = 32 << 20
#: A cell holds no more bytes than this.
LARGEST = (1 << 31) - 1 - 512
#: Bytes of members that a task hands on at once; a larger member goes alone.
BATCH = 16 << 20
ROWS = "path string, content binary, error string"
#: Plain bytes in a frame that is written, and the most of one that is read by its place; archives with larger ones are streamed.
FRAME, LARGEST_FRAME = 4 << 20, 64 << 20
#: Fixed values of the seekable form of zstd: the marks of the frame that lists the others, at its start and end.
LIST_START, LIST_END = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes taken for one of a zstd archive, where tasks are counted.
RATIO = 4
#: Schemes of paths in which Python can seek.
SEEKABLE = "^(file|hdfs|s3|s3a|gs|abfs|abfss):"


def located(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return FileSystem.from_uri("/" + (rest if colon else path).lstrip("/"))
    return FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@?=&"))


class Frames(io.RawIOBase):
    """The plain bytes of a file in the seekable form of zstd, from any place on; the frame last read is held."""

    def __init__(self, f, sizes: np.ndarray):
        self.f, self.at, self.held, self.frame = f, 0, b"", -1
        self.starts, self.ends = np.cumsum(sizes[:, 0]) - sizes[:, 0], np.cumsum(sizes[:, 1])
        self.sizes, self.length = sizes, int(sizes[:, 1].sum())

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def readinto(self, out) -> int:
        if self.at >= self.length:
            return 0
        frame = int(np.searchsorted(self.ends, self.at, side="right"))
        if frame != self.frame:
            self.f.seek(int(self.starts[frame]))
            packed, size = self.f.read(int(self.sizes[frame, 0])), int(self.sizes[frame, 1])
            self.held, self.frame = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size), frame
            if len(self.held) != size:
                raise tarfile.ReadError(f"frame {frame} has {len(self.held)} bytes in place of {size}")
        start = self.at - int(self.ends[frame] - self.sizes[frame, 1])
        got = self.held[start : start + len(out)]
        out[: len(got)] = got
        self.at += len(got)
        return len(got)


class FrameWriter:
    """Bytes written to a stream in the seekable form of zstd, each frame of at least FRAME bytes but for the last."""

    def __init__(self, stream, size: int = FRAME):
        self.stream, self.size, self.waiting, self.held, self.sizes = stream, size, [], 0, []

    def write(self, data: bytes) -> int:
        self.waiting.append(bytes(data))
        self.held += len(data)
        if self.held >= self.size:
            self._frame()
        return len(data)

    def _frame(self) -> None:
        plain = b"".join(self.waiting)
        for at in range(0, len(plain), LARGEST_FRAME):
            packed = zstandard.ZstdCompressor().compress(plain[at : at + LARGEST_FRAME])
            self.stream.write(packed)
            self.sizes.append((len(packed), len(plain[at : at + LARGEST_FRAME])))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self._frame()
        entries = np.array(self.sizes, "<u4").tobytes()
        self.stream.write(struct.pack("<II", LIST_START, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, LIST_END))
        self.stream.close()


def frame_sizes(f, length: int) -> np.ndarray | None:
    """Sizes in the file and plain of all frames (n, 2); null if the file does not list them or one is too large to hold."""
    if length < 17:
        return None
    f.seek(length - 9)
    n, flags, mark = struct.unpack("<IBI", f.read(9))
    width = 3 if flags & 128 else 2  # with checksums or without
    size = 4 * width * n
    if mark != LIST_END or size + 17 > length:
        return None
    f.seek(length - 9 - size)
    sizes = np.frombuffer(f.read(size), "<u4").reshape(n, width)[:, :2].astype(np.int64)
    return sizes if sizes[:, 0].sum() + size + 17 == length and sizes[:, 1].max(initial=0) <= LARGEST_FRAME else None


def _open(path: str, length: int):
    """(file, its plain bytes as a seekable file or null if it has none, their number)."""
    system, at = located(path)
    f = system.open_input_file(at)
    if not path.endswith(".zst"):
        return f, f, length
    sizes = frame_sizes(f, length)
    return (f, None, 0) if sizes is None else (f, io.BufferedReader(Frames(f, sizes), 1 << 16), int(sizes[:, 1].sum()))


def _failure(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _places(path: str, length: int) -> Iterator[tuple[str | None, int | None, int | None, str | None]]:
    """(name, offset of header, size, error) of an archive's files; an error ends them. All null: it can be streamed only."""
    try:
        raw, f, length = _open(path, length)
        with raw:
            if f is None:
                yield None, None, None, None
                return
            tar = tarfile.open(fileobj=f, mode="r:")
            while (m := tar.next()) is not None:
                tar.members.clear()  # headers of a large archive are not kept
                if m.isfile():
                    if (tar.offset if m.issparse() else m.offset_data + m.size) > length:
                        raise tarfile.ReadError("unexpected end of data")
                    yield m.name, m.offset, m.size, None
            f.seek(tar.offset)
            if f.read(tarfile.BLOCKSIZE).strip(b"\0"):
                raise tarfile.ReadError(f"no header at {tar.offset}")
    except Exception as e:  # of any kind: archives come from anywhere
        yield None, None, None, _failure(e)


def _stream(f, path: str) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, content, error) of an archive's files, one at a time, from first to last."""
    try:
        mode = "r|*"
        if path.endswith(".zst"):
            mode, f = "r|", zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
        with tarfile.open(fileobj=f, mode=mode) as tar:
            while (m := tar.next()) is not None:
                tar.members.clear()
                if m.isfile():
                    yield (m.name, None, f"{m.size} bytes are too many") if m.size > LARGEST else (m.name, tar.extractfile(m).read(), None)
    except Exception as e:
        yield None, None, _failure(e)


def _member(f, offset: int, size: int) -> tuple[bytes | None, str | None]:
    """(content, error) of the member whose header is at offset."""
    if size > LARGEST:
        return None, f"{size} bytes are too many"
    try:
        f.seek(offset)
        with tarfile.open(fileobj=f, mode="r:") as tar:
            return tar.extractfile(tar.next()).read(), None
    except Exception as e:
        return None, _failure(e)


def _batches(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Rows (path, content, error) in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"") + 256
        if size > BATCH:
            yield pd.DataFrame(held, columns=["path", "content", "error"], dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["path", "content", "error"], dtype=object)


def list_members(archives: DataFrame) -> DataFrame:
    """(path, length, name, offset, size, error) of the files in archives (path, length) that can be read from any place, by
    their headers; one row without name and error for each other one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["name", "offset", "size", "error"]
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                rows = []
                for row in _places(path, length):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names, dtype=object).assign(path=path, length=length)
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object).assign(path=path, length=length)

    return archives.select("path", "length").mapInPandas(work, "path string, length long, name string, offset long, size long, error string")


def _read_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        opened, raw, f = None, None, None
        try:
            for batch in batches:
                for path, length, name, offset, size, error in batch[["path", "length", "name", "offset", "size", "error"]].itertuples(index=False):
                    if error is not None:
                        yield path, None, error
                        continue
                    if name is None:
                        yield from _streamed(path)
                        continue
                    if path != opened:
                        if raw:
                            raw.close()
                        raw, f, _ = _open(path, int(length))
                        opened = path
                    content, error = _member(f, int(offset), int(size))
                    yield f"{path}!{name}", content, error
        finally:
            if raw:
                raw.close()

    yield from _batches(rows())


def _streamed(path: str) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of the members of one archive, from first to last."""
    system, at = located(path)
    with system.open_input_file(at) as f:
        for name, content, error in _stream(f, path):
            yield path if name is None else f"{path}!{name}", content, error


def _read_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _batches(row for batch in batches for path in batch["path"] for row in _streamed(path))


def _read_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for name, data, error in _stream(BytesIO(content), path):
                    yield path if name is None else f"{path}!{name}", data, error

    yield from _batches(rows())


def read_members(spark: SparkSession, files: DataFrame, span: int = SPAN) -> DataFrame:
    """(path, content, error) of the members of tar archives, which appear as path!member; files are binaryFile rows.

    An archive that breaks off, or is none, gives the members before that and a row with null content and the error. A member
    of more than LARGEST bytes has null content and an error. Equal names of one archive all stay.
    """
    seekable, plain = F.col("path").rlike(SEEKABLE), F.col("path").rlike(r"\.tar(\.zst)?$")
    archives, packed = files.where(seekable & plain), F.endswith("path", F.lit(".zst"))
    total = archives.agg(F.coalesce(F.sum(F.when(packed, F.col("length") * RATIO).otherwise(F.col("length"))), F.lit(0))).head()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // span))
    # a number of tasks is given, as their input, the members' places, is far smaller than what they read
    spans = list_members(archives).repartition(tasks, "path", F.floor(F.col("offset") / span)).sortWithinPartitions("path", "offset")
    read = spans.mapInPandas(_read_spans, ROWS).unionByName(files.where(seekable & ~plain).select("path").mapInPandas(_read_streams, ROWS))
    return read.unionByName(files.where(~seekable).select("path", "content").mapInPandas(_read_whole, ROWS))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _TarWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        names = [f.name for f in schema.fields]
        self.name, self.content = names.index("name"), names.index("content")
        self.folder, self.most = options["path"].rstrip("/"), int(options.get("bytes", 1 << 30))
        self.packed = {"none": False, "zstd": True}[options.get("compression", "none")]
        self.stage = f"{self.folder}/_stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        names, stream, tar, system = [], None, None, None

        def end() -> None:
            if tar:
                tar.close()
                stream.close()

        for row in iterator:
            if row[self.name] is None:
                continue
            if tar is None or tar.offset > self.most:
                end()
                names.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tar{'.zst' if self.packed else ''}")
                system, at = located(f"{self.stage}/{names[-1]}")
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                stream = system.open_output_stream(at, compression=None)
                stream = FrameWriter(stream) if self.packed else stream
                tar = tarfile.open(fileobj=stream, mode="w|")
            content = bytes(row[self.content] or b"")
            info = tarfile.TarInfo(row[self.name])
            info.size = len(content)
            tar.addfile(info, BytesIO(content))
        end()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = located(self.folder)
        _, stage = located(self.stage)
        system.create_dir(folder, recursive=True)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{stage}/{name}", f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Drop the stage, and with it what attempts that do not count have written."""
        system, stage = located(self.stage)
        system.create_dir(stage, recursive=True)
        system.delete_dir(stage)


class TarFiles(DataSource):
    """A folder of tar archives, to which a write adds: rows (name, content), at least one archive for each task that has rows.

    An archive ends once it holds more than `bytes` (1 GB unless given). With `compression` zstd it is in the seekable form. Rows with null name are not written, null content
    is an empty file, and equal names all stay. Archives appear when all tasks are done; those of lost attempts never do.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are added to a folder; use mode append")
        return _TarWriter(schema, dict(self.options))
