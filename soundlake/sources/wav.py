"""WAV files as a Spark data source, ``recordings``: files are read by ranges of frames and written by tasks that one commit publishes.

    spark.read.format("recordings").option("chunk", 65536).load(path)

Planning lists the folder and reads each file's header once; a long file becomes many input partitions, short files share one.
A task reads only its own bytes.  Short recordings may be packed: a ``.tar`` file of the folder is a shard whose members are whole WAV
files, so a million clips are a few hundred files and neither listing, commit nor planning grows with their number.  Paths are resolved by Spark's file systems on the driver, so one without a scheme means the
cluster's default file system; tasks reach it by the resolved address.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "recordings"
CHUNK_SCHEMA = ("session_id string, chunk_idx bigint, first_sample bigint, sample_rate int, "
                "left array<float>, right array<float>, error string")
CHUNK = 65_536
SPLIT_BYTES = 64 << 20
BATCH = 16  # chunks per Arrow batch
PACKED_BYTES = 1 << 20  # longer recordings are files of their own, also where short ones are packed
# Tags of the format.  "slpt" is this library's own chunk, which names the recording and position a file continues.
PCM, EXTENSIBLE, OWN_TAG = 1, 0xFFFE, b"slpt"


def resolved(spark: SparkSession, path: str) -> str:
    """The address of a path, with scheme and behind any mount table; what does not exist yet is resolved by its folder."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    at, rest = system.makeQualified(at), ""
    while not system.exists(at) and at.getParent() is not None:
        at, rest = at.getParent(), f"/{at.getName()}{rest}"
    return system.resolvePath(at).toString().rstrip("/") + rest


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = uri.partition(":")
    if not found:
        raise ValueError(f"{uri} has no scheme: resolve it on the driver first")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if not rest.startswith("//") else uri)


@dataclass
class Header:
    rate: int
    width: int
    channels: int
    data: int           # offset of the first frame
    frames: int
    session: str | None = None
    first: int = 0


def read_header(stream, length: int) -> Header:
    """Format, place of the samples and continuation of a PCM file; of a cut or endless data chunk what the file holds."""
    def at(offset, size):
        stream.seek(offset)
        return stream.read(size)
    head = at(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    offset, form, own, long_size = 12, None, (None, 0), None
    while offset + 8 <= length:
        tag, size = struct.unpack("<4sI", at(offset, 8))
        if tag == b"ds64":
            long_size = struct.unpack_from("<Q", at(offset + 8, 16), 8)[0]
        elif tag == b"fmt ":
            form = at(offset + 8, min(size, 40))
        elif tag == OWN_TAG:
            body = at(offset + 8, size)
            own = body[8:].decode(), struct.unpack_from("<q", body)[0]
        elif tag == b"data":
            if form is None or len(form) < 16:
                raise ValueError("no format before the samples")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
            if kind == EXTENSIBLE and len(form) >= 26:
                kind = struct.unpack_from("<H", form, 24)[0]
            if kind != PCM or bits not in (8, 16) or channels not in (1, 2):
                raise ValueError(f"unsupported PCM: format {kind}, {bits} bit, {channels} channels")
            if size == 0xFFFFFFFF:
                size = long_size if long_size is not None else length
            size = min(size, length - offset - 8)
            return Header(rate, bits // 8, channels, offset + 8, size // (channels * bits // 8), *own)
        offset += 8 + size + size % 2
    raise ValueError("no samples")


def decode(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Float [frames, channels] of whole frames."""
    if width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    else:
        values = np.frombuffer(raw, "<i2").astype(np.float32) / 32768.0
    return values.reshape(-1, channels)


@dataclass
class Spans(InputPartition):
    """Ranges of frames, each (session, path, header, from, to), files without a header, each (session, problem), and paths of shards."""
    ranges: list
    broken: list
    shards: list


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.float32)))


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self):
        system, base = opened(self.uri)
        files = [f for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.base_name.endswith((".wav", ".tar")) and not f.base_name.startswith("_")]
        shards = [f for f in files if f.base_name.endswith(".tar")]
        files = [f for f in files if f.base_name.endswith(".wav")]

        def header(file):
            try:
                with system.open_input_file(file.path) as stream:
                    return read_header(stream, file.size)
            except Exception as problem:
                return str(problem) or type(problem).__name__
        with ThreadPoolExecutor(32) as pool:
            headers = list(pool.map(header, files))
        found, held, size = [], Spans([], [], []), 0
        for file, head in sorted(zip(files, headers), key=lambda x: x[0].path):
            name = file.base_name.rsplit(".", 1)[0]
            if isinstance(head, str):
                held.broken.append((name, head))
                continue
            frame, session = head.width * head.channels, head.session or name
            # ranges end where chunks do
            step = max(1, self.split_bytes // frame // self.chunk) * self.chunk
            edges = [0, *range(step - head.first % self.chunk, head.frames, step), head.frames]
            for a, b in zip(edges, edges[1:]):
                if size and size + (b - a) * frame > self.split_bytes:
                    found.append(held)
                    held, size = Spans([], [], []), 0
                held.ranges.append((session, file.path, head, a, b))
                size += (b - a) * frame
        for file in sorted(shards, key=lambda x: x.path):
            if size and size + file.size > self.split_bytes:
                found.append(held)
                held, size = Spans([], [], []), 0
            held.shards.append(file.path)
            size += file.size
        return [*found, held] if held.ranges or held.broken or held.shards or not found else found

    def _members(self, stream) -> Iterator[tuple]:
        """Chunk rows of a shard's recordings."""
        none = np.zeros(0, np.float32)
        with tarfile.open(fileobj=stream, mode="r|") as shard:
            for member in shard:
                if not member.isfile() or not member.name.endswith(".wav"):
                    continue
                content, name = shard.extractfile(member).read(), member.name[:-4]
                try:
                    head = read_header(io.BytesIO(content), len(content))
                except Exception as problem:
                    yield name, 0, 0, none, none, str(problem) or type(problem).__name__
                    continue
                values = decode(content[head.data:head.data + head.frames * head.width * head.channels], head.width, head.channels)
                edges = [0, *range(self.chunk - head.first % self.chunk, head.frames, self.chunk), head.frames]
                for a, b in zip(edges, edges[1:]):
                    yield head.session or name, head.first + a, head.rate, values[a:b, 0], values[a:b, -1], None

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

        def batch(rows):
            session, first, rate, left, right, error = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(session, pa.string()), pa.array([x // self.chunk for x in first], pa.int64()), pa.array(first, pa.int64()),
                                               pa.array(rate, pa.int32()), _lists(left), _lists(right), pa.array(error, pa.string())], names=names)
        none = np.zeros(0, np.float32)
        if partition.broken:
            yield batch([(session, 0, 0, none, none, problem) for session, problem in partition.broken])
        system, _ = opened(self.uri)
        for session, path, head, a, b in partition.ranges:
            frame = head.width * head.channels
            edges = [a, *(x for x in range(a + self.chunk - (head.first + a) % self.chunk, b, self.chunk)), b]
            with system.open_input_file(path) as stream:
                for k in range(0, len(edges) - 1, BATCH):
                    some, rows = edges[k:k + BATCH + 1], []
                    stream.seek(head.data + some[0] * frame)
                    for x, y in zip(some, some[1:]):
                        values = decode(stream.read((y - x) * frame), head.width, head.channels)
                        rows.append((session, head.first + x, head.rate, values[:, 0], values[:, -1], None))
                    yield batch(rows)
        for path in partition.shards:
            with system.open_input_stream(path) as stream:
                rows, size = [], 0
                for row in self._members(stream):
                    rows.append(row)
                    size += len(row[3])
                    if len(rows) == 4096 or size >= BATCH * CHUNK:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list  # (path under the staging folder, final name)


def file_header(frames: int, rate: int, recording: str | None, first: int) -> bytes:
    """Stereo 16-bit header; beyond what 32 bits can say, the size stands in a chunk of its own."""
    own, size = b"", 4 * frames
    if recording is not None:
        name = recording.encode()
        own = struct.pack("<4sIq", OWN_TAG, 8 + len(name), first) + name + bytes(len(name) % 2)
    long = 36 + len(own) + size >= 1 << 32
    extra = struct.pack("<4sIQQQI", b"ds64", 28, 72 + len(own) + size, size, frames, 0) if long else b""
    return (struct.pack("<4sI4s", b"RF64" if long else b"RIFF", 0xFFFFFFFF if long else 36 + len(own) + size, b"WAVE") + extra
            + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, rate, rate * 4, 4, 16) + own + struct.pack("<4sI", b"data", 0xFFFFFFFF if long else size))


class RecordingWriter(DataSourceArrowWriter):
    """Rows file, position, frames (of the file), recording, left, right (16-bit lists), a file's rows together and in order.

    With ``packed``, recordings of up to ``PACKED_BYTES`` become members of shards of about ``SPLIT_BYTES``."""

    def __init__(self, options):
        self.uri, self.rate, self.packed = options["path"], int(options["rate"]), options.get("packed", "false").lower() == "true"
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, base = opened(self.uri)
        folder, done = f"{base}/{self.staging}", []
        system.create_dir(folder, recursive=True)
        current, stream, shard, sink = None, None, None, None

        def start(final):
            temporary = uuid.uuid4().hex
            done.append((temporary, final))
            return system.open_output_stream(f"{folder}/{temporary}")

        def finish():
            """The recording at hand is whole."""
            nonlocal shard, sink
            if not isinstance(stream, io.BytesIO):
                if stream is not None:
                    stream.close()
                return
            if shard is None:
                sink = start(f"shard-{uuid.uuid4().hex}.tar")
                shard = tarfile.open(fileobj=sink, mode="w|")
            member = tarfile.TarInfo(f"{current}.wav")
            member.size = stream.tell()
            stream.seek(0)
            shard.addfile(member, stream)
            if shard.offset >= SPLIT_BYTES:
                shard.close(), sink.close()
                shard = None
        for batch in iterator:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            names, counts, first, recording = (column[c].to_pylist() for c in ("file", "frames", "position", "recording"))
            for i, name in enumerate(names):
                if name != current:
                    finish()
                    stream, current = io.BytesIO() if self.packed and 4 * counts[i] <= PACKED_BYTES else start(f"{name}.wav"), name
                    stream.write(file_header(counts[i], self.rate, recording[i], first[i]))
                sides = [column[c][i].values.to_numpy() for c in ("left", "right")]
                stream.write(np.stack(sides, axis=1).astype("<i2").tobytes())
        finish()
        if shard is not None:
            shard.close(), sink.close()
        return Written(done)

    def commit(self, messages) -> None:
        """Only tasks that count are named here; what repeated tasks left goes with the staging folder."""
        system, base = opened(self.uri)
        system.create_dir(base, recursive=True)
        moves = [x for m in messages if m is not None for x in m.files]
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda x: system.move(f"{base}/{self.staging}/{x[0]}", f"{base}/{x[1]}"), moves))
        self._clear(system, base)

    def abort(self, messages) -> None:
        self._clear(*opened(self.uri))

    def _clear(self, system, base):
        if system.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.staging}")


class Recordings(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return CHUNK_SCHEMA

    def reader(self, schema):
        return RecordingReader(self.options)

    def writer(self, schema, overwrite):
        return RecordingWriter(self.options)
