"""The byte formats: log records and entries of sorted files, written and read.

A log record is op (1 byte: 1 put, 0 delete), key length (16 bits), key, value length (16 bits), value
and the CRC-32 of all before, integers little-endian. An entry of a sorted file is the same without op
and checksum; the file ends in a footer and the footer's length in 32 bits. Reading a log stops at the
first record that is cut off or damaged; an unknown op is an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.model import MAX_FIELD
from sedimenta.sources import remote
from sedimenta.sources.files import Files

PUT, DELETE = 1, 0


def record(op: int, key: bytes, value: bytes = b"") -> bytes:
    if max(len(key), len(value)) > MAX_FIELD:
        raise ValueError(f"keys and values have at most {MAX_FIELD} bytes")
    body = struct.pack("<BH", op, len(key)) + key + struct.pack("<H", len(value)) + value
    return body + struct.pack("<I", zlib.crc32(body))


def records(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(op, key, value) of the sound records at the head of a log."""
    at = 0
    while at + 9 <= len(raw):
        op, n = struct.unpack_from("<BH", raw, at)
        if at + 9 + n > len(raw):
            return
        (m,) = struct.unpack_from("<H", raw, at + 3 + n)
        end = at + 5 + n + m
        if end + 4 > len(raw) or zlib.crc32(raw[at:end]) != struct.unpack_from("<I", raw, end)[0]:
            return
        if op not in (PUT, DELETE):
            raise ValueError(f"unknown op {op} in a log")
        yield op, raw[at + 3 : at + 3 + n], raw[at + 5 + n : end]
        at = end + 4


def entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of the data part of a sorted file; an empty value is a deletion."""
    (footer,) = struct.unpack_from("<I", raw, len(raw) - 4)
    at, end = 0, len(raw) - 4 - footer
    while at < end:
        (n,) = struct.unpack_from("<H", raw, at)
        (m,) = struct.unpack_from("<H", raw, at + 2 + n)
        yield raw[at + 2 : at + 2 + n], raw[at + 4 + n : at + 4 + n + m]
        at += 4 + n + m


def sorted_file(rows: Iterable[tuple[bytes, bytes]], footer: bytes = b"") -> bytes:
    """The bytes of a sorted file of rows in key order, with an opaque footer."""
    out = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<H", len(v)) + v for k, v in rows)
    return out + footer + struct.pack("<I", len(footer))


def _read(spark: SparkSession, path: str, pattern: str, parse) -> DataFrame:
    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(parse(raw))
                yield pa.record_batch(
                    [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([None if r[2] else r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())],
                    ["file", "ord", "key", "value", "tomb"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(stem.alias("name"), "content").mapInArrow(run, "file string, ord long, key binary, value binary, tomb boolean")


def read_logs(spark: SparkSession, path: str, pattern: str = "*.wal") -> DataFrame:
    """(file, ord, key, value, tomb) of all log files of a folder, a task for each file or more."""
    return _read(spark, path, pattern, lambda raw: ((k, v, op == DELETE or not v) for op, k, v in records(raw)))


def read_sorted_files(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """(file, ord, key, value, tomb) of all sorted files of a folder."""
    return _read(spark, path, pattern, lambda raw: ((k, v, not v) for k, v in entries(raw)))


def write_files(rows: DataFrame, path: str, tail: bytes = b"") -> int:
    """Byte-format files of rows (file, ord, record): one for each name, its records in order and `tail` behind.
    Each is put together on an executor, so it must fit there, as a write buffer does, and written there if the
    executors reach the file system; else names and bytes pass the driver one partition at a time. A name that is
    taken by other bytes is an error. The number of files."""
    files, ordered = Files(rows.sparkSession, path), rows.select("file", "ord", F.col("record").cast("binary").alias("record")).repartition("file").sortWithinPartitions("file", "ord")
    whole = ordered.select("file", "record").mapInArrow(_whole_files(tail), "file string, content binary")
    uri = files.uri()
    if not remote.reaches(uri):
        n = 0
        for r in whole.toLocalIterator():
            if not files.create(r.file, bytes(r.content)):
                raise FileExistsError(r.file)
            n += 1
        return n
    files.mkdirs("")

    def put(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not remote.create(uri, name, content.as_buffer()):
                    raise FileExistsError(name)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return whole.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _whole_files(tail: bytes):
    """The bytes of each file, of sorted rows (file, record): one at a time, so that a task holds one."""

    def out(name: str, parts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([name], pa.string()), pa.array([b"".join([*parts, tail])], pa.binary())], ["file", "content"])

    def run(batches):
        held, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            ends = pc.run_end_encode(b.column(0)).run_ends.to_pylist()
            record = b.column(1)
            at = np.frombuffer(record.buffers()[1], np.int64 if pa.types.is_large_binary(record.type) else np.int32)[record.offset :]
            raw = memoryview(record.buffers()[2] or b"")
            for start, end in zip([0, *ends], ends):
                name = b.column(0)[start].as_py()
                if held not in (None, name):
                    yield out(held, parts)
                    parts = []
                held = name
                parts.append(bytes(raw[at[start] : at[end]]))
        if held is not None:
            yield out(held, parts)

    return run
