"""Column functions of the byte formats: sizes, checksums, little-endian integers, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(c: Column) -> Column:
    """Bytes of a string or binary column; null counts 0."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def checksum(c: Column) -> Column:
    """CRC-32 (IEEE)."""
    return F.crc32(c.cast("binary"))


def log_record_bytes(key: Column, value: Column) -> Column:
    """Bytes of a log record: op, two lengths, checksum and the payload."""
    return byte_length(key) + byte_length(value) + 9


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes of an entry of a sorted file: two lengths and the payload."""
    return byte_length(key) + byte_length(value) + 4


def little_endian(c: Column, width: int) -> Column:
    """The `width` low bytes of an integer, lowest first."""
    parts = [F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*parts))


def from_little_endian(c: Column, width: int) -> Column:
    """The unsigned integer in the first `width` bytes, at most 7."""
    parts = [F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10).cast("long") * (1 << (8 * i)) for i in range(width)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def log_record(op: Column, key: Column, value: Column) -> Column:
    """A log record as bytes: op (1 put, 0 delete), key, value, each with a 16-bit length, and the CRC-32."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    body = F.concat(little_endian(op, 1), little_endian(F.octet_length(key), 2), key, little_endian(F.octet_length(value), 2), value)
    return F.concat(body, little_endian(F.crc32(body), 4))


def sorted_entry(key: Column, value: Column) -> Column:
    """An entry of a sorted file as bytes; no value is a deletion."""
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(little_endian(F.octet_length(key), 2), key, little_endian(F.octet_length(value), 2), value)


def file_name(file_id: Column, suffix: str) -> Column:
    """Eight digits at least, and the suffix."""
    return F.concat(F.format_string("%08d", file_id), F.lit(suffix))


def file_id(name: Column) -> Column:
    """The id in a file name, 0 where there is none."""
    return F.coalesce(F.regexp_extract(name, r"([^/]*?)(\.[^/.]*)?$", 1).try_cast("long"), F.lit(0).cast("long"))


def entries_hint(data_len: Column) -> Column:
    """How many entries a file of these bytes may hold."""
    return F.floor(data_len / 32).cast("long")


def lossy_utf8(c: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))
